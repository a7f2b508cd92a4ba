"""The pipeline, stage by stage, against a brute-force version of each on the rows its predecessor kept."""

import collections
import hashlib
import math

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from cloakwork.llm import quality, queries

from test_operators import SPLIT, brute_language, brute_quality, words


def by_language(rows, items):
    found = brute_language([(r["lang"], r["text"]) for r in rows], [r["text"] for r in rows])
    return [r | {"lang": lang} for r, (lang, share) in zip(rows, found, strict=True) if lang != "und" and share >= 0.5]


def by_rules(rows, items):
    def rates(text):
        n, chars, symbols, dup, _ = brute_quality(text)
        lines = sum(1 for x in (text or "").split("\n") if SPLIT.search(x))
        return chars / n, symbols / n, dup / lines

    def bounds(values):
        out = []
        for column, (floor, low) in zip(zip(*values, strict=True), quality.MEASURES.values(), strict=True):
            s = sorted(column)
            q1, q3 = (s[math.ceil(q * len(s)) - 1] for q in (0.25, 0.75))
            reach = quality.REACH * max(q3 - q1, floor)
            out.append((q1 - reach if low else -math.inf, q3 + reach))
        return out

    rated = [(r, rates(r["text"])) for r in rows if SPLIT.search(r["text"] or "")]
    keys = (lambda r: (r["lang"], r["source"]), lambda r: r["lang"], lambda r: None)
    groups = []
    for key in keys:
        g = collections.defaultdict(list)
        for r, v in rated:
            g[key(r)].append(v)
        groups.append({k: (len(v), bounds(v)) for k, v in g.items()})
    kept = []
    for r, v in rated:
        n, *_, repeated = brute_quality(r["text"])
        found = [g[k(r)] for g, k in zip(groups, keys, strict=True)]
        limits = next((b for size, b in found[:2] if size >= quality.MIN_GROUP), found[2][1])
        if n >= 50 and 100 * repeated <= 50 * n and all(a <= x <= b for x, (a, b) in zip(v, limits, strict=True)):
            kept.append(r)
    return kept


def by_simhash(rows, items):
    def grams(text):
        w = words(text)
        return [" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []

    def fingerprint(text):
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams(text)]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fingerprint(r["text"]) for r in rows]
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for f in list(root):
        for g in list(root):
            x = f ^ g
            if f < g and x.bit_count() <= 6 and sum(x >> 8 * s & 255 == 0 for s in range(8)) >= 3:
                root[find(f)] = find(g)
    least = {}
    for r, f in zip(rows, fps, strict=True):
        if r["doc_id"] is not None:
            least[find(f)] = min(least.get(find(f), r["doc_id"]), r["doc_id"])
    return [r for r, f in zip(rows, fps, strict=True) if r["doc_id"] is None or r["doc_id"] == least[find(f)]]


def by_leaks(rows, items):
    def grams(text, n):
        w = SPLIT.findall((text or "").lower())
        return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}

    tests = []
    for text in items:
        n = min(5, len(SPLIT.findall((text or "").lower())))
        if n:
            tests.append((n, grams(text, n)))
    leaks = lambda r: any(len(own & grams(r["text"], n)) >= math.ceil(0.8 * len(own) - 1e-9) for n, own in tests)
    return [r for r in rows if r["doc_id"] is None or not leaks(r)]


BRUTE = [by_language, by_rules, by_simhash, by_leaks]


def as_bag(rows):
    return collections.Counter(repr(sorted(r.items())) for r in rows)


def follow(spark, docs, sf_dir, items):
    """Runs all stages as ``run`` does and checks each; returns what the last one gives."""
    columns = docs.columns
    for (name, stage), brute in zip(corpus_pipeline.STAGES, [*BRUTE, None], strict=True):
        before = [r.asDict() for r in docs.collect()]
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), name)
        if brute:
            assert docs.columns == columns
            assert as_bag(r.asDict() for r in docs.collect()) == as_bag(brute(before, items)), name
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
            expected = collections.Counter()
            for r in before:
                ids = t.encode(r["text"] or "", add_special_tokens=False).ids
                expected[r["doc_id"], len(ids), tuple(ids), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
            assert collections.Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in docs.collect()) == expected
    return docs


def test_stages_equal_brute_force(spark, sf):
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    last = follow(spark, docs, sf, items)
    assert 0 < last.count() < docs.count()
    whole = corpus_pipeline.run(spark, sf)
    assert whole.columns == last.columns
    assert sorted(map(tuple, whole.select("doc_id", "n_tokens", "decoded_sha256").collect())) == sorted(map(tuple, last.select("doc_id", "n_tokens", "decoded_sha256").collect()))


@pytest.fixture
def odd(spark, sf, tmp_path):
    """Nulls, empties, repeats, a very long text and columns named as the operators' own."""
    real = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()]
    texts = [None, "", " \n ", "12 34 ?!", "word", real[0]["text"], real[0]["text"], real[1]["text"] + " end", "Lorem ipsum dolor " * 8000, " ".join(real[k]["text"] for k in range(8)) * 3]
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in real]
    rows += [(1000 + k, t, None if k % 2 else "en", None if k % 3 else "src0", None) for k, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, real[3]["text"], "de", "web", 1), (None, None, None, None, None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, lang_pred string, n_words int, item_id string, component_id string, `fp` int, `key` int"
    docs = spark.createDataFrame([(*r, False, "und", 0, "i", "c", 1, 2) for r in rows], schema)
    items = [" ".join(real[4]["text"].split()[2:30]), None, "", "dolor lorem"]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, t, 1) for k, t in enumerate(items)], "item_id bigint, text string, doc_id int").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), items


def test_odd_rows(spark, odd):
    folder, items = odd
    follow(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder, items)


def test_empty_tables(spark, odd):
    docs = spark.read.parquet(f"{odd[0]}/documents.parquet").where(F.lit(False))
    assert follow(spark, docs, odd[0], odd[1]).count() == 0

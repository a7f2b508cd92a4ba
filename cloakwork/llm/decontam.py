"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Items and documents are sets of five-word shingles (lower-cased words).  An item of n
shingles leaks into a document that contains at least 0.8 n of them.  Items are
partitioned by size, by powers of two.  Each partition sets how many of an item's smallest
hashes make up its signature: SPARE times as many as its largest item may miss, and one.
The largest hash in a partition's signatures is its threshold: a document's signature for
the partition is all its hashes up to there, so it grows with the document, and a short
item is not lost in a long document as it would be under signatures of one size.

A document that leaks an item misses at most n - ceil(0.8 n) of its hashes, so of a
signature of k it holds k - (n - ceil(0.8 n)) or more.  Pairs that do are candidates: no
leak is lost.  They are verified by counting the item's distinct shingles found in the
document, string by string.

Items of fewer than five words are one shingle of all their words, looked up among the
document's shingles of that length.

All DataFrame functions.  Documents' shingles are never shuffled as long as the items'
shingles stay under BROADCAST_BYTES (summed first); beyond it a shuffled join is used.

Defined results: null, empty and wordless texts match nothing; rows with equal
ids count as one text that holds the shingles of each; null ids are never reported; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import native_words, stored

SHINGLE, THRESHOLD, SPARE = 5, 0.8, 2
#: Bytes of strings, and for each row besides, that are broadcast at most.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 64


def _shingles(words: str, n: int) -> Column:
    parts = ", ".join(f"{words}[i + {k}]" for k in range(n))
    return F.expr(f"transform(if(size({words}) >= {n}, sequence(0, size({words}) - {n}), cast(array() as array<int>)), i -> concat_ws(' ', {parts}))")


def _missing(n: Column) -> Column:
    """How many of n shingles a leak may miss."""
    return n - F.ceil(n * THRESHOLD - 1e-9).cast("int")


def item_shingles(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, words per shingle, shingle, h, n, part, need): the index, small next to the corpus.

    need: hits that make a candidate, for the shingles of the signature; null for the others.
    """
    words = items.select(F.col(id_col).alias("item_id"), native_words(F.lower(F.col(text_col))).alias("w")).where("item_id is not null and size(w) > 0")
    width = F.least(F.size("w"), F.lit(SHINGLE))
    sets = words.select("item_id", width.alias("width"), F.when(F.size("w") < SHINGLE, F.array(F.array_join("w", " "))).otherwise(_shingles("w", SHINGLE)).alias("s"))
    rows = sets.select("item_id", "width", F.explode("s").alias("shingle")).distinct()
    sets = rows.groupBy("item_id").agg(F.collect_list(F.struct(F.xxhash64("shingle").alias("h"), "shingle", "width")).alias("s"))
    n = F.size("s")
    part = F.floor(F.log2(n)).cast("int")
    k = F.least(n, SPARE * _missing(F.pow(F.lit(2), part + 1).cast("int") - 1) + 1)  # by the partition's largest size
    ranked = sets.select("item_id", n.alias("n"), part.alias("part"), k.alias("k"), F.posexplode(F.sort_array("s")).alias("rank", "e"))
    need = F.when(F.col("rank") < F.col("k"), F.col("k") - _missing(F.col("n")))
    return ranked.select("item_id", F.col("e.width").alias("width"), F.col("e.shingle").alias("shingle"), F.col("e.h").alias("h"), F.col("n").cast("bigint").alias("n"), "part", need.alias("need"))


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every leak."""
    index = stored(item_shingles(items, item_id, item_text), "benchmark_shingles")
    size = lambda df, *strings: df.agg(F.coalesce(F.sum(sum((F.octet_length(c) for c in strings), F.lit(ROW_BYTES))), F.lit(0))).first()[0]
    indexed = size(index, "shingle")
    small = lambda df, b: F.broadcast(df) if b <= BROADCAST_BYTES else df
    # At most SHINGLE widths, and a threshold for each of at most 32 partitions.
    parts = {(r["width"], r["part"]): r["top"] for r in index.where("need is not null").groupBy("width", "part").agg(F.max("h").alias("top")).collect()}
    widths = {w: max(t for (v, _), t in parts.items() if v == w) for w in sorted({w for w, _ in parts})} or {SHINGLE: 0}
    words = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), native_words(F.lower(F.col(text_col))).alias("w"))

    up_to = lambda hashes, top: F.filter(hashes, lambda h: h <= top)
    signed = F.concat(*(up_to(F.transform(_shingles("w", n), lambda s: F.xxhash64(s)), top) for n, top in widths.items()))
    signature = index.where("need is not null").select("item_id", "h", "need")
    hits = words.select("doc_id", F.explode(signed).alias("h")).join(small(signature, indexed), "h").distinct()
    candidates = stored(hits.groupBy("doc_id", "item_id", "need").count().where("count >= need").select("doc_id", "item_id"), "candidates")

    held = stored(candidates.groupBy("doc_id").agg(F.collect_set("item_id").alias("items")), "candidate_documents")
    shingles = F.concat(*(_shingles("w", n) for n in widths))
    by_shingle = index.groupBy("shingle").agg(F.collect_list(F.struct("item_id", "n")).alias("of"))
    if held.count() * ROW_BYTES + candidates.count() * 16 <= BROADCAST_BYTES:
        words = words.join(F.broadcast(held), "doc_id")
        found = words.select("doc_id", "items", F.explode(shingles).alias("shingle")).join(small(by_shingle, indexed), "shingle")
        found = found.select("doc_id", "shingle", F.explode(F.filter("of", lambda x: F.array_contains(F.col("items"), x["item_id"]))).alias("x")).select("doc_id", "shingle", "x.*")
    else:  # all documents' shingles are looked up again; no text is shuffled either way
        found = words.select("doc_id", F.explode(shingles).alias("shingle")).join(small(index.select("item_id", "shingle", "n"), indexed), "shingle").join(candidates, ["doc_id", "item_id"], "left_semi")
    counted = found.groupBy("doc_id", "item_id", "n").agg(F.count_distinct("shingle").alias("n_shared"))
    leaks = counted.where(F.col("n_shared") >= F.ceil(F.col("n") * THRESHOLD - 1e-9))
    return leaks.select(F.col("doc_id").alias(id_col), F.col("item_id"), "n_shared", F.col("n").alias("n_item"), (F.col("n_shared") / F.col("n")).alias("containment"))

"""The operators applied to whole tables, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, htmlmain, langid, lm, quality, simhash, tokencount, urlfilter, warc
from ._shared import fold

#: Rules and block list of the URL filter.
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
BLOCKED_HOSTS = tuple(f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file; TOKENIZERS_DIR names another folder."""
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        definition = f.read()
    return bpe.encode_decode(table(spark, sf_dir, "documents"), definition, outputs=("ids_sha256", "decoded_sha256"))


def url_index() -> bytes:
    kinds = {"allow": urlfilter.ALLOW, "block": urlfilter.BLOCK}
    return urlfilter.build([*((r, kinds[v]) for r, v in RULES.items()), *((f"{h}/", urlfilter.LISTED) for h in BLOCKED_HOSTS)])


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), url_index())


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), model)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    return langid.predict(docs, langid.learn(docs.where(~held_out)), F.col("doc_id"), held_out.alias("held_out")).drop("mixture")


def op5_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.extract(table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_index(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), F.col("doc_id")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 7) == 2
    return lm.score(docs, docs.where(~held_out), F.col("doc_id"), held_out.alias("held_out"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_urls, op3_tokens, op4_language, op5_text, op6_simhash, op7_leaks, op8_warc, op9_quality, op10_lm)}


_WORDS = "list_filter(string_split_regex({}, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')"


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the operators it can express."""
    fits = " ".join(f"WHEN {_fits(r)} THEN '{r}'" for r in sorted(RULES, key=len, reverse=True))
    listed = " OR ".join(f"host = '{h}' OR host LIKE '%.{h}'" for h in BLOCKED_HOSTS)
    verdicts = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in RULES.items())
    return {
        "op2_urls": f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM u),
r AS (SELECT *, CASE {fits} END AS rule FROM p)
SELECT page_id, host, path, rule, CASE {verdicts} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict FROM r""",
        "op7_leaks": _leaks("documents"),
        "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d),
k AS (SELECT *, payload_bytes >= 100 AND page_id > first AS revisit FROM f),
u AS (SELECT page_id, regexp_extract(lower(coalesce(url, '')), '^[^:]*://([^/?#]*)', 1) AS h, regexp_extract(lower(coalesce(url, '')), '^[^:]*://[^/?#]*([^#]*)', 1) AS rest FROM pages)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN first END AS refers_to,
       array_to_string(list_reverse(string_split(h, '.')), ',') || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END AS url_key,
       strftime(to_timestamp(1704067200 + page_id % 31536000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS ts
FROM k JOIN u USING (page_id)""",
    }


def _fits(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"(host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '/{path}')"


def _leaks(docs: str) -> str:
    """Shingles of both sides, for benchmarks whose items all have five words or more."""
    words = _WORDS.format("lower(coalesce(text, ''))")
    return f"""
WITH b AS (SELECT item_id, {words} AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
d AS (SELECT doc_id, {words} AS w FROM {docs}),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM m JOIN n USING (item_id) WHERE n_shared >= ceil(n_item * 0.8 - 1e-9)"""

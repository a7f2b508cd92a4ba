"""The training-data pipeline: each stage calls one operator on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm import bpe, decontam, langid, quality, simhash
from cloakwork.llm._shared import sized, stored
from cloakwork.llm.queries import table, tokenizer_file


def _whole(docs: DataFrame) -> Column:
    """A document's columns as one, so that their names cannot clash with those an operator adds."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc")


#: Least share of a document's largest language.
MIN_SHARE = 0.5
#: Near-duplicates: words a shingle, fingerprint bits that may differ for sure, and at most.
SHINGLE, TAU, RADIUS = 5, 5, 6


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one language makes up MIN_SHARE or more; its name becomes their ``lang``.

    Learns from all documents with a text and a language.  Texts without a letter, nulls among
    them, have no language and go, as do mixtures without a main language; repeated rows are
    judged alike; an empty table stays empty.
    """
    judged = langid.predict(docs, langid.learn(docs), _whole(docs)).where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SHARE))
    return judged.select(F.col("__doc").withField("lang", F.col("lang_pred")).alias("__doc")).select("__doc.*")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's thresholds.

    Null and empty texts fail the base rules; null languages and sources are groups of their
    own; repeated rows count as often as they stand; an empty table stays empty.
    """
    return quality.judge(docs, _whole(docs)).where("kept").select("__doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of smallest id.

    Rows of a null id are kept, as no id tells them apart; of repeated rows of the smallest id
    all are kept; other texts under the id of a duplicate stay, if they are none themselves.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text")).alias("__key")
    same = simhash.near_duplicates(docs.select(key, "text"), "__key", "text", SHINGLE, TAU, RADIUS)
    gone = stored(same.where("__key.doc_id <> component_id.doc_id").select("__key").distinct(), "duplicates")
    return docs.select(_whole(docs), key).join(sized(gone), "__key", "left_anti").select("__doc.*")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; rows of one id count as one text and go together; rows of a
    null id are not looked at and stay.
    """
    leaks = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    whole = docs.select(_whole(docs), "doc_id")
    return whole.join(stored(leaks, "leaks"), "doc_id", "left_anti").select("__doc.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids; null and empty texts have none, repeated rows give repeated results."""
    with open(tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        return bpe.encode_decode(docs, f.read(), outputs=("ids", "decoded_sha256"))


STAGES = [("language", language), ("quality", rules), ("near_duplicates", near_duplicates), ("decontamination", benchmark), ("bpe", tokens)]

#: Neither the language model nor the tokenizer can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs

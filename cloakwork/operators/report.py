"""Enrichment and summaries of findings.  Dimensions have one row per detector and are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import validators as v
from ..plans import dims


def enrich(found: DataFrame) -> DataFrame:
    """Add category, class, severity (default medium) and whether a checksum holds (null: none applies)."""
    joined = found.join(F.broadcast(dims.severity(found.sparkSession)), "id", "left")
    o = F.col("original")
    checked = F.when(F.col("id") == "national_id", v.emirates_id(o)).when(F.col("id").isin("uae_iban", "iban"), v.iban(o)).when(F.col("id") == "cc", v.luhn(v.digits(o)))
    return joined.withColumns({"severity": F.coalesce("severity", F.lit("medium")), "severity_rank": F.coalesce("severity_rank", F.lit(2)), "class": F.coalesce("class", F.lit("CREDENTIAL")), "checksum_verified": checked})


def by_category(found: DataFrame) -> DataFrame:
    """One row; categories without findings count zero."""
    cat = F.col("cat")
    return enrich(found).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(cat == c).alias(f"n_{c}") for c in ("id", "pii", "cred")))


def by_severity(found: DataFrame) -> DataFrame:
    return enrich(found).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def by_article(found: DataFrame) -> DataFrame:
    """Counts per article.  Counted per detector first, so the bridge meets a row per detector only."""
    counts = found.groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    return counts.join(F.broadcast(dims.articles(found.sparkSession)), "id").groupBy("article").agg(F.sum("k").alias("n"))


def top_articles(found: DataFrame, k: int = 5) -> DataFrame:
    return by_article(found).orderBy(F.desc("n"), "article").limit(k)


def rollup(found: DataFrame, source: str) -> DataFrame:
    """Counts per (source, category, severity) with subtotals."""
    return enrich(found).rollup(source, "cat", "severity").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("level"))


def observe(found: DataFrame, key: str) -> DataFrame:
    """Per resource and class: counts, detectors, highest severity, verified checksums.  Holds no values."""
    return enrich(found).groupBy(key, "class").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.sort_array(F.collect_set("id")), ",").alias("ids"),
        F.max("severity_rank").alias("severity_rank"),
        F.count_if(F.coalesce("checksum_verified", F.lit(False))).alias("verified"),
    )


def first_per_group(found: DataFrame, group: str, order: list[str], k: int = 30) -> DataFrame:
    """The first k findings of each group, for reports."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def redacted(found: DataFrame) -> DataFrame:
    """Findings without their values, as default outputs show them."""
    return found.withColumn("original_length", F.length("original").cast("bigint")).drop("original").withColumn("values_redacted", F.lit(True))

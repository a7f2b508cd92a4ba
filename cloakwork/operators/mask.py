"""Masking: redactions, tokens and synthetic values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans
from ..functions.fakes import fake_value
from ..registry import Detector, select
from ..session import materialize
from . import detect
from .rank import rank_within

MODES = ("typed", "redact", "fake")


def redact(df: DataFrame, text_col: str = "text", detectors: tuple[Detector, ...] | None = None, whitelist: tuple[str, ...] = (), out: str = "masked") -> DataFrame:
    """Replace every span by a constant, in place, without a shuffle."""
    found = detect.with_spans(df, text_col, detectors, whitelist, "__spans")
    edits = F.transform("__spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit("[REDACTED]").alias("r")))
    return found.withColumn(out, F.when(F.size("__spans") > 0, spans.splice(F.col(text_col), edits)).otherwise(F.col(text_col))).drop("__spans")


def dictionary(found: DataFrame, key: str, scope: str = "dataset") -> DataFrame:
    """Number each distinct original of each detector by first appearance.

    scope: ``dataset`` numbers over all rows, in the order of (key, start); ``document``
    starts anew in each row.  Only distinct values are shuffled, after partial aggregation.
    """
    if scope == "document":
        first = found.groupBy(key, "id", "original").agg(F.min("start").alias("first"))
        return rank_within(first, [key, "id"], ["first"]).drop("first")
    if scope != "dataset":
        raise ValueError(f"no such scope: {scope}")
    first = found.groupBy("id", "original").agg(F.min(F.struct(key, "start")).alias("first"))
    return rank_within(first, ["id"], ["first"]).drop("first")


def replacement(id: Column, n: Column, mode: str, ids: list[str]) -> Column:
    if mode == "redact":
        return F.lit("[REDACTED]")
    if mode == "typed":
        return F.concat(F.lit("["), F.upper(id), F.lit("_"), n.cast("string"), F.lit("]"))
    if mode == "fake":
        return reduce(lambda rest, i: F.when(id == i, fake_value(i, n)).otherwise(rest), ids, F.lit(None).cast("string"))
    raise ValueError(f"no such mode: {mode}")


def mask_rows(df: DataFrame, text_col: str = "text", mode: str = "typed", detectors: tuple[Detector, ...] | None = None, whitelist: tuple[str, ...] = (), min_confidence: str | None = None, allow: dict[str, Column] | None = None, out: str = "masked") -> DataFrame:
    """Document scope: each row numbers its own values by first appearance, in place, without a shuffle."""
    detectors = detectors or select()
    found = detect.with_spans(df, text_col, detectors, whitelist, "__spans", min_confidence, allow)
    ids = lambda all_: F.array_distinct(F.transform(all_, lambda x: x["id"]))
    values = lambda all_: F.transform(ids(all_), lambda i: F.struct(i.alias("id"), F.array_distinct(F.transform(F.filter(all_, lambda x: x["id"] == i), lambda x: x["m"])).alias("values")))
    number = lambda known, x: F.array_position(F.get(F.filter(known, lambda v: v["id"] == x["id"]), F.lit(0))["values"], x["m"])
    edit = lambda known, x: F.struct(x["s"].alias("s"), x["e"].alias("e"), replacement(x["id"], number(known, x), mode, [d.id for d in detectors]).alias("r"))
    edits = spans.bind(F.col("__spans"), lambda all_: spans.bind(values(all_), lambda known: F.transform(all_, lambda x: edit(known, x))))
    return found.withColumn(out, F.when(F.size("__spans") > 0, spans.splice(F.col(text_col), edits)).otherwise(F.col(text_col))).drop("__spans")


def mask(df: DataFrame, key: str, text_col: str = "text", mode: str = "typed", scope: str = "dataset", detectors: tuple[Detector, ...] | None = None, whitelist: tuple[str, ...] = (), values: DataFrame | None = None) -> DataFrame:
    """(key, text, masked).  ``key`` must be unique and gives the order of appearance.

    values: a dictionary from an earlier call, so that tokens are shared between tables.
    Findings are stored once, for the dictionary and for the edits.
    """
    detectors = detectors or select()
    if mode == "redact":
        return redact(df.select(key, text_col), text_col, detectors, whitelist)
    if scope == "document" and values is None:
        return mask_rows(df.select(key, text_col), text_col, mode, detectors, whitelist)
    found = materialize(detect.findings(df, key, text_col, detectors, whitelist), "findings")
    known = values if values is not None else materialize(dictionary(found, key, scope), "dictionary")
    on = [key, "id", "original"] if key in known.columns else ["id", "original"]
    named = found.join(known, on).withColumn("r", replacement(F.col("id"), F.col("n"), mode, [d.id for d in detectors]))
    edits = named.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("start").alias("s"), F.col("end").alias("e"), "r"))).alias("edits"))
    joined = df.select(key, text_col).join(edits, key, "left")
    return joined.select(key, text_col, F.when(F.col("edits").isNull(), F.col(text_col)).otherwise(spans.splice(F.col(text_col), F.col("edits"))).alias("masked"))


def mask_columns(df: DataFrame, columns: list[str], key: str, mode: str = "typed") -> DataFrame:
    """Mask several string columns of a table with tokens shared over all of them."""
    parts = df.select(key, F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c))))).alias("c", "text")).withColumn("cell", F.concat_ws("\x00", F.col(key).cast("string"), "c"))
    done = mask(parts.where(F.col("text").isNotNull()), "cell", "text", mode).join(parts.select("cell", key, "c"), "cell")
    wide = done.groupBy(key).pivot("c", columns).agg(F.first("masked"))
    return df.drop(*columns).join(wide, key, "left").select(df.columns)

"""Detection: texts to typed, non-overlapping spans."""

from __future__ import annotations

import functools
from functools import reduce

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, spans
from ..registry import ORDER, Detector, select

ELEMENT = "struct<s:int,e:int,ord:int,id:string,m:string,c:string>"
TEXT, LOWER, DIGIT, ALLOWED, NAMES = "__text", "__lower", "__digit", "__allowed", "__names"


def _has_digit(text: Column) -> Column:
    return text.rlike("[0-9]")


def _possible(text: Column, detector: Detector, lower: Column | None = None, digit: Column | None = None) -> Column:
    """Whether a text may hold a match, by what is cheapest first; lower, digit: where they are known already."""
    holds = lambda where, some: [reduce(Column.__or__, (where.contains(x) for x in some))] if some else []
    tests = [_has_digit(text) if digit is None else digit] if detector.digit else []
    tests += holds(text, detector.holds) + holds(F.lower(text) if lower is None else lower, detector.folded)
    tests += [text.rlike(detector.literal)] if detector.literal else []
    return reduce(Column.__and__, tests) if tests else F.lit(True)


def matches(text: Column, detector: Detector, found: Column | None = None) -> Column:
    """Confirmed matches of one detector; texts without its literal skip the pattern.

    Detectors without a pattern are those of names, found by a kernel; found: the matches
    where they are known already.
    """
    if detector.pattern is None:
        return F.coalesce(names.spans_of(text, kinds=(detector.id,))[detector.id] if found is None else found, F.array().cast(names.NAME_SPANS))
    if found is None:
        found = F.when(_possible(text, detector), spans.find_all(text, detector.pattern)).otherwise(F.array().cast(spans.SPAN))
    return F.filter(found, lambda x: detector.confirm(text, x["s"], x["m"])) if detector.confirm else found


def candidates(text: Column, detector: Detector, whitelist: tuple[str, ...] = (), min_confidence: str | None = None, placed: Column | None = None) -> Column:
    """Spans to replace: the value within each match where the detector names one.

    min_confidence: ``low``, ``medium`` or ``high``; drops names found with less.  Other
    detectors have no confidence and keep their matches.
    """
    named = detector.pattern is None

    def span(x: Column) -> Column:
        m = x["m"]
        value = detector.value(m) if detector.value else m
        tail = detector.tail(m) if detector.tail else F.lit(0)
        end = x["s"] + F.length(m) - tail
        confidence = x["confidence"] if named else F.lit(None).cast("string")
        return F.struct((end - F.length(value)).cast("int").alias("s"), end.cast("int").alias("e"), F.lit(ORDER.get(detector.id, len(ORDER))).alias("ord"), F.lit(detector.id).alias("id"), value.alias("m"), confidence.alias("c"))

    found = matches(text, detector, placed)
    if named and min_confidence:
        found = F.filter(found, lambda x: x["confidence"].isin(*names.CONFIDENCES[names.CONFIDENCES.index(min_confidence) :]))
    if whitelist:
        found = F.filter(found, lambda x: ~x["m"].isin(*whitelist))
    out = F.transform(found, span)
    return F.filter(out, lambda x: ~x["m"].isin(*whitelist)) if whitelist else out


@functools.lru_cache(maxsize=64)
def _candidates(jvm: int, detectors: tuple[Detector, ...], whitelist: tuple[str, ...], min_confidence: str | None) -> Column:
    """The candidates of all detectors, over TEXT, LOWER, DIGIT, ALLOWED and NAMES.

    Only detectors that match take part in what follows their patterns, so a row costs by
    its matches.  Expressions take seconds to build, so they are kept for as long as their JVM.
    """
    text = F.col(TEXT)
    allowed = lambda k: F.coalesce(F.get(F.col(ALLOWED), F.lit(k)), F.lit(True))
    rx = [(k, d) for k, d in enumerate(detectors) if d.pattern is not None]
    out = [F.when(allowed(k), candidates(text, d, whitelist, min_confidence, F.col(NAMES)[d.id])).otherwise(F.array().cast(f"array<{ELEMENT}>")) for k, d in enumerate(detectors) if d.pattern is None]
    if rx:
        pieces = F.array(*(F.struct(F.lit(k).alias("k"), F.when(allowed(k) & _possible(text, d, F.col(LOWER), F.col(DIGIT)), spans.pieces(text, d.pattern)).alias("p")) for k, d in rx))
        placed = F.transform(F.filter(pieces, lambda h: h["p"].isNotNull()), lambda h: F.struct(h["k"].alias("k"), spans.place(h["p"]).alias("found")))
        own = lambda h: reduce(lambda case, x: case.when(h["k"] == x[0], candidates(text, x[1], whitelist, min_confidence, h["found"])), rx[1:], F.when(h["k"] == rx[0][0], candidates(text, rx[0][1], whitelist, min_confidence, h["found"])))
        out.append(F.flatten(F.transform(placed, own)))
    return F.concat(*out) if len(out) > 1 else out[0]


def with_spans(df: DataFrame, text_col: str = "text", detectors: tuple[Detector, ...] | None = None, whitelist: tuple[str, ...] = (), out: str = "spans", min_confidence: str | None = None, allow: dict[str, Column] | None = None) -> DataFrame:
    """Add the resolved spans of all detectors.

    allow: detectors that run only on the rows where their condition holds.
    """
    detectors = detectors or select()
    rows = df.withColumn(TEXT, F.coalesce(F.col(text_col), F.lit("")))
    may = {d.id: F.coalesce(allow[d.id], F.lit(False)) if allow and d.id in allow else F.lit(True) for d in detectors}
    kinds = tuple(d.id for d in detectors if d.pattern is None)
    if kinds:
        rows = rows.withColumn(NAMES, names.spans_of(F.when(reduce(Column.__or__, (may[i] for i in kinds)), F.col(TEXT)), kinds=kinds))
    rows = rows.withColumns({LOWER: F.lower(TEXT), DIGIT: _has_digit(F.col(TEXT)), ALLOWED: F.array(*may.values()) if allow else F.lit(None).cast("array<boolean>")})
    found = rows.withColumn("__all", _candidates(id(SparkContext._gateway), detectors, whitelist, min_confidence)).drop(TEXT, NAMES, LOWER, DIGIT, ALLOWED)
    return found.withColumn(out, spans.resolve(F.col("__all"), ELEMENT)).drop("__all")


def findings(df: DataFrame, key: str, text_col: str = "text", detectors: tuple[Detector, ...] | None = None, whitelist: tuple[str, ...] = (), min_confidence: str | None = None) -> DataFrame:
    """One row per finding: key, id, start, end, line, original, confidence (null but for names).  No shuffle."""
    found = with_spans(df.select(key, F.coalesce(F.col(text_col), F.lit("")).alias(text_col)), text_col, detectors, whitelist, min_confidence=min_confidence)
    lines = spans.line_numbers(F.col(text_col), F.transform("spans", lambda x: x["s"]))
    # An outer explode: for an inner one, as for a filter on the spans, Spark would run all detectors twice.
    rows = found.select(key, F.explode_outer(F.arrays_zip(F.col("spans").alias("f"), lines.alias("line"))).alias("x")).where("x.f is not null")
    return rows.select(key, F.col("x.f.id"), F.col("x.f.s").alias("start"), F.col("x.f.e").alias("end"), F.col("x.line").alias("line"), F.col("x.f.m").alias("original"), F.col("x.f.c").alias("confidence"))

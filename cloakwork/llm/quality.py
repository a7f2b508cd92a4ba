"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document's measures are computed in place.  Per language and source, KLL sketches
of the measures give quartiles q1, q3; a document is an outlier if a measure lies above
q3 (or, for word length, also below q1) by more than REACH times the quartile distance,
which counts as FLOOR at least.  Sketches are built map-side and merged, so a group that
holds a third of all rows costs its tasks a sketch each.  Groups with fewer than
MIN_GROUP documents take the thresholds of their language, and small languages those of
all documents.  Thresholds (one row per group) join the measures; no text is shuffled.

All DataFrame functions.

Defined results: null text counts as empty; documents with fewer than 50 words or with
more than half their words in repeated three-word windows fail the base rules; null
languages and sources are groups of their own; documents without words have ratios 0
and fail the base; repeated rows count as often as they stand; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import native_words, stored

MIN_WORDS, MAX_REPEAT_PERCENT, MIN_GROUP, REACH, SKETCH_K = 50, 50, 20, 6.0, 200
#: Threshold rows that are broadcast at most; more are joined by a shuffle.
BROADCAST_GROUPS = 100_000
#: Measure: (least quartile distance, whether low values are outliers as well).
MEASURES = {"word_length": (0.35, True), "symbol_ratio": (0.02, False), "dup_line_ratio": (0.06, False)}
SYMBOLS = "#*$%&|<>"


def _repeat_words(w: str) -> Column:
    """Words covered by three-word windows that occur twice or more.

    Sorting (hash, position) puts equal windows side by side; from the sorted positions
    of repeated windows, each covers up to the next one, three words at most.
    """
    windows = f"sort_array(transform(if(size({w}) > 2, sequence(0, size({w}) - 3), cast(array() as array<int>)), i -> struct(xxhash64({w}[i], {w}[i + 1], {w}[i + 2]) as h, i as p)))"
    again = "transform(filter(s, (e, i) -> (i > 0 and s[i - 1].h = e.h) or (i < size(s) - 1 and s[i + 1].h = e.h)), e -> e.p)"
    covered = "aggregate(p, struct(cast(0 as bigint) as n, cast(-3 as int) as last), (a, x) -> struct(a.n + least(3, x - a.last) as n, x as last), a -> a.n)"
    with_s = f"transform(array({windows}), s -> {again})[0]"
    return F.expr(f"transform(array(sort_array({with_s})), p -> {covered})[0]")


def measure(df: DataFrame, *keep: Column, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = df.select(*keep, text.alias("__t"), native_words(text).alias("__w"), lines.alias("__l"))
    kept = [c for c in rows.columns if c not in ("__t", "__w", "__l")]
    return rows.select(
        *kept,
        F.size("__w").cast("bigint").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("bigint").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint").alias("n_dup_lines"),
        _repeat_words("__w").alias("n_repeat_words"),
        F.size("__l").cast("bigint").alias("n_lines"),
    )


def _with_ratios(measured: DataFrame) -> DataFrame:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return measured.withColumns({"word_length": per("word_chars", "n_words"), "symbol_ratio": per("n_symbols", "n_words"), "dup_line_ratio": per("n_dup_lines", "n_lines")})


def thresholds(rated: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: n and the bounds ``low_*``, ``high_*`` of each measure."""
    by = [F.col(k) for k in keys] or [F.lit(0).alias("__all")]  # a constant key: no row for an empty table
    sketches = rated.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.kll_sketch_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in MEASURES))
    quartile = lambda m, q: F.kll_sketch_get_quantile_double(m, F.lit(q))
    bounds = []
    for m, (floor, two_sided) in MEASURES.items():
        q1, q3 = quartile(m, 0.25), quartile(m, 0.75)
        reach = REACH * F.greatest(q3 - q1, F.lit(floor))
        bounds += [(q1 - reach if two_sided else F.lit(float("-inf"))).alias(f"low_{m}"), (q3 + reach).alias(f"high_{m}")]
    return sketches.select(*keys, "n", *bounds)


def judge(df: DataFrame, *keep: Column, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The columns ``keep``, the measures, ``base_failed`` and ``kept`` per row."""
    rated = _with_ratios(measure(df, *keep, F.col(lang_col).alias("__lang"), F.col(source_col).alias("__source"), text_col=text_col))
    n, r = F.col("n_words"), F.col("n_repeat_words")
    rated = stored(rated.withColumn("base_failed", (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)), "measures")
    worded = rated.where(n > 0)
    groups, langs, everything = (stored(thresholds(worded, keys), "thresholds") for keys in (["__lang", "__source"], ["__lang"], []))
    small = lambda t: F.broadcast(t) if t.count() <= BROADCAST_GROUPS else t
    joined = rated.join(small(_renamed(groups, "g")), F.col("__lang").eqNullSafe(F.col("g__lang")) & F.col("__source").eqNullSafe(F.col("g__source")), "left")
    joined = joined.join(small(_renamed(langs, "l")), F.col("__lang").eqNullSafe(F.col("l__lang")), "left").join(F.broadcast(_renamed(everything, "a")), F.lit(True), "left")
    outlier = F.lit(False)
    for m in MEASURES:
        pick = lambda side, m=m: F.when(F.col("gn") >= MIN_GROUP, F.col(f"g{side}_{m}")).when(F.col("ln") >= MIN_GROUP, F.col(f"l{side}_{m}")).otherwise(F.col(f"a{side}_{m}"))
        outlier = outlier | F.coalesce((F.col(m) < pick("low")) | (F.col(m) > pick("high")), F.lit(False))
    own = [c for c in rated.columns if c not in ("__lang", "__source")]
    return joined.select(*own, (~F.col("base_failed") & ~outlier).alias("kept"))


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{prefix}{c}") for c in df.columns))

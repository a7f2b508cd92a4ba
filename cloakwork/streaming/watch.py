"""Streams: per-key debounce, and findings per event."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import report
from ..operators.detect import findings

DEBOUNCE_MS = 500


def accept(times: list[int], last: int | None, gap: int) -> tuple[list[bool], int | None]:
    """Which of ascending times lie ``gap`` or more after the last accepted one."""
    out = []
    for t in times:
        ok = last is None or t - last >= gap
        out.append(ok)
        last = t if ok else last
    return out, last


def debounce(stream: DataFrame, key: str, time_ms: str, gap: int = DEBOUNCE_MS) -> DataFrame:
    """Streaming: drop events less than ``gap`` after their key's last accepted one."""
    kind = dict(stream.dtypes)[key]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        times = sorted(t for pdf in batches for t in pdf[time_ms])
        kept, last = accept(times, last, gap)
        state.update((last,))
        yield pd.DataFrame({key: [k[0]] * sum(kept), time_ms: [t for t, ok in zip(times, kept, strict=True) if ok]})

    return stream.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, `{time_ms}` bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)


def debounced(df: DataFrame, key: str, time_ms: str, gap: int = DEBOUNCE_MS) -> DataFrame:
    """Batch: the same rule.  A key's times are folded in order; only times are gathered."""
    times = df.groupBy(key).agg(F.sort_array(F.collect_list(time_ms)).alias("t"))
    empty = F.struct(F.array().cast("array<bigint>").alias("kept"), F.lit(None).cast("bigint").alias("last"))
    fold = F.aggregate("t", empty, lambda a, t: F.when(a["last"].isNull() | (t - a["last"] >= gap), F.struct(F.concat(a["kept"], F.array(t)).alias("kept"), t.alias("last"))).otherwise(a), lambda a: a["kept"])
    return times.select(key, F.explode(fold).alias(time_ms))


def scan_events(stream: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Value-free findings of each streamed text, with severity; works on streams and tables."""
    return report.redacted(report.enrich(findings(stream, key, text_col)))

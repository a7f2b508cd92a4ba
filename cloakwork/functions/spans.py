"""Span algebra as Column expressions.

A span array holds ``struct<s: int, m: string>`` (0-based start in code points and the
match) or, for candidates of several detectors, ``struct<s, e, ord, id, m, c>``.

Spark has no running sums over arrays, and growing an array by one element copies it.
So folds run over blocks of BLOCK elements: the work stays near linear in the matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<s:int,m:string>>"
BLOCK = 128


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(size: Column) -> Column:
    return F.when(size > 0, F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))


def running(sizes: Column) -> Column:
    """Sums of the elements before each one; sizes: a bound array<int>."""
    grow = lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v))
    part = lambda b: F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK))
    totals = F.transform(_blocks(F.size(sizes)), lambda b: F.aggregate(part(b), F.lit(0), lambda a, v: a + v))
    heads = F.aggregate(totals, F.array(F.lit(0)), grow)
    sums = lambda h: F.transform(_blocks(F.size(sizes)), lambda b: F.aggregate(part(b), F.array(F.get(h, b)), grow, lambda a: F.slice(a, F.lit(1), F.size(a) - 1)))
    return F.flatten(bind(heads, sums))


def pieces(text: Column, rx: str) -> Column:
    """struct<gaps: lengths between matches, found: matches>; null where nothing matches."""
    gaps = F.transform(F.split(text, F.lit(rx), -1), F.length)
    return bind(F.regexp_extract_all(text, F.lit(rx), F.lit(0)), lambda found: F.when(F.size(found) > 0, F.struct(gaps.alias("gaps"), found.alias("found"))))


def place(p: Column) -> Column:
    """The spans of ``pieces``: starts are running sums of gaps and matches."""
    sizes = F.transform(p["found"], lambda m, i: F.get(p["gaps"], i) + F.length(m))
    rows = lambda at: F.transform(p["found"], lambda m, i: F.struct((F.get(at, i) + F.get(p["gaps"], i)).alias("s"), m.alias("m")))
    one = F.array(F.struct(F.get(p["gaps"], F.lit(0)).alias("s"), F.get(p["found"], F.lit(0)).alias("m")))
    return F.when(p.isNull(), F.array().cast(SPAN)).when(F.size(p["found"]) == 1, one).otherwise(bind(bind(sizes, running), rows))


def find_all(text: Column, rx: str) -> Column:
    """All matches with their offsets."""
    return bind(pieces(text, rx), place)


def line_numbers(text: Column, starts: Column) -> Column:
    """The line of each start, from 1; starts: ascending.  Each block of them counts in its own part of the text."""
    newlines = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))

    def numbers(all_: Column) -> Column:
        a = lambda b: F.when(b == 0, 0).otherwise(F.get(all_, b * BLOCK))
        own = lambda b: F.substring(text, a(b) + 1, F.coalesce(F.get(all_, (b + 1) * BLOCK), F.get(all_, F.size(all_) - 1)) - a(b))
        ahead = bind(F.transform(_blocks(F.size(all_)), lambda b: newlines(own(b)).cast("int")), running)
        part = lambda h, b: bind(own(b), lambda t: F.transform(F.slice(all_, b * BLOCK + 1, F.lit(BLOCK)), lambda s: (F.get(h, b) + newlines(F.substring(t, F.lit(1), s - a(b))) + 1).cast("int")))
        return F.flatten(bind(ahead, lambda h: F.transform(_blocks(F.size(all_)), lambda b: part(h, b))))

    return F.when(text.contains("\n"), bind(starts, numbers)).otherwise(F.transform(starts, lambda s: F.lit(1)))


def before(text: Column, start: Column, size: int) -> Column:
    """Up to ``size`` characters before a position."""
    a = F.greatest(start - size, F.lit(0))
    return F.substring(text, a + 1, start - a)


def line_before(text: Column, start: Column, size: int | None = None) -> Column:
    """Up to ``size`` characters before a position, on its line; by default all of them."""
    return F.substring_index(before(text, start, size) if size else F.substring(text, F.lit(1), start), "\n", -1)


def after(text: Column, end: Column, size: int) -> Column:
    return F.substring(text, end + 1, F.lit(size))


def line_after(text: Column, end: Column) -> Column:
    return F.substring_index(F.substring(text, end + 1, F.length(text)), "\n", 1)


def resolve(spans: Column, kind: str) -> Column:
    """Greedy non-overlapping choice: by start, longer first, then detector order.

    kind: the array's element type, ``struct<s, e, ord, ...>``.  Spans are folded in blocks;
    a block starts behind the last span kept so far.
    """
    ordered = F.array_sort(
        spans,
        lambda a, b: F.when(a["s"] != b["s"], F.when(a["s"] < b["s"], -1).otherwise(1)).when(a["e"] != b["e"], F.when(a["e"] > b["e"], -1).otherwise(1)).when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0),
    )
    none = F.array().cast(f"array<{kind}>")
    state = lambda kept, last: F.struct(kept.alias("kept"), last.alias("last"))
    keep = lambda a, x: F.when(x["s"] >= a["last"], state(F.concat(a["kept"], F.array(x)), x["e"])).otherwise(a)

    def fold(all_: Column) -> Column:
        part = lambda b: F.slice(all_, b * BLOCK + 1, F.lit(BLOCK))
        small = F.aggregate(all_, state(none, F.lit(0)), keep, lambda a: a["kept"])
        blocks = lambda a, b: bind(F.aggregate(part(b), state(none, a["last"]), keep), lambda new: F.struct(F.concat(a["kept"], F.array(new["kept"])).alias("kept"), new["last"].alias("last")))
        large = F.flatten(F.aggregate(_blocks(F.size(all_)), F.struct(F.array().cast(f"array<array<{kind}>>").alias("kept"), F.lit(0).alias("last")), blocks, lambda a: a["kept"]))
        return F.when(F.size(all_) <= BLOCK, small).otherwise(large)

    return F.when(F.size(spans) < 2, spans).otherwise(bind(ordered, fold))


def splice(text: Column, edits: Column) -> Column:
    """Replace disjoint spans, sorted by start; edits: array<struct<s, e, r>>.

    Each block of edits gets its own part of the text, so no edit copies or scans the whole.
    """
    start = lambda all_, b: F.when(b == 0, 0).otherwise(F.get(all_, b * BLOCK)["s"])

    def parts(all_: Column) -> Column:
        def part(b: Column) -> Column:
            mine, a = F.slice(all_, b * BLOCK + 1, F.lit(BLOCK)), start(all_, b)
            end = F.coalesce(F.get(all_, (b + 1) * BLOCK)["s"], F.length(text))
            empty = F.struct(F.lit("").alias("out"), a.cast("int").alias("at"))

            def replaced(own: Column) -> Column:
                cut = lambda i, j: F.substring(own, i - a + 1, j - i)
                step = lambda s, x: F.struct(F.concat(s["out"], cut(s["at"], x["s"]), x["r"]).alias("out"), x["e"].alias("at"))
                return F.aggregate(mine, empty, step, lambda s: F.concat(s["out"], cut(s["at"], end)))

            return bind(F.substring(text, a + 1, end - a), replaced)

        return F.array_join(F.transform(_blocks(F.size(all_)), part), "")

    return F.when(F.size(edits) > 0, bind(edits, parts)).otherwise(text)

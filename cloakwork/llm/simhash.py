"""SimHash near-duplicates with pigeonring filtering.

Fingerprint: the majority of each bit over the XXH64 values of a text's word shingles.
Two fingerprints link at TAU = 3 or fewer differing bits.

Pigeonring: eight segments of eight bits stand in a ring.  If all segments together
differ in at most 3 bits, then from some segment on, every chain of k consecutive
segments differs in at most floor(3k/8) bits: 0, 0, 1, 1, 1, 2, 2, 3 for k = 1..8.  So
from some start, two segments are equal and the next three differ in one bit at most,
hence two of those three are equal as well: 8 starts x 3 choices give 24 equality keys
of 32 bits, and no link is missed.  Pairs that share a key must pass the whole chain of
budgets before the full Hamming check.

Other budgets work alike (5 bits: 56 keys of 24 bits), and links can be verified by the
exact similarity of shingle sets.

Equal fingerprints collapse first, so copies never become pairs, however many there are.
Sides of joins are broadcast only if they are small by their number of rows: Spark does not
see that a fingerprint has dozens of keys, and the driver would hold them all.
Links are made between different fingerprints only, and only as many as their connected
components need; smallest ids then spread over these.

Defined results: null or wordless text has fingerprint zero and links like any other;
repeated rows (and rows of a null id) keep their number; a row of a null id links other
rows like any other, but is never the smallest: only where all ids of a component are null
is its component_id null; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import ascii_words, sized, small_batches, stored

TAU, SEGMENTS, SHINGLE, SEED = 3, 8, 3, 42
#: Representatives' keys that are broadcast at most (24 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: How much wider each round of verification is than the one before.
GROWTH = 16
#: Shingles hashed and counted at once, which bounds memory on long texts.
BLOCK = 65_536


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, repeats included, at most BLOCK at once; nothing for a text without words."""
    words, digest = ascii_words(text), xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    for at in range(0, n if words else 0, BLOCK):
        part = words[at : min(at + BLOCK, n) + shingle - 1]
        rows = zip(*(part[k:] for k in range(shingle)), strict=False) if len(part) >= shingle else [part]
        yield np.array([digest(x, SEED) for x in map(b" ".join, rows)], "<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, shingle):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp bigint, digest) per row; fp holds the unsigned fingerprint's bits, digest tells texts apart."""
    small_batches(df.sparkSession)
    rows = df.select(id_col, text_col, F.xxhash64(text_col).alias("digest"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], [id_col, "fp", "digest"])

    return rows.mapInArrow(hashed, f"`{id_col}` {dict(rows.dtypes)[id_col]}, fp bigint, digest bigint")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(tau: int) -> list[int]:
    """Bit masks of the sets of equal segments that a chain within the budgets must hold.

    Of a chain of k segments at most floor(tau k / SEGMENTS) differ, and its d-th differing
    one stands where the budget is d or more.  The shortest chain that leaves four segments
    (three, where no chain leaves four) equal is used, at each start of the ring.
    """
    budget = [tau * k // SEGMENTS for k in range(SEGMENTS + 1)]
    most = min(4, max(k - budget[k] for k in range(SEGMENTS + 1)))
    k = next(k for k in range(1, SEGMENTS + 1) if k - budget[k] == most)
    loose = [w for w in combinations(range(1, k + 1), budget[k]) if all(budget[p] >= d for d, p in enumerate(w, 1))]
    equal = {frozenset((start + p) % SEGMENTS for p in range(1, k + 1) if p not in w) for start in range(SEGMENTS) for w in loose}
    return sorted(sum(0xFF << 8 * s for s in e) for e in equal)


def _ring(x: Column, tau: int) -> Column:
    """Whether from some segment on every chain of differences of ``x`` keeps its budget.  Lambdas keep the plan small."""
    segments = F.sequence(F.lit(0), F.lit(SEGMENTS - 1))
    differing = F.transform(segments, lambda s: F.bit_count(F.call_function("shiftrightunsigned", x, s * 8).bitwiseAND(F.lit(255))))
    more = lambda d, i: lambda a, j: F.struct((a["sum"] + F.get(d, (i + j) % SEGMENTS)).alias("sum"), (a["kept"] & (a["sum"] + F.get(d, (i + j) % SEGMENTS) <= F.floor(tau * (j + 1) / SEGMENTS))).alias("kept"))
    chain = lambda d, i: F.aggregate(segments, F.struct(F.lit(0).alias("sum"), F.lit(True).alias("kept")), more(d, i), lambda a: a["kept"])
    return F.get(F.transform(F.array(differing), lambda d: F.exists(segments, lambda i: chain(d, i))), F.lit(0))


def _key_masks(tau: int) -> Column:
    return F.array(*(F.lit(_signed(m)) for m in _masks(tau)))


def _near(a: Column, b: Column, radius: int) -> Column:
    """The whole chain of budgets, then the full Hamming check."""
    x = a.bitwiseXOR(b)
    return _ring(x, radius) & (F.bit_count(x) <= radius)


def roots(fps: DataFrame, tau: int = TAU, radius: int | None = None, sets: Callable[[DataFrame], DataFrame] | None = None, similarity: float = 0.0) -> DataFrame:
    """(fp, root): for each fingerprint that is linked, one of its connected component.

    All pairs at most tau bits apart link; with a ``radius`` above tau also pairs up to it as
    far as they share one of tau's keys.  sets: gives the shingle sets of the fingerprints of
    a table (fp), by which pairs are verified.

    First, each fingerprint is compared with the smallest (largest) near one among those that
    are the smallest (largest) under a key of its own.  After that, only fingerprints of different components
    are paired, and components are joined as wholes: a ball of n near fingerprints makes
    about n pairs, and no component is lost.
    """
    radius = radius or tau
    keyed = fps.select("fp", F.posexplode(F.transform(_key_masks(tau), lambda m: F.col("fp").bitwiseAND(m))).alias("mask", "value"))
    shared = keyed.groupBy("mask", "value").agg(F.min("fp").alias("hub"), F.max("fp").alias("last")).where("hub < last")
    members = stored(keyed.join(shared.hint("merge"), ["mask", "value"]), "shared_keys")
    low = members.where((F.col("fp") > F.col("hub")) & _near(F.col("hub"), F.col("fp"), radius)).groupBy("fp").agg(F.min("hub").alias("a")).select("a", F.col("fp").alias("b"))
    high = members.where((F.col("fp") < F.col("last")) & _near(F.col("fp"), F.col("last"), radius)).groupBy("fp").agg(F.max("last").alias("b")).select(F.col("fp").alias("a"), "b")
    star = low.union(high).distinct()
    if sets:
        star = stored(star, "star_pairs")
        star = alike(star, sets(_ends(star)), similarity).where("alike").select("a", "b")
    first = stored(_joined(star), "first_components")
    named = stored(members.drop("hub", "last").join(sized(first), "fp", "left").withColumn("of", F.coalesce("root", "fp")).drop("root"), "shared_keys")
    mixed = stored(named.groupBy("mask", "value").agg(F.min("of").alias("low"), F.max("of").alias("high")).where("low < high").select("mask", "value"), "mixed_keys")
    left = stored(named.join(sized(mixed), ["mask", "value"], "left_semi").withColumnsRenamed({"fp": "a", "of": "of_a"}), "mixed_members")
    right = left.select("mask", "value", F.col("a").alias("b"), F.col("of_a").alias("of_b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    once = F.array_position(F.transform(_key_masks(tau), lambda m: x.bitwiseAND(m) == 0), True) == F.col("mask") + 1  # at a pair's first key only
    cross = left.join(sized(right), ["mask", "value"]).where((F.col("a") < F.col("b")) & (F.col("of_a") != F.col("of_b")) & _near(F.col("a"), F.col("b"), radius) & once)
    cross = stored(cross.select("a", "b", "of_a", "of_b").distinct(), "cross_pairs")
    wholes = verified(cross, sets(_ends(cross)), similarity) if sets else _joined(cross.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct())
    wholes = stored(wholes, "joined_components")
    linked, joined = first.count(), wholes.count()
    members_of = first.select("fp", F.col("root").alias("of")).union(wholes.join(sized(first.select("fp"), linked), "fp", "left_anti").select("fp", F.col("fp").alias("of")))
    rooted = members_of.join(sized(wholes.withColumnRenamed("fp", "of"), joined), "of", "left").select("fp", F.coalesce("root", "of").alias("root"))
    return sized(rooted, linked + joined)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()


def _joined(pairs: DataFrame) -> DataFrame:
    """(fp, root) of all ends of the pairs (a, b)."""
    return components(_ends(pairs).withColumn("id", F.col("fp")), pairs).withColumnRenamed("component_id", "root")


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs with whether their shingle sets have at least that Jaccard similarity; both: what the sets share."""
    left, right = sets.select(F.col("fp").alias("a"), F.col("s").alias("sa")), sets.select(F.col("fp").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    enough = both >= F.lit(similarity) * (F.size("sa") + F.size("sb") - both)
    return pairs.join(left, "a").join(right, "b").select(*pairs.columns, enough.alias("alike"))


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(fp, s): the distinct hashes of each text's shingles, sorted.  texts: (fp, text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.concatenate([np.zeros(0, "<u8"), *shingle_hashes(t, shingle)])).view(np.int64) for t in batch.column(1).to_pylist()]
            cuts = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([np.zeros(0, np.int64), *found])))], ["fp", "s"])

    return texts.mapInArrow(sets, "fp bigint, s array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(fp, root) of the components that similar pairs join.  pairs: (a, b, of_a, of_b), with the components they lie in.

    In each round, each node is compared with its smallest open partners: one at first, then
    GROWTH times as many.  Pairs compared, and pairs whose components are joined already, are
    closed, so nothing differs from what comparing all pairs gives.
    """
    done: DataFrame | None = None
    width = 1
    while True:
        rank = F.row_number().over(Window.partitionBy("b").orderBy("a"))
        tested = stored(alike(pairs.withColumn("rank", rank).where(F.col("rank") <= width).drop("rank"), sets, similarity), "compared")
        new = tested.where("alike").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct()
        done = new if done is None else stored(done.union(new), "joins")
        labels = stored(_joined(done), "labels")
        rest = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        for end in ("of_a", "of_b"):
            named = labels.select(F.col("fp").alias(end), F.col("root").alias(f"root_{end}"))
            rest = rest.join(named, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
        pairs = stored(rest.where("root_of_a <> root_of_b").select("a", "b", "of_a", "of_b"), "open_pairs")
        if not pairs.limit(1).count():
            return labels
        width *= GROWTH


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(fp, component_id): the smallest ``id`` of each linked node's connected component.

    nodes: (fp, id).  A label is (id, fp) of some node.  Labels spread along links, and
    pointer jumping (the label of a label's own node) shortens long chains, until nothing
    changes.  Only linked nodes take part; each round is a written table.
    """
    both = pairs.select(F.col("a").alias("fp"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("fp"), F.col("a").alias("other")))
    both = stored(both, "links")
    ends = stored(both.select("fp").distinct(), "ends")
    n = ends.count()
    linked = stored(sized(ends, n).join(nodes, "fp").select("fp", F.struct("id", "fp").alias("label")), "labels")
    while True:
        heard = both.join(sized(linked.select(F.col("fp").alias("other"), "label"), n), "other").groupBy("fp").agg(F.min("label").alias("heard"))
        spread = sized(linked, n).join(heard, "fp").select("fp", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        owner = linked.select(F.col("fp").alias("at"), F.col("label").alias("owner"))
        jumped = stored(spread.join(sized(owner, n), F.col("label.fp") == F.col("at")).select("fp", "old", F.least("label", "owner").alias("label")), "labels")
        linked = jumped.select("fp", "label")
        if not jumped.where(F.col("label") < F.col("old")).limit(1).count():
            return linked.select("fp", F.col("label.id").alias("component_id"))


def named_components(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """(fp, component_id): the smallest id of each component; nodes: (fp, id), null ids coming last.  of: as ``roots`` gives it."""
    rooted = stored(nodes.select("fp", "id").join(of, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return rooted.join(sized(least, rooted.count()), "root").select("fp", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, tau: int = TAU, radius: int | None = None, similarity: float | None = None) -> DataFrame:
    """Per row: id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable.

    similarity: least Jaccard similarity of the shingle sets of linked texts; each fingerprint
    is represented by the text of its smallest id.  None links by fingerprints alone.
    """
    rows = stored(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "digest")).alias("least")).select("fp", F.col("least.id").alias("id"), F.col("least.digest").alias("digest"))
    sets = None
    if similarity:
        nodes = stored(nodes, "nodes")

        def sets(fps: DataFrame) -> DataFrame:
            wanted = stored(fps.join(nodes, "fp"), "represented")
            small = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
            texts = df.select(F.col(id_col).alias("own"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("d")).join(small, (F.col("d") == F.col("digest")) & F.col("own").eqNullSafe(F.col("id")))
            return stored(shingle_sets(texts.select("fp", "text"), shingle).dropDuplicates(["fp"]), "shingle_sets")

    of = roots(nodes.select("fp"), tau, radius, sets, similarity or 0.0)
    named = named_components(nodes, of)
    named = stored(named, "component_ids")  # a plain table on this side lets Spark split the hot partitions of the other
    return rows.join(sized(named), "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

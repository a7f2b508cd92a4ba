"""Language-model scoring: a log-bilinear neural model, trained in numpy by noise contrast.

All statistics cover every learning document.  Token counts give the unigram base and the
vocabulary: each token with 2^-FREQUENT_BITS of all learning tokens or more has a vector
of its own, so the vocabulary grows with the corpus up to 2^FREQUENT_BITS tokens; rarer
ones share the vector of a bucket, by their last two bytes.

A target w after the tokens v, u (u last) scores ``q . t_w + log p_w``, with the context
``q = r_class(u) + s_class'(v)`` and the unigram share p_w.  Training is by noise-contrastive
estimation over every position of the corpus: NOISE samples from p for each SHARED
positions, which makes the odds of data against noise ``exp(q . t_w) / NOISE``.  Context
classes start as the most frequent tokens and the buckets; after the first pass, tokens are
clustered by their vectors, and a second pass learns with these clusters as classes.  Each
task learns from its own documents from the same start; changes are averaged by how often
each row was touched.

As contexts are LAST x BEFORE pairs of classes, scores are normalised exactly: a batched
matrix product per class v sums over all targets.  A rare token's probability is its
bucket's times its share there, with one count added for each type and for all unseen ones.

Tokens of the vocabulary go to all workers; counts of the others are joined by a shuffle,
in which no key holds more than 2^-FREQUENT_BITS of all tokens.

Defined results: null text counts as empty, that is one end token; without learning
tokens every count is zero and the model is uniform; a null id is in no fold, so it is
learned from; repeated rows give repeated results; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import ascii_words, small_batches, stored

FREQUENT_BITS = 18
#: Context classes of the last token and of the one before it.
LAST, BEFORE = 256, 64
#: First leaves: WORDS frequent tokens, then the buckets, then the end; a context before the text is the end as well.
WORDS, BUCKETS = 96, LAST - 97
END_LEAF = LAST - 1
#: The end token: a blank, which no word contains.
END = " "
DIMENSIONS, NOISE, SHARED, STEP, RATE, DAMP, PASSES = 16, 16, 64, 4096, 0.1, 0.02, 2
#: Positions mixed at once, and learning tokens for a task at least.
BLOCK, TASK_TOKENS = 65_536, 3_000_000
#: Distinct tokens a counting task holds before it passes partial counts on.
HELD_TOKENS = 400_000


def bucket(token: bytes) -> int:
    """The leaf of a token that has none of its own."""
    return WORDS + zlib.crc32(token[-2:]) % BUCKETS


def bucket_column(token: Column) -> Column:
    tail = F.substring(token.cast("binary"), F.greatest(F.octet_length(token) - 1, F.lit(1)), F.lit(2))
    return (F.pmod(F.crc32(tail), F.lit(BUCKETS)) + WORDS).cast("int")


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, n) over all rows; each row adds one end token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        put = lambda: pa.RecordBatch.from_arrays([pa.array([t.decode() for t in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["token", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(ascii_words(text))
                held[END.encode()] += 1
                if len(held) > HELD_TOKENS:
                    yield put()
                    held.clear()
        yield put()

    return docs.select(text_col).mapInArrow(count, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Leaves: the WORDS most frequent tokens, buckets, the end, then all other frequent tokens."""

    def __init__(self, total: int, types: int, frequent: dict[str, int], buckets: dict[int, tuple[int, int]]):
        """buckets: (tokens, types) of the infrequent tokens of each bucket's leaf."""
        self.total, self.types = total, types
        order = sorted((t for t in frequent if t != END), key=lambda t: (-frequent[t], t))
        self.leaves = {t.encode(): k if k < WORDS else LAST + k - WORDS for k, t in enumerate(order)} | {END.encode(): END_LEAF}
        size = LAST + max(0, len(order) - WORDS)
        self.n = np.zeros(size)
        for t, k in self.leaves.items():
            self.n[k] = frequent.get(t.decode(), 0)
        self.base_zero = math.log10(1 / (total + types + 1))
        self.base = np.log10(self.n + 1) + self.base_zero
        self.known = self.n > 0
        self.share = [math.log10(1 / (sum(buckets.get(b, (0, 0))) + 1)) for b in range(WORDS, WORDS + BUCKETS)]
        self.weight = self.n.copy()
        for b, (n, _) in buckets.items():
            self.weight[b] = n
        self.log_p = np.log((self.weight + 1) / (self.weight + 1).sum()).astype(np.float32)
        own = np.arange(size)
        for t, k in self.leaves.items():
            if k >= LAST:
                own[k] = bucket(t)
        #: Starting classes.
        coarse = np.where(own < BEFORE // 2, own, np.where(own == END_LEAF, BEFORE - 1, BEFORE // 2 + own % (BEFORE // 2 - 1)))
        self.last, self.before = own.astype(np.int16), coarse.astype(np.int16)

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Leaves of the words with two ends ahead and one behind, and the places of rare words among them."""
        x = np.full(len(words) + 3, END_LEAF, np.int32)
        x[2:-1] = np.fromiter(map(self.leaves.get, words, repeat(-1)), np.int32, len(words))
        rare = np.flatnonzero(x < 0)
        x[rare] = [bucket(words[i - 2]) for i in rare.tolist()]
        return x, rare


def vocabulary(counts: DataFrame) -> Vocabulary:
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = {r["token"]: r["n"] for r in counts.where(F.col("n") * (1 << FREQUENT_BITS) >= total).toLocalIterator()}  # 2^FREQUENT_BITS rows at most
    rest = counts.where(F.col("n") * (1 << FREQUENT_BITS) < total).groupBy(bucket_column(F.col("token")).alias("b")).agg(F.sum("n"), F.count(F.lit(1)))
    return Vocabulary(total, types, frequent, {b: (n, k) for b, n, k in rest.collect()})  # BUCKETS rows


class LogBilinear:
    """Vectors of context classes (r, s) and of targets (t); the classes of all leaves."""

    NAMES = ("r", "s", "t")

    def __init__(self, last: np.ndarray, before: np.ndarray, log_p: np.ndarray):
        rng = np.random.default_rng(7)
        self.last, self.before, self.log_p = last, before, log_p
        self.r = rng.normal(0, 0.3, (LAST, DIMENSIONS)).astype(np.float32)
        self.s = rng.normal(0, 0.3, (BEFORE, DIMENSIONS)).astype(np.float32)
        self.t = np.zeros((len(log_p), DIMENSIONS), np.float32)

    def recluster(self, weight: np.ndarray) -> None:
        """Leaves of like vectors become a class; class vectors are averages of the old ones.  The end stays alone."""
        for name, of, size in (("r", "last", LAST), ("s", "before", BEFORE)):
            old, vectors = getattr(self, of), getattr(self, name)
            new = clusters(self.t, weight + 1e-9, size - 1)
            new[END_LEAF] = size - 1
            total = np.maximum(np.bincount(new, weight + 1e-9, size), 1e-9)
            mean = [np.bincount(new, (weight + 1e-9) * vectors[old, d], size) / total for d in range(DIMENSIONS)]
            setattr(self, of, new.astype(np.int16))
            setattr(self, name, np.stack(mean, axis=1).astype(np.float32))

    def log_sums(self, before: int) -> np.ndarray:
        """Logarithm of the sum over all targets, for each class of the last token after one class ``before``."""
        scores = (self.r + self.s[before]) @ self.t.T + self.log_p
        top = scores.max(1)
        return top + np.log(np.exp(scores - top[:, None]).sum(1))

    def log10_of(self, sums: np.ndarray, before: np.ndarray, last: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log10 probabilities of positions given as leaves; sums: BEFORE x LAST."""
        b, u = self.before[before], self.last[last]
        z = np.einsum("ij,ij->i", self.r[u] + self.s[b], self.t[target]) + self.log_p[target] - sums[b, u]
        return z / math.log(10)


def clusters(x: np.ndarray, weight: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Weighted k-means; centres start at the heaviest rows."""
    centres = x[np.argsort(-weight, kind="stable")[:k]].copy()
    for _ in range(rounds):
        near = np.concatenate([((centres * centres).sum(1) - 2 * x[i : i + STEP] @ centres.T).argmin(1) for i in range(0, len(x), STEP)])
        n = np.bincount(near, weight, len(centres))
        for d in range(x.shape[1]):
            centres[n > 0, d] = (np.bincount(near, weight * x[:, d], len(centres)) / np.maximum(n, 1e-12))[n > 0]
    return near


class Learner:
    """One task's copy of a model, with each row's steps scaled by its own past gradients."""

    def __init__(self, model: LogBilinear):
        self.model, self.rng = model, np.random.default_rng(11)
        self.tables = {n: getattr(model, n).copy() for n in LogBilinear.NAMES}
        self.past = {n: np.full(len(x), DAMP, np.float32) for n, x in self.tables.items()}
        self.touched = {n: np.zeros(len(x)) for n, x in self.tables.items()}
        self.cumulated = np.cumsum(np.exp(model.log_p.astype(np.float64)))
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, leaves: np.ndarray) -> None:
        self.held.append(leaves)
        self.size += len(leaves) - 2
        if self.size >= BLOCK:
            self.flush()

    def flush(self) -> None:
        """Learn from all held positions, mixed."""
        if self.held:
            before, last, target = positions(self.held)
            mix = self.rng.permutation(len(target))
            for k in range(0, len(mix), STEP):
                at = mix[k : k + STEP]
                self.learn(self.model.before[before[at]], self.model.last[last[at]], target[at])
        self.held, self.size = [], 0

    def learn(self, before: np.ndarray, last: np.ndarray, target: np.ndarray) -> None:
        """A step; each SHARED positions have their NOISE samples in common, a last group may be smaller."""
        q = self.tables["r"][last] + self.tables["s"][before]
        t = self.tables["t"][target]
        data = 1 / (1 + np.exp(np.einsum("ij,ij->i", q, t) - math.log(NOISE)))  # one less the odds that data are data
        dq, rows, steps = data[:, None] * t, [target], [data[:, None] * q]
        full = len(q) // SHARED * SHARED
        for cut, groups in ((slice(0, full), full // SHARED), (slice(full, len(q)), int(full < len(q)))):
            if groups:
                samples = np.minimum(np.searchsorted(self.cumulated, self.rng.random(groups * NOISE)), len(self.cumulated) - 1)
                noise, own = self.tables["t"][samples].reshape(groups, NOISE, -1), q[cut].reshape(groups, -1, DIMENSIONS)
                g = -1 / (1 + np.exp(math.log(NOISE) - np.matmul(own, noise.transpose(0, 2, 1))))
                dq[cut] += np.matmul(g, noise).reshape(-1, DIMENSIONS)
                rows.append(samples)
                steps.append(np.matmul(g.transpose(0, 2, 1), own).reshape(-1, DIMENSIONS))
        self._step("t", np.concatenate(rows), np.concatenate(steps))
        self._step("r", last, dq)
        self._step("s", before, dq)

    def _step(self, name: str, rows: np.ndarray, gradient: np.ndarray) -> None:
        rows = rows.astype(np.uint16 if len(self.tables[name]) <= 1 << 16 else np.int32)  # short ones are sorted by radix
        order = np.argsort(rows, kind="stable")
        edge = np.flatnonzero(np.diff(rows[order].astype(np.int32), prepend=-1))
        at, g = rows[order[edge]], np.add.reduceat(gradient[order], edge, axis=0)
        self.past[name][at] += np.einsum("ij,ij->i", g, g) / DIMENSIONS
        self.tables[name][at] += RATE * g / np.sqrt(self.past[name][at])[:, None]
        self.touched[name][at] += np.diff(np.append(edge, len(rows)))

    def changes(self) -> Iterator[pa.RecordBatch]:
        """(key, n, changes times n) of what was touched; keys number the rows of r, s and t on."""
        base = 0
        for name, x in self.tables.items():
            at = np.flatnonzero(self.touched[name])
            n = self.touched[name][at]
            d = (x[at] - getattr(self.model, name)[at]) * n[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(at + base, pa.int64()), pa.array(n), *(pa.array(c) for c in d.T)], ["key", "n", *(f"d{k}" for k in range(DIMENSIONS))])
            base += len(x)


def positions(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.concatenate([x[k : len(x) - 2 + k] for x in texts]) for k in range(3))


def train(spark: SparkSession, v: Vocabulary, words, training: DataFrame, text_col: str = "text") -> LogBilinear:
    """PASSES passes over all of ``training``; words: broadcast ``v``.  The driver gets a row per vector."""
    model = LogBilinear(v.last, v.before, v.log_p)
    columns = [f"d{k}" for k in range(DIMENSIONS)]
    docs = training.select(text_col).coalesce(v.total // TASK_TOKENS + 1)
    for k in range(PASSES if v.total else 0):
        if k:
            model.recluster(v.weight)
        shipped = spark.sparkContext.broadcast(model)  # vectors of 2^FREQUENT_BITS tokens at most

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            learner, of = Learner(shipped.value), words.value.of  # noqa: B023
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    learner.add(of(ascii_words(text))[0])
            learner.flush()
            yield from learner.changes()

        rows = docs.mapInArrow(fit, "key bigint, n double, " + ", ".join(f"{c} double" for c in columns))
        mean = rows.groupBy("key").agg(*((F.sum(c) / F.sum("n")).cast("float").alias(c) for c in columns)).toArrow()
        keys, changes = mean.column("key").to_numpy(), np.stack([mean.column(c).to_numpy() for c in columns], axis=1)
        base = 0
        for name in LogBilinear.NAMES:
            x = getattr(model, name).copy()
            own = (keys >= base) & (keys < base + len(x))
            x[keys[own] - base] += changes[own]
            base += len(x)
            setattr(model, name, x)
    return model


def log_sums(spark: SparkSession, model: LogBilinear, shipped) -> np.ndarray:
    """BEFORE x LAST normalisers, computed in tasks; shipped: broadcast ``model``."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array([shipped.value.log_sums(i).astype(np.float64) for i in b.tolist()], pa.list_(pa.float64()))], ["b", "sums"])

    rows = spark.range(0, BEFORE, 1, 16).mapInArrow(sums, "b bigint, sums array<double>").collect()  # BEFORE rows
    return np.array([r["sums"] for r in sorted(rows, key=lambda r: r["b"])])


def score(df: DataFrame, training: DataFrame, *keep: Column, text_col: str = "text") -> DataFrame:
    """The columns ``keep``, n_tokens, n_known, train_tokens, base_score and score per row of ``df``."""
    spark = small_batches(df.sparkSession)
    counts = stored(token_counts(training, text_col), "token_counts")
    v = vocabulary(counts)
    words = spark.sparkContext.broadcast(v)  # 2^FREQUENT_BITS entries at most
    model = train(spark, v, words, training, text_col)
    shipped = spark.sparkContext.broadcast(model)
    normalisers = spark.sparkContext.broadcast(log_sums(spark, model, shipped))  # BEFORE x LAST
    rows = df.select(F.struct(*keep).alias("kept"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    types = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "lm": pa.float64(), "rare": pa.list_(pa.string()), "times": pa.list_(pa.int32())}

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, model, sums = words.value, shipped.value, normalisers.value
        for batch in batches:
            leaves, rare = [], []
            for text in batch.column(2).to_pylist():
                tokens = ascii_words(text)
                x, places = v.of(tokens)
                leaves.append(x)
                rare.append(Counter([tokens[i - 2] for i in places.tolist()]))
            if not leaves:
                continue
            size = np.array([len(x) - 2 for x in leaves])
            starts = np.cumsum(size) - size
            before, last, target = positions(leaves)
            per_text = lambda values: np.add.reduceat(values, starts)
            own = (target < WORDS) | (target >= END_LEAF)  # not of a bucket
            found = [size, per_text((own & v.known[target]).astype(np.int64)), per_text(np.where(own, v.base[target], 0.0)), per_text(model.log10_of(sums, before, last, target).astype(np.float64))]
            out = [*(pa.array(x) for x in found), [[w.decode() for w in r] for r in rare], [list(r.values()) for r in rare]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(out, types.values(), strict=True))], ["kept", "row", *types])

    scored = stored(rows.mapInArrow(first_pass, f"kept {rows.schema['kept'].dataType.simpleString()}, row bigint, n_tokens bigint, n_known bigint, base double, lm double, rare array<string>, times array<int>"), "first_pass")
    pairs = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("e")).select("row", F.col("e.rare").alias("token"), F.col("e.times").alias("times"))
    infrequent = counts.where(F.col("n") * (1 << FREQUENT_BITS) < v.total)
    share = F.get(F.array(*map(F.lit, v.share)), bucket_column(F.col("token")) - WORDS)
    n = F.coalesce("n", F.lit(0))
    sums = (
        pairs.join(infrequent, "token", "left")
        .select("row", F.when(n > 0, F.col("times")).otherwise(0).alias("known"), (F.col("times") * (F.log10(n + 1) + v.base_zero)).alias("base2"), (F.col("times") * (F.log10(n + 1) + share)).alias("lm2"))
        .groupBy("row")
        .agg(F.sum("known").alias("known"), F.sum("base2").alias("base2"), F.sum("lm2").alias("lm2"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (
        scored.drop("rare", "times")
        .join(sums, "row", "left")
        .select("kept.*", "n_tokens", (F.col("n_known") + zero("known")).alias("n_known"), F.lit(v.total).cast("bigint").alias("train_tokens"), (F.col("base") + zero("base2")).alias("base_score"), (F.col("lm") + zero("lm2")).alias("score"))
    )

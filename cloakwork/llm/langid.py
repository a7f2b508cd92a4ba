"""Language identification by multilingual mixture inference.

Training counts hashed character trigrams per language over all learning documents (one
partial table per task, summed by Spark); what reaches the driver is bounded by
languages x 2^16 buckets.  Each document's language proportions are then estimated by
expectation-maximisation over its trigrams' likelihoods.  Languages of small share are
pruned, nested sets of the remaining ones are fitted again, and the set with the best
penalised likelihood (half a logarithm of the trigram count for each further language,
times PENALTY) is kept.  The prediction is its largest language, the score its share.

Defined results: null text, text without a letter, and any text where nothing could be
learned give ``und`` with score 0; ties go to the first language by name; a null id is
in no fold, so it is learned from; repeated rows give repeated results; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import small_batches

BITS, SMOOTHING, ROUNDS, PRUNE, PENALTY = 16, 0.5, 20, 0.05, 3.0
#: Characters of a text looked at at once, which bounds memory on long texts.
BLOCK = 1 << 17
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point: itself if a letter, else a blank."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((c if chr(c).isalpha() else 32 for c in range(0x110000)), np.uint32, 0x110000))
    return _LETTERS[0]


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct trigram buckets and their counts; None for a text without a letter."""
    if not text:
        return None
    text, total, last, carry = f" {text.lower()} ", None, 0, np.zeros(0, np.uint32)
    for at in range(0, len(text), BLOCK):
        points = _letters()[np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)]
        kept = points[(points != 32) | (np.r_[last, points[:-1]] != 32)]  # one blank between words
        last, kept = points[-1], np.concatenate([carry, kept])
        carry = kept[-2:]
        h = kept[:-2] * np.uint32(0x9E3779B1) + kept[1:-1] * np.uint32(0x85EBCA77) + kept[2:] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
        if len(text) <= BLOCK:
            return np.unique(h, return_counts=True) if (kept != 32).any() else None
        total = np.bincount(h, minlength=1 << BITS) + (0 if total is None else total)
        letters = (kept != 32).any() or (at > 0 and letters)
    buckets = np.flatnonzero(total)
    return (buckets, total[buckets]) if letters else None


class Mixture:
    def __init__(self, langs: list[str], counts: np.ndarray):
        """counts: languages x buckets."""
        self.langs = langs
        p = (counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * counts.shape[1])
        self.p = np.ascontiguousarray(p.T)

    @staticmethod
    def fit(p: np.ndarray, n: np.ndarray, total: int) -> tuple[np.ndarray, float]:
        share = np.full(p.shape[1], 1 / p.shape[1])
        for _ in range(ROUNDS if p.shape[1] > 1 else 0):
            new = share * ((n / (p @ share)) @ p) / total
            done = np.abs(new - share).max() < 1e-3
            share = new
            if done:
                break
        return share, float(n @ np.log(p @ share))

    def infer(self, grams: tuple[np.ndarray, np.ndarray]) -> dict[str, float]:
        """Shares of the selected languages, largest first."""
        at, n = grams
        p, total = self.p[at], int(n.sum())
        share, _ = self.fit(p, n, total)
        order = [k for k in np.argsort(-share, kind="stable") if share[k] >= PRUNE] or [int(np.argmax(share))]
        best = (-np.inf, [], share)
        for size in range(1, len(order) + 1):
            part, likelihood = self.fit(p[:, order[:size]], n, total)
            value = likelihood - PENALTY * 0.5 * (size - 1) * np.log(total)
            if value <= best[0]:
                break
            best = (value, order[:size], part)
        found = sorted(zip(-best[2], best[1], strict=True))
        return {self.langs[k]: float(-s) for s, k in found}


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Mixture:
    """Counts trigrams per language over all rows with text and a language."""
    small_batches(df.sparkSession)
    rows = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if grams := trigrams(text):
                    sums.setdefault(lang, np.zeros(1 << BITS, np.int64))[grams[0]] += grams[1]
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(s[at], pa.int64())], ["lang", "bucket", "n"])

    table = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table["lang"].unique())
    counts = np.zeros((len(langs), 1 << BITS), np.float64)
    counts[np.searchsorted(langs, table["lang"]) if langs else [], table["bucket"].to_numpy(np.int64)] = table["n"]
    return Mixture(langs, counts)


def predict(df: DataFrame, model: Mixture, *keep: Column, text_col: str = "text") -> DataFrame:
    """The columns ``keep``, ``lang_pred``, ``score`` and ``mixture`` (shares as a map) per row."""
    rows = df.select(*keep, F.col(text_col).alias("__text"))
    shipped = small_batches(df.sparkSession).sparkContext.broadcast((model.langs, model.p))  # languages x 2^16 floats
    kept = rows.columns[:-1]
    schema = T.StructType(rows.schema.fields[:-1]).add("lang_pred", T.StringType()).add("score", T.DoubleType()).add("mixture", T.MapType(T.StringType(), T.DoubleType()))

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Mixture.__new__(Mixture)
        m.langs, m.p = shipped.value
        for batch in batches:
            found = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                grams = trigrams(text) if m.langs else None
                found.append(m.infer(grams) if grams else {})
            first = [next(iter(f.items()), ("und", 0.0)) for f in found]
            new = [pa.array([f[0] for f in first], pa.string()), pa.array([min(1.0, f[1]) for f in first], pa.float64()), pa.array([list(f.items()) for f in found], pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*kept, "lang_pred", "score", "mixture"])

    return rows.mapInArrow(infer, schema)

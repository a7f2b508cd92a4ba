"""Token counts through a digest cache.

The cache is a table (version, digest, n_tokens).  A text's digest is SHA-256 of its
normalised content (null becomes empty; nothing else may change, as the tokenizer
counts every character), the version a digest of the tokenizer's own file.  Digests are
joined to the stored counts; each distinct digest without one is encoded once, and its
count is appended to the cache.

One text may make up a third of all rows: duplicates collapse map-side before texts are
shuffled, and the join back carries digests only, in a plain sort-merge join whose hot
partitions Spark splits.

Defined results: null and empty text count 0 tokens and 0 bytes; repeated rows give
repeated results; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Memo, scratch_path, stored

#: Words remembered by each worker.
MEMO_WORDS = 300_000
CACHE_SCHEMA = "version string, digest binary, n_tokens bigint"
_COUNTERS: dict[str, Counter] = {}


class Counter:
    """Exact token counts of a sentencepiece model.

    If no piece has a word mark after another character, nothing merges across the
    start of a word, and counts add up over words.  Texts with runs of blanks, blanks at
    an end or a literal word mark, and all texts of other models, go to the library whole.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = (self.library.id_to_piece(i) for i in range(self.library.get_piece_size()))
        self.by_word = not any(re.search("[^▁]▁", p) for p in pieces) and [self.library.encode(x, out_type=str) for x in ("a  b", "ab c")] == [["▁a", "▁", "▁b"], ["▁ab", "▁c"]]
        self.memo = Memo(MEMO_WORDS)

    @staticmethod
    def of(model: bytes) -> Counter:
        key = hashlib.sha256(model).hexdigest()
        if key not in _COUNTERS:
            _COUNTERS[key] = Counter(model)
        return _COUNTERS[key]

    def count(self, text: str) -> int:
        if not self.by_word or not text or "  " in text or "▁" in text or text[0] == " " or text[-1] == " ":
            return len(self.library.encode(text, num_threads=1))
        words = text.split(" ")
        found = list(map(self.memo.young.get, words))
        if None in found:
            if new := self.memo.missing(words):
                self.memo.young.update(zip(new, map(len, self.library.encode(new, num_threads=1)), strict=True))
            found = map(self.memo.young.__getitem__, words)
        return sum(found)


def count_tokens(df: DataFrame, model: bytes, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Per row: id, n_bytes, n_tokens and whether n_tokens exceeds ``limit``.

    cache_path: a Parquet table that outlives the call; None starts an empty cache in the
    shared folder, so all distinct texts are encoded.
    """
    spark = df.sparkSession
    version = hashlib.sha256(model).hexdigest()
    cache_path = cache_path or scratch_path(spark, "token_counts")
    shipped = spark.sparkContext.broadcast(model)  # a tokenizer file: its size does not depend on the data
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("version") == version)

    texts = df.select(digest, text.alias("text"))
    if cache.limit(1).count():
        texts = texts.join(cache.select("digest"), "digest", "left_anti")
    misses = texts.groupBy("digest").agg(F.first("text").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(shipped.value)
        for batch in batches:
            counts = [counter.count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(counts), pa.string()), batch.column("digest"), pa.array(counts, pa.int64())], ["version", "digest", "n_tokens"])

    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = stored(counts, "counts")  # a plain table on this side lets Spark split the hot partitions of the other
    return (
        df.select(F.col(id_col), digest, F.octet_length(text).cast("bigint").alias("n_bytes"))
        .join(counts, "digest")
        .select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )

"""Helpers of the training-data operators: shared storage, row keys, word splitting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than ASCII white space.
WHITE = r"[\x20\x09-\x0D]+"
#: Rows and bytes of a batch for Python workers.
BATCH_ROWS, BATCH_BYTES = 1000, "4m"
#: Rows of a join's side that Spark may broadcast; the size of files, by which it decides, says little of the driver's memory.
SMALL_ROWS = 100_000
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Only a local session may do without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "cloakwork-shared")
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cloakwork/{uuid.uuid4().hex}/{name}"


def small_batches(spark: SparkSession) -> SparkSession:
    """Batches for Python workers that stay small when texts are long: a batch is what a worker holds at once."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A join's side that is shuffled, never broadcast, above SMALL_ROWS rows: ``rows``, or those of the stored table ``df``."""
    return df if (df.count() if rows is None else rows) <= SMALL_ROWS else df.hint("merge")


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; null keys give -1, which is no fold."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus)), F.lit(-1))


def native_words(text: Column) -> Column:
    """Array of the words of a text column; null text gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def ascii_words(text: str | None) -> list[bytes]:
    """Words in UTF-8 with A-Z lower-cased.  ``bytes.split`` cuts at exactly ``WHITE``."""
    return text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split() if text else []


class Memo:
    """A bounded table of results, in two generations: what was not asked for since the last turnover goes first."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def missing(self, keys: list) -> list:
        """Keys without a result; the others are in ``young`` afterwards, unless this call turns it over."""
        young, old = self.young, self.old
        new = {k for k in keys if k not in young}
        if new and len(young) + len(new) > self.size:
            self.old, self.young = old, young = young, {}
            new = set(keys)
        out = []
        for k in new:
            if k in old:
                young[k] = old[k]
            else:
                out.append(k)
        return out

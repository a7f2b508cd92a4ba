"""Sessions, and getting this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(name: str = "cloakwork", cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings tests and benchmarks share."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_code(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once per application, so that workers can import it."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        here = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(), "cloakwork_code.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(here):
                for n in sorted(names):
                    if not n.endswith(".pyc"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.join("cloakwork", os.path.relpath(full, here)))
        context.addPyFile(path)
        _SHIPPED.add(context.applicationId)
    return spark


def spread(df: DataFrame, always: bool = False) -> DataFrame:
    """Deal the rows of a table of few partitions out to all cores; larger tables stay as they are.

    always: for short rows that are dear to work on, as a single partition of a file holds millions of them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if always or df.rdd.getNumPartitions() < 2 * cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Only a local session may do without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "cloakwork-shared")
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: one evaluation, and it survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/cloakwork/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

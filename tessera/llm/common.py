"""Shared helpers: table reading, the shared work folder, materialised intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import ship

ROWS_PER_FILE, LEAST_FILES = 16_000, 6  # of small tables between two steps


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where a local session has none (a test) is a new one made and set; on a cluster that is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch path once nothing reads it any more."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def materialize(df: DataFrame, label: str, rows: int | None = None, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of it; its shuffle files go.

    Cuts the lineage: a lost executor costs only its running tasks, and two consumers
    of an expensive Python stage don't compute it twice. ``rows``, if known, is about how many rows
    there are, so that a small table doesn't become a file per shuffle partition. The reader's
    ``rows`` is how many there were.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    path, seen = scratch_path(spark, label), Observation()
    made = df.observe(seen, F.count(F.lit(1)).alias("n"))
    if rows is not None:
        made = made.coalesce(min(partitions(spark), max(LEAST_FILES, -(-rows // ROWS_PER_FILE))))
    made.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch, out.rows = path, seen.get["n"]
    return out


def discard(df: DataFrame) -> None:
    """Remove a materialised table that nothing reads any more."""
    drop_path(df.sparkSession, df.scratch)


def tune_arrow(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, by rows and by bytes; send them the code."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_temp() -> str:
    """The task's own temp folder; for files that never outlive the task."""
    folder = os.environ.get("TMPDIR") or tempfile.gettempdir()
    os.makedirs(folder, exist_ok=True)
    return folder

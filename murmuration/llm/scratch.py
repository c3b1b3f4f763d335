"""Tables that cut lineage, in the folder that the cluster shares.

`spark.checkpoint.dir` names a folder that the driver and all executors see.
It is read from the session; where it is unset, as in tests, a temporary folder
is used if Spark runs in one process, and otherwise an error says what to set.

What a write has shuffled is read by no one afterwards, so those files go with it and
not when the driver happens to collect its garbage; what a run holds on disk is its
tables and the shuffles of one write.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="murmuration-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


class Scratch:
    """Tables written for one run; `drop` removes those that are no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame) -> DataFrame:
        """The table, written and read again; Python tasks get it in batches of `BATCH_ROWS` whole texts."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        before, cleanup = self.spark.conf.get(BATCH_SETTING), self.spark.conf.get(CLEANUP_SETTING, None)
        self.spark.conf.set(BATCH_SETTING, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
        self.spark.conf.set(CLEANUP_SETTING, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(BATCH_SETTING, before)
            if cleanup is None:
                self.spark.conf.unset(CLEANUP_SETTING)
            else:
                self.spark.conf.set(CLEANUP_SETTING, cleanup)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table.scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

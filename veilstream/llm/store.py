"""Intermediate tables that survive lost executors: Parquet in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset a local master (tests, local runs) gets one made and
    set; on a cluster that is an error, as its machines don't share local folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="veilstream-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Store:
    """Names the tables one operator call writes, so that it can drop those it no longer needs.

    Results read from the last tables lazily, so these stay until close() or the end of the session's process."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.close)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def close(self) -> None:
        """Drop every table; for callers that are done with the result, and at the end of the process."""
        atexit.unregister(self.close)
        with contextlib.suppress(Exception):  # the session may have ended before
            self._delete(self.root)

    def release(self) -> None:
        """Let Spark remove the shuffle files of finished steps now rather than at some later garbage collection."""
        self.spark.range(1).count()  # Spark holds on to its last job
        gc.collect()
        self.spark._jvm.System.gc()

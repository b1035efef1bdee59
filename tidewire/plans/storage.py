"""Where intermediate results go, and how long they stay."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; only a local session without spark.checkpoint.dir gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tidewire-")
        sc.setCheckpointDir(folder)
    # the context's own folder below the one that the cluster names
    gone_at_exit(spark, sc.getCheckpointDir())
    return sc.getCheckpointDir()


def _located(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """The file system deletes the path when the driver's JVM ends."""
    files, found = _located(spark, path)
    files.deleteOnExit(found)


def delete(spark: SparkSession, path: str) -> None:
    files, found = _located(spark, path)
    files.delete(found, True)


def exists(spark: SparkSession, path: str) -> bool:
    files, found = _located(spark, path)
    return files.exists(found)


def rename(spark: SparkSession, path: str, to: str) -> None:
    files, found = _located(spark, path)
    if not files.rename(found, _located(spark, to)[1]):
        raise OSError(f"{path} could not be renamed to {to}")


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Actions inside send at most `rows` rows in an Arrow batch; then the session has its own setting again."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own, now = spark.conf.getAll.get(name), int(spark.conf.get(name))
    spark.conf.set(name, str(min(rows, now) if now > 0 else rows))
    try:
        yield
    finally:
        spark.conf.unset(name) if own is None else spark.conf.set(name, own)


class Stored:
    """A table in the shared folder, compact and read by column, until drop() or the end of the driver."""

    def __init__(self, df: DataFrame, batch_rows: int = 10_000):
        """batch_rows: of the Arrow batches while it is written."""
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/stored-{uuid.uuid4().hex}"
        with arrow_rows(self.spark, batch_rows):
            df.write.parquet(self.path)
        self.rows = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """A stored table that goes when the driver ends."""
    return Stored(df).rows

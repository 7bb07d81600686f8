"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether a query's shuffle files are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that a task of a dealt table takes.
ROWS_A_TASK = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, a temporary one, on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


class Scratch:
    """The tables that one job writes to the shared folder, by name; each is dropped when its last reader is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """df as a Parquet table: what follows starts there and survives lost executors.

        The shuffles behind it aren't needed any more and their files are removed as soon as the table is whole.
        """
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.paths[name])

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more; a name that was written anew lost its older table by then."""
        for path in [self.paths.pop(name) for name in names if name in self.paths]:
            remove(self.spark, path)

    def keep_only(self, *names: str) -> None:
        self.drop(*(name for name in list(self.paths) if name not in names))


def remove(spark: SparkSession, path: str) -> None:
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).delete(held, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own in the shared folder."""
    return Scratch(df.sparkSession).write(name, df)


def large(df: DataFrame) -> DataFrame:
    """df, whose next join broadcasts neither side: the size of a table's files tells little of its rows, or of those made of them."""
    return df.hint("merge")


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by its keys in as many partitions as so many rows ask for, so that a task's memory doesn't grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, rows // ROWS_A_TASK + 1), *keys)

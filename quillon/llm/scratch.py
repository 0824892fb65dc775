"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir`` (read from the session), so a lost executor never takes
the only copy of an intermediate result along. Where the setting is missing, a folder of our own is taken only if driver
and executors are one process (a local master, as in tests); on a cluster that is an error. A table's shuffle files go as
soon as it is written; its folder goes when the driver ends, or earlier by ``drop``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
#: Spark's own switch: the shuffle files of a query are removed once it has run.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder."""
    found = spark.sparkContext.getConf().get(_KEY) or spark.conf.get(_KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"set {_KEY} to a folder that driver and executors share")
        found = "/tmp/checkpoints/quillon"
        spark.conf.set(_KEY, found)
    return found.rstrip("/")


class Scratch:
    """Tables of one operator call. ``table`` writes and rereads; ``drop`` frees one that nothing reads any more."""

    _open: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str) -> None:
        Scratch._open.append(self)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.write(df, name)
        return self.spark.read.schema(df.schema).parquet(path)

    def write(self, df: DataFrame, name: str) -> str:
        self.n += 1
        path = f"{self.root}/{self.n:02d}-{name}"
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")  # nothing rereads the shuffles of a written table
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return path

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this call that nothing reads any more."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            for file in table.inputFiles()[:1]:
                folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
                if self.root.split("://")[-1] in folder.toString():
                    folder.getFileSystem(conf).delete(folder, True)

    def close(self) -> None:
        """Delete every table of this call, once its result is written elsewhere."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def passing() -> Iterator[None]:
    """Within it the result of operators is written; their own tables go at its end."""
    mark = len(Scratch._open)
    try:
        yield
    finally:
        for made in Scratch._open[mark:]:
            made.close()
        del Scratch._open[mark:]

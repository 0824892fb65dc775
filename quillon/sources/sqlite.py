"""A SQLite table as a Spark source, read in ranges of row ids so that tasks share the scan.

``spark.dataSource.register(SQLiteSource)``; ``spark.read.format("sqlite_table").option("path", ...).option("table", ...)``.
The file must lie where executors can read it. Opened read-only; a missing or broken file raises on the driver.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Columns of the registry.
REGISTRY = "documento_id string, id long, tribunal string, ano int, relator string, natureza string, tipo string, texto string"


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class Rows(InputPartition):
    def __init__(self, first: int, stop: int) -> None:
        super().__init__(None)
        self.first, self.stop = first, stop


class SQLiteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.columns = [f.name for f in schema.fields]
        self.types = [f.dataType.typeName() for f in schema.fields]
        self.path, self.table, self.step = options["path"], options.get("table", "documentos"), int(options.get("rows", 10_000))

    def partitions(self) -> list[InputPartition]:
        if not os.path.exists(self.path):
            raise FileNotFoundError(self.path)
        with _open(self.path) as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        return [] if low is None else [Rows(a, min(a + self.step, high + 1)) for a in range(low, high + 1, self.step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        to = {"string": str, "long": int, "integer": int, "double": float}
        casts = [to.get(t, lambda x: x) for t in self.types]
        names = ", ".join(f'"{c}"' for c in self.columns)
        with _open(self.path) as db:
            for row in db.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (partition.first, partition.stop)):
                yield tuple(None if x is None else f(x) for x, f in zip(row, casts, strict=True))


class SQLiteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        return REGISTRY

    def reader(self, schema: StructType) -> SQLiteReader:
        return SQLiteReader(schema, dict(self.options))


def read_registry(spark: SparkSession, path: str, table: str = "documentos", schema: str = REGISTRY) -> DataFrame:
    """The registry's rows."""
    spark.dataSource.register(SQLiteSource)
    return spark.read.format("sqlite_table").schema(schema).option("path", path).option("table", table).load()

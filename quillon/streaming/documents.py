"""Citations of documents as they arrive: an extension, as documents are resolved one by one against a fixed registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.extraction import extract
from quillon.operators.resolve import assemble, resolve
from quillon.sources.files import BINARY, as_output, decode, stem, submission


def stream_texts(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """(doc, text) of ``*.txt`` files as they appear in a folder; Spark's file streams pass over empty files."""
    files = spark.readStream.schema(BINARY).format("binaryFile").option("pathGlobFilter", "*.txt").option("maxFilesPerTrigger", per_batch).load(folder)
    return files.select(stem(F.col("path"), "txt").alias("doc"), decode(F.col("content")).alias("text"))


def stream_cells(docs: DataFrame, index: dict[str, DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write one encoded cell for each document of a stream (doc, text).

    Each batch is a batch job over its documents. It overwrites its own folder ``out/batch=<id>``, so that a batch
    replayed after a failure leaves its rows once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        nested = assemble(batch, resolve(extract(batch), index))
        submission(as_output(nested)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

"""Best-two-fit packing of documents into sequences of at most ``capacity`` tokens.

Every document is its ids and an end id; one longer than ``capacity`` is cut from its end into full pieces, so only its
first piece may be shorter. Which bins exist depends on the lengths alone, so the bins are found on the histogram of
lengths (``capacity`` numbers, whatever the corpus): fill a bin greedily with the longest fitting piece, then replace
its smallest piece by two unpacked pieces that fit the widened gap more tightly, and use that filling as often as the
histogram allows. Pieces get their places by their rank among pieces of the same length, counted in hashed buckets, so
no length gathers in one task.

Defined results: null or empty text is a document of the end id alone; repeated rows are separate documents; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import tokens
from quillon.llm.scratch import Scratch
from quillon.llm.workers import lean

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of one document."""
    n = len(ids)
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)] if n else []


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Fillings (lengths, how many bins) that use up ``counts[length]`` pieces of each length up to ``capacity``.

    Two short pieces spent on a small gap may be missed by later bins, which then stand half empty. How much of a gap a
    replacement must close to be worth its pieces depends on the lengths at hand, so packings are made for 1, 2, 4, ...
    up to a sixteenth of a bin, and the one with the fewest bins is taken, the most replacements among equals.
    """
    least = [1 << k for k in range(max(1, (capacity // 16).bit_length()))]
    return min((fillings(counts, capacity, x) for x in least), key=lambda bins: sum(m for _, m in bins))


def fillings(counts: np.ndarray, capacity: int, least: int) -> list[tuple[list[int], int]]:
    """One packing; a replacement is made where it closes ``least`` tokens of the gap or more."""
    left = np.asarray(counts, np.int64).copy()
    sizes = np.arange(capacity + 1)
    out: list[tuple[list[int], int]] = []
    while left.any():
        spare = left.copy()

        def longest(limit: int, spare=spare) -> int:
            """The longest unpacked length up to ``limit``, or 0."""
            found = np.flatnonzero(spare[: limit + 1])
            return int(found[-1]) if len(found) else 0

        bin_: list[int] = []
        gap = capacity
        while gap and (s := longest(gap)):
            bin_.append(s)
            spare[s] -= 1
            gap -= s
        while gap and bin_:
            small = bin_[-1]  # pieces were added longest first
            wide = gap + small
            # for each first piece the longest second one beside it; the first counts once
            fits = np.maximum.accumulate(np.where(spare > 0, sizes, 0))
            first = np.flatnonzero(spare[: wide + 1] > 0)
            if not len(first):
                break
            second = fits[np.minimum(wide - first, first)]
            same = (second == first) & (spare[first] < 2)
            if same.any():
                second[same] = fits[np.minimum(wide - first[same], first[same] - 1)]
            total = np.where(second > 0, first + second, 0)
            k = int(total.argmax())
            if total[k] - small < least:
                break
            bin_[-1:] = [int(first[k]), int(second[k])]
            spare[small] += 1
            spare[first[k]] -= 1
            spare[second[k]] -= 1
            gap = wide - int(total[k])
            bin_.sort(reverse=True)
        use, often = np.unique(bin_, return_counts=True)
        m = int((left[use] // often).min())
        left[use] -= often * m
        out.append((bin_, m))
    return out


def slots(counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset): where pieces of each length go by rank."""
    used = np.zeros(capacity + 1, np.int64)
    out, sequence = [], 0
    for lengths, m in best_two_fit(counts, capacity):
        offset = 0
        for s in lengths:
            out.append((s, int(used[s]), int(used[s]) + m, sequence, offset))
            used[s] += m
            offset += s
        sequence += m
    return out


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Every document's pieces: doc_id, piece, start, length, ids_crc32."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = tokens.encoder(tokenizer), np.array([end_id], np.uint32)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in tokens.spread(texts):
                rows = []
                for key, ids in zip(keys[i:j], enc.encode(texts[i:j]), strict=True):
                    ids = np.concatenate((ids, end))
                    rows += [(key, k, s, n, tokens.crc32(ids[s : s + n])) for k, (s, n) in enumerate(cut(ids, capacity))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(encode, holds=True), _PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, bucket_rows: int = 2_000_000) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. ``bucket_rows``: pieces ranked together at most on average."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.table(token_pieces(docs, tokenizer, capacity, end_id), "pieces")
    # capacity + 1 numbers at most reach the driver
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    counts = np.zeros(capacity + 1, np.int64)
    for k, v in histogram.items():
        counts[k] = v
    total = int(counts.sum())
    buckets = max(64, -(-total // bucket_rows))
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")
    keyed = pieces.withColumn("bucket", bucket)
    per = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = per.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = keyed.withColumn("inside", inside).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside"))
    table = slots(counts, capacity)
    places = spark.createDataFrame(table or [(0, 0, 0, 0, 0)], "slot_length long, first long, stop long, sequence long, offset long")
    if len(table) <= 500_000:  # fillings are as many as lengths or a small multiple; 20 MB at this bound
        places = F.broadcast(places)
    here = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("stop"))
    placed = ranked.join(places, here)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")

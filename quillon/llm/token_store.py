"""Token-id output: Elias-Fano document boundaries over one concatenated id array.

A store is a table of blobs that Spark's own writer commits (so it works on any file system and survives lost
executors). A blob holds a run of documents in ascending doc_id order::

    magic "QEF2" | width of an id in bytes u32 | documents u64 | documents with null doc_id u64 | least doc_id i64
    | Elias-Fano sequence of end offsets | Elias-Fano sequence of doc_id - least doc_id | ids, little-endian

An Elias-Fano sequence of n values below u keeps floor(log2(u / n)) low bits of each, the rest as unary gaps, and the
position of every 64th one bit for ``select``: about 2 + log2(u / n) bits a value instead of 64.

Defined results: null text is an empty text (its one id is the end id); null doc_ids come first; equal doc_ids stay
separate documents, ordered by a hash of their text; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import tokens
from quillon.llm.scratch import Scratch

SAMPLE = 64
_BLOBS = "part int, seq int, n_docs long, n_tokens long, blob binary"
_ROWS = "doc_id long, part int, seq int, local long, n_tokens long, ids_crc32 long"


class EliasFano:
    """A non-decreasing sequence of non-negative integers with constant-size ``select``."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = values.astype(np.uint64)
        n = len(v)
        top = int(v[-1]) + 1 if n else 1
        l = max(0, (top // max(n, 1)).bit_length() - 1)
        shifts = np.arange(l, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        at = (v >> np.uint64(l)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        bits[at] = 1
        return cls(n, l, low, np.packbits(bits, bitorder="little"), at[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """The i-th value: from the sampled one bit before it, scan the unary part."""
        base = int(self.samples[i // SAMPLE])
        rest = i % SAMPLE
        byte, seen = base >> 3, -1
        skip = base & 7
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + 32], bitorder="little")[skip:])
            if seen + len(ones) >= rest:
                high = byte * 8 + skip + int(ones[rest - seen - 1])
                break
            seen += len(ones)
            byte, skip = byte + 32, 0
        low = 0
        for k in range(self.low_bits):
            b = i * self.low_bits + k
            low |= (int(self.low[b >> 3]) >> (b & 7) & 1) << k
        return (high - i) << self.low_bits | low

    def all(self) -> np.ndarray:
        """Every value, as int64."""
        if not self.n:
            return np.zeros(0, np.int64)
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        if not self.low_bits:
            return high.astype(np.int64)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return (high << self.low_bits) | (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def dump(self) -> bytes:
        head = struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def load(cls, blob: memoryview, at: int) -> tuple[EliasFano, int]:
        n, l, a, b, c = struct.unpack_from("<QBQQQ", blob, at)
        at += struct.calcsize("<QBQQQ")
        low = np.frombuffer(blob, np.uint8, a, at)
        high = np.frombuffer(blob, np.uint8, b, at + a)
        samples = np.frombuffer(blob, "<u4", c, at + a + b)
        return cls(n, l, low, high, samples), at + a + b + 4 * c


def pack(doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    """One blob of documents in the given order, null doc_ids first."""
    known = [d for d in doc_ids if d is not None]
    least = known[0] if known else 0
    ends = np.cumsum([len(x) for x in ids], dtype=np.int64)
    kind = "<u2" if width == 2 else "<u4"
    body = np.concatenate(ids).astype(kind).tobytes() if ids else b""
    head = struct.pack("<4sIQQq", b"QEF2", width, len(ids), len(doc_ids) - len(known), least)
    gaps = np.array([d - least for d in known], np.uint64)
    return head + EliasFano.encode(ends).dump() + EliasFano.encode(gaps).dump() + body


class Blob:
    """A blob opened for reading."""

    def __init__(self, blob: bytes) -> None:
        view = memoryview(blob)
        magic, width, self.n, self.nulls, self.least = struct.unpack_from("<4sIQQq", view, 0)
        if magic != b"QEF2":
            raise ValueError("not a token store blob")
        self.ends, at = EliasFano.load(view, struct.calcsize("<4sIQQq"))
        self.gaps, at = EliasFano.load(view, at)
        self.ids = np.frombuffer(view, "<u2" if width == 2 else "<u4", offset=at)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, by two selects."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + [self.least + int(g) for g in self.gaps.all()]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, blob_tokens: int = 4_000_000) -> None:
    """Encode ``docs`` (doc_id, text) and write the store at ``path``, blobs of about ``blob_tokens`` ids."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, seq = tokens.encoder(tokenizer), TaskContext.get().partitionId(), 0
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        keys: list = []
        held: list[np.ndarray] = []
        total = 0
        end = np.array([end_id], np.uint32)

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([total], pa.int64()), pa.array([pack(keys, held, width)], pa.binary())], ["part", "seq", "n_docs", "n_tokens", "blob"])

        for batch in batches:
            texts, docs_ = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for i, j in tokens.spread(texts):
                for key, ids in zip(docs_[i:j], enc.encode(texts[i:j]), strict=True):
                    keys.append(key)
                    held.append(np.concatenate((ids, end)).astype(np.uint16 if width == 2 else np.uint32))
                    total += len(ids) + 1
                    if total >= blob_tokens:
                        yield flush()
                        keys, held, total, seq = [], [], 0, seq + 1
        if keys:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()  # the hash parts rows of one doc_id
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered.mapInArrow(encode, _BLOBS).write.mode("overwrite").option("compression", "uncompressed").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    blobs = spark.read.schema(_BLOBS).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, raw in zip(*(batch.column(k).to_pylist() for k in range(2)), batch.column(2), strict=True):
                blob = Blob(raw.as_py())
                ends = blob.ends.all()
                starts = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else ends
                crc = [tokens.crc32(blob.ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = blob.n
                yield pa.RecordBatch.from_arrays([pa.array(blob.doc_ids(), pa.int64()), pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())], ["doc_id", "part", "seq", "local", "n_tokens", "ids_crc32"])

    docs = blobs.select("part", "seq", "blob").mapInArrow(decode, _ROWS)
    sizes = blobs.select("part", "seq", "n_tokens")
    # One row a partition of the writer at most; blobs within a partition are summed apart.
    before = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.withColumn("within", within).join(before.select("part", "before"), "part").select("part", "seq", (F.coalesce("before", F.lit(0)) + F.coalesce("within", F.lit(0))).alias("base"))
    if sizes.count() <= 200_000:  # else the join shuffles
        base = F.broadcast(base)
    return docs.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_index(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write a store in the shared folder and return what reading it back gives for each document."""
    spark = docs.sparkSession
    path = f"{Scratch(spark, 'tokens').root}/store"
    write_tokens(docs, path, tokenizer, end_id)
    return read_index(spark, path)

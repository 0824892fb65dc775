"""Removal of repeated byte strings by prefix-free parsing.

Every string of ``size`` bytes that starts in two places (overlaps and the same document included) is found, and every
byte it covers is removed. Rolling-hash triggers parse the texts: the trigger of a string is the position whose
``gram``-byte rolling hash is least among those inside the string, so equal strings have equal triggers at equal
places, and all strings with one trigger form one *phrase* of the text. Phrases are the dictionary, a document is the
sequence of its phrases (the parse). Neighbouring phrases overlap by ``size`` - 1 bytes, so every string of ``size`` bytes
lies in one phrase, and the order of the corpus' suffixes by their first ``size`` bytes combines from the two parts:

* the parse gives each phrase its count (by 128 bits of its content). A phrase whose trigger occurs once holds no repeated
  string and is dropped (most of a corpus); one that occurs twice or more is repeated as a whole,
* a phrase that occurs once beside others with its trigger is settled by a suffix array of the dictionary: the suffixes of
  the phrases of its trigger are ranked in the order of their bytes by prefix doubling, up to ``size`` bytes, and a string
  that shares its rank is repeated. Equal ranks are equal bytes. A task holds whole triggers, about ``local`` phrases at a time,
* a trigger with more than ``local`` different phrases is not gathered in a task: its strings are ranked by equality of 128
  bits of hash, counted before they are shuffled, and looked up among salted keys.

Defined results: null or empty text: 0 bytes, digest of the empty string; texts shorter than ``size``: kept whole;
repeated rows are each other's repeats; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.kernels import U, mix, powers, prefix_hash, range_hash, signed, slices
from quillon.llm.native_text import text_of
from quillon.llm.scratch import Scratch

GRAM = 256
_POS = 24
_ROW = "trigger long, phrase long, proof long, uid long, lo int, span int"
_PHRASE = ["trigger", "phrase", "proof"]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` values, in linear time."""
    n = len(x)
    pad = -n % w
    full = np.concatenate((x, np.full(pad, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def phrases(h: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, trigger) of each phrase of one text with gram hashes ``h``: the strings that start in the range share the trigger."""
    w = size - gram + 1
    starts = len(h) - w + 1
    step = (1 << _POS) - w
    out = []
    for a in range(0, starts, step):  # a trigger depends on its string alone, so long texts are cut with an overlap
        part = h[a : a + step + w - 1]
        packed = (part & ~U((1 << _POS) - 1)) | np.arange(len(part), dtype=U)
        out.append((sliding_min(packed, w) & U((1 << _POS) - 1)).astype(np.int64) + a)
    at = np.concatenate(out)
    head = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return head, np.append(head[1:], len(at)) - 1, at[head]


def parse(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """One row for each phrase: hash of its trigger, of the phrase, its document and place."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column(0).to_numpy()
            for i, j, data, off in slices(batch.column(1)):
                long = np.flatnonzero(np.diff(off) >= size)
                if not len(long):
                    continue
                prefix, second = prefix_hash(data), prefix_hash(data, 1)
                _, inv = powers(len(data) + 1)
                h = mix((prefix[gram:] - prefix[:-gram]) * inv[: len(data) - gram + 1])
                parts = []
                for k in long.tolist():
                    a, b = int(off[k]), int(off[k + 1])
                    lo, hi, at = phrases(h[a : b - gram + 1], size, gram)
                    body = range_hash(prefix, lo + a, hi + a + size)
                    name = mix(body + (at - lo).astype(U) * U(0x9E3779B97F4A7C15))
                    proof = range_hash(second, lo + a, hi + a + size, 1)
                    parts.append((h[at + a], name, proof, np.full(len(lo), uid[i + k], np.int64), lo, hi - lo))
                cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array(signed(c)) for c in cols[:3]), pa.array(cols[3]), *(pa.array(c.astype(np.int32)) for c in cols[4:])], [f.split()[0] for f in _ROW.split(", ")])

    return docs.select("uid", "text").mapInArrow(read, _ROW)


def suffix_ranks(data: np.ndarray, size: int) -> np.ndarray:
    """Rank of the ``size`` bytes at each position in the order of bytes, by prefix doubling: equal where the bytes are equal.

    Ranks of positions with fewer bytes behind them mean nothing.
    """
    n, width = len(data), 8 if size >= 8 else 1
    key = np.concatenate((data, np.zeros(width, np.uint8))).astype(U)
    word = np.zeros(n, U)
    for k in range(width):
        word = word << U(8) | key[k : n + k]
    rank = np.unique(word, return_inverse=True)[1].astype(U)
    while width < size:
        step = min(width, size - width)
        ahead = np.concatenate((rank[step:], np.zeros(step, U)))[:n]
        rank = np.unique(rank << U(32) | ahead, return_inverse=True)[1].astype(U)
        width += step
    return rank


def phrase_bodies(texts: DataFrame, size: int) -> DataFrame:
    """(trigger, uid, lo, asks, body) for every listed phrase. texts: uid, text, found (trigger, lo, span, asks)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, texts_, found = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            for k in range(batch.num_rows):
                raw, rows = texts_[k].as_py().encode(), found[k].as_py()
                for i in range(0, len(rows), 1000):
                    part = rows[i : i + 1000]
                    bodies = [raw[r["lo"] : r["lo"] + r["span"] + size] for r in part]
                    cols = pa.array([r["trigger"] for r in part]), pa.array([uids[k]] * len(part)), pa.array([r["lo"] for r in part], pa.int32()), pa.array([r["asks"] for r in part]), pa.array(bodies, pa.binary())
                    yield pa.RecordBatch.from_arrays(list(cols), ["trigger", "uid", "lo", "asks", "body"])

    return texts.select("uid", "text", "found").mapInArrow(read, "trigger long, uid long, lo int, asks boolean, body binary")


def ranked_repeats(bodies: DataFrame, size: int, local: int) -> DataFrame:
    """(uid, lo, hi): repeated strings of asking phrases, by the suffix array of the phrases of their triggers."""

    def settle(rows: pa.Table) -> pa.RecordBatch:
        body = rows.column("body").to_pylist()
        ends = np.cumsum([len(x) for x in body])
        starts = ends - [len(x) for x in body]
        rank = suffix_ranks(np.frombuffer(b"".join(body), np.uint8), size)
        inside = np.concatenate([np.arange(a, b - size + 1) for a, b in zip(starts, ends, strict=True)])
        counts = np.bincount(rank[inside].astype(np.int64))
        uid, lo, hi = [], [], []
        asks = rows.column("asks").to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(asks).tolist():
            again = np.flatnonzero(counts[rank[starts[k] : ends[k] - size + 1].astype(np.int64)] > 1)
            if len(again):
                runs = np.split(again, np.flatnonzero(np.diff(again) > 1) + 1)
                uid += [rows.column("uid")[k].as_py()] * len(runs)
                lo += [rows.column("lo")[k].as_py() + int(r[0]) for r in runs]
                hi += [rows.column("lo")[k].as_py() + int(r[-1]) + size for r in runs]
        return pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["uid", "lo", "hi"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.table(batch) if held is None else pa.concat_tables([held, pa.table(batch)])
            if len(held) < local:
                continue
            trigger = held.column("trigger").to_numpy()
            heads = np.flatnonzero(np.concatenate(([True], trigger[1:] != trigger[:-1])))
            at = 0
            for a, b in zip(heads, [*heads[1:].tolist(), None], strict=True):  # whole triggers, the last one may go on
                if b is None:
                    held = held.slice(at)
                elif b - at >= local:
                    yield settle(held.slice(at, int(b) - at))
                    at = int(b)
        if held is not None and len(held):
            yield settle(held)

    near = bodies.repartition("trigger").sortWithinPartitions("trigger")
    return near.mapInArrow(read, "uid long, lo int, hi int")


def suffix_hashes(texts: DataFrame, size: int) -> DataFrame:
    """(prefix, proof, uid, start, asks) for every string of the listed phrases. texts: uid, text, found (lo, span, asks)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, found = batch.column(0).to_pylist(), batch.column(2)
            for i, _, data, off in slices(batch.column(1)):
                prefix, second = prefix_hash(data), prefix_hash(data, 1)
                for k in range(len(off) - 1):
                    rows = found[i + k].as_py()
                    starts = np.concatenate([np.arange(r["lo"], r["lo"] + r["span"] + 1) for r in rows])
                    asks = np.repeat([r["asks"] for r in rows], [r["span"] + 1 for r in rows])
                    a = starts + off[k]
                    h, proof = range_hash(prefix, a, a + size), range_hash(second, a, a + size, 1)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(signed(proof)), pa.array(np.full(len(h), uids[i + k], np.int64)), pa.array(starts.astype(np.int32)), pa.array(asks)], ["prefix", "proof", "uid", "start", "asks"])

    return texts.select("uid", "text", "found").mapInArrow(read, "prefix long, proof long, uid long, start int, asks boolean")


def cut(text: bytes, lo: list[int], hi: list[int]) -> tuple[int, int, str]:
    """(bytes removed, runs removed, digest of the rest) for ranges in any order."""
    digest, removed, runs, end = hashlib.sha256(), 0, 0, -1
    for a, b in sorted(zip(lo, hi, strict=True)):
        if a > end:
            digest.update(text[max(end, 0) : a])
            runs += 1
            removed += b - a
            end = b
        elif b > end:
            removed += b - end
            end = b
    digest.update(text[max(end, 0) :])
    return removed, runs, digest.hexdigest()


def repeated_ranges(docs: DataFrame, size: int, gram: int, local: int, salts: int, scratch: Scratch) -> DataFrame:
    """(uid, lo, hi): ranges that repeated strings cover. docs: uid, text."""
    rows = scratch.table(parse(docs, size, gram), "parse")
    triggers = rows.groupBy("trigger").agg(F.count(F.lit(1)).alias("n"), *(f(F.struct("phrase", "proof")).alias(x) for f, x in ((F.min, "p"), (F.max, "q")))).where("n > 1")
    triggers = scratch.table(triggers.select("trigger", (F.col("p") != F.col("q")).alias("several")), "triggers")
    live = scratch.table(rows.join(triggers, "trigger"), "live")
    scratch.drop(rows, triggers)
    entries = live.groupBy(*_PHRASE).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "lo", "span")).alias("at"), F.first("several").alias("several"))
    entries = scratch.table(entries, "dictionary")
    salt = lambda *c: F.pmod(F.xxhash64(*c), F.lit(salts)).cast("int").alias("salt")
    each = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    many = entries.where("n > 1").select(*_PHRASE, each)
    whole = live.select("*", salt("uid", "lo")).join(many, [*_PHRASE, "salt"])
    whole = whole.select("uid", "lo", (F.col("lo") + F.col("span") + size).alias("hi"))
    # within the dictionary: phrases that occur once beside others of their trigger
    asking = entries.where("several").groupBy("trigger").agg(F.min("n").alias("least"), (F.count(F.lit(1)) > local).alias("large")).where("least = 1")
    found = entries.where("several").join(asking, "trigger")
    one = F.struct("trigger", F.col("at.lo").alias("lo"), F.col("at.span").alias("span"), (F.col("n") == 1).alias("asks"))
    found = scratch.table(found.select(F.col("at.uid").alias("uid"), "large", one.alias("one")), "open")

    def wanted(large: bool) -> DataFrame:
        lists = found.where(F.col("large") == large).groupBy("uid").agg(F.collect_list("one").alias("found"))  # phrases of one text
        return docs.join(lists.hint("shuffle_hash"), "uid").select("uid", "text", "found")

    part = ranked_repeats(phrase_bodies(wanted(False), size), size, local)
    out = whole.union(part)
    if not found.where("large").isEmpty():
        hashes = scratch.table(suffix_hashes(wanted(True), size), "hashes")
        twice = hashes.groupBy("prefix", "proof").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("prefix", "proof", each)
        hit = hashes.where("asks").select("*", salt("uid", "start")).join(twice, ["prefix", "proof", "salt"])
        out = out.union(hit.select("uid", F.col("start").alias("lo"), (F.col("start") + size).alias("hi")))
    ranges = scratch.table(out, "ranges")
    scratch.drop(live, entries, found)
    return ranges


def remove_repeats(docs: DataFrame, size: int = 400, gram: int = GRAM, local: int = 1024, salts: int = 4) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; further n_kept (bytes that remain) and has_repeats.

    local: phrases of triggers that a task ranks at a time; salts: tasks among which a repeated phrase or string is spread.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    texts = texts.withColumn("uid", F.xxhash64("doc_id", "text"))
    ranges = repeated_ranges(texts.select("uid", "text"), size, gram, local, salts, scratch)
    lists = ranges.groupBy("uid").agg(F.collect_set(F.struct("lo", "hi")).alias("found"))  # ranges of one text
    lists = lists.select("uid", F.col("found.lo").alias("los"), F.col("found.hi").alias("his"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts_ = [t.as_py().encode() for t in part.column(1)]
                out = [cut(t, lo or [], hi or []) for t, lo, hi in zip(texts_, part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts_], pa.int64()), *(pa.array([o[c] for o in out], t) for c, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.string()))), pa.array([len(t) - o[0] for t, o in zip(texts_, out, strict=True)], pa.int64()), pa.array([o[0] > 0 for o in out], pa.bool_())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept", "has_repeats"])

    joined = texts.join(lists.hint("shuffle_hash"), "uid", "left").select("doc_id", "text", "los", "his")
    return joined.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long, has_repeats boolean")

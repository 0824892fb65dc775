"""N-gram Jaccard self-join by token-combination prefixes, and the components of its links.

A document is its set of distinct ``size``-word shingles, hashed to 64 bits; equal sets are one *set* from then on
(named by a 64-bit sum over its shingles), so exact copies cost one row each. Sets of a shingles link when
``100 * shared >= percent * union``; so a set may miss at most ``a * (100 - percent) / 100`` of its shingles in a partner.

Signatures. Shingles are ordered by hash. A set's prefix is extended until the credit it has collected exceeds the
shingles it may miss: a rare shingle is indexed alone and is worth 1; a frequent one belongs to a class in which only
combinations of k shingles are indexed (2, or 4 for very frequent ones), spread over enough subclasses for the number of
combinations to stay near the length of the prefix, and is worth 1 from the k-th of its subclass on. Whichever shingles
a partner lacks, a combination remains that both prefixes hold. A set that may miss none may still be part of a larger
one, and is worth 1; a set too small for the credit it needs has all its combinations and each shingle alone. Frequencies come from counters over all documents, in a
table of fixed size: where shingles share a counter they are only thought more frequent.

Candidates. Every signature is filed under its pivot, the set of it that hashes least, and each set once under each of
its pivots, so two sets that share a signature meet under that signature's pivot. Near copies share hundreds of
signatures but few pivots: a group of thousands costs rows in proportion to its size. Sets of a small pivot group go on
only where folded bucket counts don't already bound the shared shingles of a pair too low (the bound is exact); a larger
group is verified by one matrix product of its sets, and what leaves it is a spanning star of each linked part, never its
pairs. A group beyond a block of bounded size is first held against a few of its sets, which ties a tight group together
at a cost in proportion to its size; then it is cut into blocks by the parts so found, and only pairs of blocks that may
still hold an unknown link are verified, none within one part.

A document is known by its doc_id and a hash of its text, so rows without doc_id and different texts under one doc_id link
like any others; a text fetched for verification is hashed to its set again before it counts.

Defined results: null text, or none but white space: empty set, linked with nothing; fewer words than ``size``: the
whole sequence is one shingle; repeated rows are separate documents with one set; null doc_ids are kept, their component
is null unless a linked document has an id; different texts under one doc_id are separate documents, each with the
component of its own text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.components import components
from quillon.llm.kernels import _K, U, mix, shingles, signed, slices
from quillon.llm.scratch import Scratch
from quillon.llm.workers import lean

#: Counters of the frequency table: a byte each while they are counted, two bits once classed; whatever the corpus.
BITS = 26
#: A shingle counted more often than RARE belongs to the frequent class, above FREQUENT to the very frequent one.
RARE, FREQUENT = 2, 64
CELLS = 1 << BITS
SLICES = 32
#: Bits of the table of documents whose texts are asked for; where it fills up, more texts are shuffled, none is lost.
LISTED = 1 << 26
_DOCS = "doc_id long, mark long, set_id long, n long, folded binary, cells binary, slice int"
_COLUMNS = [f.split()[0] for f in _DOCS.split(", ")]
BUCKET = 1.25


def set_id(u: np.ndarray) -> int:
    """Name of a set: a sum over its members, so the order doesn't matter."""
    return int(signed(mix(np.array([mix(u ^ U(0x5851F42D4C957F2D)).sum() + U(len(u))], U)))[0])


def folded(u: np.ndarray) -> bytes:
    """Counts of members by their low bits, in about one bucket for every two members (a power of two)."""
    n = 1 << max(4, (len(u) - 1).bit_length() - 1)
    while (c := np.bincount((u & U(n - 1)).astype(np.int64), minlength=n)).max() > 255:
        n *= 2
    return c.astype(np.uint8).tobytes()


def shared_bound(x: bytes, y: bytes) -> int:
    """At most so many members are shared."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) > len(b):
        a, b = b, a
    if len(b) > len(a):
        b = b.reshape(-1, len(a)).sum(axis=0, dtype=np.int64)
    return int(np.minimum(a, b).sum(dtype=np.int64))


def linked(shared: int, a: int, b: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def missing(n: int, percent: int) -> int:
    """How many members a set of n may miss in a linked one."""
    return n - -(-n * percent // 100)


def alone(n: int, percent: int) -> bool:
    """Whether a set of n links with none but its equals: it may miss a member, or a larger one hold it, if this is false."""
    return n * 100 // percent <= n


def classed(counts: np.ndarray) -> np.ndarray:
    """Frequency classes 0 to 2 of counts, four to a byte."""
    c = ((counts > RARE).astype(np.uint8) + (counts > FREQUENT)).reshape(-1, 4)
    return c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6


class Signatures:
    """Signatures of a set; ``classes`` is a table from ``classed`` over all cells of hashes."""

    def __init__(self, classes: np.ndarray, percent: int) -> None:
        self.classes, self.percent = classes, percent
        self.picks = {}

    def pick(self, n: int, k: int) -> np.ndarray:
        if (n, k) not in self.picks:
            self.picks[n, k] = np.array(list(itertools.combinations(range(n), k)), np.int64).reshape(-1, k)
        return self.picks[n, k]

    def buckets(self, n: int) -> list[int]:
        """Size buckets in which a set of n meets every partner: its own, and that of its longest partner."""
        at = lambda x: int(math.log(x) / math.log(BUCKET) + 1e-9)
        return sorted({at(n), at(n * 100 // self.percent)})

    def of(self, u: np.ndarray) -> np.ndarray:
        """All signatures of the sorted set ``u``; none where only an equal set can link."""
        if alone(len(u), self.percent):
            return np.zeros(0, U)
        out = [self.within(u, b, missing(len(u), self.percent) + 1) for b in self.buckets(len(u))]
        return np.unique(np.concatenate(out))

    def within(self, u: np.ndarray, bucket: int, need: int) -> np.ndarray:
        typical = BUCKET**bucket * (100 - self.percent) / 100
        parts = {2: max(1, round(typical * 0.5)), 4: max(1, round(typical * 0.5))}
        w = 3 * need + 12
        while True:
            p = u[:w]
            cell = (p >> U(64 - BITS)).astype(np.int64)
            k = 1 << (self.classes[cell >> 2] >> ((cell & 3) << 1).astype(np.uint8) & 3).astype(np.int64)
            sub = np.full(len(p), -1, np.int64)
            spread = mix(p ^ U(0xA24BAED4963EE407)) >> U(33)
            for kk, c in parts.items():
                here = k == kk
                sub[here] = (spread[here] % U(c)).astype(np.int64) + (kk << 40)
            order = np.argsort(sub, kind="stable")
            s = sub[order]
            head = np.concatenate(([True], s[1:] != s[:-1]))
            first = np.flatnonzero(head)
            rank = np.empty(len(p), np.int64)
            rank[order] = np.arange(len(p)) - first[np.cumsum(head) - 1]
            credit = np.cumsum((k == 1) | (rank >= k - 1))
            cut = int(np.searchsorted(credit, need))
            if cut < len(p) or w >= len(u):
                break
            w *= 2
        p, k, sub = p[: cut + 1], k[: cut + 1], sub[: cut + 1]
        singly = p if cut == len(credit) else p[k == 1]  # the whole set where its credit stays below need
        out = [mix(singly * _K[0] + U(1))]
        order = np.argsort(sub, kind="stable")
        order = order[sub[order] >= 0]
        if len(order):
            s = sub[order]
            first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            size = np.diff(np.append(first, len(s)))
            kinds = k[order[first]]
            salt = U(bucket * 16 + 7)
            for kk in (2, 4):
                for n in np.unique(size[(kinds == kk) & (size >= kk)]).tolist():
                    heads = first[(kinds == kk) & (size == n)]
                    members = p[order[heads[:, None] + np.arange(n)]]
                    combos = members[:, self.pick(n, kk)]
                    out.append(mix((combos * np.array(_K[:kk], U)).sum(axis=2, dtype=U).ravel() * _K[4] + salt))
        return np.concatenate(out)


def _columns(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text) and text; a null text is an empty one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def first_pass(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Document rows (doc_id, mark, set_id, n, folded), and each task's counters of prefix shingles in slices (cells, slice)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.uint8)
        for batch in batches:
            keys, marks = batch.column(0), batch.column(1)
            for i, j, data, off in slices(batch.column(2)):
                ids, ns, folds, heads = [], [], [], []
                for u in shingles(data, off, size):
                    ids.append(set_id(u))
                    ns.append(len(u))
                    folds.append(folded(u) if len(u) else b"")
                    if not alone(len(u), percent):
                        may = missing(len(u), percent)
                        heads.append(u[: may + may // 4 + 6])
                if heads:
                    at, more = np.unique(np.concatenate(heads) >> U(64 - BITS), return_counts=True)
                    counts[at.astype(np.int64)] = np.minimum(counts[at.astype(np.int64)] + more, 255).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), marks.slice(i, j - i), pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(folds, pa.binary()), pa.nulls(j - i, pa.binary()), pa.nulls(j - i, pa.int32())], _COLUMNS)
        step = CELLS // SLICES
        for s in range(SLICES):
            part = counts[s * step : (s + 1) * step]
            at = np.flatnonzero(part)
            if len(at):
                packed = (at.astype(np.uint32) << np.uint32(8)) | part[at].astype(np.uint32)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(4)), pa.nulls(1, pa.binary()), pa.array([packed.tobytes()], pa.binary()), pa.array([s], pa.int32())], _COLUMNS)

    return _columns(docs).mapInArrow(lean(read), _DOCS)


def counters(rows: DataFrame, scratch: Scratch) -> np.ndarray:
    """The table of frequency classes: ``CELLS / 4`` bytes reach the driver."""

    def add(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in table:
            for s, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total = sums.setdefault(s, np.zeros(CELLS // SLICES, np.uint8))
                packed = np.frombuffer(cells.as_buffer(), np.uint32)
                at = packed >> np.uint32(8)
                total[at] = np.minimum(total[at].astype(np.uint16) + (packed & np.uint32(255)).astype(np.uint16), 255).astype(np.uint8)
        for s, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([classed(total).tobytes()], pa.binary())], ["slice", "cells"])

    summed = rows.where("slice is not null").select("slice", "cells").repartition(SLICES, "slice").mapInArrow(lean(add), "slice int, cells binary")
    out = np.zeros(CELLS // 4, np.uint8)
    step = CELLS // SLICES // 4
    summed = scratch.table(summed, "classes")  # the shuffle of all tasks' counters goes with it
    got = summed.toArrow()
    scratch.drop(summed)
    for s, cells in zip(got.column("slice").to_pylist(), got.column("cells"), strict=True):
        out[s * step : (s + 1) * step] = np.frombuffer(cells.as_buffer(), np.uint8)
    return out


def signature_rows(docs: DataFrame, shared: Broadcast, size: int, percent: int) -> DataFrame:
    """(sig, set_id, n) of every set, once a task. shared: the frequency table."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen = Signatures(shared.value, percent), set()
        for batch in batches:
            for _, _, data, off in slices(batch.column(0)):
                sigs, ids, ns = [], [], []
                for u in shingles(data, off, size):
                    if len(u) and (name := set_id(u)) not in seen:
                        seen.add(name)
                        got = make.of(u)
                        sigs.append(got)
                        ids.append(np.full(len(got), name, np.int64))
                        ns.append(np.full(len(got), len(u), np.int32))
                if sigs:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(sigs))), pa.array(np.concatenate(ids)), pa.array(np.concatenate(ns))], ["sig", "set_id", "n"])

    return _columns(docs).select("text").mapInArrow(lean(read), "sig long, set_id long, n int")


def bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (pivot, a, b) those that the folded counts don't rule out. sets: set_id, n, folded."""
    x = sets.select(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("folded").alias("fa"))
    y = sets.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("folded").alias("fb"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, fa, fb = (batch.column(k) for k in range(3, 7))
            ok = [linked(min(shared_bound(p.as_py(), q.as_py()), m, n), m, n, percent) for p, q, m, n in zip(fa, fb, na.to_pylist(), nb.to_pylist(), strict=True)]
            yield batch.select([0, 1, 2]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(x, "a").join(y, "b").select("pivot", "a", "b", "na", "nb", "fa", "fb").mapInArrow(lean(keep), "pivot long, a long, b long")


def linked_parts(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels of the left and right sets, equal where a chain of links between the sides joins them (labels index the left)."""
    n, m = len(left), len(right)
    size = np.array([len(u) for u in left + right], np.int64)
    tokens = np.concatenate(left + right)
    row = np.repeat(np.arange(n + m), size)
    _, at, count = np.unique(tokens, return_inverse=True, return_counts=True)
    keep = count[at] > 1
    row, at = row[keep], np.unique(at[keep], return_inverse=True)[1]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    shared = np.zeros((n, m), np.float32)
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, 2048):  # exact: counts stay far below 2**24
        i, j = np.searchsorted(at, [lo, lo + 2048])
        dense = np.zeros((n + m, 2048), np.float32)
        dense[row[i:j], at[i:j] - lo] = 1
        shared += dense[:n] @ dense[n:].T
    total = size[:n, None] + size[None, n:]
    link = (shared * 100 >= percent * (total - shared)) & (shared > 0)
    a, b = np.arange(n), np.full(m, n)
    while True:
        b2 = np.minimum(b, np.where(link, a[:, None], n).min(axis=0))
        a2 = np.minimum(a, np.where(link, b2[None, :], n).min(axis=1))
        if (a2 == a).all() and (b2 == b).all():
            return a, b
        a, b = a2, b2


def listed(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, Broadcast]:
    """doc_id, mark and text of the documents named in ``wanted`` (its_id, its_mark), and of few others; and the table that
    tells, to be freed at the end. A text that nobody asks for is passed over where it is read, and never shuffled.
    """
    width = LISTED // SLICES
    spot = lambda *c: F.pmod(F.xxhash64(*c), F.lit(LISTED))

    def fill(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        for batch in rows:
            at = batch.column(0).to_numpy()
            for s in np.unique(at // width).tolist():
                bits.setdefault(s, np.zeros(width, bool))[at[at // width == s] % width] = True
        for s, row in bits.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(row).tobytes()], pa.binary())], ["slice", "bits"])

    at = wanted.select(spot("its_id", "its_mark").alias("at")).repartition(SLICES, F.expr(f"at div {width}"))
    table = np.zeros(LISTED // 8, np.uint8)
    got = at.mapInArrow(lean(fill), "slice int, bits binary").toArrow()  # LISTED / 8 bytes at most reach the driver
    for s, bits in zip(got.column("slice").to_pylist(), got.column("bits"), strict=True):
        table[s * width // 8 : (s + 1) * width // 8] = np.frombuffer(bits.as_buffer(), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            at = batch.column(3).to_numpy()
            asked = bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
            yield batch.select([0, 1, 2]).filter(pa.array(asked.astype(bool)))

    rows = _columns(docs).select("doc_id", "mark", "text", spot("doc_id", "mark").alias("at"))
    return rows.mapInArrow(lean(keep), "doc_id long, mark long, text string"), shared


def verified(members: DataFrame, sets: DataFrame, docs: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join what is linked within each group. members: set_id, group (pivot, i, j), left, right: which side of it."""
    seats = members.groupBy("set_id").agg(F.collect_list(F.struct("pivot", "i", "j", "left", "right")).alias("seats"))  # as many as a set has signatures at most
    wanted = sets.select("set_id", F.col("holder.doc_id").alias("its_id"), F.col("holder.mark").alias("its_mark")).join(seats, "set_id")
    wanted = scratch.table(wanted, "wanted")
    found, shared = listed(docs, wanted)
    rows = found.join(wanted.hint("shuffle_hash"), found["doc_id"].eqNullSafe(F.col("its_id")) & (found["mark"] == F.col("its_mark"))).select("set_id", "text", "seats")

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # repeated rows of a holder come to one task
        for batch in batches:
            ids, seats_ = batch.column(0).to_pylist(), batch.column(2)
            for i, _, data, off in slices(batch.column(1)):
                for k, u in enumerate(shingles(data, off, size)):
                    if ids[i + k] in seen or set_id(u) != ids[i + k]:
                        continue
                    seen.add(ids[i + k])
                    places, body = seats_[i + k].as_py(), u.tobytes()
                    for c in range(0, len(places), 64):
                        part = places[c : c + 64]
                        n = len(part)
                        cols = [pa.array([x[f] for x in part], t) for f, t in (("pivot", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("left", pa.bool_()), ("right", pa.bool_()))]
                        yield pa.RecordBatch.from_arrays([*cols, pa.array([ids[i + k]] * n, pa.int64()), pa.array([body] * n, pa.binary())], ["pivot", "i", "j", "left", "right", "set_id", "body"])

    seated = rows.mapInArrow(lean(seat), "pivot long, i long, j long, left boolean, right boolean, set_id long, body binary")

    def check(table):
        ids = table.column("set_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        order = order[np.concatenate(([True], ids[order][1:] != ids[order][:-1]))]
        sides = []
        for name in ("left", "right"):
            on = table.column(name).to_numpy(zero_copy_only=False)
            at = [k for k in order.tolist() if on[k]]
            sides.append((ids[at], [np.frombuffer(table.column("body")[k].as_buffer(), U) for k in at]))
        (x, left), (y, right) = sides
        if not left or not right:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        a, b = linked_parts(left, right, percent)
        names = np.append(x, 0)
        pairs = np.concatenate((np.stack((x, names[a])), np.stack((y[b < len(x)], names[b[b < len(x)]]))), axis=1)
        pairs = pairs[:, pairs[0] != pairs[1]]
        return pa.table({"a": pa.array(pairs[0]), "b": pa.array(pairs[1])})

    links = scratch.table(seated.groupBy("pivot", "i", "j").applyInArrow(check, "a long, b long"), "links")
    shared.destroy()
    scratch.drop(wanted)
    return links


def by_parts(seats: DataFrame, groups: DataFrame, verify, block_sets: int, block_shingles: int, heads: int, scratch: Scratch) -> tuple[DataFrame, DataFrame] | None:
    """Of groups beyond a block: the links of every set with ``heads`` sets of its group, and the members of blocks to verify then.

    Blocks hold sets of one part (as far as the links tie sets together) or of small parts; blocks of one part make no pair.
    """
    spot = lambda *c: F.xxhash64(*c)  # noqa: E731  names a block
    big = seats.join(groups.where("blocks > 1").select("pivot", "blocks"), "pivot")
    big = scratch.table(big.withColumn("mine", F.pmod(F.xxhash64("set_id", F.lit(5)), F.col("blocks"))), "big")
    if big.isEmpty():
        return None
    least = [F.min(F.struct(F.xxhash64("set_id", F.lit(100 + r)).alias("h"), "set_id")).alias(f"r{r}") for r in range(heads)]
    chosen = big.groupBy("pivot", "blocks").agg(*least)
    few = chosen.select("pivot", "blocks", F.explode(F.array_distinct(F.array(*(F.col(f"r{r}.set_id") for r in range(heads))))).alias("set_id"))
    yes, no = F.lit(True), F.lit(False)
    left = few.select("set_id", "pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("j"), yes.alias("left"), no.alias("right"))
    right = big.select("set_id", "pivot", F.col("mine").alias("j"), no.alias("left"), yes.alias("right"))
    both = left.union(right).groupBy("set_id", "pivot", "j").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    links = verify(scratch.table(both.select("set_id", "pivot", F.lit(-1).cast("long").alias("i"), "j", "left", "right"), "heads"))

    comp = scratch.table(components(links, scratch), "head-parts").withColumnRenamed("node", "set_id")
    named = big.join(comp, "set_id", "left")
    part = named.groupBy("pivot", "component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("shingles"))
    own = F.col("component").isNotNull() & (F.col("k") * 2 > block_sets)
    part = scratch.table(part.select("pivot", "component", "k", "shingles", own.alias("own"), F.when(own, F.col("component")).otherwise(0).alias("cls")), "parts")
    cuts = F.ceil(F.greatest(F.sum("k") / block_sets, F.sum("shingles") / block_shingles)).cast("long")
    classes = scratch.table(part.groupBy("pivot", "own", "cls").agg(cuts.alias("cuts")), "classes")
    same = (F.col("x.pivot") == F.col("y.pivot")) & F.col("x.component").eqNullSafe(F.col("y.component"))
    placed = named.alias("x").join(part.alias("y"), same).select("x.pivot", "x.set_id", "y.own", "y.cls").join(classes, ["pivot", "own", "cls"])
    placed = placed.select("pivot", "set_id", "own", "cls", F.pmod(F.xxhash64("set_id", F.lit(6)), F.col("cuts")).alias("cut"))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    x, y = (classes.select("pivot", F.struct("own", "cls").alias(n), F.col("cuts").alias(f"{n}_cuts")) for n in ("x", "y"))
    across = x.join(y, "pivot").where(F.col("x") < F.col("y")).withColumn("x_cut", each("x_cuts")).withColumn("y_cut", each("y_cuts"))
    within = classes.where(~F.col("own")).select("pivot", F.struct("own", "cls").alias("x"), F.struct("own", "cls").alias("y"), each("cuts").alias("x_cut"), F.col("cuts").alias("y_cuts")).withColumn("y_cut", each("y_cuts")).where("x_cut <= y_cut")
    cols = ["pivot", "x", "x_cut", "y", "y_cut"]
    pairs = across.select(cols).union(within.select(cols))
    pairs = scratch.table(pairs.select("*", spot("x", "x_cut").alias("i"), spot("y", "y_cut").alias("j")), "pairs")
    seat = placed.select("pivot", "set_id", F.struct("own", "cls").alias("c"), "cut")
    at = lambda n: (F.col("p.pivot") == F.col("s.pivot")) & (F.col(f"p.{n}") == F.col("s.c")) & (F.col(f"p.{n}_cut") == F.col("s.cut"))
    twin = (F.col("p.x") == F.col("p.y")) & (F.col("p.x_cut") == F.col("p.y_cut"))
    one = seat.alias("s").join(pairs.alias("p"), at("x")).select("s.set_id", "s.pivot", "p.i", "p.j", yes.alias("left"), twin.alias("right"))
    two = seat.alias("s").join(pairs.alias("p"), at("y")).where(~twin).select("s.set_id", "s.pivot", "p.i", "p.j", no.alias("left"), yes.alias("right"))
    return links, one.union(two)


def linked_documents(docs: DataFrame, size: int, percent: int, small: int, block_sets: int, block_shingles: int, scratch: Scratch, heads: int = 8) -> DataFrame:
    """(doc_id, mark, n, component): the component names a set of linked documents, null for documents without words."""
    rows = scratch.table(first_pass(docs, size, percent), "sets")
    table = docs.sparkSession.sparkContext.broadcast(counters(rows, scratch))  # CELLS / 4 bytes
    of_docs = scratch.table(rows.where("slice is null").select("doc_id", "mark", "set_id", "n", "folded"), "documents")
    scratch.drop(rows)  # with the counters, as large again
    sets = of_docs.where("n > 0").groupBy("set_id").agg(F.min(F.struct("doc_id", "mark")).alias("holder"), F.first("n").alias("n"), F.first("folded").alias("folded"))

    over = "over (partition by sig)"
    found = signature_rows(docs, table, size, percent)
    shared = found.selectExpr("set_id", "n", f"min(struct(xxhash64(set_id) as h, set_id)) {over} as pivot", f"min(set_id) {over} as lo", f"max(set_id) {over} as hi").where("lo <> hi")
    seats = scratch.table(shared.select(F.col("pivot.set_id").alias("pivot"), "set_id", "n").distinct(), "seats")
    table.destroy()  # what it was for is written

    groups = seats.groupBy("pivot").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("m") / block_sets, F.col("shingles") / block_shingles)).cast("int")
    groups = scratch.table(groups.select("pivot", "m", blocks.alias("blocks")), "groups")
    few = seats.join(groups.where(F.col("m") <= small).select("pivot"), "pivot")
    x, y = few.select("pivot", F.col("set_id").alias("a"), F.col("n").alias("p")), few.select("pivot", F.col("set_id").alias("b"), F.col("n").alias("q"))
    pairs = x.join(y, "pivot").where((F.col("a") < F.col("b")) & (F.least("p", "q") * 100 >= F.greatest("p", "q") * percent))
    pairs = pairs.groupBy("a", "b").agg(F.min("pivot").alias("pivot"))
    likely = scratch.table(bounded(pairs, sets, percent), "likely")
    zero = F.lit(0).cast("long")
    one = zero.alias("i"), zero.alias("j"), F.lit(True).alias("left"), F.lit(True).alias("right")
    members = likely.select(F.explode(F.array("a", "b")).alias("set_id"), "pivot").distinct().select("set_id", "pivot", *one)
    members = members.union(seats.join(groups.where((F.col("m") > small) & (F.col("blocks") == 1)).select("pivot"), "pivot").select("set_id", "pivot", *one))

    def verify(rows: DataFrame) -> DataFrame:
        return verified(rows, sets, docs, size, percent, scratch)

    parts = by_parts(seats, groups.where(F.col("m") > small), verify, block_sets, block_shingles, heads, scratch)
    members = scratch.table(members if parts is None else members.union(parts[1]), "members")
    links = verify(members)
    links = links if parts is None else links.union(parts[0])
    scratch.drop(seats, members, likely)
    comp = scratch.table(components(links, scratch), "components")
    named = of_docs.join(comp.withColumnRenamed("node", "set_id"), "set_id", "left")
    return named.select("doc_id", "mark", "n", F.when(F.col("n") > 0, F.coalesce("component", "set_id")).alias("component"))


def jaccard_components(docs: DataFrame, size: int = 3, percent: int = 90, small: int = 24, block_sets: int = 1024, block_shingles: int = 500_000, salts: int = 8) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links.

    small: largest pivot group whose pairs are listed; block_sets, block_shingles: size of a block of a larger one;
    salts: tasks among which a component's documents are spread for its name.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = linked_documents(docs, size, percent, small, block_sets, block_shingles, scratch)
    names = rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("m")).where("m > 1")
    names = names.select("component", "least", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(salts)).cast("int"))
    return salted.join(names, ["component", "salt"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 3, percent: int = 90, small: int = 24, block_sets: int = 1024, block_shingles: int = 500_000) -> DataFrame:
    """Rows of ``docs``, one of each group of linked documents: that with the smallest doc_id (rows without one come
    last), of several texts under it that with the least hash. Rows without words are linked with nothing and all stay.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    found = scratch.table(linked_documents(docs, size, percent, small, block_sets, block_shingles, scratch), "components")
    counted = found.where("component is not null").groupBy("component", "doc_id", "mark").agg(F.count(F.lit(1)).alias("copies"))
    first = counted.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "copies")).alias("k"))
    copies = first.select(F.col("k.doc_id").alias("its_id"), F.col("k.mark").alias("its_mark"), F.col("k.copies").alias("copies"))
    empty = found.where("component is null").groupBy("doc_id", "mark").agg(F.lit(1).cast("long").alias("copies")).toDF("its_id", "its_mark", "copies")
    keep = copies.unionByName(empty)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    packed = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("mark"), F.struct(*docs.columns).alias("row"))
    rows = packed.join(keep.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("its_id")) & (F.col("mark") == F.col("its_mark")))
    repeated = rows.where("copies > 1").select("its_id", "its_mark", "row").dropDuplicates(["its_id", "its_mark"])
    return rows.where("copies = 1").select("row.*").unionByName(repeated.select("row.*"))

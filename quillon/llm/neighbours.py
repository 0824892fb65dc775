"""Nearest neighbours by multiprobe p-stable hashing.

``tables`` hash tables of Gaussian projections of the unit vectors, cut into cells of ``width``; a bucket is a combination
of cells. Every vector is filed in one bucket of each table. A query visits, in every table, the buckets around its own in
order of estimated success (the squared distance from its projections to the bucket's cells, the less the likelier) up to a
distance that is fitted on a sample: that within which ``recall`` of the sample's neighbours lie. Neighbours of a sample
are farther off than those among all rows, so the rest find no fewer. Vectors and queries meet by (table, bucket), each
bucket ranks its vectors exactly for its queries, and the candidates of all buckets are merged.

A bucket with more than ``block`` vectors or ``query_block`` queries is cut into blocks whose pairs are separate groups,
so no bucket gathers in a task and what leaves a group is k rows a query. A query that finds fewer than k vectors, and
every query of a length that the sample holds too few of, visits all buckets of one table instead, which is exact. The
number of projections follows the number of vectors (about ``bucket_rows`` to a bucket).

Defined results: a null vec_id, a null, empty, zero or non-finite vector or one with null components takes no part; vectors
are compared with those of their own length; a query with fewer candidates returns them all; ties go to the smaller
vec_id; every row but the query's own is a candidate, repeated rows too, and each repeated row of a query is a query; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from quillon.llm.kernels import _K, U, mix, signed
from quillon.llm.scratch import Scratch

_VECTOR = "uid long, vec_id long, query boolean, dim int, body binary"
_FILED = "dim int, place int, code long, uid long, vec_id long, body binary"
_FOUND = "query_uid long, query_id long, uid long, vec_id long, score double"
_BUCKET = ["dim", "place", "code"]


class Hashing:
    """The tables for unit vectors of one length."""

    def __init__(self, dim: int, tables: int, projections: int, width: float, seed: int) -> None:
        rng = np.random.default_rng((seed, dim))
        self.a = rng.standard_normal((tables, dim, projections))
        self.b = rng.uniform(0, width, (tables, projections))
        self.tables, self.width = tables, width

    def at(self, unit: np.ndarray, t: int) -> np.ndarray:
        """Projections in units of a cell."""
        return (unit @ self.a[t] + self.b[t]) / self.width

    def codes(self, unit: np.ndarray, t: int) -> np.ndarray:
        """Bucket of each vector."""
        out = np.zeros(len(unit), U)
        for cell in np.floor(self.at(unit, t)).astype(np.int64).T:
            out = mix(out * _K[1] + cell.view(U))
        return signed(out)

    def costs(self, unit: np.ndarray, others: np.ndarray, t: int) -> np.ndarray:
        """Squared distance from each row's projections to the bucket of each of its others (rows x k vectors)."""
        x, cell = self.at(unit, t)[:, None], np.floor(self.at(others, t))
        return ((np.maximum(0, np.maximum(cell - x, x - cell - 1)) * self.width) ** 2).sum(axis=2)

    def probes(self, q: np.ndarray, t: int, most: float) -> np.ndarray:
        """Buckets within ``most`` of one unit vector, in order of estimated success."""
        code, cost = np.zeros(1, U), np.zeros(1)
        reach = int(math.sqrt(most) / self.width) + 1
        moves = np.arange(-reach, reach + 1)
        for x in self.at(q[None], t)[0]:
            home = math.floor(x)
            off = np.maximum(0, np.maximum(home + moves - x, x - home - moves - 1)) * self.width
            cost = (cost[:, None] + off**2).ravel()
            code = mix(code[:, None] * _K[1] + (home + moves).astype(np.int64).view(U)).ravel()
            near = cost <= most
            cost, code = cost[near], code[near]
        return signed(code[np.argsort(cost, kind="stable")])


def usable(rows: DataFrame, is_query, scratch: Scratch) -> tuple[DataFrame, str]:
    """The vectors that take part, each with a number of its own, and the type of their components."""
    single = isinstance(rows.schema["embedding"].dataType.elementType, FloatType)
    kind, cast = ("<f4", "array<float>") if single else ("<f8", "array<double>")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                batch = whole.slice(i, 4096)
                flat = batch.column(3).flatten()
                values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(kind)
                sizes = batch.column(3).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes)
                known = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
                ok = [k for k, (a, b) in enumerate(zip(ends - sizes, ends, strict=True)) if known[k] and b > a and np.isfinite(values[a:b]).all() and values[a:b].any()]
                kept = batch.take(pa.array(ok, pa.int64()))
                bodies = [values[ends[k] - sizes[k] : ends[k]].tobytes() for k in ok]
                yield pa.RecordBatch.from_arrays([*kept.columns[:3], pa.array(sizes[ok], pa.int32()), pa.array(bodies, pa.binary())], ["uid", "vec_id", "query", "dim", "body"])

    query = F.coalesce(is_query, F.lit(False)).alias("query")
    numbered = rows.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), query, F.col("embedding").cast(cast).alias("embedding"))
    return scratch.table(numbered.mapInArrow(read, _VECTOR), "vectors"), kind


def matrix(bodies: pa.Array, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(bodies.to_pylist()), kind).reshape(-1, dim).astype(np.float64)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither huge nor tiny components leave the range of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit(vectors: DataFrame, kind: str, k: int, tables: int, width: float, recall: float, sample: int, bucket_rows: int, seed: int) -> tuple[dict[int, int], dict[int, float]]:
    """For each length the number of projections, and (where the sample tells) how far to probe.

    ``sample`` rows, the first by hash of their number, reach the driver, and a count a length.
    """
    counts = {r["dim"]: r["count"] for r in vectors.groupBy("dim").count().collect()}
    projections = {d: max(2, min(16, round(math.log(max(n / bucket_rows, 1)) / math.log(4)))) for d, n in counts.items()}
    some = vectors.orderBy(F.xxhash64("uid"), "uid").limit(sample).select("dim", "body").toArrow().to_pandas()
    reach = {}
    for dim, rows in some.groupby("dim"):
        if len(rows) < 8 * k:
            continue
        unit = unit_rows(matrix(pa.array(rows["body"]), dim, kind))
        queries = unit[: 4096 // k]
        score = queries @ unit.T
        np.fill_diagonal(score, -np.inf)
        near = np.argpartition(-score, k - 1, axis=1)[:, :k]
        tables_ = Hashing(dim, tables, projections[dim], width, seed)
        cost = np.min([tables_.costs(queries, unit[near.ravel()].reshape(len(queries), k, dim), t) for t in range(tables)], axis=0)
        reach[int(dim)] = float(np.quantile(cost, recall)) + 1e-9
    return projections, reach


def filed(vectors: DataFrame, kind: str, projections: dict[int, int], tables: int, width: float, seed: int, reach: dict[int, float] | None = None) -> DataFrame:
    """Vectors under their bucket in every table; with ``reach``, under every bucket that they visit as queries."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Hashing] = {}
        for whole in batches:
            dims = whole.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                if reach is not None and dim not in reach:
                    continue
                rows = whole.filter(pa.array(dims == dim))
                made[dim] = made.get(dim) or Hashing(dim, tables, projections[dim], width, seed)
                for i in range(0, rows.num_rows, 256):
                    part = rows.slice(i, 256)
                    unit = unit_rows(matrix(part.column(3), dim, kind))
                    for t in range(tables):
                        if reach is None:
                            codes, at = made[dim].codes(unit, t), np.arange(len(unit))
                        else:
                            lists = [made[dim].probes(q, t, reach[dim]) for q in unit]
                            codes, at = np.concatenate(lists), np.repeat(np.arange(len(unit)), [len(x) for x in lists])
                        for j in range(0, len(codes), 4096):
                            c, rest = codes[j : j + 4096], part.take(pa.array(at[j : j + 4096]))
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), x, np.int32)) for x in (dim, t)] + [pa.array(c), rest.column(0), rest.column(1), rest.column(3)], [f.split()[0] for f in _FILED.split(", ")])

    return vectors.select("uid", "vec_id", "dim", "body").mapInArrow(read, _FILED)


def ranked(vectors: pa.Table, queries: pa.Table, k: int, kind: str) -> pa.Table:
    """The k best vectors of one group for each of its queries."""
    columns = [f.split()[0] for f in _FOUND.split(", ")]
    empty = pa.table([pa.array([], pa.int64())] * 4 + [pa.array([], pa.float64())], columns)
    if not len(vectors) or not len(queries):
        return empty
    dim = queries.column("dim")[0].as_py()
    v, q = matrix(vectors.column("body"), dim, kind), matrix(queries.column("body"), dim, kind)
    own, uid, vec_id = queries.column("uid").to_numpy(), vectors.column("uid").to_numpy(), vectors.column("vec_id").to_numpy()
    with np.errstate(all="ignore"):
        vn, qn = np.sqrt((v * v).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    near = unit_rows(q) @ unit_rows(v).T
    near[own[:, None] == uid[None]] = -np.inf
    least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(q), -2.0)
    a, b = np.nonzero((near >= least[:, None] - 1e-9) & (near > -2))  # all that rounding may rank among the k best
    score = np.empty(len(a))
    step = max(1, 2_000_000 // dim)
    for i in range(0, len(a), step):  # the measure itself, the same for a pair wherever it meets
        x, y = a[i : i + step], b[i : i + step]
        with np.errstate(all="ignore"):
            score[i : i + step] = (q[x] * v[y]).sum(axis=1) / (qn[x] * vn[y])
    far = lambda n: ~((n > 1e-150) & (n < 1e150))  # noqa: E731  squares beyond the range of doubles
    lost = far(qn)[a] | far(vn)[b]
    score[lost] = near[a[lost], b[lost]]
    order = np.lexsort((uid[b], vec_id[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    head = np.searchsorted(a, a, "left")
    top = np.arange(len(a)) - head < k
    a, b, score = a[top], b[top], score[top]
    return pa.table([pa.array(own[a]), pa.array(queries.column("vec_id").to_numpy()[a]), pa.array(uid[b]), pa.array(vec_id[b]), pa.array(score)], columns)


def compare(vectors: DataFrame, queries: DataFrame, sizes: DataFrame, k: int, kind: str, block: int, query_block: int, scratch: Scratch) -> DataFrame:
    """The k best of every query (both sides filed by bucket), ranked; sizes: vectors in each bucket."""
    visits = queries.groupBy(*_BUCKET).agg(F.count(F.lit(1)).alias("visits"))
    rows = F.ceil(F.col("n") / block).cast("int").alias("rows")
    cols = F.ceil(F.col("visits") / query_block).cast("int").alias("cols")
    large = scratch.table(sizes.join(visits, _BUCKET).where(f"n > {block} or visits > {query_block}").select(*_BUCKET, rows, cols), "large")
    cut = lambda n, salt: F.pmod(F.xxhash64("uid", F.lit(salt)), F.coalesce(n, F.lit(1))).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    v = vectors.join(large, _BUCKET, "left").select(*vectors.columns, cut(F.col("rows"), 1).alias("i"), each(F.col("cols")).alias("j"))
    q = queries.join(sizes.select(*_BUCKET), _BUCKET, "left_semi").join(large, _BUCKET, "left").select(*queries.columns, each(F.col("rows")).alias("i"), cut(F.col("cols"), 2).alias("j"))
    found = v.groupBy(*_BUCKET, "i", "j").cogroup(q.groupBy(*_BUCKET, "i", "j")).applyInArrow(lambda a, b: ranked(a, b, k, kind), _FOUND)
    once = found.groupBy("query_uid", "query_id", "uid", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid"))
    return once.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def search(rows: DataFrame, is_query, k: int = 5, tables: int = 2, width: float = 1.0, recall: float = 0.97, sample: int = 4096, bucket_rows: int = 512, block: int = 4096, query_block: int = 1024, seed: int = 3) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found to every row of ``rows`` (vec_id, embedding) for which ``is_query`` holds."""
    scratch = Scratch(rows.sparkSession, "neighbours")
    vectors, kind = usable(rows, is_query, scratch)
    projections, reach = fit(vectors, kind, k, tables, width, recall, sample, bucket_rows, seed)
    asked = vectors.where("query")
    in_buckets = filed(vectors, kind, projections, tables, width, seed)
    sizes = scratch.table(in_buckets.groupBy(*_BUCKET).agg(F.count(F.lit(1)).alias("n")), "sizes")
    visits = filed(asked, kind, projections, tables, width, seed, reach)
    found = scratch.table(compare(in_buckets, visits, sizes, k, kind, block, query_block, scratch), "found")
    # too few found: every bucket of the first table, which holds every vector
    full = found.where(F.col("rank") == k).select(F.col("query_uid").alias("uid"))
    short = scratch.table(asked.join(full, "uid", "left_anti"), "short")
    if short.isEmpty():
        return found.select("query_id", "rank", "vec_id", "score")
    whole = sizes.where("place = 0")
    everywhere = short.join(whole.select(*_BUCKET), "dim").select(*(f.split()[0] for f in _FILED.split(", ")))
    exact = compare(in_buckets.where("place = 0"), everywhere, whole, k, kind, block, query_block, scratch)
    kept = found.join(full.withColumnRenamed("uid", "query_uid"), "query_uid", "left_semi").select(exact.columns)
    return kept.union(exact).select("query_id", "rank", "vec_id", "score")

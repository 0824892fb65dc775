"""Language ID by error-correcting output codes over hashed byte n-grams.

Each language gets a binary codeword; for every bit one n-gram classifier holds a weight for each bucket (the log ratio
of the bucket's smoothed share in languages with the bit and in those without it), so all bits are trained by one pass
that counts buckets by language over every training row. A text's margin for a bit is its mean weight; decoding takes
the codeword with the least loss, bits weighted by how well they separate the training languages, and flags a text
whose two best codewords lie close together.

Defined results: null text or one without a letter: ``und`` with score 0, not ambiguous; a text of one byte has no gram
and margin 0; rows with null language are never learned from; with no training rows every text is ``und``; a prediction
rests on its own text alone, so repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.kernels import LOWER, slices

U32 = np.uint32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def codewords(n: int, extra: int = 7, seed: int = 11) -> np.ndarray:
    """``n`` rows of 0/1 bits: exhaustive code for few languages, else random bits of well separated rows."""
    if n <= 2:
        return np.arange(n)[:, None] % 2
    if n <= 5:  # every split of the languages into two sides, once
        cols = [c for c in itertools.product((0, 1), repeat=n) if c[0] == 1 and 0 in c]
        return np.array(cols).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(np.log2(n))) * 2 + extra
    best, gap = None, -1
    for _ in range(200):
        code = rng.integers(0, 2, (n, bits))
        dist = min((code[i] != code[j]).sum() for i, j in itertools.combinations(range(n), 2))
        if dist > gap and all(0 < c < n for c in code.sum(axis=0)):
            best, gap = code, dist
    return best


def grams(data: np.ndarray, off: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of the 2-, 3- and 4-byte gram that starts at each byte, ``buckets`` where it would leave its text: three rows."""
    low = np.concatenate((LOWER[data], np.zeros(3, np.uint8))).astype(U32)
    n = len(data)
    two = low[:n] | (low[1 : n + 1] << U32(8))
    three = two | (low[2 : n + 2] << U32(16))
    four = three | (low[3 : n + 3] << U32(24))
    shift = U32(32 - (buckets.bit_length() - 1))
    out = np.stack([(x * U32(m)) >> shift for x, m in ((two, 2654435769), (three, 2246822519), (four, 3266489917))])
    for back in (1, 2, 3):  # the last bytes of each text start no longer gram
        at = off[1:] - back
        out[back - 1 :, at[at >= off[:-1]]] = buckets
    return out


def gram_count(size: np.ndarray) -> np.ndarray:
    """How many grams texts of so many bytes have."""
    return sum(np.maximum(size - back, 0) for back in (1, 2, 3))


def held_out(key: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


class Decoder:
    """Weights, codewords and bit weights of a fitted model."""

    def __init__(self, labels: list[str], counts: np.ndarray, smooth: float = 0.5) -> None:
        self.labels, self.code = labels, codewords(len(labels)) if labels else np.zeros((0, 0), int)
        # a row a bucket, and one of zeros for grams that a text doesn't have
        self.weights = np.zeros((counts.shape[1] + 1 if len(labels) else 2, self.code.shape[1]), np.float32)
        share = (counts + smooth) / (counts + smooth).sum(axis=1, keepdims=True) if len(labels) else counts
        self.bias = np.zeros(self.code.shape[1])
        self.trust = np.ones(self.code.shape[1])
        for j in range(self.code.shape[1]):
            on = self.code[:, j] == 1
            w = np.log(share[on].mean(axis=0)) - np.log(share[~on].mean(axis=0)) if on.any() and (~on).any() else np.zeros(counts.shape[1])
            means = share @ w  # a language's mean margin
            if on.any() and (~on).any():
                lo, hi = means[~on].max(), means[on].min()
                self.bias[j], self.trust[j] = (lo + hi) / 2, max(hi - lo, 1e-3)
            self.weights[:-1, j] = w

    def decode(self, margin: np.ndarray, sharp: float, ambiguous: float) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Labels, scores and flags of rows of mean margins."""
        scaled = (margin - self.bias) / self.trust * 2  # +-1 at a typical text
        sign = np.where(self.code == 1, 1.0, -1.0)
        loss = (np.logaddexp(0, -scaled[:, None, :] * sign[None] * sharp) * self.trust).sum(axis=2) / self.trust.sum()
        best = loss.argmin(axis=1)
        p = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        order = np.sort(loss, axis=1)
        close = (order[:, 1] - order[:, 0] < ambiguous) if loss.shape[1] > 1 else np.zeros(len(loss), bool)
        return [self.labels[k] for k in best], p.max(axis=1), close


def fit(train: DataFrame, buckets: int = 1 << 15, max_languages: int = 512) -> Decoder:
    """Count buckets by language over all of ``train`` (text, lang) and fit. ``max_languages`` bounds what reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            for i, _, data, off in slices(batch.column(0)):
                if not len(data):
                    continue
                g = grams(data, off, buckets)
                for k in range(len(off) - 1):
                    if off[k + 1] > off[k]:
                        sums = total.setdefault(names[i + k], np.zeros(buckets, np.int64))
                        sums += np.bincount(g[:, off[k] : off[k + 1]].ravel(), minlength=buckets + 1)[:buckets]
        for name, sums in total.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(sums[at])], ["lang", "bucket", "n"])

    rows = train.where(F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    summed = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("cells"))  # `buckets` cells at most
    found = packed.orderBy("lang").limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    counts = np.zeros((len(found), buckets))
    for k, row in enumerate(found):
        cells = np.array([(c[0], c[1]) for c in row["cells"]])
        counts[k, cells[:, 0]] = cells[:, 1]
    return Decoder([r["lang"] for r in found], counts)


def identify(docs: DataFrame, model: Decoder, key: str = "doc_id", sharp: float = 4.0, ambiguous: float = 0.25) -> DataFrame:
    """Per row: key, lang_pred, score, ambiguous. Only the text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x bits floats: a few MB, whatever the corpus

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        buckets, bits = m.weights.shape[0] - 1, m.weights.shape[1]
        for batch in batches:
            keys = batch.column(0)
            for i, j, data, off in slices(batch.column(1)):
                n = j - i
                size = np.diff(off)
                letters = np.zeros(len(data) + 1, np.int64)
                np.cumsum(_ASCII_LETTER[data], out=letters[1:])
                some = letters[off[1:]] > letters[off[:-1]]
                for k in np.flatnonzero(~some & (size > 0)):
                    some[k] = any(map(str.isalpha, data[off[k] : off[k + 1]].tobytes().decode(errors="replace")))
                names, score, flag = ["und"] * n, np.zeros(n), np.zeros(n, bool)
                at = np.flatnonzero(some) if m.labels else np.zeros(0, np.int64)
                if len(at):
                    g = grams(data, off, buckets)
                    margin = np.zeros((n, bits))
                    heads = off[:-1][size > 0]
                    for b in range(bits):
                        w = np.ascontiguousarray(m.weights[:, b])
                        per = w[g[0]] + w[g[1]] + w[g[2]]
                        margin[size > 0, b] = np.add.reduceat(per.astype(np.float64), heads)
                    got, p, close = m.decode(margin[at] / np.maximum(gram_count(size[at]), 1)[:, None], sharp, ambiguous)
                    for k, name in zip(at, got, strict=True):
                        names[k] = name
                    score[at], flag[at] = p, close
                yield pa.RecordBatch.from_arrays([keys.slice(i, n), pa.array(names), pa.array(score), pa.array(flag)], ["doc_id", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(judge, "doc_id long, lang_pred string, score double, ambiguous boolean")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous; learned from rows that aren't held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")

"""Quality rules: surface counts, and a hashed n-gram log-likelihood ratio between trusted and raw text.

Unigrams and bigrams of words are hashed into a fixed number of buckets. The raw multinomial counts every document; the
trusted one counts documents labelled good, at most ``trusted_docs`` of them (the first by hash of their id, a documented
bound), smoothed towards the raw one. A document's score is its mean log ratio over its n-grams; every document is held
against the same fixed threshold. DataFrame functions only; the broadcast ids and weights are bounded by parameters.

Defined results: null or empty text: all counts 0, score null, base_failed; a text of one word has one n-gram; no labels:
every score is 0; repeated rows are judged alike; null doc_ids are kept and never trusted; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.native_text import BLANKS, gram_buckets, hashed, let, literal_array, lookup_sum, repeated, text_of, word_array

BUCKETS = 1 << 14
SYMBOLS = "#*$%&|<>"


def repeat_words(windows: Column) -> Column:
    """Words inside 5-word windows that occur twice or more, from the array of window hashes in text order."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda p, k: F.coalesce(F.get(s, k)["h"] == p["h"], F.lit(False))
        return F.transform(F.filter(s, lambda p, k: same(p, k - 1) | same(p, k + 1)), lambda p: p["i"])

    again = let(pairs, repeated)
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
    step = lambda s, i: F.struct((s["total"] + i + 5 - F.greatest(s["end"], i)).alias("total"), (i + 5).alias("end"))
    return F.aggregate(F.array_sort(again), start, step, lambda s: s["total"])


def counted(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, hashes, the base counts and the columns ``carry``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), *carry)
    rows = rows.withColumn("words", word_array(F.col("text")))
    rows = rows.select("doc_id", "text", F.size("words").alias("size"), hashed(F.col("words")).alias("hashes"), *carry)
    h = F.col("hashes")
    window = lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - 4, F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, 5))))
    rows = rows.withColumn("windows", let(h, window))
    text, win = F.col("text"), F.col("windows")
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.trim(line, F.lit(BLANKS)) != "")
    return rows.select(
        "doc_id",
        "text",
        "hashes",
        F.col("size").cast("long").alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.when(F.instr(text, "\n") > 0, F.size(lines) - F.size(F.array_distinct(lines))).otherwise(0).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct(win)) < F.size(win), repeat_words(win)).otherwise(0).cast("long").alias("n_repeat_words"),
        *carry,
    )


def log_ratios(docs: DataFrame, labels: DataFrame, trusted_docs: int, prior: float) -> list[float]:
    """log(trusted share / raw share) of each bucket; ``BUCKETS`` rows reach the driver."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("trusted_id")).distinct()
    good = good.orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(trusted_docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), hashed(word_array(text_of())).alias("hashes"))
    rows = rows.join(F.broadcast(good), F.col("doc_id") == F.col("trusted_id"), "left")  # at most trusted_docs ids
    grams = rows.select(F.col("trusted_id").isNotNull().cast("long").alias("trusted"), F.explode(gram_buckets(F.col("hashes"), BUCKETS)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("trusted").alias("trusted")).toArrow()
    raw, trusted = [0.5] * BUCKETS, [0.0] * BUCKETS
    for b, r, t in zip(*(counts.column(c).to_pylist() for c in ("bucket", "raw", "trusted")), strict=True):
        raw[b] += r
        trusted[b] += t
    n, t = sum(raw), sum(trusted)
    return [math.log((c + prior * r / n) / (t + prior)) - math.log(r / n) for r, c in zip(raw, trusted, strict=True)]


def judge_quality(docs: DataFrame, labels: DataFrame, threshold: float = -0.15, trusted_docs: int = 20_000, prior: float = 50_000.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score."""
    weights = literal_array(log_ratios(docs, labels, trusted_docs, prior))
    rows = counted(docs, carry)
    grams = F.col("grams")
    total = lookup_sum(grams, weights)
    rows = rows.withColumn("grams", gram_buckets(F.col("hashes"), BUCKETS))
    rows = rows.select("*", F.when(F.size(grams) > 0, total / F.size(grams)).alias("score"))
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    kept = ~failed & (F.coalesce(F.col("score"), F.lit(0.0)) >= threshold)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "score", *carry)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    return repeated(judge_quality(rows, labels, carry=("row",), **options), F.col("kept").cast("int"))

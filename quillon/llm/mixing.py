"""Mixing sources to target weights by soft membership.

A classifier fitted on the labelled table gives every document a posterior over domains; nonnegative document rates are
then fitted so that the expected tokens of each domain match the targets: least squares in the domain totals (whitened
by their Gram matrix, so a step of 1 is the right one), by projected gradient from rate 1, in the metric in which a
token of any document weighs the same (equal posteriors get equal rates). An iteration aggregates a few numbers a domain
over all documents and moves every rate; only those numbers reach the driver. A rate is a function of a document's
posteriors and the steps, so no rates are kept between iterations.

The classifier is naive Bayes over hashed words, fitted on at most ``train_docs`` labelled rows (the first by hash of
their id, a documented bound). Word evidence counts as that of ``evidence`` words at most, so long texts stay soft.

Defined results: null or empty text: the prior, 0 tokens, rate 1; labels missing or null in part: that row isn't learned
from; no labels: uniform posteriors; targets that can't be met: the nearest totals; repeated rows get equal rates; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.native_text import bucket, hashed, literal_array, lookup_sum, repeated, text_of, word_array
from quillon.llm.scratch import Scratch

BUCKETS = 1 << 15
DOMAINS = ("good", "plain", "toxic")


def domain_of() -> Column:
    """Domain number of a labelled row."""
    return F.when(F.col("toxic") == 1, 2).when((F.col("toxic") == 0) & (F.col("quality") == 1), 0).when((F.col("toxic") == 0) & (F.col("quality") == 0), 1)


def fit_domains(docs: DataFrame, labels: DataFrame, train_docs: int, smooth: float = 0.5) -> tuple[list[float], list[list[float]]]:
    """log priors, and log bucket weights of each domain relative to the first."""
    k = len(DOMAINS)
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), domain_of().alias("domain")).where("label_id is not null and domain is not null")
    known = known.groupBy("label_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("label_id"), "label_id").limit(train_docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))  # at most train_docs ids
    words = rows.select("domain", F.explode(hashed(word_array(text_of()))).alias("h")).select("domain", bucket(F.col("h"), BUCKETS).alias("bucket"))
    counts = np.full((k, BUCKETS), smooth)
    got = words.groupBy("domain", "bucket").agg(F.count(F.lit(1)).alias("n")).toArrow()  # domains x buckets rows
    counts[got.column("domain").to_numpy(), got.column("bucket").to_numpy()] += got.column("n").to_numpy()
    prior = np.full(k, 1.0)
    for r in known.groupBy("domain").count().collect():
        prior[r["domain"]] += r["count"]
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    return np.log(prior / prior.sum()).tolist(), (logs - logs[0]).tolist()


def posteriors(docs: DataFrame, model: tuple[list[float], list[list[float]]], evidence: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, p (array of posteriors by domain)."""
    prior, weights = model
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), hashed(word_array(text_of())).alias("hashes"), *carry)
    rows = rows.select("*", F.size("hashes").cast("long").alias("n_tokens"), F.transform("hashes", lambda h: bucket(h, BUCKETS)).alias("buckets"))
    soften = F.least(F.lit(1.0), F.lit(evidence) / F.col("n_tokens"))
    scores = [F.lit(prior[0])]
    for k in range(1, len(prior)):
        table = literal_array(weights[k])
        total = lookup_sum(F.col("buckets"), table)
        scores.append(F.lit(prior[k]) + F.when(F.col("n_tokens") > 0, total * soften).otherwise(0.0))
    rows = rows.select("doc_id", "n_tokens", *carry, F.array(*scores).alias("s"))
    rows = rows.withColumn("e", F.transform("s", lambda x: F.exp(x - F.array_max("s"))))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return rows.select("doc_id", "n_tokens", *carry, F.transform("e", lambda x: x / total).alias("p"))


def rate_of(steps: list[list[float]]) -> Column:
    """The rate after ``steps``: from 1, each step moves it along the posteriors and back to 0 where it would be negative."""
    rate = F.lit(1.0)
    for step in steps:
        move = sum((F.col("p")[j] * F.lit(x) for j, x in enumerate(step)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), rate + move)
    return rate


def fit_steps(table: DataFrame, totals: list[float], rounds: int, tolerance: float) -> list[list[float]]:
    """Steps after which the expected domain tokens of ``table`` (n_tokens, p) are as near ``totals`` as any round came.

    A round aggregates the domain totals, and their Gram matrix over documents whose rate isn't 0. A step whitened by
    that matrix is tried first; where it doesn't bring the totals nearer, the step whitened by the matrix of all documents
    is taken instead, which never leads away.
    """
    k = len(totals)
    p = [F.col("p")[i] for i in range(k)]
    best: list[list[float]] = []
    steps, best_value, scale, full, gap_at_best, ridge = best, math.inf, max(sum(totals), 1.0), None, None, 0.0
    for _ in range(rounds + 1):
        state = table.withColumn("rate", rate_of(steps))
        free = F.when(F.col("rate") > 0, F.col("n_tokens")).otherwise(0)
        sums = [F.sum(p[j] * F.col("rate") * F.col("n_tokens")).alias(f"t{j}") for j in range(k)]
        grams = [F.sum(p[i] * p[j] * free).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
        got = state.agg(*sums, *grams).first()
        gap = np.array(totals) - np.array([got[f"t{j}"] or 0.0 for j in range(k)])
        gram = np.array([[got[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        ridge = ridge or 1e-6 * max(float(np.trace(gram)), 1.0)  # a domain with next to no mass can't be steered
        inverse = np.linalg.inv(gram + ridge * np.eye(k))
        full = inverse if full is None else full
        value = float(gap @ full @ gap)
        if value < best_value:
            best, best_value, gap_at_best = steps, value, gap
            if np.abs(gap).max() <= tolerance * scale:
                break
            steps = [*best, (inverse @ gap).tolist()]
        elif steps[-1] != (again := (full @ gap_at_best).tolist()):
            steps = [*best, again]
        else:
            break
    return best


def mix_to_targets(docs: DataFrame, labels: DataFrame, shares: tuple[float, ...] = (0.70, 0.28, 0.02), budget: float = 1.0, train_docs: int = 20_000, evidence: float = 64.0, rounds: int = 24, tolerance: float = 1e-6, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, n_tokens, p_<domain>, rate.

    shares: target share of each of ``DOMAINS`` in the mixed tokens; budget: mixed tokens as a multiple of the corpus's.
    """
    if len(shares) != len(DOMAINS) or min(shares) < 0 or not math.isclose(sum(shares), 1.0):
        raise ValueError("shares must be nonnegative and sum to 1, one for each domain")
    scratch = Scratch(docs.sparkSession, "mixing")
    model = fit_domains(docs, labels, train_docs)
    table = scratch.table(posteriors(docs, model, evidence), "posteriors")
    tokens = table.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    steps = fit_steps(table, [s * budget * tokens for s in shares], rounds, tolerance)
    rated = posteriors(docs, model, evidence, carry) if carry else table  # carried columns are never written
    return rated.select("doc_id", "n_tokens", *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)), F.when(F.col("n_tokens") == 0, 1.0).otherwise(rate_of(steps)).alias("rate"), *carry)


def resample(docs: DataFrame, labels: DataFrame, shares: tuple[float, ...], budget: float, **options) -> DataFrame:
    """Rows of ``docs``, each as often as its rate says: the whole part, and once more by a hash of the row against the rest."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    rated = mix_to_targets(rows, labels, shares, budget, carry=("row",), **options)
    chance = F.pmod(F.xxhash64(F.col("row.doc_id"), F.col("row.text"), F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return repeated(rated, F.floor(F.col("rate") + chance).cast("int"))

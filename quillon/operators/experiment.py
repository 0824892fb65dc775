"""The detector experiment: folds, samples, an n-gram classifier over word windows, summaries and a paired test."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, IndexToString, Normalizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.spans import claim
from quillon.operators.evaluate import align, iou_pairs, precision_recall
from quillon.operators.noise import dealt, hash_order, words

NEGATIVE = "negativo"
SIZES = (4, 10)


def folds(docs: DataFrame, level: str, key: str, n: int = 5, seed: int = 42) -> DataFrame:
    """``docs`` with fold 0..n-1: each level dealt out in hash order, so folds differ by one document at most."""
    return dealt(docs, level, key, seed).select(*docs.columns, (F.col("rank") % n).cast("long").alias("fold"))


def first_per(rows: DataFrame, group: str, most: int, key: str, seed: int = 42) -> DataFrame:
    """Up to ``most`` rows of each group, in hash order of ``key``: few-shot examples, synthetic instances of a fold."""
    w = Window.partitionBy(group).orderBy(hash_order(key, seed), key)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def test_instances(instances: DataFrame, fold: int, most: int = 3) -> DataFrame:
    """Of one fold all real instances and up to ``most`` synthetic ones. instances: instance_id, kind, fold."""
    mine = instances.where(F.col("fold") == fold)
    return mine.where("kind = 'real'").unionByName(first_per(mine.where("kind <> 'real'"), "fold", most, "instance_id"))


def char_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams within words padded by a space on either side; a padded word shorter than n counts once, whole."""
    padded = F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "\\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(w: Column) -> Column:
        parts = []
        for n in range(low, high + 1):
            starts = F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1)))
            grams = F.transform(starts, lambda i: F.substring(w, i, F.lit(n)))  # noqa: B023
            fits = F.lit(True) if n == low else F.length(w) >= n
            parts.append(F.when(fits, grams).otherwise(F.array().cast("array<string>")))
        return F.concat(*parts)

    return F.flatten(F.transform(padded, of))


def train(examples: DataFrame, iterations: int = 200) -> PipelineModel:
    """A multinomial model of window_text, label: smoothed tf-idf of n-grams, unit length, classes weighted to equal shares.

    Regularisation equals a penalty constant of 1 over the summed loss.
    """
    rows = examples.select("label", char_grams(F.col("window_text")).alias("grams"))
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"))
    totals = sizes.agg(F.sum("n").alias("all"), F.count("*").alias("k"))
    total, classes = totals.first()
    weighted = rows.join(F.broadcast(sizes.select("label", (total / (classes * F.col("n"))).alias("weight"))), "label")  # a row a class
    counts = CountVectorizer(inputCol="grams", outputCol="tf").fit(weighted)
    idf = IDF(inputCol="tf", outputCol="_idf").fit(counts.transform(weighted)).idf.toArray() + 1.0
    scale = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="tf", outputCol="tfidf")
    unit = Normalizer(p=2.0, inputCol="tfidf", outputCol="features")
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(weighted)
    fit = LogisticRegression(labelCol="y", weightCol="weight", family="multinomial", regParam=1.0 / total, standardization=False, maxIter=iterations)
    ready = unit.transform(scale.transform(counts.transform(index.transform(weighted))))
    names = IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)
    return PipelineModel([counts, scale, unit, fit.fit(ready), names])


def window_spans(docs: DataFrame, model: PipelineModel, least: float = 0.5, sizes: tuple[int, int] = SIZES) -> DataFrame:
    """(doc, start, stop, type, score): windows of words that the model calls vague, best first, none overlapping."""
    most = sizes[1]
    ahead = F.transform(F.col("w"), lambda x, i: F.slice("w", i + 1, most))  # each word with those behind it, never the whole text
    rows = docs.select("doc", words(F.col("text")).alias("w")).select("doc", F.explode(ahead).alias("w"))
    rows = rows.withColumn("n", F.explode(F.sequence(F.lit(sizes[0]), F.lit(most)))).where(F.size("w") >= F.col("n"))
    window = F.array_join(F.transform(F.slice("w", F.lit(1), F.col("n")), lambda x: x["match"]), " ")
    rows = rows.select("doc", F.get("w", 0)["start"].alias("start"), F.get("w", F.col("n") - 1)["stop"].alias("stop"), char_grams(window).alias("grams"))
    scored = model.transform(rows).select("doc", "start", "stop", F.col("predicted").alias("label"), F.array_max(vector_to_array("probability")).alias("score"))
    hits = scored.where((F.col("label") != NEGATIVE) & (F.col("score") >= least))
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "start", "stop", "label")))
    kept = claim(order, "struct<o:double,start:int,stop:int,label:string>")
    flat = hits.groupBy("doc").agg(kept.alias("k")).select("doc", F.explode("k").alias("k"))
    return flat.select("doc", "k.start", "k.stop", F.regexp_replace("k.label", "^vago_", "").alias("type"), (-F.col("k.o")).alias("score"))


def detection_report(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(gold, pred, matched, type_right, precision, recall, f1) of spans with doc, start, stop, type."""
    w = Window.partitionBy("doc").orderBy("start", "stop", "type")
    g = gold.withColumn("g", F.row_number().over(w) - 1)
    p = pred.withColumn("p", F.row_number().over(w) - 1)
    pairs = align(iou_pairs(g, p))
    right = pairs.join(g.select("doc", "g", F.col("type").alias("gt")), ["doc", "g"]).join(p.select("doc", "p", F.col("type").alias("pt")), ["doc", "p"])
    found = right.agg(F.count("*").alias("matched"), F.coalesce(F.sum((F.col("gt") == F.col("pt")).cast("long")), F.lit(0)).alias("type_right"))
    row = g.agg(F.count("*").alias("gold")).join(p.agg(F.count("*").alias("pred")), F.lit(True)).join(found, F.lit(True))  # a row each
    precision, recall, f1 = precision_recall(F.col("gold"), F.col("pred"), F.col("matched"))
    return row.withColumns({"precision": precision, "recall": recall, "f1": f1})


def cross_validate(spans: DataFrame, instances: DataFrame, methods: dict[str, Callable[[DataFrame, DataFrame], DataFrame]], n: int = 5) -> DataFrame:
    """(method, fold, seconds, and the columns of ``detection_report``). A method takes the training and the test instances of a fold and returns its spans.

    spans: gold spans with doc; instances: doc, text, fold. The loop is over folds and methods, never over rows.
    """
    out = None
    for fold, (name, method) in itertools.product(range(n), methods.items()):
        test, rest = instances.where(F.col("fold") == fold), instances.where(F.col("fold") != fold)
        gold = spans.join(test.select("doc").distinct(), "doc", "left_semi")
        began = time.time()
        (row,) = detection_report(gold, method(rest, test)).collect()  # one row of counts
        line = instances.sparkSession.createDataFrame([(name, fold, time.time() - began, *row)], "method string, fold int, seconds double, gold long, pred long, matched long, type_right long, precision double, recall double, f1 double")
        out = line if out is None else out.unionByName(line)
    return out


def fold_summary(results: DataFrame, by: str = "method", measures: tuple[str, ...] = ("precision", "recall", "f1")) -> DataFrame:
    """Mean and population deviation of each measure over folds."""
    return results.groupBy(by).agg(*(a for m in measures for a in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))))


def wilcoxon(a: list[float], b: list[float]) -> float:
    """Two-sided p of the signed-rank test of paired values, exact over all signs; zero differences are left out and equal ones share their rank. 1 without differences.

    For numbers of folds; above 20 pairs it raises.
    """
    diffs = [x - y for x, y in zip(a, b, strict=True) if x != y]
    if len(diffs) > 20:
        raise ValueError("too many pairs for the exact test")
    if not diffs:
        return 1.0
    size = sorted(abs(d) for d in diffs)
    ranks = [(size.index(abs(d)) + 1 + len(size) - size[::-1].index(abs(d))) / 2 for d in diffs]
    half = sum(ranks) / 2
    seen = abs(sum(r for r, d in zip(ranks, diffs, strict=True) if d > 0) - half)
    signs = itertools.product((0, 1), repeat=len(ranks))
    return sum(abs(sum(r for r, s in zip(ranks, sign, strict=True) if s) - half) >= seen - 1e-12 for sign in signs) / 2 ** len(ranks)


def wilcoxon_pairs(results: DataFrame, measure: str = "f1") -> list[tuple[str, str, float]]:
    """(method, method, p) of every pair of methods, from a few rows of fold results."""
    rows = results.select("method", "fold", measure).orderBy("method", "fold").collect()  # methods times folds
    by = {m: [r[measure] for r in g] for m, g in itertools.groupby(rows, key=lambda r: r["method"])}
    return [(a, b, wilcoxon(by[a], by[b])) for a, b in itertools.combinations(by, 2)]


def markdown(summary: DataFrame, pairs: list[tuple[str, str, float]]) -> str:
    """A report of fold means and paired tests, four decimals."""
    rows = summary.orderBy(summary.columns[0]).collect()  # a row a method
    lines = ["| " + " | ".join(summary.columns) + " |", "|" + " - |" * len(summary.columns)]
    lines += ["| " + " | ".join(f"{x:.4f}" if isinstance(x, float) else str(x) for x in r) + " |" for r in rows]
    return "\n".join([*lines, "", *(f"- {a} against {b}: p = {p:.4f}" for a, b, p in pairs)]) + "\n"

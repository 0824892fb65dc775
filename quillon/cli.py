"""Command line: ``python -m quillon.cli COMMAND ...``, exit code 1 with a message where input is missing."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import evaluate, official
from quillon.operators import vocabulary as v
from quillon.operators.experiment import cross_validate, first_per, fold_summary, folds, markdown, train, wilcoxon_pairs, window_spans
from quillon.operators.extraction import extract, find_spans
from quillon.operators.noise import instance_windows, instances, stress_instances, stress_report, training_windows
from quillon.operators.phrases import accept_paraphrases, phrase_spans
from quillon.operators.resolve import assemble, build_index, resolve
from quillon.sources import files
from quillon.sources.sqlite import read_registry


def session() -> SparkSession:
    return SparkSession.builder.appName("quillon").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def registry_index(spark: SparkSession, place: str) -> dict[str, DataFrame]:
    """A saved index folder, or one built from a SQLite registry."""
    if os.path.isdir(place) or "://" in place:
        index = files.load_index(spark, place)
        if index is None:
            raise files.NoInput(f"no complete index in {place}")
        return index
    if not os.path.isfile(place):
        raise files.NoInput(f"no registry at {place}")
    return build_index(read_registry(spark, place))


def run(spark: SparkSession, texts: str, registry: str, out: str) -> int:
    """Cite every text of a folder; returns how many documents failed and stand without citations."""
    index = registry_index(spark, registry)
    docs = files.read_texts(spark, texts)
    spans = extract(docs).persist()
    failed = [r["doc"] for r in spans.where("error is not null").select("doc").limit(20).collect()]  # for the message
    if failed:
        print("documents that failed:", ", ".join(failed), file=sys.stderr)
    files.write_documents(assemble(docs, resolve(spans.where("error is null"), index)), out)
    spans.unpersist()
    return len(failed)


def cells(spark: SparkSession, texts: str, registry: str, out: str) -> int:
    """Texts to a submission in one go, one CSV file."""
    index, docs = registry_index(spark, registry), files.read_texts(spark, texts)
    spans = extract(docs).persist()
    failed = spans.where("error is not null").count()
    nested = assemble(docs, resolve(spans.where("error is null"), index))
    files.write_submission(files.submission(files.as_output(nested)), out, single=True)
    spans.unpersist()
    return failed


def stress(spark: SparkSession, texts: str, registry: str, gold: str, n: int) -> DataFrame:
    """Noisy forms of every gold citation in its own document, found and resolved again, and how many came out right."""
    made = stress_instances(files.read_texts(spark, texts), files.read_gold(spark, gold), n).persist()
    found = resolve(extract(made.select("doc", "text")).where("error is null"), registry_index(spark, registry))
    return stress_report(made.drop("text"), found)


def augment(spark: SparkSession, texts: str, gold: str, paraphrases: str, out: str) -> None:
    """Instances and training windows as JSONL in ``out``. paraphrases: JSONL of original, paraphrase, type, in the order made (ord)."""
    docs, spans = files.read_texts(spark, texts), files.read_gold(spark, gold)
    offered = files.read_jsonl(spark, paraphrases, "original string, paraphrase string, type string, ord int")
    made = instances(docs, spans, accept_paraphrases(offered)).persist()
    files.write_jsonl(made, f"{out}/instances")
    windows = training_windows(docs, spans).withColumnRenamed("doc", "base_doc_id")
    files.write_jsonl(windows.unionByName(instance_windows(made)), f"{out}/training_windows")
    made.unpersist()


def experiment(spark: SparkSession, data: str, out: str, n: int) -> None:
    """Cross-validation of the phrase search and the learned windows over what ``augment`` wrote: results CSV and a report."""
    made = files.read_jsonl(spark, f"{data}/instances", "instance_id string, base_doc_id string, nivel string, text string, vago_citations array<struct<inicio:int,fim:int,tipo:string>>, kind string, original_phrase string").persist()
    windows = files.read_jsonl(spark, f"{data}/training_windows", "base_doc_id string, window_text string, label string").persist()
    fold_of = folds(made.where("kind = 'real'").select("base_doc_id", "nivel"), "nivel", "base_doc_id", n)
    tests = made.join(fold_of.select("base_doc_id", "fold"), "base_doc_id")
    chosen = tests.where("kind = 'real'").unionByName(first_per(tests.where("kind <> 'real'"), "fold", 3, "instance_id"))
    rows = chosen.select(F.col("instance_id").alias("doc"), "base_doc_id", "text", "fold", "vago_citations").persist()
    spans = rows.select("doc", F.explode("vago_citations").alias("c")).select("doc", F.col("c.inicio").alias("start"), F.col("c.fim").alias("stop"), F.col("c.tipo").alias("type"))

    def learned(rest: DataFrame, test: DataFrame) -> DataFrame:
        return window_spans(test, train(windows.join(rest.select("base_doc_id").distinct(), "base_doc_id", "left_semi")))

    results = cross_validate(spans, rows, {"phrases": lambda rest, test: phrase_spans(test), "learned": learned}, n).persist()
    files.write_results(results, f"{out}/results")
    spark.createDataFrame([(markdown(fold_summary(results), wilcoxon_pairs(results)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/report")


def unseen(numbers: tuple[str, str] = ("1234567-89.2021.1.00.0001", "45.678")) -> list[tuple[str, bool, bool]]:
    """For each class that no rule lists, whether a citation of it by long and by short number is found."""
    text = "Conforme o julgamento do {} nº {}/DF, cuja ementa reproduzimos."
    return [(short, *(bool(find_spans(text.format(short, x))) for x in numbers)) for _, short in v.UNSEEN_CLASSES]


#: Commands and their arguments.
COMMANDS = {
    "run": ("texts", "registry", "out"),
    "cells": ("texts", "registry", "out"),
    "submission": ("documents", "out"),
    "index": ("registry", "out"),
    "score": ("submission", "gold"),
    "diagnose": ("documents", "gold"),
    "stress": ("texts", "registry", "gold"),
    "augment": ("texts", "gold", "paraphrases", "out"),
    "experiment": ("data", "out"),
    "unseen": (),
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillon")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, args in COMMANDS.items():
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a)
        if "documents" in args:
            p.add_argument("--per-file", action="store_true", help="a folder with one JSON file for each document")
        if name in ("stress", "experiment"):
            p.add_argument("-n", type=int, default=5, help="noisy forms of a citation, or folds")
    a = parser.parse_args(argv)
    if a.command == "unseen":
        print("\n".join(f"{short}: long {'found' if x else 'missed'}, short {'found' if y else 'missed'}" for short, x, y in unseen()))
        return 0
    spark = session()
    try:
        if a.command == "run":
            run(spark, a.texts, a.registry, a.out)
        elif a.command == "cells":
            cells(spark, a.texts, a.registry, a.out)
        elif a.command == "submission":
            files.write_submission(files.submission(files.read_documents(spark, a.documents, a.per_file)), a.out, single=True)
        elif a.command == "index":
            if os.path.abspath(a.registry) == os.path.abspath(a.out):
                raise files.NoInput("the index must not overwrite the registry")
            files.save_index(registry_index(spark, a.registry), a.out)
        elif a.command == "score":
            gold = official.gold_cells(files.read_gold(spark, a.gold))
            print(f"{official.score(gold, files.read_submission(spark, a.submission)):.6f}")
        elif a.command == "diagnose":
            gold, pred = files.read_gold(spark, a.gold), files.predictions(files.read_documents(spark, a.documents, a.per_file))
            official.diagnose(gold, pred).orderBy("level").show(truncate=False)
            official.confusions(gold, pred).show(truncate=False)
            official.examples(gold, pred).show(70, truncate=False)
            levels = evaluate.alternate_scores(gold, pred)
            levels.show()
            evaluate.alternate_final(levels).show()
        elif a.command == "stress":
            stress(spark, a.texts, a.registry, a.gold, a.n).show()
        elif a.command == "augment":
            augment(spark, a.texts, a.gold, a.paraphrases, a.out)
        else:
            experiment(spark, a.data, a.out, a.n)
    except (files.NoInput, official.SubmissionError, official.SolutionError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

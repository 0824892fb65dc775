"""A corpus pipeline of five operators: quality rules, near-duplicate removal, secret masking, mixing, packing.

Every stage works on all rows of its predecessor and returns the columns of ``documents``, packing its pieces. Defined
results, for each stage: an empty table gives an empty table; further columns are carried along whatever their names;
repeated rows are separate documents until near_duplicates keeps one of them; rows without doc_id are documents like any
others; a null text is an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.contracts import vocabulary
from quillon.llm.jaccard_join import keep_one
from quillon.llm.mixing import resample
from quillon.llm.packing import pack_documents
from quillon.llm.quality import keep_good
from quillon.llm.scratch import Scratch, passing
from quillon.llm.secrets import redact

#: Near duplicates of the pipeline: shingles of five words, similarity 0.8 or more.
SHINGLE, PERCENT = 5, 80
#: Shares of good, plain and toxic tokens, and mixed tokens as a multiple of those that come in. The quality stage has
#: removed most plain and toxic text before, and the stage must not lose clean documents: so the target asks for more good
#: tokens than there are, which repeats some good documents (a rate above 1), rather than for fewer of the others alone,
#: which could only be had by dropping documents whose posteriors are mixed.
SHARES, BUDGET = (0.97, 0.02, 0.01), 1.15


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, unchanged; those without text or with fewer than ten words go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id (without one: last), unchanged; texts without words all stay."""
    return keep_one(docs, SHINGLE, PERCENT)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret span replaced by a mark and n_chars with it; texts without secrets, and null ones, unchanged."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say: the whole part, once more by a hash of the row against the rest; without words once."""
    return resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), SHARES, BUDGET)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their places in training sequences; an empty text is its end id alone."""
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]
#: Tokenising and fitting have no SQL form; tests/llm holds each stage and run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and reread by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with passing():
            docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

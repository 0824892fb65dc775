"""Word columns from SQL functions alone, shared by the native operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``.
BLANKS = " \t\n\x0b\x0c\r"
SPLIT = "[ \\t-\\r]+"


def text_of(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_array(text: Column) -> Column:
    """The words of a text, in order."""
    inner = F.trim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPLIT))


def hashed(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def literal_array(values: Sequence[float], digits: int = 5) -> Column:
    """A constant array of doubles: one string, split and cast when the plan is optimised, never for a row."""
    return F.split(F.lit(",".join(f"{v:.{digits}f}" for v in values)), ",").cast("array<double>")


def bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for a row, also where lambdas in ``use`` refer to it again and again."""
    return F.get(F.transform(F.array(value), use), 0)


def gram_buckets(hashes: Column, buckets: int) -> Column:
    """Buckets of the unigrams, then of the bigrams, of an array of word hashes."""

    def both(h: Column) -> Column:
        ones = F.transform(h, lambda x: bucket(x, buckets))
        twos = F.transform(F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: bucket(F.xxhash64(F.get(h, i), x), buckets))
        return F.concat(ones, twos)

    return let(hashes, both)


def lookup_sum(buckets: Column, table: Column) -> Column:
    """Sum of the table's entries at the buckets."""
    return F.aggregate(buckets, F.lit(0.0), lambda s, b: s + F.get(table, b))


def repeated(rows: DataFrame, copies: Column) -> DataFrame:
    """The columns packed in ``row``, each as often as ``copies`` says.

    A filter would be pushed down to the scan, with every expression it rests on computed again in each of its uses; what
    an outer explode leaves out is only known above it.
    """
    out = rows.select(F.explode_outer(F.array_repeat("row", copies)).alias("row"))
    return out.where(F.col("row").isNotNull()).select("row.*")

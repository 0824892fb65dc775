"""Registry index and resolution of spans by how many records a lookup finds: one join by key for spans of every kind."""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from quillon.functions.text import class_text, fold_accents
from quillon.operators import vocabulary as v
from quillon.operators.extraction import own_number
from quillon.operators.phrases import normalized, ratio


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """2M/T of the longest matching blocks; null where either is null."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def own_numbers(records: DataFrame) -> DataFrame:
    """(id, digits, snippet): each record's own number; records without one are left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, own_number(t or "")) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            rows = [(k, x.digits, x.match) for k, x in found if x]
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)], ["id", "digits", "snippet"])

    return records.select(F.col("id").cast("long"), F.col("texto").cast("string")).mapInArrow(read, "id long, digits string, snippet string")


def precedent_numbers(records: DataFrame) -> DataFrame:
    """(id, court, number) of records of kind sumula."""
    known = F.lit(None).cast("int")
    for court, n in v.KNOWN_PRECEDENTS.items():
        known = F.when(F.col("tribunal") == court, n).otherwise(known)
    found = F.regexp_extract(fold_accents(F.lower("texto")), "sumula\\s+([0-9]+)", 1).try_cast("int")
    return records.where("natureza = 'sumula'").select("id", F.col("tribunal").alias("court"), F.coalesce(found, known).alias("number"))


def provisions(records: DataFrame) -> DataFrame:
    """(id, article, code) of records of kind dispositivo."""
    article = F.regexp_extract(F.lower("texto"), "art(?:igo)?[.]?\\s*([0-9]{1,4})", 1).try_cast("int")
    code = F.lit(None).cast("string")
    for n, name in v.ARTICLE_CODES.items():
        code = F.when(F.col("article") == n, name).otherwise(code)
    return records.where("natureza = 'dispositivo'").select("id", article.alias("article")).withColumn("code", code)


def build_index(records: DataFrame) -> dict[str, DataFrame]:
    return {"numbers": own_numbers(records.where("natureza = 'acordao'")), "precedents": precedent_numbers(records), "provisions": provisions(records), "records": records}


@lru_cache(maxsize=1)
def code_names() -> list[tuple[str, str]]:
    """(code, normalised name), in the order that settles ties."""
    return [(code, normalized(name)) for code, names in v.CODES.items() for name in names]


@lru_cache(maxsize=20_000)
def code_named(clause: str, least: float = 0.72) -> str | None:
    """The code whose name is most like the clause; a name that stands in it as whole words counts 1, the first wins ties."""
    norm = normalized(clause)
    words = f" {' '.join(''.join(c if c.isalnum() or c in './' else ' ' for c in norm).split())} "
    best, code = 0.0, None
    for key, name in code_names():
        score = 1.0 if f" {name} " in words else difflib.SequenceMatcher(None, name, norm[: len(name) + 4]).ratio()
        if score > best:
            best, code = score, key
    return code if best >= least else None


@F.pandas_udf(StringType())
def code_of(clause: pd.Series) -> pd.Series:
    """The code that a clause names, null where none is like enough."""
    return clause.map(lambda c: code_named(c) if c is not None else None)


def keyed_index(index: dict[str, DataFrame]) -> DataFrame:
    """(key, rid, ties, snippet, code, court, name): every way to look a record up, as one table; ties: records of its key."""
    none = lambda t: F.lit(None).cast(t)
    rid = F.col("id").alias("rid")
    row = lambda d, key, **c: d.select(key.alias("key"), rid, *(c.get(n, none("string")).alias(n) for n in ("snippet", "code", "court", "name")))
    p = index["precedents"]
    numbers = row(index["numbers"], F.concat(F.lit("number|"), "digits"), snippet=F.col("snippet"))
    by_number = row(p, F.concat_ws("|", F.lit("precedent"), F.col("court"), F.col("number").cast("string")).alias("key"))
    by_court = row(p, F.concat(F.lit("court|"), "court"))
    laws = row(index["provisions"], F.concat(F.lit("article|"), F.col("article").cast("string")), code=F.col("code"))
    people = row(index["records"].where("relator is not null"), F.concat(F.lit("year|"), F.col("ano").cast("string")), court=F.col("tribunal"), name=F.lower(F.trim("relator")))
    out = numbers.unionByName(by_number).unionByName(by_court).unionByName(laws).unionByName(people).where("key is not null")
    once = out.groupBy("key", "rid").agg(*(F.min(c).alias(c) for c in ("snippet", "code", "court", "name")))
    return once.withColumn("ties", F.count(F.lit(1)).over(Window.partitionBy("key")))


def span_key() -> Column:
    """What a span is looked up by; one that names too little has a key of its own, which no record has."""
    known = F.col("number").cast("string")
    precedent = F.when(F.col("court").isNull(), None).when(known.isNull(), F.concat(F.lit("court|"), "court")).otherwise(F.concat_ws("|", F.lit("precedent"), "court", known))
    key = (
        F.when(F.col("kind") == "numero", F.concat(F.lit("number|"), "digits"))
        .when(F.col("kind") == "sumula", precedent)
        .when(F.col("kind") == "artigo", F.concat(F.lit("article|"), F.col("article").cast("string")))
        .when(F.col("kind") == "relator_ano", F.concat(F.lit("year|"), F.col("year").cast("string")))
    )
    return F.coalesce(key, F.concat_ws("|", F.lit("none"), "doc", "start"))


def same_person(a: Column, b: Column) -> Column:
    """One name within the other, or a shared word of four letters."""
    long_words = lambda c: F.filter(F.split(c, "\\s+"), lambda w: F.length(w) >= 4)
    return F.contains(a, b) | F.contains(b, a) | F.arrays_overlap(long_words(a), long_words(b))


def found_records(spans: DataFrame, index: dict[str, DataFrame], margin: float = 0.15) -> DataFrame:
    """``spans`` with n records found, m of them of the span's code, id (of that code, if any, else the least), and for
    several records of one number the one whose class text leads clearly (picked, ratio).

    One left join by key for spans of every kind, so a document is read once; whether the index is broadcast is left to
    the optimizer and its statistics. Candidates of a span are weighed in the exchange that counts them. What Python
    computes of a row is computed at once, behind the join.
    """
    of = ["doc", "start", "stop"]
    rows = spans.withColumn("key", span_key())
    idx = keyed_index(index).select("key", "rid", "ties", "snippet", F.col("code").alias("rcode"), F.col("court").alias("rcourt"), "name")
    joined = rows.join(idx, "key", "left")
    who = F.lower(F.trim("rapporteur"))
    person = (F.col("court").isNull() | (F.col("court") == F.col("rcourt"))) & same_person(F.col("name"), who)
    joined = joined.withColumn("ok", F.col("rid").isNotNull() & ((F.col("kind") != "relator_ano") | F.coalesce(person, F.lit(False))))
    tied = (F.col("kind") == "numero") & (F.col("ties") > 1)
    like = similarity(F.when(tied, class_text(F.col("match"))), F.when(tied, class_text(F.col("snippet"))))
    joined = joined.withColumns({"like": like, "clause_code": code_of(F.when(F.col("kind") == "artigo", F.col("clause")))})
    joined = joined.withColumn("best", F.max("like").over(Window.partitionBy(*of)))
    exact = F.col("ok") & (F.col("rcode") == F.col("clause_code"))
    found = joined.groupBy(*of).agg(
        *(F.first(c).alias(c) for c in ("match", "type", "kind", "court", "number", "article", "rapporteur", "clause_code")),
        F.count_if("ok").alias("n"),
        F.count_if(exact).alias("m"),
        F.coalesce(F.min(F.when(exact, F.col("rid"))), F.min(F.when(F.col("ok"), F.col("rid")))).alias("id"),
        F.max("best").alias("ratio"),
        F.count_if(F.col("best") - F.col("like") < margin).alias("leaders"),
        F.max_by("rid", "like").alias("picked"),
    )
    return found.withColumn("picked", F.when(F.col("leaders") == 1, F.col("picked")))


def verdict(least: float = 0.30) -> Column:
    """(label, conf) by kind and how many records were found."""
    pair = lambda label, conf: F.struct(F.lit(label).alias("label"), F.lit(conf).cast("double").alias("conf"))
    by = lambda n, none, one, many: F.when(n == 0, pair("inventada", none)).when(n == 1, pair("real", one)).otherwise(pair("incompleta", many))
    n, m = F.col("n"), F.col("m")
    told = F.col("picked").isNotNull() & (F.col("ratio") >= least)
    number = F.when((n > 1) & told, pair("real", 0.80)).otherwise(by(n, 0.88, 0.97, 0.75))
    nameless = F.coalesce(F.trim("rapporteur"), F.lit("")) == ""
    person = F.when(nameless, pair("incompleta", 0.70)).otherwise(by(n, 0.65, 0.65, 0.88))
    no_number = F.when(n == 1, pair("real", 0.50)).otherwise(pair("incompleta", 0.60))
    precedent = F.when(F.col("court").isNull(), pair("incompleta", 0.85)).when(F.col("number").isNull(), no_number).otherwise(by(n, 0.92, 0.97, 0.70))
    unknown = F.when(n == 1, pair("real", 0.65)).otherwise(pair("incompleta", 0.60))
    article = F.when(F.col("article").isNull(), pair("incompleta", 0.85)).when(n == 0, pair("inventada", 0.90)).when(F.col("clause_code").isNull(), unknown).otherwise(by(m, 0.92, 0.97, 0.60))
    kind = F.col("kind")
    return F.when(kind == "numero", number).when(kind == "relator_ano", person).when(kind == "sumula", precedent).when(kind == "artigo", article).when(kind == "tema", pair("inventada", 0.95)).otherwise(pair("incompleta", 0.30))


def resolve(spans: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
    """doc, start, stop, match, type, kind, label, conf, id (real spans only)."""
    out = found_records(spans.where("start is not null"), index).withColumn("r", verdict())
    chosen = F.when((F.col("kind") == "numero") & (F.col("n") > 1), F.col("picked")).otherwise(F.col("id"))
    return out.select("doc", "start", "stop", "match", "type", "kind", F.col("r.label").alias("label"), F.round("r.conf", 4).alias("conf"), F.when(F.col("r.label") == "real", chosen.cast("string")).alias("id"))


def assemble(docs: DataFrame, resolved: DataFrame, key: str = "doc") -> DataFrame:
    """One nested row for each document, spans by start; documents without spans have an empty list."""
    one = F.struct("start", "stop", "match", "type", "label", "conf", F.when(F.col("id").isNotNull(), F.struct(F.col("id").alias("id_canonico"))).alias("resolution"))
    lists = resolved.groupBy(F.col("doc").alias("_d")).agg(F.array_sort(F.collect_list(one)).alias("citations"))
    out = docs.select(F.col(key).cast("string").alias("doc")).join(lists, F.col("doc") == F.col("_d"), "left")
    return out.select("doc", F.coalesce("citations", F.array().cast(lists.schema["citations"].dataType)).alias("citations"))

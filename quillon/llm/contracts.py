"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules of the URL query: (verdict, host/path), longest wins; then globs of hosts that are blocked.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
URL_BLOCKED = ["*casino*", "*pills*", "*-bets.*", "*spam-*", "ads-*", "*.ads-*", "*/*/wp-admin/*"]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.mixing import mix_to_targets

    return mix_to_targets(documents(spark, sf_dir), labels(spark, sf_dir))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.jaccard_join import jaccard_components

    return jaccard_components(documents(spark, sf_dir), size=3, percent=90)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.quality import judge_quality

    return judge_quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.packing import pack_documents

    return pack_documents(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op5_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.repeats import remove_repeats

    return remove_repeats(documents(spark, sf_dir), size=400)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.language_id import language_id

    return language_id(documents(spark, sf_dir))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.url_filter import judge_urls

    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES, URL_BLOCKED)


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.token_store import token_index

    return token_index(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=2)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.neighbours import search

    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.secrets import secret_report

    return secret_report(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mixing, op2_jaccard_join, op3_quality_rules, op4_best_fit_packing, op5_repeated_substrings, op6_language_id, op7_url_filter, op8_token_ids, op9_nearest_neighbours, op10_secret_scan)}


def _url_sql() -> str:
    """The URL query in SQL: one row a rule, globs as GLOB."""
    upper = "".join(map(chr, range(65, 91)))
    rules = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in URL_RULES)
    parts = [b.partition("/") for b in URL_BLOCKED]
    bad = " OR ".join(f"(host GLOB '{h}'" + (f" AND path GLOB '/{p}')" if s else ")") for h, s, p in parts)
    return f"""WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{upper.lower()}'), '') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
      r(verdict, rule, h, p) AS (VALUES {rules}),
      m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(r.verdict, length(rule)) AS v FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
      SELECT u.page_id, host, path, m.rule, coalesce(m.v, CASE WHEN host = '' OR {bad} THEN 'block' ELSE 'allow' END) AS verdict FROM u LEFT JOIN m USING (page_id)"""


ORACLE_SQL: dict[str, str] = {"op7_url_filter": _url_sql()}

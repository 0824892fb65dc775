"""A citation corpus with known answers: documents and a registry written from ``orders`` and ``nation`` by fixed rules.

Every document is a row of pieces. The pieces are SQL that Spark and DuckDB read alike, so the expected spans follow from
the lengths of the pieces and the expected records from joins over the keys, without reading any text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLASSES = ["REsp", "AgRg no REsp", "HC", "Recurso Especial", "EDcl no AgInt no AREsp", "TST-RR"]
MARKS = [" nº ", " n. ", " "]
COURTS = ["STF", "STJ", "TST", "TSE", "STM"]
PEOPLE = ["Ana Lima Braga", "CARLOS DUTRA", "Elisa Franco", "Gil Horta Igreja", "Joana Kehl", "Luiz Moura Neto"]
ARTICLES = [1, 2, 3, 5, 7, 9, 14, 93, 186, 290]


def _case(number: str, values: list, quote: bool = True) -> str:
    """The value at a number's remainder."""
    text = " ".join(f"WHEN {i} THEN " + (f"'{x}'" if quote else str(x)) for i, x in enumerate(values))
    return f"(CASE ({number}) % {len(values)} {text} END)"


def _dotted(digits: str) -> str:
    return f"(substring({digits}, 1, 1) || '.' || substring({digits}, 2, 3) || '.' || substring({digits}, 5, 3))"


_OWN = "CAST(1000000 + k % 8000000 AS STRING)"
_FILED = "CAST(1000000 + k % 8000000 - (CASE WHEN k % 8 = 3 THEN 1 ELSE 0 END) AS STRING)"
_STATE = "(CASE WHEN k % 2 = 0 THEN '/SP' ELSE ' (RJ)' END)"
#: A last digit 1 stands misread as l before the state.
_READ = f"(CASE WHEN k % 10 = 1 THEN substring({_dotted(_OWN)}, 1, 8) || 'l' ELSE {_dotted(_OWN)} END)"
_LONG = "('0' || CAST(100000 + k % 800000 AS STRING) || '-56.2019.8.26.' || lpad(CAST(k % 10000 AS STRING), 4, '0'))"
_CLAUSE = "(CASE WHEN k % 7 = 0 THEN 'Xyzw Qqqq' WHEN k % 7 = 1 THEN 'Constituiçao Fedcral' ELSE 'Constituição Federal' END)"

#: Of each document, in order: a name, what precedes the citation, and the citation.
PIECES = [
    ("numero", "('Processo nº 9' || CAST(k AS STRING) || '.1234 e CPF nº 123.456.789-00. Veja o ')", f"({_case('k', CLASSES)} || {_case('k', MARKS)} || {_READ} || {_STATE})"),
    ("cnj", "'; ainda '", _LONG),
    ("sumula", "'; e a '", f"((CASE WHEN k % 3 = 0 THEN 'Súmula ' WHEN k % 3 = 1 THEN '5úrnula nº ' ELSE 'súmula Vinculante n. ' END) || CAST(k % 40 + 1 AS STRING) || (CASE WHEN k % 4 = 0 THEN '' ELSE ' do ' || {_case('k', COURTS)} END))"),
    ("artigo", "'; o '", f"('art. ' || CAST({_case('k', ARTICLES, False)} AS STRING) || 'º, § 1º, II, da ' || {_CLAUSE})"),
    ("relator_ano", "', o '", f"('acórdão do ' || {_case('k', COURTS)} || ', julgado em ' || CAST(2000 + k % 20 AS STRING) || ' pela relatoria de ' || {_case('k', PEOPLE)})"),
    ("tema", "' disse; o '", "('Tema ' || CAST(k AS STRING) || ' da repercussão geral')"),
]
_END = "'. CNPJ nº 12.345.678/0001-95, quartos do imóvel, resumo.'"
#: The document's text.
TEXT = " || ".join(x for _, lead, cite in PIECES for x in (lead, cite)) + f" || {_END}"
#: A judgment's text: some name another number before the opening formula.
JUDGMENT = f"((CASE WHEN k % 3 = 0 THEN 'Cita o HC nº 999.' || CAST(100 + k % 900 AS STRING) || '/BA. ' ELSE '' END) || 'Vistos, relatados e discutidos estes autos de ' || {_case('k', CLASSES)} || ' n. ' || {_dotted(_FILED)} || '/SP, em que é parte X.')"
_RECORD = "k % 4 <> 0"
_JUDGED = "((k % 60 < 6 AND k < 120) OR k IN (301, 302))"


def order_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The keys of all orders, dealt over the cluster: they lie in few splits, and each becomes a text that takes time to read."""
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").repartition(tasks, "o_orderkey")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """(doc, text): one document for each order."""
    return order_keys(spark, sf).select(F.col("o_orderkey").alias("k")).selectExpr("CAST(k AS STRING) AS doc", f"{TEXT} AS text")


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """(id, tribunal, ano, relator, natureza, texto): judgments, precedents and provisions."""
    keys = order_keys(spark, sf).select(F.col("o_orderkey").alias("k"))
    cols = "id bigint, tribunal string, ano int, relator string, natureza string, texto string"
    judgments = keys.where(_RECORD).selectExpr("CAST(k * 10 + 1 AS BIGINT) AS id", f"{_case('k', COURTS)} AS tribunal", "CAST(2000 + k % 50 AS INT) AS ano", f"CASE WHEN {_JUDGED} THEN {_case('k', PEOPLE)} END AS relator", "'acordao' AS natureza", f"{JUDGMENT} AS texto")
    precedents = keys.where("k <= 30").selectExpr("CAST(k * 10 + 2 AS BIGINT) AS id", f"{_case('k', COURTS)} AS tribunal", "CAST(NULL AS INT) AS ano", "CAST(NULL AS STRING) AS relator", "'sumula' AS natureza", "CASE WHEN k % 15 IN (0, 2) THEN 'sem numero' ELSE 'SÚMULA ' || CAST(k AS STRING) || ' texto' END AS texto")
    nations = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"))
    laws = nations.where("k < 14").selectExpr("CAST(k * 10 + 3 AS BIGINT) AS id", "CAST(NULL AS STRING) AS tribunal", "CAST(NULL AS INT) AS ano", "CAST(NULL AS STRING) AS relator", "'dispositivo' AS natureza", f"'Art. ' || CAST({_case('k', ARTICLES[1:], False)} AS STRING) || ' Texto' AS texto")
    return judgments.union(precedents).union(laws).to(spark.createDataFrame([], cols).schema)


def spans_sql() -> str:
    """Expected spans: (k, kind, start, stop, piece)."""
    parts, before = [], []
    for name, lead, cite in PIECES:
        before.append(lead)
        start = f"length({' || '.join(before)})"
        parts.append(f"SELECT k, '{name}' AS kind, CAST({start} AS BIGINT) AS start, CAST({start} + length({cite}) AS BIGINT) AS stop, {cite} AS piece FROM (SELECT o_orderkey AS k FROM orders)")
        before.append(cite)
    return "(" + " UNION ALL ".join(parts) + ")"


_COURT = f"(CASE WHEN k % 4 <> 0 THEN {_case('k', COURTS)} WHEN k % 3 = 2 THEN 'STF' END)"
#: Expected results of lookups in DuckDB: (k, kind, n records, label, conf, id).
_NUMBERS = f"SELECT k * 10 + 1 AS id, {_FILED} AS digits FROM (SELECT o_orderkey AS k FROM orders) WHERE {_RECORD}"
_PRECEDENTS = f"SELECT k * 10 + 2 AS id, {_case('k', COURTS)} AS court, CASE WHEN k % 15 NOT IN (0, 2) THEN k WHEN k % 5 = 0 THEN 10 ELSE 331 END AS number FROM (SELECT o_orderkey AS k FROM orders) WHERE k <= 30"
_LAWS = f"SELECT k * 10 + 3 AS id, article, CASE WHEN article IN (5, 7, 93) THEN 'cf' WHEN article = 14 THEN 'cdc' WHEN article = 186 THEN 'cc' WHEN article = 290 THEN 'cpm' WHEN article = 1 THEN 'lc64_1990' END AS code FROM (SELECT n_nationkey AS k, {_case('n_nationkey', ARTICLES[1:], False)} AS article FROM nation WHERE n_nationkey < 14)"
_JUDGES = f"SELECT k * 10 + 1 AS id, {_case('k', COURTS)} AS court, 2000 + k % 50 AS year, {_case('k', PEOPLE)} AS who FROM (SELECT o_orderkey AS k FROM orders) WHERE {_RECORD} AND {_JUDGED}"


def _by(n: str, none: float, one: float, many: float) -> str:
    return f"CASE {n} WHEN 0 THEN 'inventada' WHEN 1 THEN 'real' ELSE 'incompleta' END AS label, CAST(CASE {n} WHEN 0 THEN {none} WHEN 1 THEN {one} ELSE {many} END AS DOUBLE) AS conf"


def verdicts_sql(kind: str) -> str:
    """(k, label, conf, id) of the spans of a kind."""
    keys = "SELECT o_orderkey AS k FROM orders"
    if kind == "numero":  # of several records the one whose class the document names is told apart
        inner = f"SELECT k, count(id) AS n, min(id) AS one, max(CASE WHEN id = k * 10 + 1 THEN id END) AS own FROM (SELECT k, {_OWN} AS digits FROM ({keys})) LEFT JOIN ({_NUMBERS}) r USING (digits) GROUP BY k"
        return f"SELECT k, CASE n WHEN 0 THEN 'inventada' ELSE 'real' END AS label, CAST(CASE n WHEN 0 THEN 0.88 WHEN 1 THEN 0.97 ELSE 0.80 END AS DOUBLE) AS conf, CASE n WHEN 0 THEN NULL WHEN 1 THEN one ELSE own END AS id FROM ({inner})"
    if kind == "cnj":
        return f"SELECT k, 'inventada' AS label, CAST(0.88 AS DOUBLE) AS conf, CAST(NULL AS BIGINT) AS id FROM ({keys})"
    if kind == "tema":
        return f"SELECT k, 'inventada' AS label, CAST(0.95 AS DOUBLE) AS conf, CAST(NULL AS BIGINT) AS id FROM ({keys})"
    if kind == "sumula":
        inner = f"SELECT k, any_value(c) AS c, count(id) AS n, min(id) AS one FROM (SELECT k, {_COURT} AS c, k % 40 + 1 AS number FROM ({keys})) s LEFT JOIN ({_PRECEDENTS}) p ON p.court = c AND p.number = s.number GROUP BY k"
        return f"SELECT k, CASE WHEN c IS NULL THEN 'incompleta' ELSE label END AS label, CASE WHEN c IS NULL THEN 0.85 ELSE conf END AS conf, CASE WHEN n = 1 THEN one END AS id FROM (SELECT *, {_by('n', 0.92, 0.97, 0.70)} FROM ({inner}))"
    if kind == "relator_ano":
        inner = f"SELECT k, count(id) AS n, min(id) AS one FROM (SELECT k, {_case('k', COURTS)} AS court, 2000 + k % 20 AS year, {_case('k', PEOPLE)} AS who FROM ({keys})) LEFT JOIN ({_JUDGES}) j USING (court, year, who) GROUP BY k"
        return f"SELECT k, {_by('n', 0.65, 0.65, 0.88)}, CASE WHEN n = 1 THEN one END AS id FROM ({inner})"
    inner = f"SELECT k, any_value(code) AS code, count(id) AS n, count(CASE WHEN p.pcode = s.code THEN id END) AS m, min(id) AS one, min(CASE WHEN p.pcode = s.code THEN id END) AS exact FROM (SELECT k, {_case('k', ARTICLES, False)} AS article, CASE WHEN k % 7 <> 0 THEN 'cf' END AS code FROM ({keys})) s LEFT JOIN (SELECT id, article, code AS pcode FROM ({_LAWS})) p USING (article) GROUP BY k"
    cases = lambda a, b, c, d: f"CASE WHEN n = 0 THEN {a} WHEN code IS NULL THEN (CASE n WHEN 1 THEN {b} ELSE {c} END) ELSE {d} END"
    label = cases("'inventada'", "'real'", "'incompleta'", "CASE m WHEN 0 THEN 'inventada' WHEN 1 THEN 'real' ELSE 'incompleta' END")
    conf = cases("0.90", "0.65", "0.60", "CASE m WHEN 0 THEN 0.92 WHEN 1 THEN 0.97 ELSE 0.60 END")
    return f"SELECT k, label, conf, CASE WHEN label = 'real' THEN coalesce(exact, one) END AS id FROM (SELECT *, {label} AS label, CAST({conf} AS DOUBLE) AS conf FROM ({inner}))"

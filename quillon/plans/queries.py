"""Registered queries of the citation operators on the driver's tables, each with its DuckDB twin where SQL has one.

Citations and a registry with known answers are written from ``orders`` (``planted``); lines of an order are gold and
predicted spans; ``documents`` are texts for the span functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import spans as S
from quillon.functions import text as T
from quillon.operators import cells, evaluate, experiment, noise, official, phrases, resolve
from quillon.operators.extraction import extract
from quillon.plans import planted
from quillon.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = "[0-9]{8,20}"
IPV4 = "[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}"
PHONE = "\\+?[0-9]{1,2} ?\\(?[0-9]{3}\\)?[ -][0-9]{3}-[0-9]{4}"
TOKEN = "[0-9a-f]{32,64}"
MAIL = "[a-z0-9._]+@[a-z0-9.]+\\.[a-z]{2,4}"
PARTS = "[0-9]{5,9}|[a-z0-9._]+@[a-z0-9.]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def span_rows(spark: SparkSession, sf: str, pattern: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.explode(S.match_spans(F.coalesce("text", F.lit("")), pattern)).alias("s"))
    return d.select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.stop").cast("long").alias("stop"), F.col("s.match").alias("match"))


def span_sql(pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"""(SELECT doc_id, b AS start, b + length(m) AS stop, m AS match FROM (
      SELECT doc_id, h[k] AS m, CAST(coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:k-1], lambda x: length(x))), 0) AS BIGINT) AS b
      FROM (SELECT doc_id, h, g, unnest(range(1, len(h) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS h, regexp_split_to_array(text, '{p}') AS g FROM documents WHERE regexp_matches(text, '{p}')))))"""


for _name, _p in (("span_digit_runs", DIGITS), ("span_ipv4", IPV4), ("span_phone", PHONE), ("span_token", TOKEN), ("span_mail", MAIL)):
    query(_name, f"SELECT doc_id, start, stop, match FROM {span_sql(_p)}")(lambda s, sf, p=_p: span_rows(s, sf, p))

query("raw_digits_norm", "SELECT doc_id, regexp_replace(text, '[^0-9]', '', 'g') AS digits FROM documents")(lambda s, sf: table(s, sf, "documents").select("doc_id", T.raw_digits(F.col("text")).alias("digits")))
query("ocr_digit_fix", "SELECT doc_id, regexp_replace(translate(text, 'OoIlSsg', '0011559'), '[^0-9]', '', 'g') AS digits FROM documents")(lambda s, sf: table(s, sf, "documents").select("doc_id", T.ocr_digits(F.col("text")).alias("digits")))
query("accent_fold_words", "SELECT doc_id, replace(trim(regexp_replace(strip_accents(lower(text)), '\\s+', ' ', 'g')), 'rn', 'm') AS norm FROM documents")(lambda s, sf: table(s, sf, "documents").select("doc_id", T.normalize_words(F.col("text")).alias("norm")))
query("class_text_norm", "SELECT p_partkey, replace(trim(regexp_replace(strip_accents(lower(regexp_replace(p_name, '[0-9/º°.,-]', ' ', 'g'))), '\\s+', ' ', 'g')), 'rn', 'm') AS norm FROM part")(lambda s, sf: table(s, sf, "part").select("p_partkey", T.class_text(F.col("p_name")).alias("norm")))
query("identifier_noise", "SELECT c_custkey, regexp_full_match(c_name, '[0-9.\\-/°º\\s]*') AS noise, regexp_full_match(CAST(c_custkey AS VARCHAR), '[0-9.\\-/°º\\s]*') AS key_noise FROM customer")(lambda s, sf: table(s, sf, "customer").select("c_custkey", T.is_identifier_noise(F.col("c_name")).alias("noise"), T.is_identifier_noise(F.col("c_custkey").cast("string")).alias("key_noise")))
query("number_regroup", "SELECT o_orderkey, reverse(regexp_replace(rtrim(regexp_replace(reverse(CAST(o_orderkey AS VARCHAR)), '(...)', '\\1.', 'g'), '.'), '^$', '')) AS grouped FROM orders")(lambda s, sf: table(s, sf, "orders").select("o_orderkey", T.group_by_three(F.col("o_orderkey").cast("string")).alias("grouped")))
query("plain_ids", "SELECT l_orderkey, l_linenumber, coalesce(nullif(ltrim(lpad(CAST(l_orderkey % 100 AS VARCHAR), 4, '0'), '0'), ''), '0') AS id FROM lineitem")(lambda s, sf: table(s, sf, "lineitem").select("l_orderkey", "l_linenumber", T.plain_id(F.lpad((F.col("l_orderkey") % 100).cast("string"), 4, "0")).alias("id")))


@query("union_extractors", f"SELECT doc_id, start, stop, 0 AS source FROM {span_sql(DIGITS)} UNION ALL SELECT doc_id, start, stop, 1 AS source FROM {span_sql(IPV4)}")
def union_extractors(spark, sf):
    return span_rows(spark, sf, DIGITS).select("doc_id", "start", "stop", F.lit(0).alias("source")).unionByName(span_rows(spark, sf, IPV4).select("doc_id", "start", "stop", F.lit(1).alias("source")))


@query("greedy_claim_spans", f"""WITH a AS (SELECT doc_id, start, stop, 0 AS source FROM {span_sql(DIGITS)} UNION ALL SELECT doc_id, start, stop, 1 FROM {span_sql(TOKEN)})
    SELECT doc_id, start, stop, source FROM a WHERE source = 0 OR NOT EXISTS (SELECT 1 FROM a b WHERE b.doc_id = a.doc_id AND b.source = 0 AND a.start < b.stop AND a.stop > b.start)""")
def greedy_claim_spans(spark, sf):
    both = span_rows(spark, sf, DIGITS).withColumn("source", F.lit(0)).unionByName(span_rows(spark, sf, TOKEN).withColumn("source", F.lit(1)))
    order = F.array_sort(F.collect_list(F.struct("source", "start", "stop")))
    kept = S.claim(order, "struct<source:int,start:bigint,stop:bigint>")
    return both.groupBy("doc_id").agg(kept.alias("k")).select("doc_id", F.explode("k").alias("k")).select("doc_id", "k.start", "k.stop", "k.source")


@query("fuzzy_levenshtein_match", "SELECT n_nationkey, arg_min(r_name, struct_pack(d := levenshtein(n_name, r_name), k := r_regionkey)) AS best FROM nation, region GROUP BY n_nationkey")
def fuzzy_levenshtein_match(spark, sf):
    n, r = table(spark, sf, "nation"), F.broadcast(table(spark, sf, "region"))  # a fixed five rows
    return n.join(r, F.lit(True)).groupBy("n_nationkey").agg(F.min_by("r_name", F.struct(F.levenshtein("n_name", "r_name").alias("d"), F.col("r_regionkey").alias("k"))).alias("best"))


#: Gold and predicted spans of every order: lines lie so close that spans overlap in chains, short ones lie within others.
_ORDER = "ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount, l_tax"
_LABEL = "CASE l_returnflag WHEN 'A' THEN 'real' WHEN 'N' THEN 'inventada' ELSE 'incompleta' END"
_PRED_LABEL = f"CASE (l_partkey + l_linenumber) % 4 WHEN 0 THEN 'real' WHEN 1 THEN {_LABEL} WHEN 2 THEN 'inventada' ELSE 'incompleta' END"
_AT = "l_linenumber * 4 + l_partkey % 5"
GOLD = {
    "doc": "CAST(l_orderkey AS STRING)",
    "g": f"CAST(row_number() OVER (PARTITION BY l_orderkey {_ORDER}) - 1 AS BIGINT)",
    "level": "CAST(l_orderkey % 2 + 1 AS INT)",
    "start": "CAST(l_linenumber * 4 AS BIGINT)",
    "stop": "CAST(l_linenumber * 4 + 10 AS BIGINT)",
    "label": _LABEL,
    "one_id": "CAST(l_partkey % 50 AS STRING)",
    "match": "'trecho ' || CAST(l_partkey AS STRING)",
}
PRED = {
    "doc": "CAST(l_orderkey AS STRING)",
    "p": f"CAST(row_number() OVER (PARTITION BY l_orderkey {_ORDER}) - 1 AS BIGINT)",
    "start": f"CAST({_AT} AS BIGINT)",
    "stop": f"CAST({_AT} + (CASE l_suppkey % 3 WHEN 0 THEN 4 ELSE 10 END) AS BIGINT)",
    "label": _PRED_LABEL,
    "id": "CAST(l_partkey % 50 + l_suppkey % 2 AS STRING)",
    "conf": "CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE CAST(l_partkey % 100 AS DOUBLE) / 100 END",
    "match": "'achado ' || CAST(l_partkey AS STRING)",
}
_KEPT = "l_partkey % 11 <> 0"


def gold_pred(spark, sf):
    lines = table(spark, sf, "lineitem")
    gold = lines.selectExpr(*(f"{e} AS {n}" for n, e in GOLD.items())).withColumn("ids", F.array("one_id")).drop("one_id")
    return gold, lines.where(_KEPT).selectExpr(*(f"{e} AS {n}" for n, e in PRED.items()))


_SELECT = lambda cols: ", ".join(f"{e} AS {n}" for n, e in cols.items())
_G = f"g AS (SELECT {_SELECT(GOLD)} FROM lineitem), p AS (SELECT {_SELECT(PRED)} FROM lineitem WHERE {_KEPT})"
_I = "i AS (SELECT g.doc, g.g, p.p, CAST(least(g.stop, p.stop) - greatest(g.start, p.start) AS DOUBLE) / (greatest(g.stop, p.stop) - least(g.start, p.start)) AS iou FROM g JOIN p ON g.doc = p.doc AND g.start < p.stop AND p.start < g.stop)"
#: Greedy pairs, one after the other: best overlap first, each side once.
_A = """q AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY iou DESC, g, p) AS r FROM i WHERE iou >= 0.5),
  s AS (SELECT DISTINCT doc, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS gs, CAST([] AS BIGINT[]) AS ps, FALSE AS ok, CAST(NULL AS BIGINT) AS g, CAST(NULL AS BIGINT) AS p, CAST(NULL AS DOUBLE) AS iou FROM q
    UNION ALL SELECT doc, r, CASE WHEN ok THEN list_append(gs, g) ELSE gs END, CASE WHEN ok THEN list_append(ps, p) ELSE ps END, ok, g, p, iou
      FROM (SELECT q.doc, q.r, gs, ps, NOT list_contains(gs, q.g) AND NOT list_contains(ps, q.p) AS ok, q.g, q.p, q.iou FROM s JOIN q ON q.doc = s.doc AND q.r = s.r + 1)),
  a AS (SELECT doc, g, p, iou FROM s WHERE ok)"""
_W = f"WITH RECURSIVE {_G}, {_I}, {_A}"
_T = "t AS (SELECT p.doc, p.p FROM p WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc = p.doc AND a.p = p.p) AND EXISTS (SELECT 1 FROM a JOIN g ON a.doc = g.doc AND a.g = g.g WHERE g.doc = p.doc AND least(g.stop, p.stop) - greatest(g.start, p.start) >= 0.9 * (p.stop - p.start)))"
_LOST = "g WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc = g.doc AND a.g = g.g)"
_MORE = "p WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc = p.doc AND a.p = p.p)"
query("iou_pairs", f"{_W} SELECT doc, g, p, round(iou, 9) AS iou FROM i WHERE iou >= 0.5")(lambda s, sf: evaluate.iou_pairs(*gold_pred(s, sf)).withColumn("iou", F.round("iou", 9)))
query("align_best_iou", f"{_W} SELECT doc, g, p, round(iou, 9) AS iou FROM a")(lambda s, sf: evaluate.align(evaluate.iou_pairs(*gold_pred(s, sf))).withColumn("iou", F.round("iou", 9)))


@query("unmatched_gold", f"{_W} SELECT doc, g FROM {_LOST}")
def unmatched_gold(spark, sf):
    g, p = gold_pred(spark, sf)
    return evaluate.unmatched(g, evaluate.align(evaluate.iou_pairs(g, p)), "g").select("doc", "g")


@query("unmatched_pred", f"{_W} SELECT doc, p FROM {_MORE}")
def unmatched_pred(spark, sf):
    g, p = gold_pred(spark, sf)
    return evaluate.unmatched(p, evaluate.align(evaluate.iou_pairs(g, p)), "p").select("doc", "p")


@query("extra_tolerated", f"{_W}, {_T} SELECT doc, p FROM t")
def extra_tolerated(spark, sf):
    g, p = gold_pred(spark, sf)
    pairs = evaluate.align(evaluate.iou_pairs(g, p))
    return evaluate.tolerated(evaluate.unmatched(p, pairs, "p"), g.join(pairs.select("doc", "g"), ["doc", "g"], "left_semi")).select("doc", "p")


_M = "m AS (SELECT a.doc, a.g, a.p, g.level, g.start, g.match, g.label AS gl, p.label AS pl, p.conf, g.label = p.label AS same, g.label = p.label AND (g.label <> 'real' OR g.one_id = p.id) AS hit, g.one_id = p.id AS linked FROM a JOIN g ON a.doc = g.doc AND a.g = g.g JOIN p ON a.doc = p.doc AND a.p = p.p)"
_D = "d AS (SELECT doc, min(level) AS level FROM g GROUP BY doc)"
_O = f"""{_W}, {_T}, {_M}, {_D},
  r AS (SELECT level, gl AS label, hit::INT AS tp, (same AND NOT hit)::INT AS fp, (NOT same)::INT AS fn, 1 AS support, (gl = 'inventada' AND pl = 'real')::INT AS severe, (conf - hit::INT) ** 2 AS brier FROM m
  UNION ALL SELECT level, pl, 0, (NOT same)::INT, 0, 0, 0, NULL FROM m
  UNION ALL SELECT level, label, 0, 0, 1, 1, 0, NULL FROM {_LOST}
  UNION ALL SELECT d.level, x.label, 0, 1, 0, 0, 0, NULL FROM (SELECT * FROM {_MORE}) x JOIN d USING (doc) WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc = x.doc AND t.p = x.p)),
  c AS (SELECT level, label, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(support)::BIGINT AS support FROM r GROUP BY ALL)"""


def outcomes(spark, sf):
    return evaluate.outcomes(*gold_pred(spark, sf))


query("confusion_by_level", f"{_O} SELECT * FROM c")(lambda s, sf: evaluate.confusion(outcomes(s, sf)))
_F1 = "CASE WHEN 2*tp+fp+fn > 0 THEN 2.0*tp/(2*tp+fp+fn) ELSE 0 END"
query("f1_by_class", f"{_O} SELECT level, label, round(({_F1})::DOUBLE, 9) AS f1 FROM c")(lambda s, sf: evaluate.confusion(outcomes(s, sf)).select("level", "label", F.round(evaluate.f1(F.col("tp"), F.col("fp"), F.col("fn")), 9).alias("f1")))
_L = f"l AS (SELECT level, z.f AS macro_f1, coalesce(v.severe / z.fakes, 0)::DOUBLE AS tau, v.brier FROM (SELECT level, avg({_F1})::DOUBLE AS f, sum(support) FILTER (WHERE label = 'inventada') AS fakes FROM c WHERE support > 0 GROUP BY level) z JOIN (SELECT level, sum(severe) AS severe, avg(brier) AS brier FROM r GROUP BY level) v USING (level))"
_SC = "macro_f1 * (1 - 0.5 * tau) * (1 + CASE WHEN brier IS NULL THEN 0 ELSE greatest(0, least(0.1, 0.1 * (1 - brier))) END)"


@query("macro_score", f"{_O}, {_L} SELECT level, round(macro_f1, 9) AS macro_f1, round(tau, 9) AS tau, round(brier, 9) AS brier, round({_SC}, 9) AS score FROM l")
def macro_score(spark, sf):
    return evaluate.level_scores(outcomes(spark, sf)).select("level", *(F.round(c, 9).alias(c) for c in ("macro_f1", "tau", "brier", "score")))


query("final_score", f"{_O}, {_L} SELECT round(sum(({_SC}) * level) / sum(level), 9) AS final_score FROM l")(lambda s, sf: evaluate.final_score(evaluate.level_scores(outcomes(s, sf))).select(F.round("final_score", 9).alias("final_score")))
query("brier_by_class", f"{_O} SELECT level, label, round(avg(brier), 9) AS brier FROM r GROUP BY ALL")(lambda s, sf: outcomes(s, sf).groupBy("level", "label").agg(F.round(F.avg("brier"), 9).alias("brier")))
_ALT = f"""{_W}, {_M}, {_D}, w AS (SELECT *, CASE WHEN same THEN 0 WHEN gl = 'inventada' AND pl = 'real' THEN 2 ELSE 1 END AS off FROM m),
  r AS (SELECT level, gl AS label, same::INT AS tp, 0 AS fp, off AS fn FROM w UNION ALL SELECT level, pl, 0, off, 0 FROM w UNION ALL SELECT level, label, 0, 0, 1 FROM {_LOST} UNION ALL SELECT d.level, x.label, 0, 1, 0 FROM (SELECT * FROM {_MORE}) x JOIN d USING (doc)),
  c AS (SELECT level, label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM r GROUP BY ALL),
  b AS (SELECT level, avg((conf - same::INT) ** 2) AS brier FROM m GROUP BY level),
  e AS (SELECT level, (sum({_F1}) / 3)::DOUBLE AS macro_f1, any_value(brier) AS brier FROM c LEFT JOIN b USING (level) GROUP BY level)"""


@query("alternate_scores", f"{_ALT} SELECT level, round(macro_f1, 9) AS macro_f1, round(brier, 9) AS brier, round(0.1 * greatest(0, 1 - brier / 0.25), 9) AS bonus FROM e")
def alternate_scores(spark, sf):
    return evaluate.alternate_scores(*gold_pred(spark, sf)).select("level", *(F.round(c, 9).alias(c) for c in ("macro_f1", "brier", "bonus")))


query("alternate_final", f"{_ALT} SELECT round(sum(macro_f1 * level) / sum(level), 9) AS final_score FROM e")(lambda s, sf: evaluate.alternate_final(evaluate.alternate_scores(*gold_pred(s, sf))).select(F.round("final_score", 9).alias("final_score")))
_DIAG = "count(*) FILTER (WHERE side = 'g') AS gold, count(*) FILTER (WHERE side = 'p') AS pred, count(*) FILTER (WHERE side = 'm') AS matched, count(*) FILTER (WHERE side = 'm' AND same) AS class_right, count(*) FILTER (WHERE side = 'm' AND gl = 'real') AS links, count(*) FILTER (WHERE side = 'm' AND gl = 'real' AND linked) AS links_right"


@query("diagnostic_report", f"{_W}, {_M}, {_D}, u AS (SELECT 'g' AS side, level, NULL::BOOLEAN AS same, NULL::VARCHAR AS gl, NULL::BOOLEAN AS linked FROM g UNION ALL SELECT 'p', d.level, NULL::BOOLEAN, NULL::VARCHAR, NULL::BOOLEAN FROM p JOIN d USING (doc) UNION ALL SELECT 'm', level, same, gl, linked FROM m), n AS (SELECT level, {_DIAG} FROM u GROUP BY GROUPING SETS ((level), ())) SELECT level, gold, pred, matched, class_right, links, links_right, round(matched / pred, 9) AS precision, round(matched / gold, 9) AS recall, round(class_right / matched, 9) AS class_accuracy, round(links_right / links, 9) AS link_accuracy FROM n")
def diagnostic_report(spark, sf):
    out = official.diagnose(*gold_pred(spark, sf))
    return out.select(*out.columns[:7], *(F.round(c, 9).alias(c) for c in out.columns[7:]))


query("class_confusions", f"{_W}, {_M} SELECT gl AS gold_label, pl AS pred_label, count(*) AS n FROM m GROUP BY ALL")(lambda s, sf: official.confusions(*gold_pred(s, sf)))


@query("diagnostic_examples", f"""{_W}, {_M}, o AS (SELECT 'miss' AS kind, doc, start, label AS gold_label, CAST(NULL AS VARCHAR) AS pred_label, match FROM {_LOST} ORDER BY doc, start, match LIMIT 20),
  x AS (SELECT 'extra' AS kind, doc, start, CAST(NULL AS VARCHAR) AS gold_label, label AS pred_label, match FROM {_MORE} ORDER BY doc, start, match LIMIT 20),
  y AS (SELECT 'class' AS kind, doc, start, gl AS gold_label, pl AS pred_label, match FROM m WHERE NOT same ORDER BY doc, start, match LIMIT 30)
  SELECT * FROM o UNION ALL SELECT * FROM x UNION ALL SELECT * FROM y""")
def diagnostic_examples(spark, sf):
    """The report's samples: 20 misses, 20 extras, 30 class errors."""
    return official.examples(*gold_pred(spark, sf))


_HIT = "SELECT doc, g, one_id, label, start, stop FROM g"


@query("stress_report", f"{_W}, f AS (SELECT doc, g, arg_min(row(label, id), row(start, stop, label, id)) AS v FROM (SELECT i.doc, i.g, p.label, p.id, p.start, p.stop FROM i JOIN p ON p.doc = i.doc AND p.p = i.p WHERE iou >= 0.5) GROUP BY doc, g) SELECT count(*) AS n, round(avg((v IS NOT NULL)::INT), 9) AS span_recall, round(avg(CASE WHEN v IS NOT NULL THEN (v[1] = label)::INT END), 9) AS class_accuracy, round(avg(CASE WHEN v IS NOT NULL AND label = 'real' THEN (v[2] = one_id)::INT END), 9) AS link_accuracy FROM ({_HIT}) LEFT JOIN f USING (doc, g)")
def stress_report(spark, sf):
    return noise.stress_report(*gold_pred(spark, sf)).select("n", *(F.round(c, 9).alias(c) for c in ("span_recall", "class_accuracy", "link_accuracy")))


def _numbered(cols: dict, n: str) -> dict:
    """The spans numbered by place and label."""
    return cols | {n: f"row_number() OVER (PARTITION BY l_orderkey ORDER BY {cols['start']}, {cols['stop']}, {cols['label']}) - 1"}


_BY_PLACE = f"WITH RECURSIVE g AS (SELECT {_SELECT(_numbered(GOLD, 'g'))} FROM lineitem), p AS (SELECT {_SELECT(_numbered(PRED, 'p'))} FROM lineitem WHERE {_KEPT}), {_I}, {_A}"


@query("detection_report", f"{_BY_PLACE} SELECT (SELECT count(*) FROM g) AS gold, (SELECT count(*) FROM p) AS pred, count(*) AS matched, count(*) FILTER (WHERE g.label = p.label) AS type_right, round(count(*) / (SELECT count(*) FROM p), 9) AS precision, round(count(*) / (SELECT count(*) FROM g), 9) AS recall, round(2 * count(*) / ((SELECT count(*) FROM p) + (SELECT count(*) FROM g)), 9) AS f1 FROM a JOIN g ON a.doc = g.doc AND a.g = g.g JOIN p ON a.doc = p.doc AND a.p = p.p")
def detection_report(spark, sf):
    """Precision, recall and F1 of spans whose type is their label."""
    g, p = gold_pred(spark, sf)
    out = experiment.detection_report(*(d.select("doc", x, "start", "stop", F.col("label").alias("type")) for d, x in ((g, "g"), (p, "p"))))
    return out.select(*out.columns[:4], *(F.round(c, 9).alias(c) for c in out.columns[4:]))


@query("dedupe_keep_first", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def dedupe_keep_first(spark, sf):
    return evaluate.keep_first(table(spark, sf, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")


query("missing_docs", "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")(lambda s, sf: evaluate.missing_docs(table(s, sf, "documents"), table(s, sf, "labels"), "doc_id"))


@query("stratified_folds", "SELECT doc_id, quality, (row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) - 1) % 5 AS fold FROM labels")
def stratified_folds(spark, sf):
    return experiment.folds(table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id")


@query("fold_summary", "SELECT event_type, round(avg(value), 6) AS value_mean, round(stddev_pop(value), 6) AS value_std FROM events GROUP BY event_type")
def fold_summary(spark, sf):
    return experiment.fold_summary(table(spark, sf, "events"), "event_type", ("value",)).select("event_type", F.round("value_mean", 6).alias("value_mean"), F.round("value_std", 6).alias("value_std"))


@query("first_per_group", "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR) || '|42'), event_id) AS r FROM events) WHERE r <= 3")
def first_per_group(spark, sf):
    """Few-shot examples: a given number of each group in hash order."""
    return experiment.first_per(table(spark, sf, "events"), "event_type", 3, "event_id").select("event_type", "event_id")


@query("token_windows", "SELECT item_id, k AS first, array_to_string(h[k + 1:k + 4], ' ') AS win, CAST(coalesce(list_sum(list_transform(g[1:k + 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:k], lambda x: length(x))), 0) AS BIGINT) AS start FROM (SELECT item_id, h, g, unnest(range(0, len(h) - 3)) AS k FROM (SELECT item_id, regexp_extract_all(text, '\\S+') AS h, regexp_split_to_array(text, '\\S+') AS g FROM benchmark))")
def token_windows(spark, sf):
    """Windows of four words with the place of the first."""
    b = table(spark, sf, "benchmark").select("item_id", noise.words(F.col("text")).alias("w")).where(F.size("w") >= 4)
    b = b.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 4)).alias("i"))
    return b.select("item_id", F.col("i").cast("long").alias("first"), F.array_join(F.transform(F.slice("w", F.col("i") + 1, F.lit(4)), lambda x: x["match"]), " ").alias("win"), F.get("w", F.col("i"))["start"].cast("long").alias("start"))


@query("span_substitute_shift", f"SELECT doc_id, substring(text, 1, start) || '<N>' || substring(text, CAST(stop + 1 AS BIGINT)) AS changed, length(text) + 3 - (stop - start) AS end_of_text FROM (SELECT * FROM {span_sql(DIGITS)} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY start) = 1) s JOIN documents USING (doc_id)")
def span_substitute_shift(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.get(S.match_spans(F.col("text"), DIGITS), 0).alias("s")).where("s is not null")
    delta = 3 - (F.col("s.stop") - F.col("s.start"))
    return d.select("doc_id", noise.substitute(F.col("text"), F.col("s.start"), F.col("s.stop"), F.lit("<N>")).alias("changed"), noise.shifted(F.length("text"), F.col("s.stop"), delta).cast("long").alias("end_of_text"))


@query("encode_cells", f"SELECT doc_id AS documento_id, string_agg(start || ',' || stop || ',real,' || match || ',0.9700', '|' ORDER BY start) AS citacoes FROM {span_sql(DIGITS)} GROUP BY doc_id")
def encode_cells(spark, sf):
    one = F.struct("start", "stop", F.lit("real").alias("label"), F.col("match").alias("id"), F.lit(0.97).alias("conf"))
    return span_rows(spark, sf, DIGITS).groupBy(F.col("doc_id").alias("documento_id")).agg(cells.encode(F.array_sort(F.collect_list(one))).alias("citacoes"))


@query("parse_cells", f"SELECT doc_id, start, stop, 'real' AS label, match AS id FROM (SELECT doc_id, start, stop, coalesce(nullif(ltrim(match, '0'), ''), '0') AS match FROM {span_sql(DIGITS)})")
def parse_cells(spark, sf):
    e = encode_cells(spark, sf).select(F.col("documento_id").alias("doc_id"), F.explode(cells.parse(F.col("citacoes"))).alias("s"))
    return e.select("doc_id", "s.start", "s.stop", "s.label", F.get("s.ids", F.lit(0)).alias("id"))


@query("citation_cells")
def citation_cells(spark, sf):
    """Extraction, index, lookups and cells in one plan; benchmark passages stand in for records."""
    b = table(spark, sf, "benchmark")
    none = lambda t: F.lit(None).cast(t)
    records = b.select(F.col("item_id").alias("id"), none("string").alias("tribunal"), none("int").alias("ano"), none("string").alias("relator"), F.lit("acordao").alias("natureza"), F.col("text").alias("texto"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc"), "text")
    rows = resolve.assemble(docs, resolve.resolve(extract(docs), resolve.build_index(records)))
    one = lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop"), c["label"].alias("label"), c["resolution"]["id_canonico"].alias("id"), c["conf"].alias("conf"))
    return rows.select(F.col("doc").alias("documento_id"), cells.encode(F.transform("citations", one)).alias("citacoes"))


_SPANS = planted.spans_sql()
_DOC = "CAST(k AS VARCHAR) AS doc"


def planted_spans(spark, sf, *kinds):
    found = extract(planted.documents(spark, sf), numbers_only=bool(kinds) and {*kinds} <= {"numero", "sumula"}).where("error is null")
    return found.where(F.col("kind").isin(*kinds)) if kinds else found


def places(rows, *columns):
    return rows.select("doc", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "match", *columns)


def planted_sql(kinds: str, **columns: str) -> str:
    return f"SELECT {_DOC}, start, stop, piece AS match" + "".join(f", {e} AS {n}" for n, e in columns.items()) + f" FROM {_SPANS} WHERE kind IN ({kinds})"


query("citation_spans", planted_sql("'numero', 'cnj', 'sumula', 'artigo', 'relator_ano', 'tema'", kind="CASE kind WHEN 'cnj' THEN 'numero' ELSE kind END", type="CASE kind WHEN 'artigo' THEN 'lei' ELSE 'jurisprudencia' END"))(lambda s, sf: places(planted_spans(s, sf), "kind", "type"))
query("extract_case_numbers", planted_sql("'numero', 'cnj'", digits=f"CASE kind WHEN 'cnj' THEN regexp_replace(piece, '[^0-9]', '', 'g') ELSE {planted._OWN} END"))(lambda s, sf: places(planted_spans(s, sf, "numero"), "digits"))
query("extract_precedents", planted_sql("'sumula'", court=planted._COURT, number="CAST(k % 40 + 1 AS INT)"))(lambda s, sf: places(planted_spans(s, sf, "sumula"), "court", "number"))
query("extract_topics", planted_sql("'tema'"))(lambda s, sf: places(planted_spans(s, sf, "tema")))
query("extract_rapporteurs", planted_sql("'relator_ano'", court=planted._case("k", planted.COURTS), year="CAST(2000 + k % 20 AS INT)", rapporteur=planted._case("k", planted.PEOPLE)))(lambda s, sf: places(planted_spans(s, sf, "relator_ano"), "court", "year", "rapporteur"))
query("extract_articles", planted_sql("'artigo'", article=f"CAST({planted._case('k', planted.ARTICLES, False)} AS INT)", clause=planted._CLAUSE))(lambda s, sf: places(planted_spans(s, sf, "artigo"), "article", "clause"))
query("numbers_only", f"SELECT {_DOC}, start, stop FROM {_SPANS} WHERE kind IN ('numero', 'cnj', 'sumula')")(lambda s, sf: extract(planted.documents(s, sf), numbers_only=True).select("doc", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop")))

_KEYS = "(SELECT o_orderkey AS k FROM orders)"
query("own_numbers", f"SELECT k * 10 + 1 AS id, {planted._FILED} AS digits, {planted._case('k', planted.CLASSES)} || ' n. ' || {planted._dotted(planted._FILED)} || '/SP' AS snippet FROM {_KEYS} WHERE {planted._RECORD}")(lambda s, sf: resolve.build_index(planted.registry(s, sf))["numbers"])
query("precedent_numbers", f"SELECT id, court, CAST(number AS INT) AS number FROM (SELECT k * 10 + 2 AS id, {planted._case('k', planted.COURTS)} AS court, CASE WHEN k % 15 NOT IN (0, 2) THEN k WHEN k % 5 = 0 THEN 10 ELSE 331 END AS number FROM {_KEYS} WHERE k <= 30)")(lambda s, sf: resolve.build_index(planted.registry(s, sf))["precedents"])
query("provision_codes", f"SELECT CAST(id AS BIGINT) AS id, CAST(article AS INT) AS article, code FROM ({planted._LAWS})")(lambda s, sf: resolve.build_index(planted.registry(s, sf))["provisions"])


def resolved(spark, sf, *kinds):
    return resolve.resolve(planted_spans(spark, sf, *kinds), resolve.build_index(planted.registry(spark, sf)))


def resolved_sql(*kinds: str) -> str:
    one = lambda k: f"SELECT CAST(s.k AS VARCHAR) AS doc, s.start, s.stop, v.label, v.conf, CAST(v.id AS VARCHAR) AS id FROM {_SPANS} s JOIN ({planted.verdicts_sql(k)}) v ON s.k = v.k WHERE s.kind = '{k}'"
    return " UNION ALL ".join(map(one, kinds))


for _name, _kinds in {"resolve_by_number": ("numero", "cnj"), "resolve_rapporteur_year": ("relator_ano",), "resolve_precedent": ("sumula",), "resolve_article_code": ("artigo",), "resolve_topic": ("tema",), "resolve_all": ("numero", "cnj", "relator_ano", "sumula", "artigo", "tema")}.items():
    query(_name, resolved_sql(*_kinds))(lambda s, sf, ks=_kinds: resolved(s, sf, *(k for k in ks if k != "cnj")).select("doc", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "label", "conf", "id"))


@query("planted_cells", f"SELECT doc AS documento_id, string_agg(start || ',' || stop || ',' || label || ',' || coalesce(id, '-') || ',' || printf('%.4f', conf), '|' ORDER BY start) AS citacoes FROM ({resolved_sql('numero', 'cnj', 'relator_ano', 'sumula', 'artigo', 'tema')}) GROUP BY doc")
def planted_cells(spark, sf):
    """Texts to submission: extraction, lookups, nested documents and cells of the planted corpus in one plan."""
    nested = resolve.assemble(planted.documents(spark, sf), resolved(spark, sf))
    return files.submission(files.as_output(nested))


_FAULTS = ["'5,9,real,007,0.5'", "'5,9,real,7'", "'5,x,real,7,0.5'", "'9,5,real,7,0.5'", "'5,9,talvez,7,0.5'", "'5,9,real,-,0.5'", "'5,9,real,a7,0.5'", "'5,9,inventada,-,1.5'", "'-'", "'0,10,REAL,7,-|1,10,inventada,-,0.2'"]
_CELL = f"CASE o_orderkey % 10 {' '.join(f'WHEN {i} THEN {c}' for i, c in enumerate(_FAULTS))} END"
_ERRORS = ["NULL", "'field count'", "'not an integer'", "'inverted span'", "'unknown class'", "'real without id'", "'id is not a number'", "'confidence outside 0..1'", "NULL", "NULL"]


@query("cell_errors", f"SELECT o_orderkey, CASE o_orderkey % 10 {' '.join(f'WHEN {i} THEN {e}' for i, e in enumerate(_ERRORS))} END AS error, o_orderkey % 10 = 9 AS clash, CAST(CASE o_orderkey % 10 WHEN 8 THEN 0 WHEN 9 THEN 2 ELSE 1 END AS INT) AS n, CASE WHEN o_orderkey % 10 IN (0, 2, 3, 4, 7, 9) AND o_orderkey % 10 <> 7 THEN '7' WHEN o_orderkey % 10 = 1 THEN '7' WHEN o_orderkey % 10 = 6 THEN 'a7' END AS id FROM orders")
def cell_errors(spark, sf):
    """Faulty and valid cells of a submission."""
    o = table(spark, sf, "orders").select("o_orderkey", cells.parse(F.expr(_CELL)).alias("s"))
    first = F.get("s", F.lit(0))
    return o.select("o_orderkey", first["error"].alias("error"), cells.clash(F.col("s")).alias("clash"), F.size("s").alias("n"), F.get(first["ids"], F.lit(0)).alias("id"))


_GOLD_FAULTS = ["'0,5,real,7:012|5,9,incompleta,-'", "'0,5,real,-'", "'0,5,real,7,0.5'", "'0,5,real,7|4,9,real,8'", "''"]


@query("gold_cell_errors", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN 'real without id' WHEN 2 THEN 'field count' END AS error, o_orderkey % 5 = 3 AS clash, CASE o_orderkey % 5 WHEN 0 THEN '7:12' WHEN 2 THEN '7' WHEN 3 THEN '7' END AS ids FROM orders")
def gold_cell_errors(spark, sf):
    cell = F.expr(f"CASE o_orderkey % 5 {' '.join(f'WHEN {i} THEN {c}' for i, c in enumerate(_GOLD_FAULTS))} END")
    o = table(spark, sf, "orders").select("o_orderkey", cells.parse(cell, gold=True).alias("s"))
    first = F.get("s", F.lit(0))
    return o.select("o_orderkey", first["error"].alias("error"), cells.clash(F.col("s"), gold=True).alias("clash"), F.nullif(F.array_join(first["ids"], ":"), F.lit("")).alias("ids"))


_PHRASE = planted._case("o_orderkey", [p for p, _ in phrases.PHRASES])
_SPOKEN = f"(CASE WHEN o_orderkey % 2 = 0 THEN {_PHRASE} ELSE replace(upper(substring({_PHRASE}, 1, 1)) || substring({_PHRASE}, 2), 'ã', 'a') END)"


@query("phrase_spans", f"SELECT CAST(o_orderkey AS VARCHAR) AS doc, CAST(length('Segundo ') AS INT) AS start, CAST(length('Segundo ' || {_SPOKEN}) AS INT) AS stop, {_PHRASE} AS phrase FROM orders")
def phrase_spans(spark, sf):
    """Vague phrases, half of them with a capital and without tildes, one in the text of each order."""
    docs = planted.order_keys(spark, sf).selectExpr("CAST(o_orderkey AS STRING) AS doc", f"'Segundo ' || {_SPOKEN} || ' 12.3 x (y).' AS text")
    return phrases.phrase_spans(docs).select("doc", "start", "stop", "phrase")


@query("phrase_spans_documents")
def phrase_spans_documents(spark, sf):
    """Vague phrases of every whole document; the ratio has no SQL form, and tests hold it against a plain search."""
    return phrases.phrase_spans(table(spark, sf, "documents"), key="doc_id")


@query("number_styles", "SELECT o_orderkey, style, CASE style WHEN 0 THEN d WHEN 1 THEN format('{:t.}', o_orderkey * 1009) WHEN 2 THEN format('{:t }', o_orderkey * 1009) ELSE regexp_replace(format('{:t.}', o_orderkey * 1009), '[.]([^.]*)$', '. \\1') END AS styled FROM (SELECT o_orderkey, CAST(o_orderkey * 1009 AS VARCHAR) AS d FROM orders), (SELECT unnest(range(4)) AS style)")
def number_styles(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("style"))
    return o.withColumn("styled", noise.reformat_number((F.col("o_orderkey") * 1009).cast("string"), F.col("style")))


@query("gold_cells", "SELECT CAST(l_orderkey AS VARCHAR) AS documento_id, 1 AS nivel, string_agg((l_linenumber * 10) || ',' || (l_linenumber * 10 + 5) || ',' || CASE WHEN l_returnflag = 'A' THEN 'real,' || l_partkey ELSE 'inventada,-' END, '|' ORDER BY l_linenumber, l_returnflag = 'A', CAST(l_partkey AS VARCHAR)) AS citacoes FROM lineitem GROUP BY l_orderkey")
def gold_cells(spark, sf):
    real = F.col("l_returnflag") == "A"
    ids = F.when(real, F.array(F.col("l_partkey").cast("string"))).otherwise(F.array().cast("array<string>"))
    g = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("doc"), F.lit(1).alias("level"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + 5).alias("stop"), F.when(real, "real").otherwise("inventada").alias("label"), ids.alias("ids"))
    return official.gold_cells(g)


@query("vague_spans", "SELECT l_orderkey, l_linenumber, l_linestatus = 'O' AND NOT l_partkey % 3 IN (1, 2) AS vague FROM lineitem")
def vague_spans(spark, sf):
    label = F.when(F.col("l_linestatus") == "O", "incompleta").otherwise("real")
    match = F.concat("l_returnflag", F.translate((F.col("l_partkey") % 3).cast("string"), "0", "x"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", noise.is_vague(label, match).alias("vague"))


@query("negative_windows")
def negative_windows(spark, sf):
    """Windows of every document that touch no run of digits; drawn by hash, so tests check their properties."""
    gold = span_rows(spark, sf, DIGITS).select(F.col("doc_id").alias("doc"), "start", "stop")
    return noise.negative_windows(table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text"), gold)


@query("noisy_variants")
def noisy_variants(spark, sf):
    """Three noisy variants of every number span."""
    return noise.variants(span_rows(spark, sf, DIGITS).withColumn("key", F.xxhash64("doc_id", "start")), 3)


@query("nested_output_json", f"SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n, coalesce(m, '') AS matches FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(match, ',' ORDER BY start) AS m FROM {span_sql(DIGITS)} GROUP BY doc_id) x USING (doc_id)")
def nested_output_json(spark, sf):
    """Nested documents through their JSON form and back."""
    found = span_rows(spark, sf, DIGITS).select(F.col("doc_id").cast("string").alias("doc"), "start", "stop", "match", F.lit("jurisprudencia").alias("type"), F.lit("real").alias("label"), F.lit(0.97).alias("conf"), F.col("match").alias("id"))
    out = files.as_output(resolve.assemble(table(spark, sf, "documents"), found, "doc_id"))
    back = out.select(F.from_json(F.to_json(F.struct("*")), files.PREDICTION).alias("j")).select("j.*")
    return back.select(F.col("documento_id").cast("long").alias("doc_id"), F.size("citacoes").cast("long").alias("n"), F.array_join("citacoes.trecho", ",").alias("matches"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Number spans of every document, looked up among order keys, one encoded cell a document."""
    spans = span_rows(spark, sf, DIGITS).withColumn("digits", T.ocr_digits(F.col("match")))
    keys = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderkey").alias("rid"))
    found = spans.join(keys, F.col("digits") == F.col("key"), "left").groupBy("doc_id", "start", "stop").agg(F.count_distinct("rid").alias("n"), F.min("rid").alias("rid"))
    label = F.when(F.col("n") == 0, "inventada").when(F.col("n") == 1, "real").otherwise("incompleta")
    conf = F.when(F.col("n") == 0, 0.88).when(F.col("n") == 1, 0.97).otherwise(0.75)
    one = F.struct("start", "stop", label.alias("label"), F.when(F.col("n") == 1, F.col("rid").cast("string")).alias("id"), conf.alias("conf"))
    lists = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("s"))
    return table(spark, sf, "documents").select("doc_id").join(lists, "doc_id", "left").select("doc_id", F.coalesce(cells.encode(F.col("s")), F.lit("-")).alias("citacoes"))


query("flagship", f"""SELECT d.doc_id, coalesce(c, '-') AS citacoes FROM documents d LEFT JOIN (SELECT doc_id, string_agg(start || ',' || stop || ',' || CASE WHEN k IS NULL THEN 'inventada,-,0.8800' ELSE 'real,' || k || ',0.9700' END, '|' ORDER BY start) AS c
    FROM {span_sql(DIGITS)} s LEFT JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS k FROM orders) o ON s.match = k GROUP BY doc_id) x USING (doc_id)""")(flagship)

import difflib
import re

import pytest
from pyspark.sql import functions as F

from quillon.operators import experiment as E
from quillon.operators import noise as N
from quillon.operators import phrases as P
from quillon.operators import vocabulary as v
from quillon.operators.extraction import find_spans
from quillon.plans import planted, queries


def test_unseen_classes():
    """A class no rule lists: a long number is still found, a short one isn't."""
    for _, short in v.UNSEEN_CLASSES:
        text = f"Conforme o julgamento do {short} nº {{}}/DF, cuja ementa reproduzimos."
        assert [s.digits for s in find_spans(text.format("1234567-89.2021.1.00.0001"))] == ["12345678920211000001"]
        assert not find_spans(text.format("45.678"))


def test_phrases_equal_plain_search(spark):
    text = "Segundo a jurisprudencia pacífica  desta Côrte e normas de regência\nda matéria, posicao consolidada desta Corte, nada mais desta Corte."
    want = []
    spots = [m.span() for m in re.finditer(r"\S+", text)]
    for phrase, kind in P.PHRASES:
        n = len(phrase.split())
        for size in {n - 1, n, n + 1} - {0}:
            for i in range(len(spots) - size + 1):
                a, b = spots[i][0], spots[i + size - 1][1]
                r = difflib.SequenceMatcher(None, P.normalized(phrase), P.normalized(text[a:b])).ratio()
                if r >= 0.82:
                    want.append((r, a, b, phrase, kind))
    want = P.apart(want)
    assert P.find_phrases(["", text, "de", text], P.PHRASES) == [[], want, [], want] and len(want) == 3
    docs = spark.createDataFrame([("a", text), ("b", None), ("c", "")], "doc string, text string")
    got = P.phrase_spans(docs).orderBy("start").collect()
    assert [(r["start"], r["stop"], r["phrase"]) for r in got] == [w[1:4] for w in want]
    assert P.phrase_spans(docs.limit(0)).count() == 0


def test_model_output(spark):
    assert P.json_in('<think>{"no": 1}</think>So:\n```json\n[{"a": 1}] and {more}') == '[{"a": 1}]'
    assert P.json_in(None) is None and P.json_in("no {json") is None
    assert P.locate("um texto qualquer", "texto") == (3, 8) and P.locate("abc", "xyzxyz") is None
    assert P.locate("a jurisprudencia desta", "jurisprudencla desta")[0] == 2
    docs = spark.createDataFrame([("a", "um texto qualquer"), ("b", None)], "doc string, text string")
    spans = P.model_spans(docs, lambda ts: ['[{"trecho": "texto", "tipo": "lei"}, 3]' if t else "sorry" for t in ts])
    assert [tuple(r) for r in spans.collect()] == [("a", 3, 8, "lei")]
    c = spark.createDataFrame([("frase um dois", p, "lei", i) for i, p in enumerate(["frase um dois", "uma frase nova aqui", "uma frase nova aqua", "frase 12 de algo", "the law is this", "curta", "outra coisa bem diversa"])], "original string, paraphrase string, type string, ord int")
    assert {r["paraphrase"] for r in P.accept_paraphrases(c).collect()} == {"uma frase nova aqui", "outra coisa bem diversa"}


def test_noise(spark):
    d = spark.createDataFrame([(i, f"o AgRg no REsp nº 1.234.{i:03d}/SP é açaí") for i in range(200)] + [(900, None), (901, "")], "key long, match string")
    k = F.col("key")
    rows = d.select("key", "match", N.light(F.col("match"), k).alias("light"), N.ocr(F.col("match"), k).alias("ocr"), N.line_break(F.col("match"), k).alias("br"), N.swap_synonym(F.col("match"), k).alias("syn")).collect()
    for r in rows:
        t = r["match"]
        if not t:
            assert r["light"] == r["ocr"] == r["br"] == r["syn"] == t
            continue
        assert sorted(r["br"].replace("\n", " ")) == sorted(t) and r["br"].count("\n") == 1
        assert r["ocr"] != t and r["syn"] != t and r["syn"].endswith(t[t.index(" nº") :])
        assert "REsp" in r["syn"] or "AgRg" in r["syn"]
        assert len(r["light"]) - len(t) in (0, 1)
    assert 20 < sum(r["light"] == r["match"] for r in rows) < 120
    assert len({r["syn"] for r in rows if r["match"]}) > 100
    styles = spark.range(4).select(N.reformat_number(F.lit("12.34567"), F.col("id")).alias("s")).collect()
    assert [r["s"] for r in styles] == ["1234567", "1.234.567", "1 234 567", "1.234. 567"]
    out = N.variants(d, 3).collect()
    assert len(out) == 3 * d.count() and out == N.variants(d, 3).collect()


def test_windows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([("a", text), ("b", "curto demais"), ("c", None)], "doc string, text string")
    gold = spark.createDataFrame([("a", 0, 0, 40, "vaga de fato", "lei", "incompleta", [])], "doc string, g long, start int, stop int, match string, type string, label string, ids array<string>")
    rows = N.negative_windows(docs, gold).collect()
    assert len(rows) == 8 and all(r["start"] >= 40 and text[r["start"] : r["stop"]] == r["match"] and 4 <= len(r["match"].split()) <= 10 for r in rows)
    assert {r["label"] for r in N.training_windows(docs, gold).collect()} == {"negativo", "vago_lei"}
    more = gold.union(spark.createDataFrame([("a", 1, 50, 60, text[50:60], "lei", "real", ["7"]), ("a", 2, 70, 80, "outra vaga", "lei", "incompleta", [])], gold.schema)).withColumn("level", F.lit(2))
    para = spark.createDataFrame([("vaga de fato", f"bem vaga mesmo {c}", t) for c, t in (("a", "lei"), ("b", "lei"), ("c", "lei"), ("d", "outro"))], "original string, paraphrase string, type string")
    made = {r["instance_id"]: r for r in N.instances(docs, more, para).collect()}
    assert [made[d]["text"] for d in "abc"] == [text, "curto demais", None] and len(made["a"]["vago_citations"]) == 2 and made["b"]["nivel"] is None
    synthetic = [r for r in made.values() if r["kind"] == "synthetic"]
    assert len(synthetic) == 3 and {r["nivel"] for r in synthetic} == {"2"}
    for r in synthetic:
        first, other = r["vago_citations"]
        delta = len(r["text"]) - len(text)
        assert len(first["tipo"]) == 3 and "vag" in r["text"][first["inicio"] : first["fim"]].replace("rn", "m")
        cut = (0, 40) if first["inicio"] == 0 else (70, 80)
        assert r["text"] == text[: cut[0]] + r["text"][first["inicio"] : first["fim"]] + text[cut[1] :]
        assert (other["inicio"], other["fim"]) == ((70 + delta, 80 + delta) if cut[0] == 0 else (0, 40))
    assert {r["label"] for r in N.instance_windows(N.instances(docs, more, para)).collect()} == {"vago_lei"}
    stress = N.stress_instances(docs, more, 4).collect()
    assert len(stress) == 12 and all(r["text"][: r["start"]] == text[: r["start"]] for r in stress)
    assert all(len(r["text"]) - len(text) == r["stop"] - {0: 40, 1: 60, 2: 80}[r["g"]] for r in stress)
    pred = spark.createDataFrame([("a", 0, 39, "real", "7")], "doc string, start int, stop int, label string, id string")
    assert tuple(N.stress_report(gold, pred).first()) == (1, 1.0, 0.0, None)


def test_char_grams(spark):
    def plain(text):
        out = []
        for w in text.lower().split():
            w = f" {w} "
            for n in (3, 4, 5):
                out.append(w[:n])
                out += [w[i : i + n] for i in range(1, len(w) - n + 1)]
                if len(w) <= n:
                    break
        return sorted(out)

    for t in ["uma Frase curta é", "a", "", "ab abc abcd"]:
        (r,) = spark.createDataFrame([(t,)], "t string").select(E.char_grams(F.col("t")).alias("g")).collect()
        assert sorted(r["g"]) == plain(t)


def test_experiment(spark):
    docs = spark.createDataFrame([(f"d{i}", f"vamos falar de outra coisa qualquer sem valor {'normas de regência da matéria' if i % 2 else 'jurisprudência pacífica desta Corte'} para encerrar o assunto deste dia", 1 + i % 2) for i in range(20)], "doc string, text string, level int")
    f = E.folds(docs, "level", "doc")
    assert {r["count"] for r in f.groupBy("level", "fold").count().collect()} == {2}
    at = lambda p: F.instr("text", p) - 1
    gold = docs.select("doc", *[x for x in [F.when(F.col("level") == 2, at("normas")).otherwise(at("jurisprudência")).alias("start")]], F.when(F.col("level") == 2, "lei").otherwise("jurisprudencia").alias("type"), at(" para encerrar").alias("stop"), "text")
    gold = gold.withColumn("match", F.substring(F.col("text"), F.col("start") + 1, F.col("stop") - F.col("start"))).withColumn("label", F.lit("incompleta")).drop("text")

    def learned(rest, test):
        model = E.train(N.training_windows(rest, gold.join(rest.select("doc"), "doc", "left_semi")))
        return E.window_spans(test, model)

    methods = {"phrases": lambda rest, test: P.phrase_spans(test), "learned": learned}
    res = E.cross_validate(gold, f.withColumn("fold", F.col("fold") % 2), methods, 2).cache()
    by = {r["method"]: r for r in E.fold_summary(res).collect()}
    assert by["phrases"]["f1_mean"] == 1.0 and by["learned"]["recall_mean"] > 0.5
    assert "| phrases |" in E.markdown(E.fold_summary(res), E.wilcoxon_pairs(res))
    assert {r["kind"] for r in E.test_instances(spark.createDataFrame([("a", "real", 0), ("b", "synthetic", 0), ("c", "real", 1)], "instance_id string, kind string, fold int"), 0).collect()} == {"real", "synthetic"}


def test_wilcoxon():
    assert E.wilcoxon([1, 2, 3, 4, 5], [0, 0, 0, 0, 0]) == pytest.approx(0.0625)
    assert E.wilcoxon([1, 2], [1, 2]) == 1.0 and E.wilcoxon([1, -1], [0, 0]) == 1.0


def test_phrases_compare_few_windows(monkeypatch):
    """Windows next to a phrase, and those of like phrases, are settled without their ratio."""
    made = []
    real = difflib.SequenceMatcher
    monkeypatch.setattr(P.difflib, "SequenceMatcher", lambda *a: made.append(a) or real(*a))
    texts = [f"Segundo {p} 12.3 x{i} (y)." for i, (p, _) in enumerate(P.PHRASES)]
    found = P.find_phrases(texts, P.PHRASES)
    assert [[(f[0], f[3]) for f in one] for one in found] == [[(1.0, p)] for p, _ in P.PHRASES]
    assert len(made) <= 2 * len(texts)


def test_texts_of_orders_are_dealt_over_the_cluster(spark, tmp_path):
    """One small file of keys becomes texts in many tasks."""
    spark.range(50).withColumnRenamed("id", "o_orderkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    for rows in (planted.documents(spark, str(tmp_path)), queries.phrase_spans(spark, str(tmp_path))):
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism

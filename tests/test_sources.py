import sqlite3

import pytest
from pyspark.sql import functions as F

from quillon import cli
from quillon.operators import official
from quillon.operators.resolve import build_index
from quillon.sources import files
from quillon.sources.sqlite import read_registry
from quillon.streaming.documents import stream_cells, stream_texts


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    root = tmp_path_factory.mktemp("cite")
    texts = root / "txt"
    texts.mkdir()
    (texts / "doc a.txt").write_bytes("Vide REsp nº 1.234.567/SP.\r\nFim\rde tudo".encode())
    (texts / "b.txt").write_bytes(b"Conforme HC 999.999/RJ \xff")
    (texts / "c.txt").write_bytes(b"")
    (texts / "other.md").write_text("no")
    db = root / "base.db"
    with sqlite3.connect(db) as con:
        con.execute("CREATE TABLE documentos (documento_id TEXT, id INTEGER, tribunal TEXT, ano INTEGER, relator TEXT, natureza TEXT, tipo TEXT, texto TEXT)")
        con.execute("INSERT INTO documentos VALUES ('r1', 1, 'STJ', 2019, 'Maria Silva', 'acordao', 'x', 'REsp 1.234.567/SP. texto'), ('r2', 2, 'TST', NULL, NULL, 'sumula', 'x', 'texto')")
    gold = root / "gold.csv"
    gold.write_text('﻿nivel,documento_id,citacao_id,inicio,fim,trecho,tipo,classificacao,id_canonico\n1,doc a,g1,5,25,"REsp nº 1.234.567/SP",jurisprudencia,real,1\n2,b,g1,9,23,"HC 999.999/RJ",jurisprudencia,inventada,\n', encoding="utf-8")
    return root


def test_texts(spark, place):
    rows = {r["doc"]: r for r in files.read_texts(spark, str(place / "txt")).collect()}
    assert set(rows) == {"doc a", "b", "c"} and rows["doc a"]["text"].endswith("\nFim\nde tudo")
    assert rows["b"]["text"].endswith("�") and rows["b"]["bad_bytes"] and not rows["c"]["bad_bytes"] and rows["c"]["text"] == ""
    with pytest.raises(files.NoInput):
        files.read_texts(spark, str(place / "nowhere"))


def test_registry(spark, place):
    rows = read_registry(spark, str(place / "base.db"))
    assert [(r["id"], r["ano"], r["natureza"]) for r in rows.orderBy("id").collect()] == [(1, 2019, "acordao"), (2, None, "sumula")]


def test_gold(spark, place):
    rows = files.read_gold(spark, str(place / "gold.csv")).orderBy("level").collect()
    assert [(r["doc"], r["g"], r["start"], r["ids"]) for r in rows] == [("doc a", 0, 5, ["1"]), ("b", 0, 9, [])]


def test_command_line(spark, place, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    p = lambda n: str(place / n)
    assert cli.main(["index", p("base.db"), p("index")]) == 0
    assert cli.main(["run", p("txt"), p("index"), p("json")]) == 0
    assert cli.main(["submission", p("json"), p("sub")]) == 0
    rows = {r["documento_id"]: r["citacoes"] for r in files.read_submission(spark, p("sub")).collect()}
    assert rows == {"doc a": "5,25,real,1,0.9700", "b": "9,23,inventada,-,0.8800", "c": "-"}
    capsys.readouterr()
    assert cli.main(["score", p("sub"), p("gold.csv")]) == 0
    # levels 1 and 2, one class each, all right: 1 + 0.1 (1 - Brier), weights 1 and 2
    want = ((1 + 0.1 * (1 - 0.03**2)) + 2 * (1 + 0.1 * (1 - 0.12**2))) / 3
    assert float(capsys.readouterr().out) == pytest.approx(want, abs=1e-6)
    assert len(list((place / "sub").glob("part-*.csv"))) == 1
    assert cli.main(["cells", p("txt"), p("base.db"), p("cells")]) == 0
    assert {r["documento_id"]: r["citacoes"] for r in files.read_submission(spark, p("cells")).collect()} == rows
    assert cli.main(["diagnose", p("json"), p("gold.csv")]) == 0
    noisy = cli.stress(spark, p("txt"), p("index"), p("gold.csv"), 6).first()
    assert noisy["n"] == 12 and noisy["span_recall"] > 0.6 and noisy["class_accuracy"] > 0.6
    assert cli.main(["stress", p("txt"), p("index"), p("gold.csv"), "-n", "1"]) == 0
    assert cli.main(["unseen"]) == 0 and [x[1:] for x in cli.unseen()] == [(True, False)] * 9
    assert cli.main(["run", p("nowhere"), p("index"), p("x")]) == 1 and cli.main(["run", p("txt"), p("nowhere.db"), p("x")]) == 1
    assert files.load_index(spark, p("txt")) is None


def test_prediction_files(spark, place):
    folder = place / "pretty"
    folder.mkdir()
    (folder / "d + 1.json").write_text('{\n "citacoes": [{"inicio": 1, "fim": 4, "classificacao": "real", "resolucao": {"id_canonico": "7"}}]\n}')
    (folder / "d2.json").write_text('{"documento_id": "x", "citacoes": []}')
    assert {r["documento_id"] for r in files.read_documents(spark, str(folder), per_file=True).collect()} == {"d + 1", "x"}
    (row,) = files.predictions(files.read_documents(spark, str(folder), per_file=True)).collect()
    assert (row["doc"], row["start"], row["id"]) == ("d + 1", 1, "7")


def test_faults(spark):
    sol = spark.createDataFrame([("a", 1, "0,5,real,1")], "documento_id string, nivel int, citacoes string")
    sub = lambda c, d="a": spark.createDataFrame([(d, c)], "documento_id string, citacoes string")
    assert official.score(sol, sub("0,5,real,1,-")) == 1.0 and official.score(sol, sub("0,5,real,1,1")) == 1.1
    for bad in (sub("0,5,real,-,-"), sub("0,5,real,1,-|0,6,real,2,-"), sub("x"), sub("-", "other"), sol.select("documento_id")):
        with pytest.raises(official.SubmissionError):
            official.score(sol, bad)
    for cell in ("0,5,real,-", "0,5,real,1|4,9,real,1", "-"):
        with pytest.raises(official.SolutionError):
            official.score(sol.withColumn("citacoes", F.lit(cell)), sub("-"))


def test_first_of_repeated_rows_counts(spark, tmp_path):
    sol = spark.createDataFrame([("a", 1, "0,5,real,1"), ("b", 1, "0,5,real,2")], "documento_id string, nivel int, citacoes string")
    (tmp_path / "sub.csv").write_text('documento_id,citacoes\na,"0,5,real,1,-"\nb,"0,5,real,2,-"\na,"-"\nb,"0,5,inventada,-,-"\n')
    assert official.score(sol, files.read_submission(spark, str(tmp_path / "sub.csv"))) == 1.0


def test_experiment_commands(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    texts = tmp_path / "txt"
    texts.mkdir()
    lines = ["nivel,documento_id,citacao_id,inicio,fim,trecho,tipo,classificacao,id_canonico"]
    for i in range(12):
        kind, phrase = (("lei", "normas de regência da matéria") if i % 2 else ("jurisprudencia", "jurisprudência pacífica desta Corte"))
        text = f"vamos falar de outra coisa qualquer sem valor {phrase} para encerrar o assunto deste dia de sessao numero {'x' * i}"
        (texts / f"d{i}.txt").write_text(text)
        lines.append(f"{1 + i % 2},d{i},g1,{text.index(phrase)},{text.index(phrase) + len(phrase)},{phrase},{kind},incompleta,")
    (tmp_path / "gold.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "para.jsonl").write_text('{"original": "normas de regência da matéria", "paraphrase": "regras que valem para o tema", "type": "lei", "ord": 0}\n{"original": "x", "paraphrase": "curta", "type": "lei", "ord": 1}\n')
    p = lambda n: str(tmp_path / n)
    assert cli.main(["augment", p("txt"), p("gold.csv"), p("para.jsonl"), p("aug")]) == 0
    made = spark.read.json(p("aug/instances"))
    assert made.count() == 13 and made.where("kind = 'synthetic'").count() == 1
    assert {r["label"] for r in spark.read.json(p("aug/training_windows")).select("label").distinct().collect()} == {"negativo", "vago_lei", "vago_jurisprudencia"}
    assert cli.main(["experiment", p("aug"), p("res"), "-n", "2"]) == 0
    rows = spark.read.option("header", True).csv(p("res/results")).collect()
    assert [(r["method"], r["fold"]) for r in rows] == [("learned", "0"), ("learned", "1"), ("phrases", "0"), ("phrases", "1")]
    assert all(len(r["f1"].split(".")[1]) == 4 for r in rows) and "phrases" in "".join(r[0] for r in spark.read.text(p("res/report")).collect())


def test_stream(spark, place):
    index = build_index(read_registry(spark, str(place / "base.db")))
    for _ in range(2):  # nothing new the second time
        stream_cells(stream_texts(spark, str(place / "txt"), 2), index, str(place / "out"), str(place / "ckpt")).awaitTermination(120)
    rows = {r["documento_id"]: r["citacoes"] for r in spark.read.parquet(str(place / "out")).collect()}
    assert rows == {"doc a": "5,25,real,1,0.9700", "b": "9,23,inventada,-,0.8800"}

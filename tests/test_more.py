"""Workbooks, embedders, caches, restarts of a stream, the topic model's own ways of changing its topics."""

import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom import providers
from textloom.functions import vectors as v
from textloom.operators import hierarchy, spelling
from textloom.plans.topic_model import TopicModel, TopicModelParams
from textloom.sources import files, workbook
from textloom.streaming import online


def test_workbook(spark, tmp_path):
    a = spark.createDataFrame([(1, "a <b> & \x01c", None, 2.5, True)], "n int, t string, e string, x double, b boolean")
    path = str(tmp_path / "out.xlsx")
    workbook.write_workbook({"Codebook": a, "A/B": a.where("n > 5")}, path)
    z = zipfile.ZipFile(io.BytesIO(open(path, "rb").read()))
    assert z.testzip() is None and {"xl/workbook.xml", "xl/worksheets/sheet1.xml", "xl/worksheets/sheet2.xml", "[Content_Types].xml"} <= set(z.namelist())
    sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert "a &lt;b&gt; &amp; c" in sheet and "<v>2.5</v>" in sheet and '<c r="E2" t="b"><v>1</v></c>' in sheet and 'r="C2"' not in sheet
    assert 'name="A B"' in z.read("xl/workbook.xml").decode()
    assert [workbook._column(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert workbook.export_folder("/data/study.sav", "Q1") == "/data/exports/study_Q1"


def test_embedders(spark):
    rows = spark.createDataFrame([(i, f"word{i % 3} text number {i % 5}") for i in range(30)], "id int, text string")
    model = providers.choose_embedder()
    assert isinstance(model, providers.ReducedEmbedder)
    model.size = 4
    got = {r["id"]: np.array(r["vector"]) for r in providers.embed(model, rows, "text").collect()}
    assert len(got[0]) == 4 and np.allclose(got[0], got[15]) and not np.allclose(got[0], got[1])
    pair = providers.PairEmbedder(providers.HashingEmbedder(8), model)
    assert len(pair.embed(rows, "text", kind="word").first()["vector"]) == 8 and len(pair.embed(rows, "text").first()["vector"]) == 4
    for bad in ("nothing", 5):
        with pytest.raises(ValueError):
            providers.choose_embedder(bad)
    with pytest.raises(ValueError):
        providers.embed(model, rows, "text", kind="smell")


def test_retries_with_linear_delays():
    waits, calls = [], []

    def call():
        calls.append(1)
        raise OSError

    with pytest.raises(OSError):
        providers.retrying(call, 4, 2.0, sleep=waits.append, linear=True)()
    assert waits == [2.0, 4.0, 6.0] and len(calls) == 4


def test_intermediate_tables_are_checked(spark, tmp_path):
    cache = files.StageCache(spark, str(tmp_path / "cache"))
    df = spark.createDataFrame([(1, "a")], "id long, t string")
    assert cache.save_intermediate(df, "study", "labels") and cache.load_intermediate("study", "other") is None
    assert cache.load_intermediate("study", "labels", df.schema).count() == 1
    assert cache.load_intermediate("study", "labels", spark.createDataFrame([], "id string").schema) is None


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    say = lambda text: spark.createDataFrame([("en", text)], "lang string, text string")
    online.OnlineTerms(spark, str(tmp_path), "lang").absorb(say("alpha beta"), 0)
    again = online.OnlineTerms(spark, str(tmp_path), "lang")
    again.absorb(say("alpha gamma"), 1)
    want = {"alpha": 2.0, "beta": 1.0, "gamma": 1.0}
    assert {r["term"]: r["n"] for r in again.state().collect()} == want
    online.OnlineTerms(spark, str(tmp_path), "lang").absorb(say("alpha gamma"), 1)  # the batch comes again
    assert {r["term"]: r["n"] for r in online.OnlineTerms(spark, str(tmp_path), "lang").state().collect()} == want


def test_topic_model_changes_its_topics(spark):
    rng = random.Random(3)
    words = {0: "apple pear plum cherry", 1: "train bus tram ferry", 2: "rain snow wind storm", 3: "apple pear plum berry"}
    base = {0: [1.0, 0.0, 0.0], 1: [0.0, 1.0, 0.0], 2: [0.0, 0.0, 1.0], 3: [1.0, 0.02, 0.0]}
    rows = [(i, " ".join(rng.choices(words[i % 4].split(), k=8)), i % 4, base[i % 4]) for i in range(80)]
    rows += [(100, "rain and snow and wind", -1, [0.0, 0.1, 1.0]), (101, "nothing of this", -1, [0.0, 0.0, 0.0])]
    model = TopicModel.fit(spark.createDataFrame(rows, "doc_id long, text string, topic long, vector array<double>"), TopicModelParams(top_n_words=4))
    for strategy in ("distributions", "c-tf-idf"):
        got = {r["doc_id"]: r["topic"] for r in model.reduce_outliers(strategy=strategy).collect()}
        assert got[100] == 2 and got[101] == -1 and got[0] == 0
    near = {r["doc_id"]: r["topic"] for r in model.reduce_outliers(strategy="embeddings", threshold=0.5).collect()}
    assert near[100] == 2 and near[101] == -1
    sure = spark.createDataFrame([(100, 1, 0.9), (100, 2, 0.1), (101, 0, 0.05)], "doc_id long, topic long, probability double")
    given = {r["doc_id"]: r["topic"] for r in model.reduce_outliers(strategy="probabilities", threshold=0.2, probabilities=sure).collect()}
    assert given[100] == 1 and given[101] == -1
    with pytest.raises(ValueError):
        model.reduce_outliers(strategy="guess")
    again = model.update(docs=model.reduce_outliers())
    assert {r["topic"]: r["size"] for r in again.sizes.collect()}[2] == 21
    assert {r["rank"] for r in model.representative_documents(n=2).where("topic >= 0").collect()} == {1, 2}
    assert model.tuned(lambda w: w.where("rank <= 2")).where("topic = 0").count() == 2
    assert model.reduce("auto").sizes.where("topic >= 0").count() <= 4
    assert model.reduce(2).sizes.where("topic >= 0").count() == 2


def test_dense_topics_become_one(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (3, [2.0, 0.02, 0.0]), (6, [1.0, 0.0, 0.015]), (1, [0.0, 1.0, 0.0]), (4, [0.0, 3.0, 0.06]), (5, [0.01, 1.0, 0.0]), (2, [-1.0, -1.0, 9.0]), (-1, [1.0, 1.0, 1.0])]
    auto = {r["from_topic"]: r["to_topic"] for r in hierarchy.auto_mapping(spark.createDataFrame(rows, "topic long, vector array<double>")).collect()}
    assert auto == {0: 0, 3: 0, 6: 0, 1: 1, 4: 1, 5: 1, 2: 2}


def test_representations_and_vectors(spark):
    one, two = spark.range(1), spark.range(2)
    assert v.representation(one, two, True) == (one, True) and v.representation(None, two, True) == (two, False) and v.representation(one, None, False) == (one, True)
    with pytest.raises(ValueError):
        v.representation(None, None, True)
    row = spark.createDataFrame([([3.0, 4.0], None)], "a array<double>, b array<double>").select(v.combined(F.col("a"), F.col("b")).alias("x"), v.masked_mean(F.array("a"), F.array(F.lit(0))).alias("y")).first()
    assert row["x"] == [3.0, 4.0] and row["y"] == [0.0, 0.0]


def test_suggestions_two_edits_away(spark):
    known = spark.createDataFrame([("banana", 5), ("bandana", 3), ("house", 9)], "word string, n long")
    unknown = spark.createDataFrame([("bonona",), ("hse",)], "word string")
    near = {(r["word"], r["suggestion"]): r["distance"] for r in spelling.suggestions(unknown, known, 2).collect()}
    assert near == {("bonona", "banana"): 2, ("hse", "house"): 2}
    assert spelling.suggestions(unknown, known, 1).count() == 0


def test_json_and_versions(spark, tmp_path):
    assert files.plain(np.arange(2)) == [0, 1] and files.plain({3, 1}) == [1, 3] and "pyspark" in files.package_versions()
    files.save_model({"topic_sizes": spark.range(2)}, {"top": np.int64(3)}, str(tmp_path / "m"))
    assert files.load_model(spark, str(tmp_path / "m"))[1] == {"top": 3}

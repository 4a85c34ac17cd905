"""Whole models and pipelines, providers, and operators that no query shows."""

import pytest
from pyspark.sql import functions as F

from textloom import providers
from textloom.operators import facets, topics, tuners
from textloom.plans import tables
from textloom.plans.survey import SurveyPipeline
from textloom.plans.topic_model import TopicModel, TopicModelParams
from textloom.sources import files


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, ["red apple pie", "green apple tart", "fast blue car", "slow blue bus"][i % 4] + f" n{i % 3}", [1.0, 0.1 * (i % 2), 0.0] if i % 4 < 2 else [0.0, 0.1 * (i % 2), 1.0], i % 4) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, vector array<double>, topic long")


def test_model_words_merge_update(docs):
    model = TopicModel.fit(docs)
    first = {r["topic"]: r["term"] for r in model.words().where("rank = 1").collect()}
    assert set(first) == {0, 1, 2, 3} and first[3] in ("bus", "slow")
    merged = model.merge([[0, 1], [2, 3]])
    assert {r["topic"]: r["size"] for r in merged.sizes.collect()} == {0: 20, 2: 20}
    assert {r["term"] for r in merged.words().where("topic = 0 and rank <= 1").collect()} == {"apple"}
    assert {r["term"] for r in model.update(TopicModelParams(ngram_range=(2, 2))).words().collect()} >= {"red apple", "blue bus"}
    assert model.hierarchy().count() == 3


def test_model_clusters_transforms_and_reloads(spark, docs, tmp_path):
    model = TopicModel.fit(docs.drop("topic"), TopicModelParams(clusterer="kmeans", n_clusters=2))
    found = model.transform(docs.drop("topic")).select("doc_id", "topic", (F.col("doc_id") % 4 < 2).alias("fruit"))
    assert {(r["topic"], r["fruit"]) for r in found.collect()} in ({(0, True), (1, False)}, {(1, True), (0, False)})
    model.save(str(tmp_path / "m"))
    again = TopicModel.load(spark, str(tmp_path / "m"))
    assert again.params == model.params and sorted(again.words().collect()) == sorted(model.words().collect())
    with pytest.raises(ValueError):
        TopicModel.fit(docs, TopicModelParams(clusterer="magic"))


def test_reduction_keeps_all_documents(docs):
    model = TopicModel.fit(docs, TopicModelParams(nr_topics=2))
    assert {r["topic"]: r["size"] for r in model.sizes.collect()} == {0: 20, 2: 20}


def test_survey_keeps_every_respondent(spark):
    raw = spark.createDataFrame([(1, "The staff was kind. Parking is hard"), (2, "I don't know"), (3, None), (4, "x"), (5, "Kind staff and good food")], "respondent_id long, response string")
    p = SurveyPipeline(n_clusters=2)
    graded = p.grade(p.preprocess(raw))
    codes = {r["respondent_id"]: r["quality_code"] for r in graded.collect()}
    assert codes == {1: 0, 2: 99999997, 3: 99999998, 4: 99999998, 5: 0}
    coded, book = p.label(p.cluster(p.segment(graded)))
    assert coded.select("respondent_id").distinct().count() == 2
    out = {r["respondent_id"]: r for r in p.export(raw, graded, coded, [r["theme"] for r in book.select("theme").distinct().collect()], []).collect()}
    assert set(out) == {1, 2, 3, 4, 5}
    assert out[2]["Q_USER_MISSING_97"] == 1 and out[3]["Q_SYSTEM_MISSING_98"] == 1 and out[1]["Q_SYSTEM_MISSING_98"] == 0
    assert sum(v for k, v in out[1].asDict().items() if "THEME" in k) >= 1


def test_providers(spark, docs):
    embedded = providers.HashingEmbedder(16).embed(docs, "text", "e")
    assert embedded.columns == [*docs.columns, "e"] and len(embedded.first()["e"]) == 16
    asked = providers.once_each(docs, "topic", lambda d: d.withColumn("answer", F.col("topic") * 10))
    assert asked.where("answer = topic * 10").count() == 40

    def shout(texts):
        if any("bus" in t for t in texts):
            raise ValueError
        return [t.upper() for t in texts]

    providers_time, providers.time.sleep = providers.time.sleep, lambda s: None
    try:
        got = providers.map_batches(docs.where("doc_id < 4").coalesce(1), "text", shout, "loud", size=1).collect()
    finally:
        providers.time.sleep = providers_time
    assert sum(r["loud"] is None for r in got) == 1 and any(r["loud"] == "RED APPLE PIE N0" for r in got)


def test_smoothing_with_the_bin_before(spark):
    rows = spark.createDataFrame([(0, 1, "a", 1.0), (0, 5, "a", 0.0), (0, 5, "b", 1.0)], "topic long, bin long, term string, value double")
    assert {(r["bin"], r["term"]): r["value"] for r in facets.smoothed(rows, "bin").collect()} == {(1, "a"): 1.0, (5, "a"): 0.5, (5, "b"): 0.5}


def test_tuners_follow_one_another(spark):
    words = spark.createDataFrame([(0, 1, "run", 3.0), (0, 2, "dog", 2.0), (0, 3, "big", 1.0)], "topic long, rank long, term string, score double")
    tags = spark.createDataFrame([("dog", "NOUN"), ("big", "ADJ"), ("run", "VERB")], "term string, tag string")
    tuned = tuners.chain(lambda w: tuners.tagged_words(w, tags), lambda w: w.where("rank <= 1"))(words)
    assert [r["term"] for r in tuned.collect()] == ["dog"]
    scores = spark.createDataFrame([(0, "pets", 0.9), (0, "cars", 0.5), (7, "pets", 0.9)], "topic long, label string, probability double")
    assert [tuple(r) for r in tuners.classified(words, scores).collect()] == [(0, "pets")]


def test_labels_and_variables(spark):
    labels = spark.createDataFrame([(0, "0_a"), (1, "1_b")], "topic long, label string")
    given = spark.createDataFrame([(1, "Mine")], "topic long, label string")
    assert {r["topic"]: r["label"] for r in topics.custom_labels(labels, given).collect()} == {0: "0_a", 1: "Mine"}
    with pytest.raises(ValueError):
        files.variable(labels, "nope")
    with pytest.raises(ValueError):
        files.read_survey(spark, "x.sav", "sav")


def test_cross_joins_are_broadcast_only_when_small(spark, monkeypatch):
    plan = lambda df: spark.range(9).crossJoin(tables.counted(df, 5))._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(spark.range(5)).lower() and "broadcast" not in plan(spark.range(6)).lower()


def test_scratch_is_cleared(spark):
    rows = tables.cut(spark.range(3))
    assert rows.count() == 3
    tables.clear_scratch(spark)
    with pytest.raises(Exception):
        spark.read.parquet(rows.inputFiles()[0]).count()

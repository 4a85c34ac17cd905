"""Operators against restatements in plain Python on small tables."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom import providers
from textloom.operators import clusters, codebook, export, hierarchy, pairwise, quality, segments, similarity, spelling, topics, tuners
from textloom.sources import files
from textloom.streaming import online


def test_renumber_keeps_outliers_and_breaks_ties(spark):
    sizes = spark.createDataFrame([(-1, 50), (4, 2), (7, 9), (2, 2)], "topic long, size long")
    assert {r[0]: r[1] for r in topics.renumbering(sizes).collect()} == {-1: -1, 7: 0, 2: 1, 4: 2}


def test_mappings_compose_and_unknown_is_outlier(spark):
    a = spark.createDataFrame([(1, 10), (2, 20)], "from_topic long, to_topic long")
    b = spark.createDataFrame([(10, 5)], "from_topic long, to_topic long")
    assert {r["from_topic"]: r["to_topic"] for r in topics.compose(a, b).collect()} == {1: 5, 2: -1}


def test_filter_and_remap(spark):
    rows = spark.createDataFrame([(-1, "x"), (2, "NA"), (2, "na"), (5, "NA"), (5, "p"), (9, "q")], "cluster long, label string")
    got = [(r["label"], r["cluster"]) for r in clusters.filter_and_remap(rows).orderBy("label", F.col("cluster").asc_nulls_last()).collect()]
    assert got == [("NA", 0), ("NA", None), ("na", None), ("p", 0), ("q", 1), ("x", None)]


def test_assignment_by_confidence(spark):
    rows = [(1, 0, "A", 0.6), (1, 1, "B", 0.6), (2, 0, "A", 0.3), (2, 1, "B", 0.48), (3, 0, "A", 0.0), (5, 1, "B", 0.49)]
    scores = spark.createDataFrame(rows, "cluster long, ord long, concept string, confidence double")
    assert {r[0]: r[1] for r in codebook.by_confidence(scores).collect()} == {1: "A", 5: "B"}


def test_indicators(spark):
    people = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    coded = spark.createDataFrame([(1, "1", "1.1"), (1, "2", "2.1")], "id long, theme string, concept string")
    codes = spark.createDataFrame([(2, 99999997)], "id long, code int")
    rows = {r["id"]: tuple(r)[1:] for r in export.indicators(people, coded, codes, "id", "Q", ["1", "2"], []).collect()}
    assert rows == {1: (1, 1, 0, 0, 0), 2: (0, 0, 1, 0, 0), 3: (0, 0, 0, 1, 0)}


def test_labels_travel_as_metadata(spark):
    df = export.with_labels(spark.range(1).withColumn("Q_THEME_1", F.lit(1)), {"Q_THEME_1": "Price"})
    assert files.variables(df) == {"id": "", "Q_THEME_1": "Price"}


def test_silhouette_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(pairwise, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(1)
    x, c = rng.normal(size=(40, 3)), rng.integers(0, 3, 40)
    rows = spark.createDataFrame([(i, int(c[i]), x[i].tolist()) for i in range(40)], "id long, cluster long, vector array<double>")
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    s = []
    for i in range(40):
        a = d[i][(c == c[i]) & (np.arange(40) != i)].mean()
        b = min(d[i][c == k].mean() for k in set(c) - {c[i]})
        s.append((b - a) / max(a, b))
    assert math.isclose(pairwise.silhouette(rows).first()[0], np.mean(s), abs_tol=1e-9)
    within = {r["cluster"]: (r["min"], r["max"], r["pairs"]) for r in pairwise.similarity_within(rows).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for k in set(c):
        v = [u[i] @ u[j] for i, j in itertools.combinations(np.flatnonzero(c == k), 2)]
        assert np.allclose(within[k], (min(v), max(v), len(v)))


def test_nearest_breaks_ties_and_thresholds(spark):
    t = spark.createDataFrame([(1, [1.0, 0.0]), (0, [2.0, 0.0]), (2, [0.0, 1.0])], "topic long, vector array<double>")
    rows = spark.createDataFrame([(1, [3.0, 0.0]), (2, [0.0, 0.0])], "id long, vector array<double>")
    got = {r["id"]: (r["topic"], r["similarity"]) for r in similarity.nearest(rows, t, threshold=0.5).collect()}
    assert got == {1: (0, 1.0), 2: (-1, 0.0)}


@pytest.mark.parametrize("method", ["average", "ward", "single", "complete"])
def test_linkage_heights_rise_and_sizes_add_up(method):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 2))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    links = hierarchy.linkage(d, method)
    assert links[-1][3] == 12 and len(links) == 11
    assert all(a[2] <= b[2] + 1e-12 for a, b in itertools.pairwise(links))
    assert links[0][2] == pytest.approx(d[np.triu_indices(12, 1)].min())
    assert sorted(set(hierarchy.cut(links, 12, 4))) == [0, 1, 2, 3]


def test_text_tree_and_ancestors(spark):
    centers = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.99, 0.1]), (2, [0.0, 1.0])], "topic long, vector array<double>")
    merges = hierarchy.tree(spark, centers)
    assert hierarchy.text_tree(merges, {0: "a", 1: "b", 2: "c"}).count("topic") == 3
    assert {r[0]: r[1] for r in hierarchy.ancestors(merges, 0.5).collect()} == {0: 3, 1: 3, 2: 2}


def test_density_clusters_find_blobs():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (40, 2)), rng.normal(5, 0.1, (40, 2)), rng.uniform(-20, 20, (8, 2))])
    labels = clusters.density_labels(x, 10)
    assert len(set(labels[:40])) == 1 and len(set(labels[40:80])) == 1 and labels[0] != labels[40]
    assert (clusters.density_labels(x[:5], 10) == -1).all()


def test_mmr_by_hand():
    words = np.array([[1.0, 0.0], [0.999, 0.01], [0.5, 0.5]])
    assert clusters.mmr_order(np.array([1.0, 0.0]), words, 0.9, 2) == [0, 2]
    assert clusters.mmr_order(np.array([1.0, 0.0]), words, 0.0, 3) == [0, 1, 2]
    assert len(clusters.mmr_order(np.array([1.0, 0.0]), words, 0.5, 9)) == 3


def test_suggestions_are_all_within_one_edit(spark):
    words = ["kat", "kaat", "kart", "hat", "at", "één", "eén", "boom"]
    unknown = spark.createDataFrame([("katt",), ("een",), ("bom",)], "word string")
    lex = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = {(r["word"], r["suggestion"]) for r in spelling.suggestions(unknown, lex).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i] + [0] * len(b) if False else _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        return out

    assert got == {(a, b) for a in ("katt", "een", "bom") for b in words if distance(a, b) <= 1}


def test_greedy_batches_keep_to_the_budget(spark):
    rows = spark.createDataFrame([(0, i, c) for i, c in enumerate([5, 5, 20, 1, 1, 1, 1])], "s long, o long, c long")
    got = [r["batch"] for r in spelling.greedy_batches(rows, "s", "o", "c", 10, 3).orderBy("o").collect()]
    assert got == [0, 0, 1, 2, 2, 2, 3]


def test_mark_unknown_marks_whole_words_once(spark):
    t = spark.createDataFrame([(1, "Bal balk bal.")], "id long, text string")
    u = spark.createDataFrame([("bal", 1)], "word string, n long")
    assert spelling.mark_unknown(t, u, "id").first()["marked"] == "<bal> balk bal."


def test_online_batches_equal_one(spark):
    a = spark.createDataFrame([(0, "w", 10)], "topic long, term string, n long")
    b = spark.createDataFrame([(0, "w", 1)], "topic long, term string, n long")
    assert online.update(online.update(None, a, 0.1), b, 0.1).first()["n"] == 10.0
    assert online.update(online.update(None, a), b).first()["n"] == 11.0
    assert online.update(online.update(None, a, least=5), b, least=20).count() == 0


def test_stream_batch_that_comes_again_counts_once(spark, tmp_path):
    docs = spark.createDataFrame([("x", "aa aa"), ("x", "bb")], "lang string, text string")
    terms = online.OnlineTerms(spark, str(tmp_path), "lang")
    terms.absorb(docs, 0)
    terms.absorb(docs, 1)
    terms.absorb(docs, 1)
    assert {r["term"]: r["n"] for r in terms.state().collect()} == {"aa": 4.0, "bb": 2.0}


def test_csv_with_nested_cells(spark, tmp_path):
    rows = spark.createDataFrame([(1, [("a", 1), (None, 2)], 'say "x", y\nz'), (2, None, None)], "id long, s array<struct<t:string,n:long>>, t string")
    files.write_csv(rows, str(tmp_path / "c"))
    back = files.read_csv(spark, str(tmp_path / "c"), rows.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))


def test_stage_cache(spark, tmp_path):
    cache = files.StageCache(spark, str(tmp_path))
    assert cache.load("f", "s") is None and not cache.save(spark.range(0), "f", "s")
    assert cache.save(spark.range(3), "f", "s", 1.0) and cache.save(spark.range(5), "f", "s", 2.0)
    assert cache.load("f", "s").count() == 5
    cache.invalidate("f", "s")
    assert cache.load("f", "s") is None


def test_segments_nest_and_flatten(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 1, "b")], "k long, n long, t string")
    flat = segments.flatten(segments.nest(rows, "k", ["n", "t"]), "k", ["t"])
    assert sorted(map(tuple, flat.collect())) == [(1, 1, "a"), (1, 2, "NA"), (2, 1, "b")]
    cut = segments.split_sentences(spark.createDataFrame([(1, " A b. ; c!")], "k long, t string"), ["k"], "t")
    assert [tuple(r) for r in cut.collect()] == [(1, 1, "A b"), (1, 2, "c")]


def test_batches_hold_at_most_their_size(spark):
    got = quality.batches(spark.range(500), "id", 20, 4).groupBy("shard", "batch").count().agg(F.max("count"), F.sum("count")).first()
    assert got[0] <= 20 and got[1] == 500


def test_retrying_and_padding(spark):
    seen = []

    def shaky():
        seen.append(1)
        if len(seen) < 3:
            raise OSError
        return 7

    assert providers.retrying(shaky, sleep=lambda s: None)() == 7
    words = spark.createDataFrame([(0, 1, "a", 2.0)], "topic long, rank long, term string, score double")
    assert [(r["term"], r["score"]) for r in tuners.padded(words, words, 2).orderBy("rank").collect()] == [("a", 2.0), ("", 0.00001)]


def test_every_word_with_a_vector_counts(spark, tmp_path):
    """Words beyond the 500 most frequent have vectors too, where embeddings has more rows."""
    from textloom.queries.vectors import word_vector_mean

    words = [f"w{k:04d}" for k in range(650)]
    texts = [(0, " ".join(words)), (1, " ".join(words[:500])), (2, words[600] + " " + words[610] + " " + words[610]), (3, words[649])]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, [float(k), 1.0], 0) for k in range(640)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    counts = {w: sum(t.split().count(w) for _, t in texts) for w in words}
    rank = {w: k for k, w in enumerate(sorted(words, key=lambda w: (-counts[w], w)))}
    want = {}
    for d, t in texts:
        found = [rank[w] for w in t.split() if rank[w] < 640]
        if found:
            want[d] = round(sum(found) / len(found), 6)
    assert set(want) >= {0, 1, 2}
    got = {r["doc_id"]: r["value"] for r in word_vector_mean(spark, str(tmp_path)).where("i = 0").collect()}
    assert got == pytest.approx(want)


def test_density_clusters_of_many_rows_use_all_rows(spark, monkeypatch):
    """Block against block gives what one process gives, and a small cluster isn't lost among many rows."""
    monkeypatch.setattr(pairwise, "BLOCK_ROWS", 150)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 0.3, (300, 2)), rng.normal(9, 0.3, (280, 2)), rng.normal((0, 9), 0.1, (12, 2)), rng.uniform(-40, 40, (40, 2))])
    rows = spark.createDataFrame([(1000 + i, p.tolist()) for i, p in enumerate(x)], "id long, vector array<double>")
    got = {r["id"]: r["cluster"] for r in clusters.density_clusters(rows, min_size=10, fit_points=100).collect()}
    labels = [got[1000 + i] for i in range(len(x))]
    want = clusters.density_labels(x, 10).tolist()
    # Where a point ties between two clusters either may have it.
    assert len(set(labels)) == len(set(want)) and sum(a != b for a, b in zip(labels, want)) <= 3
    assert len({labels[i] for i in range(580, 592)} - {-1, labels[0], labels[300]}) == 1
    numbered = rows.select((F.col("id") - 1000).alias("id"), F.col("vector").alias("v"))
    far = np.linalg.norm(x[:, None] - x[None], axis=2)
    core = np.sort(far, axis=1)[:, 10]
    a, b = np.triu_indices(len(x), 1)
    d = np.maximum(far, np.maximum(core[:, None], core))[a, b]
    assert sorted(clusters._spanning_edges(numbered, 10, len(x))["d"]) == pytest.approx(sorted(d[clusters._forest(a, b, d)]), abs=1e-6)


def test_outlier_whose_cosine_rounds_to_nothing_has_a_topic(spark):
    """A topic of 150 million words, where a word that occurs once has a cosine below 0.0000005."""
    from textloom.operators import outliers

    scored = spark.createDataFrame([("en", "the", 2.0, 0.24), ("en", "rare", 18.0, 1e-7), ("de", "die", 2.0, 0.3)], "topic string, term string, idf double, score double")
    docs = spark.createDataFrame([(1, "rare"), (2, "the"), (3, "unseen"), (4, None)], "doc_id long, text string")
    found = {tuple(r) for r in outliers.by_term_scores(docs, scored, "doc_id").collect()}
    assert found == {(1, "en", 0.0), (2, "en", 1.0)}
    assert {r["doc_id"] for r in outliers.by_term_scores(docs, scored, "doc_id", threshold=0.5).collect()} == {2}

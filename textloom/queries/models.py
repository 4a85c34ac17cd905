"""Hierarchies, tuners, online learning, storage, whole models."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as v
from ..operators import ctfidf, hierarchy, outliers, topics, tuners
from ..plans.survey import SurveyPipeline
from ..plans.tables import scratch, table
from ..plans.topic_model import TopicModel, TopicModelParams
from ..sources import files
from ..streaming import online
from ._register import query
from .topics import TOK, bow_sql, score_sql, top_sql
from .vectors import CENTER_LISTS, cos_sql


def _embedded(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), F.col("label").cast("long").alias("topic"))


def _centers(spark, sf_dir):
    return v.mean_vectors(_embedded(spark, sf_dir), "topic", "vector")


def _bow(spark, sf_dir, topic="lang"):
    return ctfidf.bag_of_words(table(spark, sf_dir, "documents").select(topic, "text"), topic)


@query()
def topic_hierarchy(spark, sf_dir):
    return hierarchy.tree(spark, _centers(spark, sf_dir)).withColumn("distance", F.round("distance", 6))


@query()
def hierarchy_names(spark, sf_dir):
    """The tree over sources, by the vectors of their documents' scores against languages, with the words of each merge."""
    numbered = table(spark, sf_dir, "documents").select(F.substring("source", 4, 9).cast("long").alias("topic"), "lang", "text")
    bow = ctfidf.bag_of_words(numbered.select("topic", "text"), "topic")
    shares = numbered.groupBy("topic").pivot("lang", ["de", "en", "es", "fr"]).count().fillna(0)
    centers = shares.select("topic", F.array(*[F.col(c).cast("double") for c in ("de", "en", "es", "fr")]).alias("vector"))
    idf = ctfidf.score(bow).groupBy("term").agg(F.max("idf").alias("idf"))
    merges = hierarchy.tree(spark, centers)
    return merges.join(hierarchy.name_parents(merges, bow, idf), "step", "left").select("step", "left", "right", "name")


@query()
def reduce_topics(spark, sf_dir):
    mapping = hierarchy.reduction_mapping(spark, _centers(spark, sf_dir), 4)
    return topics.sizes(topics.remap(_embedded(spark, sf_dir), mapping))


@query()
def topic_ancestors(spark, sf_dir):
    return hierarchy.ancestors(hierarchy.tree(spark, _centers(spark, sf_dir), "average"), 0.9)


@query(f"""WITH c AS ({CENTER_LISTS}), a AS (SELECT * FROM c WHERE topic < 6), b AS (SELECT topic + 100 AS from_topic, list_transform(c, lambda x, i: CASE WHEN i % 3 = 0 THEN -x ELSE x END) AS c FROM c),
  s AS (SELECT from_topic, topic, round({cos_sql('b.c', 'a.c')}, 9) AS similarity FROM b CROSS JOIN a),
  n AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY from_topic ORDER BY similarity DESC, topic) = 1)
  SELECT from_topic, CASE WHEN similarity >= 0.3 THEN topic ELSE 6 + row_number() OVER (PARTITION BY similarity >= 0.3 ORDER BY from_topic) - 1 END AS to_topic FROM n""")
def merge_models(spark, sf_dir):
    first = _centers(spark, sf_dir)
    second = first.select((F.col("topic") + 100).alias("topic"), F.transform("vector", lambda x, i: F.when((i + 1) % 3 == 0, -x).otherwise(x)).alias("vector"))
    _, mapping = hierarchy.merge_models(first.where("topic < 6"), second, 0.3)
    return mapping


SCORED = score_sql(bow_sql())


@query(f"""WITH s AS ({SCORED}), c AS (SELECT doc_id, lang AS topic, term, count(*) AS c FROM (SELECT *, unnest({TOK}) AS term FROM documents) GROUP BY 1, 2, 3),
  m AS (SELECT doc_id, topic, sum(c * idf * score) AS dot, sqrt(sum(c * idf * c * idf)) AS own FROM c JOIN s USING (topic, term) GROUP BY 1, 2),
  n AS (SELECT topic, sqrt(sum(score * score)) AS norm FROM s GROUP BY 1)
  SELECT * FROM (SELECT doc_id, topic, row_number() OVER (PARTITION BY topic ORDER BY round(dot / (own * norm), 6) DESC, doc_id) AS rank, round(dot / (own * norm), 6) AS similarity FROM m JOIN n USING (topic)) WHERE rank <= 3""")
def representative_docs(spark, sf_dir):
    return tuners.representative_documents(table(spark, sf_dir, "documents"), ctfidf.score(_bow(spark, sf_dir)), "doc_id", "lang", digits=6)


@query(f"""WITH s AS ({SCORED}), o AS (SELECT doc_id, term, count(*) AS c FROM (SELECT *, unnest({TOK}) AS term FROM documents WHERE n_chars < 400) GROUP BY 1, 2),
  m AS (SELECT doc_id, topic, sum(c * idf * score) AS dot FROM o JOIN s USING (term) GROUP BY 1, 2),
  i AS (SELECT term, max(idf) AS idf FROM s GROUP BY 1), w AS (SELECT doc_id, sqrt(sum(c * idf * c * idf)) AS own FROM o JOIN i USING (term) GROUP BY 1),
  n AS (SELECT topic, sqrt(sum(score * score)) AS norm FROM s GROUP BY 1)
  SELECT doc_id, topic, similarity FROM (SELECT doc_id, topic, round(dot / (own * norm), 6) AS similarity, row_number() OVER (PARTITION BY doc_id ORDER BY round(dot / (own * norm), 6) DESC, topic) AS k FROM m JOIN n USING (topic) JOIN w USING (doc_id)) WHERE k = 1""")
def reduce_outliers_ctfidf(spark, sf_dir):
    """Outliers (the short documents) take the topic whose term scores are most like theirs."""
    return outliers.by_term_scores(table(spark, sf_dir, "documents").where("n_chars < 400"), ctfidf.score(_bow(spark, sf_dir)), "doc_id")


@query(f"""WITH s AS ({SCORED}), n AS (SELECT topic, sqrt(sum(score * score)) AS norm FROM s GROUP BY 1)
  SELECT a.topic AS left_topic, b.topic AS right_topic, round(sum(a.score * b.score) / any_value(x.norm * y.norm), 6) AS similarity FROM s a JOIN s b USING (term) JOIN n x ON x.topic = a.topic JOIN n y ON y.topic = b.topic GROUP BY 1, 2""")
def topic_similarity_ctfidf(spark, sf_dir):
    s = ctfidf.score(_bow(spark, sf_dir)).select("topic", "term", "score")
    norms = s.groupBy("topic").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"))
    left, right = s.select(F.col("topic").alias("left_topic"), "term", F.col("score").alias("a")), s.select(F.col("topic").alias("right_topic"), "term", F.col("score").alias("b"))
    dots = left.join(right, "term").groupBy("left_topic", "right_topic").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
    joined = dots.join(norms.select(F.col("topic").alias("left_topic"), F.col("norm").alias("x")), "left_topic").join(norms.select(F.col("topic").alias("right_topic"), F.col("norm").alias("y")), "right_topic")
    return joined.select("left_topic", "right_topic", F.round(F.col("dot") / (F.col("x") * F.col("y")), 6).alias("similarity"))


@query(f"""WITH t AS ({top_sql(SCORED, 100)}), d AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS vec_id FROM (SELECT DISTINCT term FROM t)),
  w AS (SELECT term, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM d JOIN embeddings USING (vec_id)),
  r AS (SELECT lang AS topic, i, avg(x) AS x FROM (SELECT lang, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM documents JOIN embeddings ON doc_id = vec_id) GROUP BY 1, 2),
  c AS (SELECT topic, list(x ORDER BY i) AS c FROM r GROUP BY 1),
  s AS (SELECT t.topic, t.term, round({cos_sql('e', 'c')}, 6) AS score FROM t JOIN w USING (term) JOIN c USING (topic))
  SELECT topic, rank, term, score FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS rank FROM s) WHERE rank <= 10""")
def nearest_words(spark, sf_dir):
    from pyspark.sql import Window

    candidates = ctfidf.top_words(ctfidf.score(_bow(spark, sf_dir)), 100)
    ids = candidates.select("term").distinct().withColumn("vec_id", (F.row_number().over(Window.orderBy("term")) - 1).cast("long"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("lang").alias("topic")).join(vectors, "vec_id")
    return tuners.nearest_words(candidates, ids.join(vectors, "vec_id").select("term", "vector"), docs, digits=6)


BATCHED = f"SELECT doc_id % 4 AS batch, lang AS topic, term, count(*) AS n FROM (SELECT *, unnest({TOK}) AS term FROM documents) GROUP BY 1, 2, 3"


@query(f"SELECT topic, term, round(sum(n * pow(0.9, 3 - batch)), 6) AS n FROM ({BATCHED}) GROUP BY 1, 2")
def online_bow_decay(spark, sf_dir):
    """Four batches absorbed one after the other."""
    docs, state = table(spark, sf_dir, "documents"), None
    for k in range(4):
        state = online.update(state, ctfidf.bag_of_words(docs.where(f"doc_id % 4 = {k}").select("lang", "text"), "lang"), 0.1)
    return state.withColumn("n", F.round("n", 6))


@query(f"SELECT lang AS topic, term, CAST(count(*) AS DOUBLE) AS n FROM (SELECT *, unnest({TOK}) AS term FROM documents) GROUP BY 1, 2")
def online_stream(spark, sf_dir):
    """A stream read to its end in several batches; without decay the counts are those of one batch."""
    docs = table(spark, sf_dir, "documents")
    root = scratch(spark)
    docs.select("lang", "text").repartition(4).write.parquet(f"{root}/arriving")  # a stream reads a folder; the table may be one file
    stream = spark.readStream.schema("lang string, text string").option("maxFilesPerTrigger", 2).parquet(f"{root}/arriving")
    terms = online.OnlineTerms(spark, f"{root}/state", "lang")
    terms.run(stream, f"{root}/progress")
    return terms.state()


@query("""SELECT from_topic, 3 + row_number() OVER (ORDER BY from_topic) AS to_topic FROM (SELECT DISTINCT source AS from_topic FROM documents WHERE source NOT IN ('src0', 'src1', 'src2', 'src3'))""")
def online_new_topics(spark, sf_dir):
    known = spark.createDataFrame([("src0", 0), ("src1", 1), ("src2", 2), ("src3", 3)], "from_topic string, to_topic long")
    return online.new_topics(known, table(spark, sf_dir, "documents"), "source")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_events(spark, sf_dir):
    return online.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type")


@query("SELECT conv_id, count(*) AS n, CAST(sum(turn) AS BIGINT) AS turns, max(role) AS role FROM conversations GROUP BY conv_id")
def json_roundtrip(spark, sf_dir):
    """Conversations nested, written as CSV with JSON cells, read back and flattened."""
    from ..operators import segments

    nested = segments.nest(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"])
    path = scratch(spark)
    files.write_csv(nested, path)
    back = files.read_csv(spark, path, T.StructType([T.StructField(f.name, f.dataType) for f in nested.schema]))
    rows = back.select("conv_id", F.explode("segments").alias("s"))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum("s.turn").alias("turns"), F.max("s.role").alias("role"))


@query("SELECT 'labels' AS step, 1::BIGINT AS entries, 2.0::DOUBLE AS seconds UNION ALL SELECT 'topics', 1, 3.0")
def cache_stats(spark, sf_dir):
    cache = files.StageCache(spark, scratch(spark))
    cache.save(table(spark, sf_dir, "labels"), "f", "labels", 1.0)
    cache.save(table(spark, sf_dir, "labels"), "f", "labels", 2.0)
    cache.save(topics.sizes(table(spark, sf_dir, "documents"), "lang"), "f", "topics", 3.0)
    cache.save(table(spark, sf_dir, "region"), "f", "gone", 4.0)
    cache.invalidate("f", "gone")
    return cache.statistics()


@query(top_sql(SCORED))
def model_roundtrip(spark, sf_dir):
    """A fitted model saved, loaded and asked for its words."""
    model = TopicModel.fit(table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("topic")))
    path = scratch(spark)
    model.save(path)
    return TopicModel.load(spark, path).words()


@query()
def model_fit_transform(spark, sf_dir):
    """k-means topics of embedded documents, and the nearest topic of each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id")
    model = TopicModel.fit(docs, TopicModelParams(clusterer="kmeans", n_clusters=5))
    return model.transform(docs.select("doc_id", "vector")).select("doc_id", "topic", F.round("similarity", 6).alias("similarity"))


@query()
def survey_pipeline(spark, sf_dir):
    """First turns of conversations taken as answers, coded and exported as indicators of themes."""
    raw = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("respondent_id")).agg(F.min_by("text", "turn").alias("response"))
    p = SurveyPipeline(n_clusters=4)
    graded = p.grade(p.preprocess(raw))
    coded, book = p.label(p.cluster(p.segment(graded)))
    names = book.select("theme", "concept_id").collect()  # one row for each of the four clusters
    return p.export(raw, graded, coded, sorted({r["theme"] for r in names}), sorted({r["concept_id"] for r in names})).select("respondent_id", "Q_USER_MISSING_97", "Q_SYSTEM_MISSING_98", "Q_NO_ANSWER_99")

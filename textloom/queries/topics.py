"""Term scores, topic tables and facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..operators import ctfidf, facets, topics
from ..plans.tables import table
from ._register import query

TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"


def bow_sql(topic: str = "lang", source: str = "documents") -> str:
    return f"SELECT {topic} AS topic, term, count(*) AS n FROM (SELECT *, unnest({TOK}) AS term FROM {source}) GROUP BY 1, 2"


def score_sql(bow: str, idf: str = "ln(a / total + 1)", tf: str = "n / size", join: str = "") -> str:
    return f"""SELECT topic, term, n, total, ({tf}) * ({idf}) AS score, {idf} AS idf FROM (
      SELECT b.*, sum(n) OVER (PARTITION BY term) AS total, size, a FROM ({bow}) b
      JOIN (SELECT topic, sum(n) AS size, floor(avg(sum(n)) OVER ()) AS a FROM ({bow}) GROUP BY topic) s USING (topic)) {join}"""


def top_sql(scored: str, n: int = 10) -> str:
    return f"""SELECT topic, rank, term, score FROM (SELECT topic, term, round(score, 9) AS score,
      row_number() OVER (PARTITION BY topic ORDER BY round(score, 9) DESC, term) AS rank FROM ({scored}) WHERE round(score, 9) > 0) WHERE rank <= {n}"""


def _bow(spark, sf_dir, topic="lang"):
    return ctfidf.bag_of_words(table(spark, sf_dir, "documents").select(topic, "text"), topic)


def _top(scored, n=10):
    return ctfidf.top_words(scored, n).select("topic", "rank", "term", "score")


@query(top_sql(score_sql(bow_sql())))
def ctfidf_top_words(spark, sf_dir):
    return _top(ctfidf.score(_bow(spark, sf_dir)))


@query(top_sql(score_sql(bow_sql(), idf="ln(1 + (a - total + 0.5) / (total + 0.5))")))
def ctfidf_bm25(spark, sf_dir):
    return _top(ctfidf.score(_bow(spark, sf_dir), bm25=True))


@query(top_sql(score_sql(bow_sql(), tf="sqrt(n / size)")))
def ctfidf_sqrt(spark, sf_dir):
    return _top(ctfidf.score(_bow(spark, sf_dir), sqrt=True))


@query(top_sql(score_sql(bow_sql(), idf="ln(a / total + 1) * CASE WHEN term IN ('the', 'der') THEN 2.0 WHEN term = 'of' THEN 1.2 ELSE 1.0 END")))
def ctfidf_seeded(spark, sf_dir):
    seeds = spark.createDataFrame([("the", 2.0), ("der", 2.0), ("of", 1.2)], "term string, multiplier double")
    return _top(ctfidf.score(_bow(spark, sf_dir), seeds=seeds))


BIGRAMS = f"""SELECT topic, term || ' ' || after AS term, count(*) AS n FROM (
  SELECT topic, term, lead(term) OVER (PARTITION BY topic ORDER BY doc_id, i) AS after FROM (
    SELECT lang AS topic, doc_id, unnest({TOK}) AS term, unnest(range(len({TOK}))) AS i FROM documents)) WHERE after IS NOT NULL GROUP BY 1, 2"""


@query(top_sql(score_sql(BIGRAMS)))
def ctfidf_bigrams(spark, sf_dir):
    return _top(ctfidf.score(ctfidf.bigrams_across(table(spark, sf_dir, "documents"), "lang", "doc_id")))


@query(f"""WITH b AS ({bow_sql('source')}), t AS (SELECT term, count(*) AS df, sum(n) AS total FROM b GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.9 * (SELECT count(DISTINCT topic) FROM b)),
  k AS (SELECT term FROM t ORDER BY total DESC, term LIMIT 500)
  SELECT topic, term, n FROM b WHERE term IN (SELECT term FROM k)""")
def vocabulary_bounds(spark, sf_dir):
    return tk.bounded_terms(_bow(spark, sf_dir, "source"), "topic", min_df=2, max_df=0.9, max_features=500).select("topic", "term", "n")


@query(f"""SELECT topic, rank, score, log10(score) AS log_score FROM ({top_sql(score_sql(bow_sql()), 30)})""".replace("log10(score)", "round(log10(score), 6)"))
def term_rank_decline(spark, sf_dir):
    return ctfidf.top_words(ctfidf.score(_bow(spark, sf_dir)), 30).select("topic", "rank", "score", F.round(F.log10("score"), 6).alias("log_score"))


@query("SELECT lang AS topic, count(*) AS size FROM documents GROUP BY lang")
def topic_sizes(spark, sf_dir):
    return topics.sizes(table(spark, sf_dir, "documents"), "lang")


TOPIC = "CASE WHEN n_chars < 400 THEN -1 ELSE CAST(substring(source, 4) AS BIGINT) END"
SIZES = f"SELECT {TOPIC} AS topic, count(*) AS size FROM documents GROUP BY 1"
RENUMBER = f"SELECT topic AS from_topic, CAST(CASE WHEN topic = -1 THEN -1 ELSE row_number() OVER (PARTITION BY topic = -1 ORDER BY size DESC, topic) - 1 END AS BIGINT) AS to_topic FROM ({SIZES})"


def _numbered(spark, sf_dir):
    topic = F.when(F.col("n_chars") < 400, F.lit(-1)).otherwise(F.substring("source", 4, 9).cast("long"))
    return table(spark, sf_dir, "documents").withColumn("topic", topic.cast("long"))


@query(RENUMBER)
def topic_renumber(spark, sf_dir):
    return topics.renumbering(topics.sizes(_numbered(spark, sf_dir)))


@query(f"SELECT CAST(max(CASE WHEN {TOPIC} = -1 THEN 1 ELSE 0 END) AS INTEGER) AS outliers FROM documents")
def outlier_flag(spark, sf_dir):
    return topics.outliers(_numbered(spark, sf_dir))


WORDS = f"SELECT topic, list(term ORDER BY rank) AS words FROM ({top_sql(score_sql(bow_sql()))}) GROUP BY topic"


@query(f"""SELECT s.topic, s.n AS count, w.topic || '_' || array_to_string(words[1:4], '_') AS name, array_to_string(words, ',') AS representation
  FROM (SELECT lang AS topic, count(*) AS n FROM documents GROUP BY 1) s LEFT JOIN ({WORDS}) w USING (topic)""")
def topic_info(spark, sf_dir):
    words = ctfidf.representation(ctfidf.score(_bow(spark, sf_dir)))
    info = topics.topic_info(topics.sizes(table(spark, sf_dir, "documents"), "lang"), words)
    return info.withColumn("representation", F.array_join("representation", ","))


@query(f"""SELECT topic, topic || '_' || array_to_string(words[1:4], '_') AS label, array_to_string(list_transform(words[1:3], lambda w: left(w, 3)), '-') AS short,
  CASE WHEN topic = 'en' THEN 'English texts' ELSE topic || '_' || array_to_string(words[1:4], '_') END AS custom FROM ({WORDS})""")
def topic_labels(spark, sf_dir):
    words = ctfidf.representation(ctfidf.score(_bow(spark, sf_dir)))
    made = words.select("topic", topics.label(F.col("topic"), F.col("words")).alias("label"), topics.label(F.col("topic"), F.col("words"), 3, "-", 3, False).alias("short"))
    custom = topics.custom_labels(made.select("topic", "label"), spark.createDataFrame([("en", "English texts")], "topic string, label string"))
    return made.join(custom.withColumnRenamed("label", "custom"), "topic")


@query(f"""WITH i AS (SELECT topic, topic || '_' || array_to_string(words[1:4], '_') AS name, array_to_string(words, ' - ') AS top_words FROM ({WORDS})),
  r AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 3)
  SELECT doc_id, lang AS topic, name, top_words, doc_id IN (SELECT doc_id FROM r) AS representative FROM documents JOIN i ON lang = topic""")
def document_info(spark, sf_dir):
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("topic"), "n_chars")
    words = ctfidf.representation(ctfidf.score(_bow(spark, sf_dir)))
    info = topics.topic_info(topics.sizes(docs), words)
    order = Window.partitionBy("topic").orderBy(F.desc("n_chars"), "doc_id")
    marked = docs.withColumn("k", F.row_number().over(order)).where("k <= 3")
    found = topics.document_info(docs.drop("n_chars"), info, marked)
    return found.select("doc_id", "topic", "name", F.array_join("representation", " - ").alias("top_words"), "representative")


MERGED = f"SELECT doc_id, lang, text, CASE WHEN {TOPIC} IN (3, 7, 11) THEN 3 WHEN {TOPIC} IN (1, 2) THEN 1 ELSE {TOPIC} END AS topic FROM documents"


@query(top_sql(score_sql(bow_sql("topic", f"({MERGED})"))).replace("CAST(substring(source, 4) AS BIGINT)", "CAST(substring(source, 4) AS BIGINT)"))
def topic_merge(spark, sf_dir):
    docs = _numbered(spark, sf_dir)
    mapping = topics.merge_mapping(topics.sizes(docs), [[3, 7, 11], [1, 2]])
    return _top(ctfidf.score(ctfidf.bag_of_words(topics.remap(docs, mapping).select("topic", "text"), "topic")))


@query(f"""WITH a AS ({RENUMBER}), b AS (SELECT from_topic, CASE WHEN from_topic % 2 = 0 THEN from_topic // 2 END AS to_topic FROM (SELECT to_topic AS from_topic FROM a WHERE to_topic >= 0) WHERE from_topic % 2 = 0)
  SELECT a.from_topic, coalesce(b.to_topic, -1) AS to_topic FROM a LEFT JOIN b ON a.to_topic = b.from_topic""")
def mapping_compose(spark, sf_dir):
    first = topics.renumbering(topics.sizes(_numbered(spark, sf_dir)))
    then = first.where("to_topic >= 0 and to_topic % 2 = 0").selectExpr("to_topic as from_topic", "to_topic div 2 as to_topic")
    return topics.compose(first, then)


@query("""SELECT vec_id AS doc_id, CAST(label // 2 AS BIGINT) AS topic, round(sum(w), 6) AS weight FROM (
  SELECT vec_id, unnest(range(10)) AS label, unnest(list_transform(embedding[1:10], lambda x: abs(CAST(x AS DOUBLE)))) AS w FROM embeddings) GROUP BY 1, 2""")
def probability_remap(spark, sf_dir):
    weights = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.posexplode(F.transform(F.slice("embedding", 1, 10), lambda x: F.abs(x.cast("double")))).alias("topic", "weight"))
    mapping = spark.range(10).selectExpr("id as from_topic", "id div 2 as to_topic")
    return topics.remap_weights(weights.withColumn("topic", F.col("topic").cast("long")), mapping).withColumn("weight", F.round("weight", 6))


@query("""SELECT topic, 'new' AS kind FROM (SELECT DISTINCT lang AS topic FROM documents WHERE doc_id % 2 = 1 EXCEPT SELECT DISTINCT lang FROM documents WHERE doc_id % 2 = 0 AND lang <> 'es')
  UNION ALL SELECT topic, 'missing' FROM (SELECT DISTINCT lang AS topic FROM documents WHERE doc_id % 2 = 0 AND lang <> 'es' EXCEPT SELECT DISTINCT lang FROM documents WHERE doc_id % 2 = 1)""")
def topic_differences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("lang", "topic")
    return topics.set_differences(docs.where("doc_id % 2 = 0 and topic <> 'es'"), docs.where("doc_id % 2 = 1"))


def facet_sql(docs: str) -> str:
    """``docs`` gives facet, topic, text."""
    return f"""WITH d AS ({docs}), f AS ({score_sql(bow_sql('topic', '(SELECT lang AS topic, text FROM documents)'))}),
  g AS (SELECT topic, term, idf, score / sum(score) OVER (PARTITION BY topic) AS overall FROM f),
  c AS (SELECT facet, topic, count(*) AS frequency FROM d GROUP BY 1, 2),
  b AS (SELECT facet, topic, term, count(*) AS n FROM (SELECT facet, topic, unnest({TOK}) AS term FROM d) GROUP BY 1, 2, 3),
  s AS (SELECT b.facet, b.topic, b.term, n / sum(n) OVER (PARTITION BY b.facet, b.topic) * idf AS v FROM b JOIN g USING (topic, term)),
  t AS (SELECT facet, topic, term, v / sum(v) OVER (PARTITION BY facet, topic) AS v FROM s),
  m AS (SELECT c.facet, c.topic, g.term, round((g.overall + coalesce(t.v, 0)) / 2, 9) AS v FROM c JOIN g USING (topic) LEFT JOIN t ON t.facet = c.facet AND t.topic = c.topic AND t.term = g.term),
  r AS (SELECT *, row_number() OVER (PARTITION BY facet, topic ORDER BY v DESC, term) AS k FROM m WHERE v > 0)
  SELECT facet, topic, string_agg(term, ', ' ORDER BY k) AS words, any_value(frequency) AS frequency FROM r JOIN c USING (facet, topic) WHERE k <= 5 GROUP BY 1, 2"""


@query(facet_sql("SELECT source AS facet, lang AS topic, text FROM documents"))
def topics_per_class(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("facet"), "lang", "text")
    return facets.facet_words(docs, ctfidf.score(_bow(spark, sf_dir)), "facet", "lang")


STAMPED = "SELECT doc_id, lang, text, epoch_us(ts) AS stamp FROM documents JOIN events ON event_id = doc_id"
BINNED = f"""SELECT *, CAST(CASE WHEN place = 1 THEN lo - 0.001 * (hi - lo) ELSE lo + (place - 1) * ((hi - lo) / 10) END AS BIGINT) AS bin_left FROM (
  SELECT *, greatest(1, ceil((stamp - lo) / ((hi - lo) / 10))) AS place FROM (SELECT *, min(stamp) OVER () AS lo, max(stamp) OVER () AS hi FROM ({STAMPED})))"""
BINNED = BINNED.replace("0.001 *", "CAST(0.001 AS DOUBLE) *").replace("CAST(CASE", "CAST(trunc(CASE").replace("END AS BIGINT)", "END) AS BIGINT)")


def _binned(spark, sf_dir):
    stamps = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("stamp"))
    return facets.bins(table(spark, sf_dir, "documents").select("doc_id", "lang", "text").join(stamps, "doc_id"), "stamp", 10)


@query(f"SELECT bin_left, count(*) AS n, min(stamp) AS first, max(stamp) AS last FROM ({BINNED}) GROUP BY 1")
def time_bins(spark, sf_dir):
    return _binned(spark, sf_dir).groupBy("bin_left").agg(F.count(F.lit(1)).alias("n"), F.min("stamp").alias("first"), F.max("stamp").alias("last"))


@query(facet_sql(f"SELECT bin_left AS facet, lang AS topic, text FROM ({BINNED})"))
def topics_over_time(spark, sf_dir):
    docs = _binned(spark, sf_dir).withColumnRenamed("bin_left", "facet")
    return facets.facet_words(docs, ctfidf.score(_bow(spark, sf_dir)), "facet", "lang")


@query("""SELECT lang AS topic, source, n AS frequency, round(n / sqrt(sum(n * n) OVER (PARTITION BY lang)), 6) AS normalized
  FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2)""")
def facet_frequencies(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("topic"), "source").agg(F.count(F.lit(1)).alias("frequency"))
    return counts.withColumn("normalized", F.round(facets.normalized_frequency(counts), 6))

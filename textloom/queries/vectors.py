"""Vectors, similarity assignment, clusters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import blocks, clusters, pairwise, similarity
from ..plans.tables import ranked, table
from ._register import query

D = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
LONG = "SELECT vec_id, CAST(label AS BIGINT) AS topic, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"
CENTERS = f"SELECT topic, i, avg(x) AS c FROM ({LONG}) GROUP BY topic, i"
CENTER_LISTS = f"SELECT topic, list(c ORDER BY i) AS c FROM ({CENTERS}) GROUP BY topic"


def cos_sql(a: str, b: str) -> str:
    return f"(CASE WHEN list_dot_product({a}, {a}) = 0 OR list_dot_product({b}, {b}) = 0 THEN 0.0 ELSE list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) END)"


def nearest_sql(rows: str, topics: str, threshold: float | None = None) -> str:
    """``rows``: vec_id, e; ``topics``: topic, c."""
    topic = "topic" if threshold is None else f"CASE WHEN similarity >= {threshold} THEN topic ELSE -1 END"
    return f"""SELECT vec_id, CAST({topic} AS BIGINT) AS topic, similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, topic) AS k FROM (
      SELECT vec_id, topic, round({cos_sql('e', 'c')}, 6) AS similarity FROM ({rows}) CROSS JOIN ({topics}))) WHERE k = 1"""


def _embedded(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), F.col("label").cast("long").alias("topic"))


def _centers(spark, sf_dir):
    return v.mean_vectors(_embedded(spark, sf_dir), "topic", "vector")


def _seeds(spark, sf_dir):
    """The first vector of each label, as the embedding of a given label."""
    first = _embedded(spark, sf_dir).groupBy("topic").agg(F.min_by("vector", "vec_id").alias("vector"))
    return first


SEEDS = f"SELECT CAST(label AS BIGINT) AS topic, arg_min({D}, vec_id) AS c FROM embeddings GROUP BY label"
ROWS = f"SELECT vec_id, {D} AS e FROM embeddings"


@query(f"SELECT topic, i, round(c, 6) + 0.0 AS value FROM ({CENTERS})")
def centroids(spark, sf_dir):
    c = _centers(spark, sf_dir).select("topic", F.posexplode("vector").alias("i", "x"))
    return c.select("topic", F.col("i").cast("long").alias("i"), (F.round("x", 6) + 0.0).alias("value"))


@query(f"SELECT vec_id, CAST(label AS BIGINT) AS topic, round({cos_sql('e', 'c')}, 6) AS similarity FROM (SELECT *, {D} AS e FROM embeddings) JOIN ({CENTER_LISTS}) ON topic = label")
def cosine_to_centroid(spark, sf_dir):
    c = _centers(spark, sf_dir).withColumnRenamed("vector", "c")
    joined = _embedded(spark, sf_dir).join(c, "topic")
    return joined.select("vec_id", "topic", F.round(v.cosine(v.doubles(F.col("vector")), F.col("c")), 6).alias("similarity"))


@query(nearest_sql(ROWS, CENTER_LISTS))
def nearest_topic(spark, sf_dir):
    return similarity.nearest(_embedded(spark, sf_dir).drop("topic"), _centers(spark, sf_dir), digits=6).select("vec_id", "topic", "similarity")


@query(f"SELECT topic // 2 AS topic, i, round(sum(n * c) / sum(n), 6) + 0.0 AS value FROM (SELECT topic, i, avg(x) AS c, count(*) AS n FROM ({LONG}) GROUP BY 1, 2) GROUP BY 1, 2")
def weighted_topic_vectors(spark, sf_dir):
    sizes = _embedded(spark, sf_dir).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    merged = _centers(spark, sf_dir).join(sizes, "topic").withColumn("topic", F.expr("topic div 2"))
    means = v.mean_vectors(merged, "topic", "vector", "n").select("topic", F.posexplode("vector").alias("i", "x"))
    return means.select("topic", F.col("i").cast("long").alias("i"), (F.round("x", 6) + 0.0).alias("value"))


@query(f"""SELECT l.vec_id, l.i, round(0.6 * l.x + 0.3 * q.x + 0.1 * m.x, 6) + 0.0 AS value FROM ({LONG}) l JOIN (SELECT i, x FROM ({LONG}) WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) q USING (i)
  JOIN (SELECT i, avg(x) AS x FROM ({LONG}) GROUP BY i) m USING (i)""")
def question_aware_blend(spark, sf_dir):
    rows = _embedded(spark, sf_dir)
    question = rows.agg(F.min_by("vector", "vec_id").alias("vector"))
    out = similarity.question_aware(rows, question).select("vec_id", F.posexplode("vector").alias("i", "x"))
    return out.select("vec_id", F.col("i").cast("long").alias("i"), (F.round("x", 6) + 0.0).alias("value"))


@query(f"SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS l2, round(list_sum(list_transform(e, lambda x: abs(x))), 6) AS l1, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first FROM ({ROWS})")
def vector_norms(spark, sf_dir):
    e = v.doubles(F.col("vector"))
    return _embedded(spark, sf_dir).select("vec_id", F.round(v.norm(e), 6).alias("l2"), F.round(F.aggregate(e, F.lit(0.0), lambda s, x: s + F.abs(x)), 6).alias("l1"), F.round(v.scaled(e)[0], 6).alias("first"))


@query(f"""SELECT a.vec_id, round(list_dot_product(a.e, b.e), 6) AS product, round((a.e[1] + b.e[1]) / 2, 6) AS first FROM ({ROWS}) a JOIN ({ROWS}) b ON b.vec_id = a.vec_id + 1""")
def combine_embeddings(spark, sf_dir):
    a = _embedded(spark, sf_dir).select("vec_id", v.doubles(F.col("vector")).alias("a"))
    b = _embedded(spark, sf_dir).select((F.col("vec_id") - 1).alias("vec_id"), v.doubles(F.col("vector")).alias("b"))
    both = a.join(b, "vec_id")
    return both.select("vec_id", F.round(v.dot(F.col("a"), F.col("b")), 6).alias("product"), F.round(v.blend(F.col("a"), F.col("b"), 0.5, 0.5)[0], 6).alias("first"))


@query(f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents),
  d AS (SELECT term, row_number() OVER (ORDER BY n DESC, term) - 1 AS vec_id FROM (SELECT term, count(*) AS n FROM w GROUP BY term)),
  j AS (SELECT doc_id, embedding FROM w JOIN d USING (term) JOIN embeddings USING (vec_id)),
  s AS (SELECT doc_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM j)
  SELECT doc_id, i, round(avg(x), 6) + 0.0 AS value FROM s GROUP BY 1, 2""")
def word_vector_mean(spark, sf_dir):
    from ..functions import tokens as tk

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = docs.select("doc_id", F.explode(tk.tokens(F.col("text"))).alias("term"))
    known = ranked(words.groupBy("term").agg(F.count(F.lit(1)).alias("n")), F.desc("n"), "term", name="vec_id").select("term", "vec_id")
    vectors = known.join(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("e")), "vec_id").select("term", "e")
    means = blocks.word_means(docs.select("doc_id", tk.tokens(F.col("text")).alias("words")), "doc_id", "words", vectors, "e")
    return means.select("doc_id", F.col("i").cast("long").alias("i"), (F.round("x", 6) + 0.0).alias("value"))


@query(nearest_sql(ROWS, SEEDS, 0.3))
def zero_shot_assign(spark, sf_dir):
    return similarity.nearest(_embedded(spark, sf_dir).drop("topic"), _seeds(spark, sf_dir), digits=6, threshold=0.3).select("vec_id", "topic", "similarity")


@query(f"""SELECT vec_id, CASE WHEN similarity >= 0.3 THEN topic ELSE CAST(label AS BIGINT) + 10 END AS topic FROM ({nearest_sql(ROWS, SEEDS)}) JOIN embeddings USING (vec_id)""")
def zero_shot_combine(spark, sf_dir):
    found = similarity.nearest(_embedded(spark, sf_dir).withColumnRenamed("topic", "cluster"), _seeds(spark, sf_dir), digits=6, threshold=0.3)
    assigned = found.where("topic >= 0").select("vec_id", "topic")
    rest = found.where("topic < 0").select("vec_id", (F.col("cluster") + 10).alias("topic"))
    return assigned.unionByName(rest)


OVERALL = f"SELECT CAST(1073741824 AS BIGINT) AS topic, list(c ORDER BY i) AS c FROM (SELECT i, avg(x) AS c FROM ({LONG}) GROUP BY i)"


@query(f"""WITH n AS ({nearest_sql(ROWS, f'{SEEDS} UNION ALL {OVERALL}')}), s AS ({SEEDS})
  SELECT n.vec_id, CASE WHEN n.topic = 1073741824 THEN -1 ELSE n.topic END AS seed, round(CASE WHEN s.c IS NULL THEN e[1] ELSE 0.75 * e[1] + 0.25 * s.c[1] END, 6) AS first
  FROM n JOIN ({ROWS}) USING (vec_id) LEFT JOIN s ON s.topic = n.topic""")
def guided_blend(spark, sf_dir):
    rows = _embedded(spark, sf_dir).drop("topic")
    overall = v.mean_vectors(rows.withColumn("g", F.lit(1)), "g", "vector")
    out = similarity.guided(rows, _seeds(spark, sf_dir), overall)
    return out.select("vec_id", "seed", F.round(F.col("vector")[0], 6).alias("first"))


NOISY = "CASE WHEN vec_id % 5 = 0 THEN -1 ELSE CAST(label AS BIGINT) END"
NOISY_CENTERS = f"SELECT topic, list(c ORDER BY i) AS c FROM (SELECT topic, i, avg(x) AS c FROM ({LONG}) WHERE vec_id % 5 <> 0 GROUP BY 1, 2) GROUP BY topic"


def _noisy(spark, sf_dir):
    return _embedded(spark, sf_dir).withColumn("cluster", F.when(F.col("vec_id") % 5 == 0, F.lit(-1)).otherwise(F.col("topic"))).drop("topic")


@query(f"""SELECT vec_id, {NOISY} AS cluster, FALSE AS rescued FROM embeddings WHERE vec_id % 5 <> 0
  UNION ALL SELECT vec_id, topic, topic >= 0 FROM ({nearest_sql(f'{ROWS} WHERE vec_id % 5 = 0', NOISY_CENTERS, 0.25)})""")
def noise_rescue(spark, sf_dir):
    return clusters.rescue_by_similarity(_noisy(spark, sf_dir), threshold=0.25).select("vec_id", "cluster", "rescued")


@query(f"""WITH t AS (SELECT vec_id FROM embeddings WHERE vec_id % 5 = 0 ORDER BY vec_id LIMIT 1000),
  s AS (SELECT vec_id, unnest(range(10)) AS topic, unnest(list_transform(embedding[1:10], lambda x: abs(CAST(x AS DOUBLE)))) AS strength FROM embeddings JOIN t USING (vec_id)),
  b AS (SELECT vec_id, topic, strength FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY strength DESC, topic) = 1)
  SELECT vec_id, coalesce(b.topic, {NOISY}) AS cluster FROM embeddings LEFT JOIN (SELECT * FROM b WHERE strength > 0.2) b USING (vec_id)""")
def noise_rescue_strength(spark, sf_dir):
    strengths = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.transform(F.slice("embedding", 1, 10), lambda x: F.abs(x.cast("double")))).alias("topic", "strength"))
    return clusters.rescue_by_strength(_noisy(spark, sf_dir), strengths.withColumn("topic", F.col("topic").cast("long")), "vec_id", threshold=0.2).select("vec_id", "cluster")


@query(f"""SELECT vec_id, topic FROM ({nearest_sql(f'{ROWS} WHERE vec_id % 5 = 0', NOISY_CENTERS)}) UNION ALL SELECT vec_id, CAST(label AS BIGINT) FROM embeddings WHERE vec_id % 5 <> 0""")
def reduce_outliers_embeddings(spark, sf_dir):
    return clusters.rescue_by_similarity(_noisy(spark, sf_dir), threshold=-2.0).select("vec_id", F.col("cluster").alias("topic"))


@query(f"""SELECT vec_id, CAST(CASE WHEN {NOISY} = -1 THEN list_position(p, list_max(p)) - 1 ELSE label END AS BIGINT) AS topic FROM (SELECT *, list_transform(embedding[1:10], lambda x: abs(CAST(x AS DOUBLE))) AS p FROM embeddings)""")
def reduce_outliers_probabilities(spark, sf_dir):
    p = F.transform(F.slice("embedding", 1, 10), lambda x: F.abs(x.cast("double")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", p.alias("p"))
    best = F.array_position("p", F.array_max("p")) - 1
    return rows.select("vec_id", F.when(F.col("vec_id") % 5 == 0, best).otherwise(F.col("label").cast("long")).alias("topic"))


@query(f"""SELECT topic, similarity FROM (SELECT topic, round({cos_sql('e', 'c')}, 6) AS similarity FROM ({CENTER_LISTS}) CROSS JOIN (SELECT {D} AS e FROM embeddings WHERE vec_id = 7)) ORDER BY similarity DESC, topic LIMIT 5""")
def find_topics(spark, sf_dir):
    term = _embedded(spark, sf_dir).where("vec_id = 7").select("vector")
    scored = similarity.similarities(term, _centers(spark, sf_dir))
    return scored.select("topic", F.round("similarity", 6).alias("similarity")).orderBy(F.desc("similarity"), "topic").limit(5)


@query(f"SELECT a.topic AS left_topic, b.topic AS right_topic, round({cos_sql('a.c', 'b.c')}, 6) AS similarity FROM ({CENTER_LISTS}) a CROSS JOIN ({CENTER_LISTS}) b")
def topic_similarity_matrix(spark, sf_dir):
    c = _centers(spark, sf_dir)
    scored = similarity.similarities(c.withColumnRenamed("topic", "left_topic"), c.select("topic", "vector"))
    return scored.select("left_topic", F.col("topic").alias("right_topic"), F.round("similarity", 6).alias("similarity"))


@query(f"""WITH n AS (SELECT label, role, count(*) AS c FROM (SELECT conv_id % 12 - 1 AS label, CASE WHEN conv_id % 12 IN (4, 7) THEN 'NA' ELSE role END AS role, conv_id FROM conversations) GROUP BY 1, 2),
  k AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS new FROM n WHERE label <> -1 GROUP BY label HAVING NOT bool_and(lower(role) = 'na'))
  SELECT c.conv_id, c.turn, k.new AS cluster FROM conversations c LEFT JOIN k ON k.label = c.conv_id % 12 - 1""")
def cluster_filter_remap(spark, sf_dir):
    n = F.col("conv_id") % 12
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (n - 1).alias("cluster"), F.when(n.isin(4, 7), "NA").otherwise(F.col("role")).alias("label"))
    return clusters.filter_and_remap(rows).select("conv_id", "turn", "cluster")


@query(f"""WITH c AS (SELECT {NOISY} AS cluster FROM embeddings), s AS (SELECT cluster, count(*) AS n FROM c WHERE cluster <> -1 GROUP BY 1)
  SELECT round(count(*) FILTER (WHERE cluster = -1) / count(*), 6) AS noise_ratio, round(1 - count(*) FILTER (WHERE cluster = -1) / count(*), 6) AS coverage, (SELECT count(*) FROM s) AS clusters,
  (SELECT round(avg(n), 6) FROM s) AS mean_size, (SELECT round(var_pop(n), 6) FROM s) AS size_variance FROM c""")
def cluster_quality(spark, sf_dir):
    q = clusters.quality(_noisy(spark, sf_dir))
    return q.select(*[F.round(c, 6).alias(c) if c != "clusters" else c for c in q.columns])



@query(f"""WITH e AS (SELECT vec_id, CAST(label AS BIGINT) AS c, {D} AS e FROM embeddings WHERE vec_id % 5 <> 0),
  p AS (SELECT a.vec_id, a.c AS own, b.c AS other, sum(list_distance(a.e, b.e)) AS s, count(*) AS n FROM e a CROSS JOIN e b GROUP BY 1, 2, 3),
  q AS (SELECT vec_id, max(CASE WHEN own = other AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM p GROUP BY 1)
  SELECT round(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM q WHERE b IS NOT NULL""")
def silhouette(spark, sf_dir):
    return pairwise.silhouette(_noisy(spark, sf_dir), "vec_id", "cluster").select(F.round("silhouette", 6).alias("silhouette"))


@query(f"""WITH e AS (SELECT vec_id, CAST(label AS BIGINT) AS cluster, {D} AS e FROM embeddings)
  SELECT a.cluster, round(avg({cos_sql('a.e', 'b.e')}), 6) AS mean, round(min({cos_sql('a.e', 'b.e')}), 6) AS min, round(max({cos_sql('a.e', 'b.e')}), 6) AS max, count(*) AS pairs
  FROM e a JOIN e b ON a.cluster = b.cluster AND a.vec_id < b.vec_id GROUP BY 1""")
def alignment_check(spark, sf_dir):
    s = pairwise.similarity_within(_embedded(spark, sf_dir), "vec_id", "topic")
    return s.select("cluster", *[F.round(c, 6).alias(c) for c in ("mean", "min", "max")], "pairs")


@query("SELECT md5(text) AS text_md5, count(DISTINCT conv_id % 7) AS clusters FROM conversations GROUP BY text HAVING count(DISTINCT conv_id % 7) > 1")
def duplicate_descriptions(spark, sf_dir):
    same = table(spark, sf_dir, "conversations").groupBy(F.md5("text").alias("text_md5")).agg(F.count_distinct(F.col("conv_id") % 7).alias("clusters"))
    return same.where("clusters > 1")


@query(f"""WITH s AS (SELECT topic, source || '-' || lang AS text, max(similarity) AS similarity FROM (SELECT vec_id, CAST(label AS BIGINT) AS topic, round({cos_sql('e', 'c')}, 6) AS similarity
    FROM (SELECT *, {D} AS e FROM embeddings) JOIN ({CENTER_LISTS}) ON topic = label) JOIN documents ON doc_id = vec_id GROUP BY 1, 2)
  SELECT topic, rank, text, similarity FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY similarity DESC, text) AS rank FROM s) WHERE rank <= 3""")
def cluster_representatives(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.concat_ws("-", "source", "lang").alias("text"))
    rows = _embedded(spark, sf_dir)
    centers = _centers(spark, sf_dir)
    scored = rows.join(texts, "vec_id").join(centers.withColumnRenamed("vector", "c"), "topic")
    scored = scored.select("topic", "text", F.round(v.cosine(v.doubles(F.col("vector")), F.col("c")), 6).alias("similarity"))
    once = scored.groupBy("topic", "text").agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy("topic").orderBy(F.desc("similarity"), "text")
    return once.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 3").select("topic", "rank", "text", "similarity")


@query("SELECT CAST(label AS BIGINT) AS cluster, count(*) AS size FROM embeddings GROUP BY label ORDER BY size DESC, cluster LIMIT 5")
def top_clusters(spark, sf_dir):
    return _embedded(spark, sf_dir).groupBy(F.col("topic").alias("cluster")).agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "cluster").limit(5)


@query()
def mmr_words(spark, sf_dir):
    """A diverse choice of ten rows for each topic among the hundred nearest to its centre, the method's candidates."""
    centers = _centers(spark, sf_dir)
    near = F.round(v.cosine(v.doubles(F.col("vector")), F.col("c")), 9)
    order = Window.partitionBy("topic").orderBy(F.desc("near"), "vec_id")
    scored = _embedded(spark, sf_dir).join(centers.withColumnRenamed("vector", "c"), "topic").withColumn("near", near)
    candidates = scored.withColumn("k", F.row_number().over(order)).where("k <= 100").select("vec_id", "vector", "topic")
    return clusters.mmr(candidates, "topic", "vec_id", "vector", centers, 0.3)


@query()
def pca_reduce(spark, sf_dir):
    return clusters.pca(_embedded(spark, sf_dir), 5).select("vec_id", v.rounded(F.col("reduced"), 5).alias("reduced"))


@query()
def kmeans_labels(spark, sf_dir):
    return clusters.kmeans(_embedded(spark, sf_dir), 10).select("vec_id", F.col("cluster").cast("long").alias("cluster"))


@query()
def density_labels(spark, sf_dir):
    return clusters.density_clusters(_embedded(spark, sf_dir).withColumnRenamed("vec_id", "id"), min_size=5)

"""Soft distributions, exports, codebooks and spelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..operators import codebook, ctfidf, distribution, export, spelling
from ..plans.tables import table
from ._register import query
from .topics import TOK, bow_sql, score_sql

RAW = "regexp_extract_all(text, '[\\p{L}\\p{N}_]{2,}')"
SPANS = f"""SELECT doc_id, f + 1 AS first, least(f + 4, len(w)) AS last, unnest(w[f + 1 : least(f + 4, len(w))]) AS t FROM (
  SELECT doc_id, w, unnest(range(greatest(1, len(w) - 3))) AS f FROM (SELECT doc_id, {RAW} AS w FROM documents WHERE len({RAW}) > 0))"""


@query(f"SELECT doc_id, first, last, lower(t) AS term, count(*) AS n FROM ({SPANS}) GROUP BY 1, 2, 3, 4")
def token_windows(spark, sf_dir):
    w = distribution.window_terms(table(spark, sf_dir, "documents"), "doc_id")
    return w.withColumns({"first": F.col("first").cast("long"), "last": F.col("last").cast("long")})


SIMS = f"""WITH s AS ({score_sql(bow_sql())}), i AS (SELECT term, max(idf) AS idf FROM s GROUP BY 1), m AS (SELECT topic, sqrt(sum(score * score)) AS topic_norm FROM s GROUP BY 1),
  t AS (SELECT doc_id, first, last, lower(t) AS term, count(*) AS n FROM ({SPANS}) GROUP BY 1, 2, 3, 4),
  w AS (SELECT t.*, n * idf AS w FROM t JOIN i USING (term)),
  l AS (SELECT doc_id, first, last, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1, 2, 3),
  d AS (SELECT doc_id, first, last, topic, sum(w * score) AS dot FROM w JOIN s USING (term) GROUP BY 1, 2, 3, 4),
  v AS (SELECT doc_id, first, last, topic, dot / (norm * topic_norm) AS similarity FROM d JOIN l USING (doc_id, first, last) JOIN m USING (topic) WHERE dot / (norm * topic_norm) >= 0.1)"""


def _sims(spark, sf_dir, **how):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return distribution.similarities(docs, ctfidf.score(ctfidf.bag_of_words(docs, "lang")), "doc_id", **how)


@query(SIMS + ", q AS (SELECT doc_id, topic, sum(similarity) AS s FROM v GROUP BY 1, 2) SELECT doc_id, topic, round(s / sum(s) OVER (PARTITION BY doc_id), 5) AS weight FROM q")
def approx_distribution(spark, sf_dir):
    return distribution.shares(_sims(spark, sf_dir), "doc_id").withColumn("weight", F.round("weight", 5))


@query(SIMS + " SELECT doc_id, position, topic, round(sum(similarity), 5) AS weight FROM (SELECT doc_id, topic, similarity, unnest(range(first, last + 1)) AS position FROM v) GROUP BY 1, 2, 3")
def approx_distribution_tokens(spark, sf_dir):
    t = _sims(spark, sf_dir, by="token")
    return t.withColumns({"position": F.col("position").cast("long"), "weight": F.round("weight", 5)})


@query(SIMS + ", q AS (SELECT doc_id, topic, sum(similarity) AS s FROM v GROUP BY 1, 2), p AS (SELECT doc_id, topic, round(s / sum(s) OVER (PARTITION BY doc_id), 5) AS weight FROM q) SELECT * FROM p WHERE weight >= 0.3")
def distribution_chart(spark, sf_dir):
    return distribution.shares(_sims(spark, sf_dir), "doc_id").withColumn("weight", F.round("weight", 5)).where("weight >= 0.3")


ASSIGNED = "SELECT conv_id, CAST(turn % 3 + 1 AS VARCHAR) AS theme, CAST(turn % 3 + 1 AS VARCHAR) || '.' || CASE role WHEN 'user' THEN '1' WHEN 'assistant' THEN '2' ELSE '3' END AS concept FROM conversations"
THEMES = ["1", "2", "3"]
CONCEPTS = [f"{t}.{c}" for t in THEMES for c in ("1", "2", "3")]


def _assigned(spark, sf_dir):
    theme = (F.col("turn") % 3 + 1).cast("string")
    number = F.when(F.col("role") == "user", "1").when(F.col("role") == "assistant", "2").otherwise("3")
    return table(spark, sf_dir, "conversations").select("conv_id", theme.alias("theme"), F.concat_ws(".", theme, number).alias("concept"))


@query(f"""WITH a AS ({ASSIGNED}), r AS (SELECT doc_id AS conv_id FROM documents), c AS (SELECT doc_id AS conv_id, 99999997 + 2 * toxic AS code FROM labels WHERE quality = 0),
  w AS (SELECT conv_id, {", ".join(f"max(CASE WHEN theme = '{t}' THEN 1 ELSE 0 END) AS Q_THEME_{t}" for t in THEMES)}, {", ".join(f"max(CASE WHEN concept = '{c}' THEN 1 ELSE 0 END) AS Q_CONCEPT_{c.replace('.', '_')}" for c in CONCEPTS)} FROM a GROUP BY conv_id)
  SELECT r.conv_id, {", ".join(f"coalesce(Q_THEME_{t}, 0) AS Q_THEME_{t}" for t in THEMES)}, {", ".join(f"coalesce(Q_CONCEPT_{c.replace('.', '_')}, 0) AS Q_CONCEPT_{c.replace('.', '_')}" for c in CONCEPTS)},
  CASE WHEN code = 99999997 THEN 1 ELSE 0 END AS Q_USER_MISSING_97, CASE WHEN code = 99999998 OR (w.conv_id IS NULL AND code IS NULL) THEN 1 ELSE 0 END AS Q_SYSTEM_MISSING_98, CASE WHEN code = 99999999 THEN 1 ELSE 0 END AS Q_NO_ANSWER_99
  FROM r LEFT JOIN w USING (conv_id) LEFT JOIN c USING (conv_id)""")
def indicator_pivot(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"))
    codes = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("conv_id"), (99999997 + 2 * F.col("toxic")).alias("code"))
    return export.indicators(docs, _assigned(spark, sf_dir), codes, "conv_id", "Q", THEMES, CONCEPTS)


FREQ = f"""WITH a AS ({ASSIGNED}), n AS (SELECT count(DISTINCT conv_id) AS n FROM conversations), f AS (
  SELECT 'Theme' AS level, theme AS id, count(DISTINCT conv_id) AS frequency FROM a GROUP BY theme UNION ALL SELECT 'Concept', concept, count(DISTINCT conv_id) FROM a GROUP BY theme, concept)
  SELECT level, id, frequency, printf('%.1f', round(100.0 * frequency / n, 1)) || '%' AS percentage FROM f, n"""


def _respondents(spark, sf_dir) -> int:
    return table(spark, sf_dir, "conversations").select("conv_id").distinct().count()


@query(FREQ)
def concept_frequencies(spark, sf_dir):
    return export.frequencies(_assigned(spark, sf_dir), "conv_id", _respondents(spark, sf_dir))


@query(f"SELECT * FROM ({FREQ}) WHERE level = 'Concept' ORDER BY frequency DESC, id LIMIT 5")
def top_concepts(spark, sf_dir):
    f = export.frequencies(_assigned(spark, sf_dir), "conv_id", _respondents(spark, sf_dir))
    return f.where("level = 'Concept'").orderBy(F.desc("frequency"), "id").limit(5)


@query(f"WITH e AS (SELECT conv_id, count(DISTINCT theme) AS t, count(DISTINCT concept) AS c FROM ({ASSIGNED}) GROUP BY 1) SELECT count(*) FILTER (WHERE t > 1) AS multi_theme, count(*) FILTER (WHERE c > 1) AS multi_concept FROM e")
def multi_concept_counts(spark, sf_dir):
    return export.several(_assigned(spark, sf_dir), "conv_id")


@query(f"SELECT * FROM ({ASSIGNED}) WHERE concept IN ('1.1', '2.2', '3.1')")
def codebook_check(spark, sf_dir):
    book = spark.createDataFrame([("1", "1.1"), ("2", "2.2"), ("3", "3.1"), ("1", "2.1")], "theme string, concept string")
    return export.in_codebook(_assigned(spark, sf_dir), book)


@query("""SELECT count(*) FILTER (WHERE b IS NULL) AS only_original, count(*) FILTER (WHERE a IS NULL) AS only_processed, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS matched,
  round(100.0 * count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) / count(a), 2) AS match_pct FROM (SELECT DISTINCT doc_id AS a FROM documents) FULL JOIN (SELECT DISTINCT doc_id AS b FROM labels) ON a = b""")
def id_consistency(spark, sf_dir):
    return export.id_consistency(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT count(*) FILTER (WHERE value <> floor(value)) AS fractional, count(*) AS total FROM events")
def id_format(spark, sf_dir):
    return export.fractional_ids(table(spark, sf_dir, "events"), "value")


@query("""SELECT 'Theme' AS level, CAST(r_regionkey AS VARCHAR) AS id, r_name AS label, '' AS parent_id, r_name AS full_path FROM region
  UNION ALL SELECT 'Concept', n_regionkey || '.' || n_nationkey, n_name, CAST(n_regionkey AS VARCHAR), r_name || ' > ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def codebook_rows(spark, sf_dir):
    themes = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("theme"), F.col("r_name").alias("label"))
    concepts = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("theme"), F.concat_ws(".", "n_regionkey", "n_nationkey").alias("concept"), F.col("n_name").alias("label"))
    return export.codebook_rows(themes, concepts)


SCORES = """SELECT vec_id AS cluster, n_nationkey AS ord, n_name AS concept, round(abs(CAST(embedding[n_nationkey + 1] AS DOUBLE)) * 2, 6) AS confidence FROM embeddings, nation"""


def _scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cluster"), F.posexplode(F.slice("embedding", 1, 25)).alias("ord", "x"))
    names = F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("ord"), F.col("n_name").alias("concept")))  # 25 rows in every release of the table
    return e.join(names, "ord").select("cluster", "ord", "concept", F.round(F.abs(F.col("x").cast("double")) * 2, 6).alias("confidence"))


BEST = f"SELECT cluster, concept FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY confidence DESC, ord) AS k FROM ({SCORES}) WHERE confidence > 0) WHERE k = 1 AND confidence >= 0.49"


@query(BEST)
def concept_assignment_confidence(spark, sf_dir):
    return codebook.by_confidence(_scores(spark, sf_dir))


@query(f"SELECT cluster, arg_min(concept, ord) AS concept FROM ({SCORES}) WHERE confidence >= 0.4 GROUP BY cluster")
def concept_assignment_evidence(spark, sf_dir):
    return codebook.by_evidence(_scores(spark, sf_dir).where("confidence >= 0.4"))


@query(f"SELECT c.cluster, n_name AS concept, CASE WHEN s.cluster IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence FROM (SELECT vec_id AS cluster FROM embeddings) c CROSS JOIN nation LEFT JOIN (SELECT * FROM ({SCORES}) WHERE confidence >= 0.4) s ON s.cluster = c.cluster AND s.concept = n_name")
def concept_scores_binary(spark, sf_dir):
    clusters = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cluster"))
    concepts = table(spark, sf_dir, "nation").select(F.col("n_name").alias("concept"))
    return codebook.binary_scores(clusters, concepts, _scores(spark, sf_dir).where("confidence >= 0.4"))


@query(f"SELECT concept, row_number() OVER (ORDER BY c[1]) - 1 AS merged_id, array_to_string(c, ',') AS clusters FROM (SELECT concept, list(cluster ORDER BY cluster) AS c FROM ({BEST}) GROUP BY concept)")
def merged_clusters(spark, sf_dir):
    m = codebook.merged(codebook.by_confidence(_scores(spark, sf_dir)))
    return m.select("concept", "merged_id", F.array_join("clusters", ",").alias("clusters"))


@query(f"""SELECT vec_id AS cluster, coalesce(CAST(n_regionkey AS VARCHAR), '99') AS theme, coalesce(n_regionkey || '.' || n_nationkey, '99.1') AS concept_id
  FROM (SELECT vec_id FROM embeddings) LEFT JOIN ({BEST}) ON cluster = vec_id LEFT JOIN nation ON n_name = concept""")
def final_labels(spark, sf_dir):
    clusters = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cluster"))
    book = table(spark, sf_dir, "nation").select(F.col("n_name").alias("label"), F.col("n_regionkey").cast("string").alias("theme"), F.concat_ws(".", "n_regionkey", "n_nationkey").alias("concept_id"))
    return codebook.final_labels(clusters, codebook.by_confidence(_scores(spark, sf_dir)), book)


@query(f"""SELECT CAST(n_regionkey AS VARCHAR) AS theme, n_regionkey || '.' || n_nationkey AS concept_id, n_name AS label FROM nation UNION ALL
  SELECT '99', '99.' || row_number() OVER (ORDER BY vec_id), 'cluster ' || vec_id FROM embeddings WHERE vec_id NOT IN (SELECT cluster FROM ({BEST}))""")
def other_theme(spark, sf_dir):
    book = table(spark, sf_dir, "nation").select(F.col("n_name").alias("label"), F.col("n_regionkey").cast("string").alias("theme"), F.concat_ws(".", "n_regionkey", "n_nationkey").alias("concept_id"))
    clusters = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cluster"), F.concat(F.lit("cluster "), F.col("vec_id").cast("string")).alias("label"))
    rest = clusters.join(codebook.by_confidence(_scores(spark, sf_dir)), "cluster", "left_anti")
    return codebook.with_other(book, rest)


@query("""WITH c AS (SELECT n_name AS concept, n_nationkey AS ord FROM nation), n AS (SELECT DISTINCT substring(n_name, 1, 4) AS name FROM nation UNION SELECT DISTINCT lower(p_brand) FROM part)
  SELECT name, (SELECT coalesce(arg_min(concept, ord) FILTER (WHERE lower(concept) = lower(name)), arg_min(concept, ord)) FROM c WHERE contains(lower(concept), lower(name)) OR contains(lower(name), lower(concept))) AS concept FROM n""")
def fuzzy_concept_match(spark, sf_dir):
    concepts = table(spark, sf_dir, "nation").select(F.col("n_name").alias("concept"), F.col("n_nationkey").alias("ord"))
    names = concepts.select(F.substring("concept", 1, 4).alias("name")).unionByName(table(spark, sf_dir, "part").select(F.lower("p_brand").alias("name")))
    return codebook.fuzzy_match(names, concepts)


LEXICON = f"SELECT word, count(*) AS n FROM (SELECT unnest({TOK}) AS word FROM documents) WHERE regexp_full_match(word, '\\p{{L}}+') GROUP BY word HAVING count(*) >= 20"
UNKNOWN = f"SELECT word, count(*) AS n FROM (SELECT unnest({TOK}) AS word FROM benchmark) WHERE regexp_full_match(word, '\\p{{L}}{{3,}}') AND word NOT IN (SELECT word FROM ({LEXICON})) GROUP BY word"


def _lexicon(spark, sf_dir):
    return spelling.lexicon(table(spark, sf_dir, "documents"), least=20)


def _unknown(spark, sf_dir):
    return spelling.unknown_words(table(spark, sf_dir, "benchmark"), _lexicon(spark, sf_dir))


@query(UNKNOWN)
def oov_words(spark, sf_dir):
    return _unknown(spark, sf_dir)


# One edit apart, by characters (DuckDB's own distance counts bytes); unknown words are never equal to known ones.
SHORTER = "len(list_filter(range(1, length({a}) + 1), lambda i: substring({a}, 1, i - 1) || substring({a}, i + 1) = {b})) > 0"
NEAR = f"""CASE length(u.word) - length(l.word) WHEN 0 THEN len(list_filter(range(1, length(u.word) + 1), lambda i: substring(u.word, i, 1) <> substring(l.word, i, 1))) = 1
  WHEN 1 THEN {SHORTER.format(a='u.word', b='l.word')} WHEN -1 THEN {SHORTER.format(a='l.word', b='u.word')} ELSE FALSE END"""


@query(f"SELECT u.word, l.word AS suggestion, CAST(1 AS INTEGER) AS distance FROM ({UNKNOWN}) u JOIN ({LEXICON}) l ON {NEAR}")
def levenshtein_suggestions(spark, sf_dir):
    return spelling.suggestions(_unknown(spark, sf_dir), _lexicon(spark, sf_dir)).select("word", "suggestion", "distance")


@query(f"""SELECT word, suggestion, distance FROM (SELECT u.word, l.word AS suggestion, CAST(1 AS INTEGER) AS distance, row_number() OVER (PARTITION BY u.word ORDER BY l.n DESC, l.word) AS k
  FROM ({UNKNOWN}) u JOIN ({LEXICON}) l ON {NEAR}) WHERE k = 1""")
def best_suggestions(spark, sf_dir):
    return spelling.best_suggestion(spelling.suggestions(_unknown(spark, sf_dir), _lexicon(spark, sf_dir)))


@query(f"""WITH l AS ({LEXICON}), c AS (SELECT word, unnest(range(4, length(word) - 3)) AS i FROM ({UNKNOWN}) WHERE length(word) >= 8)
  SELECT word, substring(word, 1, max(i)) AS left_part, substring(word, max(i) + 1) AS right_part FROM c WHERE substring(word, 1, i) IN (SELECT word FROM l) AND substring(word, i + 1) IN (SELECT word FROM l) GROUP BY word""")
def compound_splits(spark, sf_dir):
    return spelling.compound_splits(_unknown(spark, sf_dir), _lexicon(spark, sf_dir))


@query()
def correction_tasks(spark, sf_dir):
    return spelling.mark_unknown(table(spark, sf_dir, "benchmark"), _unknown(spark, sf_dir), "item_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text || ' x' ELSE text END AS corrected, doc_id % 4 = 0 AS changed FROM
  (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) WHERE doc_id = first""")
def corrections_applied(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    corrections = docs.where("doc_id % 4 = 0").select(F.col("text").alias("original"), F.concat("text", F.lit(" x")).alias("correction"))
    return spelling.apply_corrections(docs, corrections).select("doc_id", "corrected", "changed")


@query(f"""WITH RECURSIVE s AS (SELECT conv_id % 16 AS shard, conv_id, turn, CAST(len({TOK}) AS INTEGER) AS cost, conv_id * 1000 + turn AS place FROM conversations),
  k AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY place) AS k FROM s),
  g AS (SELECT shard, conv_id, turn, cost, place, k, CAST(0 AS BIGINT) AS batch, cost AS used, 1 AS n FROM k WHERE k = 1
    UNION ALL SELECT k.shard, k.conv_id, k.turn, k.cost, k.place, k.k, g.batch + CASE WHEN g.used + k.cost > 500 OR g.n >= 20 THEN 1 ELSE 0 END,
      CASE WHEN g.used + k.cost > 500 OR g.n >= 20 THEN k.cost ELSE g.used + k.cost END, CASE WHEN g.used + k.cost > 500 OR g.n >= 20 THEN 1 ELSE g.n + 1 END
    FROM g JOIN k ON k.shard = g.shard AND k.k = g.k + 1)
  SELECT shard, conv_id, turn, cost, place, batch FROM g""")
def greedy_batches(spark, sf_dir):
    """Conversations' turns packed under a budget of words."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 16).alias("shard"), "conv_id", "turn", F.size(tk.tokens(F.col("text"))).alias("cost")).withColumn("place", F.col("conv_id") * 1000 + F.col("turn"))
    return spelling.greedy_batches(rows, "shard", "place", "cost", 500, 20)

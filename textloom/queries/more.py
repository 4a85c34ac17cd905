"""Outlier strategies, labelling phases, sheets, memberships, merges of several models, affixes, embeddings put together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as v
from ..operators import clusters, codebook, ctfidf, export, hierarchy, labelling, outliers, segments, spelling
from ..plans.prompts import TEMPLATES
from ..plans.tables import table
from ..providers import label_topics
from ..streaming import online
from ._register import query
from .survey import SIMS
from .topics import TOK, bow_sql, score_sql, top_sql
from .vectors import CENTER_LISTS, CENTERS, D, LONG, ROWS, _centers, _embedded, nearest_sql

SHORT = SIMS.replace("FROM documents WHERE len(", "FROM documents WHERE n_chars < 400 AND len(")


@query(SHORT + """, q AS (SELECT doc_id, topic, sum(similarity) AS s FROM v GROUP BY 1, 2), p AS (SELECT doc_id, topic, round(s / sum(s) OVER (PARTITION BY doc_id), 5) AS weight FROM q)
  SELECT doc_id, topic, weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, topic) AS k FROM p) WHERE k = 1 AND weight > 0""")
def reduce_outliers_distributions(spark, sf_dir):
    """Outliers (the short documents) take the topic that weighs most in their windows."""
    docs = table(spark, sf_dir, "documents")
    scored = ctfidf.score(ctfidf.bag_of_words(docs.select("lang", "text"), "lang"))
    return outliers.by_distributions(docs.where("n_chars < 400"), scored, "doc_id")


MEMBERS = f"""WITH e AS (SELECT vec_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), c AS (SELECT topic AS t, i, c FROM ({CENTERS})),
  f AS (SELECT vec_id, t AS topic, sqrt(sum((x - c) * (x - c))) AS far FROM e JOIN c USING (i) GROUP BY 1, 2), w AS (SELECT *, CASE WHEN min(far) OVER (PARTITION BY vec_id) = 0 THEN CAST(far = 0 AS DOUBLE) ELSE 1 / far END AS w FROM f),
  p AS (SELECT vec_id, topic, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM w)"""


@query(MEMBERS + " SELECT vec_id, topic, round(p, 6) AS probability FROM p")
def membership_probabilities(spark, sf_dir):
    found = clusters.memberships(_embedded(spark, sf_dir).drop("topic"), _centers(spark, sf_dir), "vec_id")
    return found.select("vec_id", "topic", F.round("probability", 6).alias("probability"))


@query(MEMBERS + " SELECT vec_id, topic, probability FROM (SELECT vec_id, topic, round(p, 6) AS probability, row_number() OVER (PARTITION BY vec_id ORDER BY round(p, 6) DESC, topic) AS k FROM p) WHERE k = 1")
def strongest_membership(spark, sf_dir):
    found = clusters.memberships(_embedded(spark, sf_dir).drop("topic"), _centers(spark, sf_dir), "vec_id")
    return clusters.strength(found.withColumn("probability", F.round("probability", 6)), "vec_id")


@query(f"""WITH n AS ({nearest_sql(ROWS, CENTER_LISTS)}), o AS (SELECT topic, i, c * 10 AS s, 10 AS n FROM ({CENTERS})),
  a AS (SELECT topic, i, sum(x) AS s, count(*) AS n FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) JOIN n USING (vec_id) GROUP BY 1, 2)
  SELECT topic, i, round((o.s + coalesce(a.s, 0)) / (o.n + coalesce(a.n, 0)), 6) + 0.0 AS value, CAST(o.n + coalesce(a.n, 0) AS DOUBLE) AS n FROM o LEFT JOIN a USING (topic, i)""")
def online_centers(spark, sf_dir):
    """One batch, all embeddings, moves centres that stand for ten rows each."""
    moved = online.moved_centers(_centers(spark, sf_dir).withColumn("n", F.lit(10.0)), _embedded(spark, sf_dir).select("vector"))
    return moved.select("topic", "n", F.posexplode("vector").alias("i", "x")).select("topic", F.col("i").cast("long").alias("i"), (F.round("x", 6) + 0.0).alias("value"), "n")


TURNS = "SELECT conv_id, turn, role, text, CAST((turn * 7 + conv_id) % 5 AS BIGINT) - 1 AS cluster FROM conversations"


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").withColumn("cluster", ((F.col("turn") * 7 + F.col("conv_id")) % 5 - 1).cast("long"))


@query(f"SELECT cluster, count(*) AS size, list_sort(list(DISTINCT role)) AS labels, len(list(DISTINCT text)) AS descriptions, len(list(DISTINCT conv_id)) AS keys FROM ({TURNS}) WHERE cluster >= 0 GROUP BY 1")
def segment_clusters(spark, sf_dir):
    found = labelling.collected(_turns(spark, sf_dir), "cluster", "conv_id", "role", "text")
    return found.select("cluster", "size", "labels", F.size("descriptions").cast("long").alias("descriptions"), F.size("keys").cast("long").alias("keys"))


CLUSTER_LABELS = "SELECT conv_id AS cluster, CASE WHEN conv_id % 3 = 0 THEN '  ' || upper(role) ELSE role END AS label FROM conversations WHERE turn = 0"
CONCEPTS = f"SELECT regexp_replace(lower(trim(label)), '\\s+', ' ', 'g') AS concept, list_sort(list(DISTINCT cluster)) AS evidence FROM ({CLUSTER_LABELS.replace('role', 'split_part(text, chr(32), 1)')}) GROUP BY 1"


def _labels(spark, sf_dir):
    first = F.substring_index("text", " ", 1)
    turns = table(spark, sf_dir, "conversations").where("turn = 0")
    return turns.select(F.col("conv_id").alias("cluster"), F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("  "), tx.upper(first))).otherwise(first).alias("label"))


@query(CONCEPTS)
def atomic_concepts(spark, sf_dir):
    return labelling.concepts(_labels(spark, sf_dir))


MERGED = "SELECT CAST(conv_id % 6 AS BIGINT) AS merged_id, list_sort(list(DISTINCT conv_id)) AS clusters FROM conversations GROUP BY 1"


def _merged(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy((F.col("conv_id") % 6).cast("long").alias("merged_id")).agg(F.array_sort(F.collect_set("conv_id")).alias("clusters"))


@query(f"SELECT merged_id, round(avg(coalesce(confidence, 0)), 6) AS confidence FROM (SELECT merged_id, unnest(clusters) AS conv_id FROM ({MERGED})) LEFT JOIN (SELECT conv_id, max(turn) / 10 AS confidence FROM conversations WHERE conv_id % 5 > 0 GROUP BY 1) USING (conv_id) GROUP BY 1")
def merged_confidence(spark, sf_dir):
    sure = table(spark, sf_dir, "conversations").where("conv_id % 5 > 0").groupBy(F.col("conv_id").alias("cluster")).agg((F.max("turn") / 10).alias("confidence"))
    return labelling.merged_confidence(_merged(spark, sf_dir), sure).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH m AS (SELECT merged_id, unnest(clusters) AS conv_id FROM ({MERGED})), o AS (SELECT merged_id, text, max(1.0 / (1 + length(text) % 97)) AS similarity FROM m JOIN conversations USING (conv_id) GROUP BY 1, 2)
  SELECT merged_id, rank, text, round(similarity, 9) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY merged_id ORDER BY similarity DESC, text) AS rank FROM o) WHERE rank <= 3""")
def merged_representatives(spark, sf_dir):
    near = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("cluster"), "text", (F.lit(1.0) / (1 + F.length("text") % 97)).alias("similarity"))
    found = labelling.merged_representatives(_merged(spark, sf_dir), near)
    return found.select("merged_id", "rank", "text", F.round("similarity", 9).alias("similarity"))


BOOK = "SELECT CAST(l_linenumber AS VARCHAR) AS theme, CAST(l_linenumber AS VARCHAR) || '.' || CASE l_returnflag WHEN 'A' THEN '1' WHEN 'N' THEN '2' ELSE '3' END AS concept FROM lineitem GROUP BY 1, 2"


def _book(spark, sf_dir):
    mode = F.when(F.col("l_returnflag") == "A", "1").when(F.col("l_returnflag") == "N", "2").otherwise("3")
    number = F.col("l_linenumber").cast("string")
    pairs = table(spark, sf_dir, "lineitem").select(number.alias("theme"), F.concat(number, F.lit("."), mode).alias("concept")).distinct()
    themes = pairs.select("theme", F.concat(F.lit("theme "), "theme").alias("label")).distinct()
    return themes, pairs.select("theme", "concept", F.concat(F.lit("concept "), "concept").alias("label"), F.concat(F.lit("about "), "concept").alias("description"))


FULL_BOOK = f"""SELECT 'Theme' AS level, theme AS id, CAST(theme AS BIGINT) AS numeric_id, 'theme ' || theme AS label, '' AS description, '' AS parent_id, 'theme ' || theme AS full_path FROM (SELECT DISTINCT theme FROM ({BOOK}))
  UNION ALL SELECT 'Concept', concept, CAST(theme AS BIGINT) * 100 + CAST(split_part(concept, '.', 2) AS BIGINT), 'concept ' || concept, 'about ' || concept, theme, 'theme ' || theme || ' > concept ' || concept FROM ({BOOK})"""


@query(FULL_BOOK)
def codebook_sheet(spark, sf_dir):
    return export.full_codebook(*_book(spark, sf_dir))


@query(f"""WITH b AS ({FULL_BOOK}), n AS (SELECT level, id, length(id) AS frequency FROM b WHERE numeric_id % 2 = 1), k AS (SELECT parent_id AS id, count(*) AS children FROM b WHERE parent_id <> '' GROUP BY 1)
  SELECT b.id, b.parent_id, CAST(level = 'Concept' AS BIGINT) AS depth, b.label, coalesce(n.frequency, 0) AS frequency, coalesce(k.children, 0) AS children FROM b LEFT JOIN n USING (level, id) LEFT JOIN k USING (id)""")
def hierarchy_sheet(spark, sf_dir):
    book = export.full_codebook(*_book(spark, sf_dir))
    return export.hierarchy_rows(book, book.where("numeric_id % 2 = 1").select("level", "id", F.length("id").alias("frequency")))


@query(f"SELECT DISTINCT concept AS id, CASE WHEN theme % 2 = 0 THEN 'better ' || concept ELSE 'concept ' || concept END AS label, theme % 2 = 0 AS changed FROM (SELECT CAST(theme AS BIGINT) AS theme, concept FROM ({BOOK}))")
def refined_labels(spark, sf_dir):
    concepts = _book(spark, sf_dir)[1]
    answers = concepts.where("cast(theme as bigint) % 2 = 0").select(F.col("concept").alias("id"), F.concat(F.lit("better "), "concept").alias("label"))
    answers = answers.unionByName(concepts.select(F.concat("concept", F.lit("?")).alias("id"), "label")).unionByName(concepts.select(F.col("concept").alias("id"), F.lit(" ").alias("label")))
    return labelling.refined(concepts.select(F.col("concept").alias("id"), "label"), answers)


LEX = "SELECT DISTINCT word, CASE WHEN length(word) % 3 = 0 THEN 'AB' WHEN length(word) % 3 = 1 THEN 'B' ELSE 'AC' END AS flags FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM benchmark)"


@query(f"""WITH d AS ({LEX}), s AS (SELECT word, CASE WHEN word LIKE '%y' THEN left(word, length(word) - 1) || 'ies' ELSE word || 's' END AS form FROM d WHERE flags LIKE '%A%'),
  c AS (SELECT word, word || 'ing' AS form FROM d WHERE flags LIKE '%C%' AND NOT regexp_matches(word, '[aeiou]$'))
  SELECT word FROM d UNION SELECT form FROM s UNION SELECT form FROM c UNION SELECT 're' || word FROM d WHERE flags LIKE '%B%' AND regexp_matches(word, '^[^aeiou]')
  UNION SELECT 're' || form FROM s JOIN d USING (word) WHERE flags LIKE '%B%' AND regexp_matches(form, '^[^aeiou]') AND word NOT LIKE '%y'""")
def affix_forms(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word")).distinct()
    size = F.length("word") % 3
    flags = F.when(size == 0, "AB").when(size == 1, "B").otherwise("AC")
    rules = [("A", "SFX", "y", "ies", "y", False), ("A", "SFX", "", "s", "[^y]", True), ("C", "SFX", "", "ing", "[^aeiou]", False), ("B", "PFX", "", "re", "[^aeiou]", True)]
    return spelling.expanded(words.withColumn("flags", flags), spark.createDataFrame(rules, "flag string, kind string, strip string, add string, condition string, cross boolean"))


@query("SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 THEN 'PROCESSING_ERROR' WHEN turn % 2 = 0 THEN 'NA' ELSE role END AS answer FROM conversations")
def answer_fallbacks(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 1, F.col("role")).alias("answer"), (F.col("conv_id") % 7 == 0).alias("failed"))
    return segments.with_fallbacks(rows, "answer", "failed").drop("failed")


@query(f"""SELECT a.vec_id, round((a.e[1] + b.e[1]) / 2, 6) AS mean, round(a.e[1] * b.e[1], 6) AS product, CAST(len(a.e) + len(b.e) AS BIGINT) AS both, round(m.x, 6) + 0.0 AS pooled FROM ({ROWS}) a JOIN ({ROWS}) b ON b.vec_id = a.vec_id + 1
  JOIN (SELECT vec_id, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x, i FROM (SELECT a.vec_id, i, CASE WHEN a.vec_id % 2 = 0 THEN (a.x + b.x) / 2 ELSE b.x END AS x FROM
    (SELECT vec_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) a JOIN (SELECT vec_id - 1 AS vec_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) b USING (vec_id, i)) s(vec_id, i, x)) m ON m.vec_id = a.vec_id AND m.i = 0""")
def pooled_embeddings(spark, sf_dir):
    """Two vectors as one in several ways, the last by a mask that leaves the first out of every second row."""
    a = _embedded(spark, sf_dir).select("vec_id", v.doubles(F.col("vector")).alias("a"))
    b = _embedded(spark, sf_dir).select((F.col("vec_id") - 1).alias("vec_id"), v.doubles(F.col("vector")).alias("b"))
    both, a, b = a.join(b, "vec_id"), F.col("a"), F.col("b")
    mask = F.array((F.col("vec_id") % 2 == 0).cast("int"), F.lit(1))
    return both.select("vec_id", F.round(v.combined(a, b)[0], 6).alias("mean"), F.round(v.combined(a, b, "product")[0], 6).alias("product"), F.size(v.combined(a, b, "concat")).cast("long").alias("both"), (F.round(v.masked_mean(F.array(a, b), mask)[0], 6) + 0.0).alias("pooled"))


@query(f"""WITH c AS ({CENTER_LISTS}), s AS (SELECT CAST(label AS BIGINT) AS topic, count(*) AS size FROM embeddings GROUP BY 1) SELECT topic, 3 * size AS size FROM s""")
def merge_several_models(spark, sf_dir):
    """A model merged with two copies of itself whose topics are numbered otherwise: every topic finds its own."""
    centers = _centers(spark, sf_dir)
    sizes = _embedded(spark, sf_dir).groupBy("topic").agg(F.count(F.lit(1)).alias("size"))
    shifted = lambda df, k: df.withColumn("topic", F.col("topic") + k)
    models = [(centers, sizes), *[(shifted(centers, k), shifted(sizes, k)) for k in (100, 200)]]
    return hierarchy.merge_all(models, 0.999999)[1]


@query()
def reduce_topics_auto(spark, sf_dir):
    return hierarchy.auto_mapping(_centers(spark, sf_dir))


@query(f"SELECT topic, 'about ' || array_to_string(words[1:2], ', ') AS label FROM (SELECT topic, list(term ORDER BY rank) AS words FROM ({top_sql(score_sql(bow_sql()))}) GROUP BY topic)")
def provider_labels(spark, sf_dir):
    """Topics labelled by a provider (here a rule that reads the prompt) from their words and documents."""
    words = ctfidf.representation(ctfidf.score(ctfidf.bag_of_words(table(spark, sf_dir, "documents").select("lang", "text"), "lang")))

    def call(prompts):
        return ["about " + ", ".join(p.split("Keywords: ")[1].split("\n")[0].split(", ")[:2]) for p in prompts]

    return label_topics(words.withColumn("documents", F.array(F.lit("one document"))), call, "Keywords: [KEYWORDS]\nDocuments:\n[DOCUMENTS]")


@query(f"SELECT * FROM (VALUES {', '.join(f'(\'{k}\', {len(t)})' for k, t in sorted(TEMPLATES.items()))}) t(name, length)")
def prompt_templates(spark, sf_dir):
    rows = spark.createDataFrame(sorted(TEMPLATES.items()), "name string, template string")
    return rows.select("name", F.length("template").alias("length"))


@query(f"SELECT role AS label, count(*) AS segments, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM conversations GROUP BY 1")
def topic_segments(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("role", F.col("role").alias("cluster"))
    return labelling.topic_summary(turns, turns.select("cluster", F.col("role").alias("label")).distinct())

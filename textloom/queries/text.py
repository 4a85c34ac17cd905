"""Sources, cleaning, grading and segmenting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import tokens as tk
from ..operators import quality, segments
from ..plans.tables import table
from ._register import query

BLANK = tx.BLANK
NORM = f"trim(regexp_replace(trim(regexp_replace(regexp_replace(lower({{0}}), '{BLANK}*/{BLANK}*', ' of ', 'g'), '{BLANK}+', ' ', 'g')), '{BLANK}+([,.;!?])', '\\1', 'g'))"


def norm_sql(c: str) -> str:
    n = NORM.replace("{0}", c)
    return f"CASE WHEN {n} IS NULL OR length({n}) <= 1 THEN '<NA>' ELSE {n} END"


def final_sql(c: str) -> str:
    t = f"lower({c})"
    t = f"upper(substring({t}, 1, 1)) || substring({t}, 2)"
    t = f"CASE WHEN length({t}) = 0 OR right({t}, 1) IN ('.', '!', '?') THEN {t} ELSE {t} || '.' END"
    for mark, plain in (("\\.", "."), ("\\?", "?"), ("!", "!")):
        t = f"regexp_replace({t}, '{mark}{{2,}}', '{plain}', 'g')"
    t = f"regexp_replace({t}, '{BLANK}+', ' ', 'g')"
    t = f"regexp_replace({t}, '([.!?])([a-zA-Z])', '\\1 \\2', 'g')"
    return f"regexp_replace({t}, '{BLANK}+([.!?,;:])', '\\1', 'g')"


@query(f"SELECT conv_id, turn, md5({norm_sql('text')}) AS normalized FROM conversations")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(tx.normalize(F.col("text"))).alias("normalized"))


@query(f"SELECT conv_id, turn, md5({final_sql('text')}) AS finalized FROM conversations")
def finalize_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(tx.finalize(F.col("text"))).alias("finalized"))


@query(f"""SELECT count(*) FILTER (WHERE lower(text) <> text) AS case_changed, count(*) FILTER (WHERE regexp_matches(text, '{BLANK}{{2,}}')) AS spaces,
  count(*) FILTER (WHERE {norm_sql('text')} = '<NA>') AS became_missing, count(*) AS total FROM documents""")
def normalizer_stats(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").agg(
        F.count_if(F.lower(t) != t).alias("case_changed"),
        F.count_if(t.rlike(BLANK + "{2,}")).alias("spaces"),
        F.count_if(tx.normalize(t) == tx.MISSING).alias("became_missing"),
        F.count(F.lit(1)).alias("total"),
    )


@query(f"""SELECT count(*) FILTER (WHERE substring(text, 1, 1) <> upper(substring(text, 1, 1))) AS no_capital,
  count(*) FILTER (WHERE right(text, 1) NOT IN ('.', '!', '?')) AS no_end_mark,
  count(*) FILTER (WHERE regexp_matches(text, '\\.{{2,}}|\\?{{2,}}|!{{2,}}|{BLANK}{{2,}}')) AS repeated_marks FROM documents""")
def finalizer_stats(spark, sf_dir):
    t = F.col("text")
    first = F.substring(t, 1, 1)
    return table(spark, sf_dir, "documents").agg(
        F.count_if(first != tx.upper(first)).alias("no_capital"),
        F.count_if(~F.substring(t, -1, 1).isin(".", "!", "?")).alias("no_end_mark"),
        F.count_if(t.rlike(r"\.{2,}|\?{2,}|!{2,}|" + BLANK + "{2,}")).alias("repeated_marks"),
    )


@query("""SELECT doc_id, CASE WHEN regexp_replace(translate(text, chr(10) || chr(9), '  '), '[^A-Za-z0-9 ]+', '', 'g') = '' THEN 'emptydoc'
  ELSE regexp_replace(translate(text, chr(10) || chr(9), '  '), '[^A-Za-z0-9 ]+', '', 'g') END AS cleaned FROM documents""")
def clean_document(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.clean_document(F.col("text")).alias("cleaned"))


@query("""SELECT doc_id, substring(text, 1, 50) AS by_char, array_to_string(string_split(text, ' ')[1:20], ' ') AS by_word,
  array_to_string(regexp_extract_all(text, '[\\p{L}\\p{N}_]{2,}')[1:20], ' ') AS by_token,
  CASE WHEN length(text) > 50 THEN substring(text, 1, 50) || '...' ELSE text END AS short FROM documents""")
def truncate_document(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", tx.truncate(t, 50).alias("by_char"), tx.truncate(t, 20, "whitespace").alias("by_word"), tx.truncate(t, 20, "vectorizer").alias("by_token"), tx.ellipsis(t, 50).alias("short"))


@query("""SELECT conv_id, turn, regexp_replace(text, '\\[[^\\n]*?\\]', '', 'g') AS bare,
  '- ' || substring(text, 1, 255) || chr(10) AS listed,
  'Words: ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')[1:4], ', ') || chr(10) || '- ' || substring(text, 1, 255) || chr(10) AS prompt
  FROM conversations""")
def prompt_fill(spark, sf_dir):
    t = F.col("text")
    words = F.slice(tk.tokens(t), 1, 4)
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", tx.strip_bracketed(t).alias("bare"),
        tx.fill_prompt(F.lit("[DOCUMENTS]"), words, F.array(t)).alias("listed"),
        tx.fill_prompt(F.lit("Words: [KEYWORDS]\n[DOCUMENTS]"), words, F.array(t)).alias("prompt"),
    )


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE v IS NULL) AS n_nan, count(*) FILTER (WHERE v IS NOT NULL AND try_cast(v AS DOUBLE) IS NOT NULL) AS n_numeric,
  count(*) FILTER (WHERE v IS NOT NULL AND try_cast(v AS DOUBLE) IS NULL) AS n_string
  FROM (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN event_type ELSE CAST(user_id AS VARCHAR) END AS v FROM events) GROUP BY event_type""")
def response_types(spark, sf_dir):
    raw = F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("user_id").cast("string"))
    typed = table(spark, sf_dir, "events").select("event_type", quality.response_type(raw).alias("kind"))
    return typed.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("nan", "numeric", "string")])


@query("""SELECT 'text' AS variable, count(text) AS n_valid, count(*) FILTER (WHERE text IS NULL) AS n_null, count(DISTINCT text) AS n_distinct FROM documents
  UNION ALL SELECT 'source', count(source), count(*) FILTER (WHERE source IS NULL), count(DISTINCT source) FROM documents""")
def variable_profile(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    # Texts are told apart by digest, so the distinct count shuffles 32 characters a row instead of whole texts.
    one = lambda c, v: docs.agg(F.lit(c).alias("variable"), F.count(c).alias("n_valid"), F.count_if(F.col(c).isNull()).alias("n_null"), F.count_distinct(v).alias("n_distinct"))
    return one("text", F.sha2("text", 256)).unionByName(one("source", F.col("source")))


CODES = """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN '99999997' WHEN doc_id % 17 = 0 THEN ' ' WHEN doc_id % 19 = 0 THEN 'x' ELSE text END AS r FROM documents"""


@query(f"""SELECT code, count(*) AS n, CASE code WHEN 99999997 THEN 'user missing' WHEN 99999998 THEN 'system missing' WHEN 99999999 THEN 'no answer' ELSE 'to grade' END AS meaning FROM (
  SELECT CAST(CASE WHEN r IS NULL THEN 99999998 WHEN try_cast(r AS BIGINT) IN (99999997, 99999998, 99999999) THEN try_cast(r AS BIGINT)
    WHEN trim(r) = '' THEN 99999999 WHEN {norm_sql('r')} = '<NA>' THEN 99999998 END AS INTEGER) AS code FROM ({CODES})) GROUP BY code""")
def missing_codes(spark, sf_dir):
    i = F.col("doc_id")
    r = F.when(i % 11 == 0, None).when(i % 13 == 0, F.lit("99999997")).when(i % 17 == 0, F.lit(" ")).when(i % 19 == 0, F.lit("x")).otherwise(F.col("text"))
    coded = table(spark, sf_dir, "documents").select(r.alias("r")).select(quality.missing_code(F.col("r"), tx.normalize(F.col("r"))).alias("code"))
    meaning = F.when(F.col("code") == 99999997, "user missing").when(F.col("code") == 99999998, "system missing").when(F.col("code") == 99999999, "no answer").otherwise("to grade")
    return coded.groupBy("code").agg(F.count(F.lit(1)).alias("n")).withColumn("meaning", meaning)


@query("""WITH g AS (SELECT d.doc_id, CASE WHEN d.doc_id % 11 = 0 THEN 99999998 END AS code, l.quality = 0 AS f FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
  q AS (SELECT code, code IS NOT NULL OR coalesce(f, FALSE) AS bad FROM g)
  SELECT count(*) AS total, count(*) FILTER (WHERE NOT bad) AS meaningful, count(*) FILTER (WHERE bad) AS meaningless, round(100.0 * count(*) FILTER (WHERE bad) / count(*), 2) AS pct_meaningless,
  count(*) FILTER (WHERE code IS NULL) AS graded, count(*) FILTER (WHERE code IS NOT NULL) AS pre_filtered FROM q""")
def quality_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 11 == 0, F.lit(quality.SYSTEM_MISSING)).alias("code"))
    grades = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("grade_filter"), F.lit(0).alias("grade_code"))
    return quality.summary(quality.apply_grades(rows, grades, "doc_id"))


@query("""SELECT doc_id, text FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality, 1) <> 0""")
def keep_meaningful(spark, sf_dir):
    bad = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(bad, "doc_id", "left_anti")


@query("""SELECT conv_id % 64 AS shard, turn AS batch, count(*) AS n FROM conversations GROUP BY 1, 2""")
def provider_batches(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy((F.col("conv_id") % 64).alias("shard"), F.col("turn").alias("batch")).agg(F.count(F.lit(1)).alias("n"))


GRADE = """CASE WHEN {t} IS NULL OR ((length(regexp_replace({t}, '[^\\p{{L}}]', '', 'g')) * 2 < length({t}) OR length({t}) < 2) AND NOT ({u})) THEN 99999999
  WHEN ({u}) AND length({t}) < 60 THEN 99999997 ELSE 0 END"""
GRADE = GRADE.format(t="lower(trim(text))", u=" OR ".join("contains(lower(trim(text)), '" + p.replace("'", "''") + "')" for p in quality.UNCERTAIN))


@query(f"SELECT {GRADE} AS grade, count(*) AS n FROM (SELECT text FROM conversations UNION ALL SELECT text FROM documents) GROUP BY 1")
def rule_grader(spark, sf_dir):
    both = table(spark, sf_dir, "conversations").select("text").unionByName(table(spark, sf_dir, "documents").select("text"))
    return both.groupBy(quality.rule_grade(F.col("text")).alias("grade")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id, turn, pos AS segment_id, segment FROM (
  SELECT conv_id, turn, unnest(range(1, len(s) + 1)) AS pos, unnest(s) AS segment FROM (
    SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[.!?;]+|\\n'), lambda x: trim(x)), lambda x: x <> '') AS s FROM conversations))""")
def segment_split(spark, sf_dir):
    return segments.split_sentences(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text")


LABELS = "regexp_extract_all(upper(text), '[\\p{L}\\p{N}]{3,}')[1:3]"


@query(f"""WITH s AS (SELECT conv_id, turn, CASE WHEN len({LABELS}) = 0 THEN 'NA' ELSE array_to_string({LABELS}, '_') END AS label FROM conversations),
  r AS (SELECT conv_id, count(*) AS n FROM s GROUP BY conv_id)
  SELECT (SELECT count(DISTINCT label) FROM s WHERE label <> 'NA') AS labels, (SELECT round(avg(len(string_split(label, '_'))), 6) FROM s WHERE label <> 'NA') AS mean_words,
  (SELECT count(*) FROM r WHERE n > 1) AS several""")
def segment_stats(spark, sf_dir):
    labelled = segments.with_labels(table(spark, sf_dir, "conversations"), "text")
    return segments.statistics(labelled, "conv_id", "label", (segments.FAILED,))  # the rule breaks no label; a text may say "processing error"


@query("""SELECT conv_id, count(*) AS n, string_agg(CAST(turn AS VARCHAR) || ':' || role, ',' ORDER BY turn) AS nested FROM conversations GROUP BY conv_id""")
def segment_nest(spark, sf_dir):
    nested = segments.nest(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role"])
    return nested.select("conv_id", F.size("segments").cast("long").alias("n"), F.array_join(F.transform("segments", lambda s: F.concat_ws(":", s["turn"].cast("string"), s["role"])), ",").alias("nested"))


@query("SELECT conv_id, turn, coalesce(role, 'NA') AS role FROM conversations")
def segment_flatten(spark, sf_dir):
    nested = segments.nest(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role"])
    return segments.flatten(nested, "conv_id", ["role"])

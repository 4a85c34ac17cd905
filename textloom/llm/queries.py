"""The queries of this subpackage: each applies its operator, with the parameters meant for production, to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_extraction, language_id, pii, quality_rules, simhash_dedup, source_mixing, suffix_tree_lm, token_counts, vector_search
from ._common import prepare, read_table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(prepare(spark), sf_dir, "pages")
    return html_extraction.extract_pages(pages, keep=["page_id", "url"])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(prepare(spark), sf_dir, "documents")
    held = suffix_tree_lm.held_out("doc_id", 3, 1)
    model = language_id.train(docs.where(~held))
    return language_id.predict(docs.select("doc_id", "text", held.alias("held_out")), model, keep=["doc_id", "held_out"])


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = source_mixing.plan_mix(read_table(prepare(spark), sf_dir, "documents"))
    return source_mixing.taken_words(plan, source_mixing.mix_pieces(plan))


def op4_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    docs = read_table(prepare(spark), sf_dir, "documents")
    ranks = token_counts.load_ranks(spark, public_tokenizers.PATTERN, public_tokenizers.path(vocabulary))
    return token_counts.count_with_edits(docs, ranks, keep=["doc_id"])


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(read_table(prepare(spark), sf_dir, "documents"))
    return found.select("doc_id", simhash_dedup.hex_fingerprint().alias("fingerprint"), "component_id")


def op6_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score_documents(read_table(prepare(spark), sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(read_table(prepare(spark), sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    docs = read_table(prepare(spark), sf_dir, "documents")
    return bpe.coding_digest(docs, bpe.load_vocabulary(spark, public_tokenizers.path(vocabulary)))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_documents(read_table(prepare(spark), sf_dir, "documents"), keep=["doc_id", "source"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_search.search(read_table(prepare(spark), sf_dir, "embeddings"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_language_id, op3_source_mixing, op4_token_counts, op5_simhash_dedup, op6_suffix_tree_lm, op7_pii, op8_bpe, op9_quality_rules, op10_vector_search)}

def _op3_sql(block: int, rounds: int, seed: int) -> str:
    """The mix without shards: targets, streams in hashed order, and the blocks that the shuffle of the last pass draws."""
    swaps, x = [], "block"
    for i in range(rounds):
        key = f"CAST(('0x' || substr(md5(name || ':{i}'), 1, 12)) AS BIGINT) % blocks"
        partner = f"((({key}) - {x}) % blocks + blocks) % blocks"
        swaps.append(f"x{i} AS (SELECT *, CASE WHEN substr(md5(name || ':{i}:' || greatest({x}, {partner})), 1, 1) >= '8' THEN {partner} ELSE {x} END AS s{i} FROM {f'x{i - 1}' if i else 'e'} WHERE blocks > 0)")
        x = f"s{i}"
    return r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('SEED:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k, row_number() OVER () AS id
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM s),
w AS (SELECT *, CAST(1 + rk % 3 AS DOUBLE) AS weight, 3 * source_size AS cap FROM r),
f AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS below,
         sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS behind,
         row_number() OVER (ORDER BY cap / weight, rk) AS place
  FROM w),
v AS (SELECT *, (total - below) / behind AS lvl FROM f),
l AS (SELECT arg_min(lvl, place) AS lvl FROM v WHERE lvl <= cap / weight),
t AS (SELECT v.rk, v.source, v.source_size, least(CAST(v.cap AS DOUBLE), v.weight * l.lvl) AS target FROM v, l),
q AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target) AS BIGINT) // source_size END AS passes FROM t),
p AS (
  SELECT d.id, d.doc_id, d.size, q.rk, q.source_size, q.target, q.passes, q.source_size // BLOCK AS blocks,
         CAST(floor(q.target) AS BIGINT) - q.passes * q.source_size AS rest,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
e AS (
  SELECT *, 'SEED:' || rk || ':' || passes AS name, unnest(range(pos // BLOCK, (pos + size - 1) // BLOCK + 1)) AS block FROM p WHERE size > 0 AND rest > 0),
SWAPS,
o AS (
  SELECT id, pos, size, rest, block, CASE WHEN block < blocks THEN LAST ELSE blocks END AS own FROM FINAL
  UNION ALL SELECT id, pos, size, rest, block, blocks FROM e WHERE blocks = 0),
g AS (
  SELECT id, sum(greatest(0, least(pos + size, CASE WHEN own < rest // BLOCK THEN (block + 1) * BLOCK WHEN own = rest // BLOCK THEN block * BLOCK + rest % BLOCK ELSE 0 END) - greatest(pos, block * BLOCK))) AS n
  FROM o GROUP BY id)
SELECT doc_id, size, source_size, target, CAST(passes * size + coalesce(g.n, 0) AS BIGINT) AS taken FROM p LEFT JOIN g USING (id)
""".replace("SWAPS", ",\n".join(swaps)).replace("FINAL", f"x{rounds - 1}").replace("LAST ELSE", f"{x} ELSE").replace("BLOCK", str(block)).replace("SEED", str(seed))


OP3_SQL = _op3_sql(source_mixing.BLOCK_WORDS, source_mixing.ROUNDS, source_mixing.SEED)

_OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, b, c, e, h) AS n, h IS NOT NULL AS whole
  FROM (SELECT doc_id, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c, lead(word, 3) OVER o AS e, lead(word, 4) OVER o AS h
        FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i))),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, (SELECT unnest(range(5)) AS k) WHERE whole AND n > 1 GROUP BY doc_id),
l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, d.source, CAST(len(d.w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS base{counts} FROM b GROUP BY source),
{fits}
z AS (SELECT source{rates} FROM h, {priors}),
y AS (SELECT {limits} FROM z),
v AS (SELECT source, refused{flags} FROM z, y)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT v.refused{verdicts} AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""


def _op9_sql(text: str) -> str:
    rules = list(quality_rules.RULES)
    fits = []
    for r in ["base", *rules]:
        fits.append(f"""s_{r} AS (SELECT count(*) AS k, least(greatest((sum({r}) + 0.5) / (sum(n) + 1), 1e-6), 1 - 1e-6) AS mean, var_samp({r} / n) AS v FROM h),
p_{r} AS (SELECT mean * weight AS a_{r}, (1 - mean) * weight AS b_{r} FROM (SELECT mean, CASE WHEN k < 2 THEN 2.0 WHEN coalesce(v, 0) <= 0 THEN 1000.0 ELSE least(greatest(mean * (1 - mean) / v - 1, 2.0), 1000.0) END AS weight FROM s_{r})),""")
    spread = lambda a, b: f"sqrt({a} * {b} / (({a} + {b}) * ({a} + {b}) * ({a} + {b} + 1)))"
    rates = f", (base + a_base) / (n + a_base + b_base) - 2 * {spread('(base + a_base)', '(n - base + b_base)')} > 0.5 AS refused"
    rates += "".join(f", ({r} + a_{r}) / (n + a_{r} + b_{r}) AS rate_{r}" for r in rules)
    for name, part in {
        "counts": "".join(f", count(*) FILTER (WHERE {quality_rules.RULES[r]}) AS {r}" for r in rules),
        "fits": "\n".join(fits), "rates": rates, "limits": ", ".join(f"avg(rate_{r}) + coalesce(stddev_samp(rate_{r}), 0) + {quality_rules.TIE} AS limit_{r}" for r in rules),
        "flags": "".join(f", rate_{r} > limit_{r} AS strict_{r}" for r in rules), "priors": ", ".join(f"p_{r}" for r in ["base", *rules]),
        "verdicts": "".join(f" AND NOT (v.strict_{r} AND ({quality_rules.RULES[r]}))" for r in rules),
    }.items():
        text = text.replace("{" + name + "}", part)
    return text


OP9_SQL = _op9_sql(_OP9_SQL)

ORACLE_SQL = {"op3_source_mixing": OP3_SQL, "op9_quality_rules": OP9_SQL}

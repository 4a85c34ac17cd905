"""Grading of responses: typing, missing codes, rule-based grades, batches and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed codes of missing answers.
DONT_KNOW = 99999997
SYSTEM_MISSING = 99999998
NO_ANSWER = 99999999

#: Phrases that say that the respondent doesn't know, in the languages of surveys at hand.
UNCERTAIN = ("geen idee", "weet niet", "weet ik niet", "don't know", "do not know", "no idea", "not sure", "keine ahnung", "weiß nicht", "je ne sais pas", "no sé")


def response_type(response: Column, is_text: Column | None = None) -> Column:
    """nan, numeric or string. A text that reads as a number is numeric only where the source column wasn't text."""
    number = response.try_cast("double").isNotNull()
    if is_text is not None:
        number = number & ~is_text
    return F.when(response.isNull(), "nan").when(number, "numeric").otherwise("string")


def missing_code(response: Column, cleaned: Column) -> Column:
    """The preliminary code: system missing, a code given as the answer itself, no answer for a blank, null for a real answer."""
    number = response.try_cast("bigint")
    codes = [DONT_KNOW, SYSTEM_MISSING, NO_ANSWER]
    return (
        F.when(response.isNull(), F.lit(SYSTEM_MISSING))
        .when(number.isin(*codes), number.cast("int"))
        .when(F.trim(response) == "", F.lit(NO_ANSWER))
        .when(cleaned.isNull() | (cleaned == "<NA>"), F.lit(SYSTEM_MISSING))
        .otherwise(F.lit(None).cast("int"))
    )


def rule_grade(response: Column, question: Column | None = None) -> Column:
    """A grade without a language model: uncertainty, then gibberish or an echo of the question, else 0 (meaningful)."""
    t = F.lower(F.trim(response))
    uncertain = F.lit(False)
    for phrase in UNCERTAIN:
        uncertain = uncertain | t.contains(phrase)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    gibberish = (letters * 2 < F.length(t)) | (F.length(t) < 2)
    if question is not None:
        gibberish = gibberish | (t == F.lower(F.trim(question)))
    return F.when(t.isNull() | gibberish & ~uncertain, F.lit(NO_ANSWER)).when(uncertain & (F.length(t) < 60), F.lit(DONT_KNOW)).otherwise(F.lit(0))


def batches(rows: DataFrame, order: str, size: int = 20, shards: int = 64) -> DataFrame:
    """``rows`` with ``shard`` and ``batch``: batches of at most ``size`` in the order of ``order`` within shards, so no task numbers all rows."""
    shard = F.pmod(F.xxhash64(order), F.lit(shards)).cast("int")
    place = F.row_number().over(Window.partitionBy("shard").orderBy(order)) - 1
    return rows.withColumn("shard", shard).withColumn("batch", F.floor(place / size).cast("long"))


def apply_grades(rows: DataFrame, grades: DataFrame, key: str) -> DataFrame:
    """Coded rows keep their code; others take their grade, and pass as meaningful with code 0 where none came."""
    joined = rows.join(grades, key, "left")
    failed = F.coalesce(F.col("grade_filter"), F.lit(False))
    code = F.when(F.col("code").isNotNull(), F.col("code")).otherwise(F.coalesce("grade_code", F.lit(0)))
    return joined.withColumn("quality_filter", F.when(F.col("code").isNotNull(), True).otherwise(failed)).withColumn("quality_code", code)


def summary(graded: DataFrame) -> DataFrame:
    """total, meaningful, meaningless, pct_meaningless, graded, pre_filtered: one row."""
    bad = F.coalesce(F.col("quality_filter"), F.lit(False))
    return graded.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~bad).alias("meaningful"),
        F.count_if(bad).alias("meaningless"),
        F.round(100.0 * F.count_if(bad) / F.count(F.lit(1)), 2).alias("pct_meaningless"),
        F.count_if(F.col("code").isNull()).alias("graded"),
        F.count_if(F.col("code").isNotNull()).alias("pre_filtered"),
    )

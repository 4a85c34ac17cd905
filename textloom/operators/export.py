"""Exports of coded answers: indicator columns, frequencies, codebook tables, checks of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import DONT_KNOW, NO_ANSWER, SYSTEM_MISSING

MISSING_COLUMNS = {DONT_KNOW: "USER_MISSING_97", SYSTEM_MISSING: "SYSTEM_MISSING_98", NO_ANSWER: "NO_ANSWER_99"}


def indicators(respondents: DataFrame, assigned: DataFrame, codes: DataFrame, key: str, variable: str, themes: list[str], concepts: list[str]) -> DataFrame:
    """A row for each respondent with a 0/1 column for each theme and concept of the codebook and three for missing answers.

    ``assigned`` has key, theme, concept (a row for each coded segment); ``codes`` has key and code. Someone in neither is
    a system missing. The columns are one aggregation; the codebook's names are given, so nothing is looked up first.
    """
    flag = lambda on: F.coalesce(F.max(on.cast("int")), F.lit(0))
    made = [flag(F.col("theme") == t).alias(f"{variable}_THEME_{t}") for t in themes]
    made += [flag(F.col("concept") == c).alias(f"{variable}_CONCEPT_{c.replace('.', '_')}") for c in concepts]
    wide = assigned.groupBy(key).agg(*made, F.lit(1).alias("__coded"))
    joined = respondents.select(key).join(wide, key, "left").join(codes.select(key, "code"), key, "left")
    names = [c for c in wide.columns if c not in (key, "__coded")]
    lost = F.col("__coded").isNull() & F.col("code").isNull()
    out = [F.coalesce(c, F.lit(0)).alias(c) for c in names]
    for code, name in MISSING_COLUMNS.items():
        on = (F.col("code") == code) | lost if code == SYSTEM_MISSING else F.col("code") == code
        out.append(F.coalesce(on, F.lit(False)).cast("int").alias(f"{variable}_{name}"))
    return joined.select(key, *out)


def frequencies(assigned: DataFrame, key: str, total: int | Column) -> DataFrame:
    """level, id, frequency (respondents), percentage of all: one row for each theme and each concept, in one pass by grouping sets."""
    rolled = assigned.groupBy("theme", "concept", key).count().rollup("theme", "concept").agg(F.count_distinct(key).alias("frequency"), F.grouping("concept").alias("g"), F.grouping("theme").alias("t"))
    rows = rolled.where("t = 0")
    percent = F.round(100.0 * F.col("frequency") / (F.lit(total) if isinstance(total, int) else total), 1)
    return rows.select(F.when(F.col("g") == 1, "Theme").otherwise("Concept").alias("level"), F.when(F.col("g") == 1, F.col("theme")).otherwise(F.col("concept")).alias("id"), "frequency", F.concat(F.format_string("%.1f", percent), F.lit("%")).alias("percentage"))


def several(assigned: DataFrame, key: str) -> DataFrame:
    """multi_theme, multi_concept: respondents with more than one."""
    each = assigned.groupBy(key).agg(F.count_distinct("theme").alias("t"), F.count_distinct("concept").alias("c"))
    return each.agg(F.count_if(F.col("t") > 1).alias("multi_theme"), F.count_if(F.col("c") > 1).alias("multi_concept"))


def in_codebook(assigned: DataFrame, concepts: DataFrame) -> DataFrame:
    """Assignments whose (theme, concept) stands in the codebook."""
    return assigned.join(concepts.select("theme", "concept").distinct(), ["theme", "concept"], "left_semi")


def id_consistency(original: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """only_original, only_processed, matched, match_pct."""
    a = original.select(key).distinct().withColumn("a", F.lit(1))
    b = processed.select(key).distinct().withColumn("b", F.lit(1))
    both = a.join(b, key, "full")
    return both.agg(
        F.count_if(F.col("b").isNull()).alias("only_original"),
        F.count_if(F.col("a").isNull()).alias("only_processed"),
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("matched"),
        F.round(100.0 * F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()) / F.greatest(F.count("a"), F.lit(1)), 2).alias("match_pct"),
    )


def fractional_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.agg(F.count_if(F.col(key).cast("double") != F.floor(F.col(key).cast("double"))).alias("fractional"), F.count(F.lit(1)).alias("total"))


def full_codebook(themes: DataFrame, concepts: DataFrame) -> DataFrame:
    """level, id, numeric_id, label, description, parent_id, full_path: a codebook's sheet, themes and their concepts by number.

    A theme's number is its id, a concept's the theme's times 100 and its own place; ids that are no numbers have none. A missing description is empty.
    """
    described = lambda df: df.withColumn("description", F.coalesce("description", F.lit(""))) if "description" in df.columns else df.withColumn("description", F.lit(""))
    a, b = described(themes), described(concepts)
    top = a.select(F.lit("Theme").alias("level"), F.col("theme").alias("id"), F.expr("try_cast(theme AS bigint)").alias("numeric_id"), "label", "description", F.lit("").alias("parent_id"), F.col("label").alias("full_path"))
    named = b.join(a.select("theme", F.col("label").alias("theme_label")), "theme")
    number = F.expr("try_cast(theme AS bigint) * 100 + try_cast(substring_index(concept, '.', -1) AS bigint)")
    path = F.concat_ws(" > ", "theme_label", "label")
    below = named.select(F.lit("Concept").alias("level"), F.col("concept").alias("id"), number.alias("numeric_id"), "label", "description", F.col("theme").alias("parent_id"), path.alias("full_path"))
    return top.unionByName(below)


def hierarchy_rows(codebook: DataFrame, counts: DataFrame) -> DataFrame:
    """id, parent_id, depth, label, frequency, children: a tree of themes and concepts with what each holds, for a hierarchy's sheet."""
    kids = codebook.where("parent_id <> ''").groupBy("parent_id").agg(F.count(F.lit(1)).alias("children")).withColumnRenamed("parent_id", "id")
    depth = F.when(F.col("level") == "Theme", 0).otherwise(1).cast("long")
    joined = codebook.join(counts.select("level", "id", "frequency"), ["level", "id"], "left").join(kids, "id", "left")
    return joined.select("id", "parent_id", depth.alias("depth"), "label", F.coalesce("frequency", F.lit(0)).cast("long").alias("frequency"), F.coalesce("children", F.lit(0)).cast("long").alias("children"))


def codebook_rows(themes: DataFrame, concepts: DataFrame) -> DataFrame:
    """level, id, label, parent_id, full_path (``theme > concept``)."""
    top = themes.select(F.lit("Theme").alias("level"), F.col("theme").alias("id"), "label", F.lit("").alias("parent_id"), F.col("label").alias("full_path"))
    named = concepts.join(themes.select("theme", F.col("label").alias("theme_label")), "theme")
    below = named.select(F.lit("Concept").alias("level"), F.col("concept").alias("id"), "label", F.col("theme").alias("parent_id"), F.concat_ws(" > ", "theme_label", "label").alias("full_path"))
    return top.unionByName(below)


def with_labels(df: DataFrame, labels: dict[str, str], values: dict[int, str] | None = None) -> DataFrame:
    """``df`` with a label, and value labels, in the metadata of the named columns."""
    values = values or {0: "Niet genoemd", 1: "Wel genoemd"}
    return df.select(*[F.col(c).alias(c, metadata={"label": labels[c], "values": {str(k): x for k, x in values.items()}}) if c in labels else F.col(c) for c in df.columns])

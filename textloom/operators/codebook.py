"""From clusters to a codebook: scoring against concepts, assignment, themes, final labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import counted

OTHER_THEME = "99"
OTHER_CONCEPT = "99.1"
THRESHOLD = 0.49


def by_confidence(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """cluster, concept: the concept of highest confidence above 0 (ties: first by ``ord``), where it reaches the threshold."""
    best = scores.where("confidence > 0").groupBy("cluster").agg(F.max(F.struct("confidence", (-F.col("ord")).alias("o"), "concept")).alias("b"))
    return best.where(F.col("b.confidence") >= threshold).select("cluster", F.col("b.concept").alias("concept"))


def by_evidence(evidence: DataFrame) -> DataFrame:
    """cluster, concept: the first concept (by ``ord``) that names the cluster as evidence."""
    return evidence.groupBy("cluster").agg(F.min_by("concept", "ord").alias("concept"))


def binary_scores(clusters: DataFrame, concepts: DataFrame, evidence: DataFrame) -> DataFrame:
    """cluster, concept, confidence for every cluster and concept: 1 where evidence says so, else 0. Concepts are few and counted before they are broadcast."""
    said = evidence.select("cluster", "concept", F.lit(1.0).alias("confidence")).distinct()
    return clusters.select("cluster").crossJoin(counted(concepts.select("concept"))).join(said, ["cluster", "concept"], "left").fillna(0.0, ["confidence"])


def merged(assigned: DataFrame) -> DataFrame:
    """merged_id (from 0, by first cluster), concept, clusters: clusters of one concept."""
    groups = assigned.groupBy("concept").agg(F.array_sort(F.collect_list("cluster")).alias("clusters"))
    return groups.withColumn("merged_id", (F.row_number().over(Window.orderBy(F.col("clusters")[0])) - 1).cast("long"))


def with_other(concepts: DataFrame, unassigned: DataFrame) -> DataFrame:
    """theme, concept_id, label: given concepts, then unassigned clusters as ``99.k`` of the theme Other."""
    order = Window.orderBy("cluster")
    rest = unassigned.select(F.lit(OTHER_THEME).alias("theme"), F.concat(F.lit(OTHER_THEME + "."), F.row_number().over(order).cast("string")).alias("concept_id"), "label")
    return concepts.select("theme", "concept_id", "label").unionByName(rest)


def final_labels(clusters: DataFrame, assigned: DataFrame, codebook: DataFrame) -> DataFrame:
    """cluster, theme, concept_id: every cluster's place in the codebook; without one, Other."""
    named = assigned.join(codebook.select(F.col("label").alias("concept"), "theme", "concept_id"), "concept", "left")
    out = clusters.select("cluster").join(named, "cluster", "left")
    return out.select("cluster", F.coalesce("theme", F.lit(OTHER_THEME)).alias("theme"), F.coalesce("concept_id", F.lit(OTHER_CONCEPT)).alias("concept_id"))


def segment_codes(segments: DataFrame, labels: DataFrame) -> DataFrame:
    """Segments with theme, concept and code as one-entry maps, as they are stored with answers."""
    joined = segments.join(labels, "cluster", "left")
    return joined.withColumns({"theme_map": F.create_map(F.col("theme"), F.lit("theme")), "code_map": F.create_map(F.col("concept_id"), F.col("cluster").cast("string"))})


def fuzzy_match(names: DataFrame, concepts: DataFrame) -> DataFrame:
    """name, concept: the concept equal to the name but for case, else the first by ``ord`` that contains it or is contained.

    Concepts are few: they travel as one checked, broadcast array, and each name keeps one row.
    """
    if concepts.limit(20_001).count() > 20_000:
        raise ValueError("more concepts than can be broadcast")
    packed = concepts.agg(F.array_sort(F.collect_list(F.struct("ord", "concept"))).alias("__all"))
    rows = names.select("name").distinct().crossJoin(F.broadcast(packed))
    n = F.lower("name")
    same = F.filter("__all", lambda c: F.lower(c["concept"]) == n)
    like = F.filter("__all", lambda c: F.contains(F.lower(c["concept"]), n) | F.contains(n, F.lower(c["concept"])))
    return rows.select("name", F.coalesce(F.get(same, F.lit(0))["concept"], F.get(like, F.lit(0))["concept"]).alias("concept"))

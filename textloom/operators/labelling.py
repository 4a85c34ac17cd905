"""Phases of labelling clusters: collecting them, concepts with evidence, merging, refined labels under stable ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def collected(segments: DataFrame, cluster: str, key: str, label: str, description: str) -> DataFrame:
    """cluster, size, labels, descriptions, keys (distinct, sorted): what a labeller gets to see of each cluster."""
    real = segments.where(F.col(cluster).isNotNull() & (F.col(cluster) >= 0))
    distinct = lambda c: F.array_sort(F.collect_set(c))
    return real.groupBy(F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("size"), distinct(label).alias("labels"), distinct(description).alias("descriptions"), distinct(key).alias("keys"))


def concepts(labels: DataFrame) -> DataFrame:
    """concept, evidence (cluster numbers in order): clusters whose labels are the same but for case and white space. The rule where no language model is given."""
    plain = F.regexp_replace(F.lower(F.trim("label")), r"\s+", " ")
    return labels.groupBy(plain.alias("concept")).agg(F.array_sort(F.collect_set("cluster")).alias("evidence"))


def merged_confidence(merged: DataFrame, confidence: DataFrame) -> DataFrame:
    """merged_id, confidence: the mean confidence of the clusters that were merged; a cluster without one counts as 0."""
    each = merged.select("merged_id", F.explode("clusters").alias("cluster")).join(confidence.select("cluster", "confidence"), "cluster", "left")
    return each.groupBy("merged_id").agg(F.avg(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))


def merged_representatives(merged: DataFrame, representatives: DataFrame, n: int = 3) -> DataFrame:
    """merged_id, rank, text, similarity: the ``n`` best of the representatives of the clusters that were merged, equal texts once."""
    each = merged.select("merged_id", F.explode("clusters").alias("cluster")).join(representatives.select("cluster", "text", "similarity"), "cluster")
    once = each.groupBy("merged_id", "text").agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy("merged_id").orderBy(F.desc("similarity"), "text")
    return once.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def refined(codebook: DataFrame, answers: DataFrame) -> DataFrame:
    """``codebook`` (id, label) with refined labels (id, label) of a provider. Ids are stable: answers to ids that don't exist, and empty ones, change nothing."""
    good = answers.where(F.trim("label") != "").groupBy("id").agg(F.min("label").alias("__new"))
    joined = codebook.join(good, "id", "left")
    return joined.withColumn("changed", F.coalesce(F.col("__new") != F.col("label"), F.lit(False))).withColumn("label", F.coalesce("__new", "label")).drop("__new")


def topic_summary(segments: DataFrame, labels: DataFrame, cluster: str = "cluster") -> DataFrame:
    """label, segments, share: how many segments each final label was applied to; those without a label are counted as such."""
    joined = segments.join(labels.select(F.col("cluster").alias(cluster), "label"), cluster, "left")
    sums = joined.groupBy("label").agg(F.count(F.lit(1)).alias("segments"))
    return sums.withColumn("share", F.round(F.col("segments") / F.sum("segments").over(Window.partitionBy()), 6))

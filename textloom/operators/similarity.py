"""Similarity joins against topic vectors.

The small side, one vector a topic, is counted and broadcast in slices of bounded size; each document is one row with an
array of a slice's similarities, of which the best is kept: no row for each pair is made, and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..plans.tables import BROADCAST_ROWS, counted, cut


def similarities(rows: DataFrame, topics: DataFrame, vector: str = "vector") -> DataFrame:
    """``rows`` times topics with ``similarity``; ``topics`` has topic and vector."""
    t = topics.select("topic", v.doubles(F.col("vector")).alias("__t"))
    return rows.crossJoin(counted(t)).withColumn("similarity", v.cosine(v.doubles(F.col(vector)), F.col("__t"))).drop("__t")


def nearest(rows: DataFrame, topics: DataFrame, vector: str = "vector", digits: int = 9, threshold: float | None = None, slice_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` with ``topic`` and ``similarity`` of the nearest topic vector (ties: smaller topic); below ``threshold`` topic -1."""
    t = cut(topics.select("topic", v.doubles(F.col("vector")).alias("t")))
    slices = max(1, -(-t.count() // slice_rows))
    best = rows.withColumn("__v", v.doubles(F.col(vector)))
    score = F.transform("__topics", lambda x: F.struct(F.round(v.cosine(F.col("__v"), x["t"]), digits).alias("s"), (-x["topic"]).alias("n")))
    for k in range(slices):
        own = t.where(F.pmod(F.xxhash64("topic"), F.lit(slices)) == k)
        packed = own.agg(F.array_sort(F.collect_list(F.struct("topic", "t"))).alias("__topics"))
        found = F.array_max(score) if not k else F.greatest("__b", F.array_max(score))
        best = best.crossJoin(F.broadcast(packed)).withColumn("__b", found).drop("__topics")
    topic, similarity = -F.col("__b")["n"], F.col("__b")["s"]
    if threshold is not None:
        topic = F.when(similarity >= threshold, topic).otherwise(F.lit(-1))
    return best.withColumns({"topic": topic, "similarity": similarity}).drop("__v", "__b")


def guided(rows: DataFrame, seeds: DataFrame, overall: DataFrame, vector: str = "vector", share: float = 0.75) -> DataFrame:
    """``rows`` with ``seed`` and blended vectors: a row nearer to a seed than to the mean of all rows moves towards it; others have seed -1."""
    targets = seeds.select("topic", "vector").unionByName(overall.select(F.lit(1 << 30).cast("long").alias("topic"), "vector"))
    found = nearest(rows, targets, vector).withColumn("seed", F.when(F.col("topic") == 1 << 30, F.lit(-1)).otherwise(F.col("topic"))).drop("topic", "similarity")
    s = seeds.select(F.col("topic").alias("seed"), v.doubles(F.col("vector")).alias("__s"))
    own = v.doubles(F.col(vector))
    joined = found.join(s, "seed", "left")
    return joined.withColumn(vector, F.when(F.col("__s").isNull(), own).otherwise(v.blend(own, F.col("__s"), share, 1 - share))).drop("__s")


def question_aware(rows: DataFrame, question: DataFrame, vector: str = "vector", weights: tuple[float, float, float] = (0.6, 0.3, 0.1)) -> DataFrame:
    """Vectors blended with the question's and with the mean of all, by weights that are scaled to sum to one."""
    total = sum(weights)
    a, b, c = (w / total if abs(total - 1) > 0.001 else w for w in weights)
    mean = v.mean_vectors(rows.withColumn("__all", F.lit(1)), "__all", vector).select(F.col("vector").alias("__m"))
    q = question.select(v.doubles(F.col("vector")).alias("__q"))
    joined = rows.crossJoin(F.broadcast(mean)).crossJoin(F.broadcast(q))  # one row each
    blended = v.blend(v.blend(v.doubles(F.col(vector)), F.col("__q"), a, b), F.col("__m"), 1.0, c)
    return joined.withColumn(vector, blended).drop("__m", "__q")

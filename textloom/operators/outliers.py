"""Outliers take a topic: by soft distributions, by probabilities, by term scores or by vectors.

Each strategy yields key, topic and the weight of the best topic; :func:`reassign` puts these into the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..plans.tables import cut
from . import distribution, similarity

OUTLIER = -1


def best(weights: DataFrame, key: str, weight: str, threshold: float = 0.0, exact: str | None = None) -> DataFrame:
    """key, topic, weight: the heaviest topic of each row (ties: smaller topic), if it weighs something and the threshold or more.

    ``exact``: the weight before it was rounded, which then decides whether it weighs enough; a small one may round to 0.
    """
    enough = F.col(exact or weight)
    order = Window.partitionBy(key).orderBy(F.desc(weight), "topic")
    top = weights.where((enough > 0) & (enough >= threshold)).withColumn("__k", F.row_number().over(order)).where("__k = 1")
    return top.select(key, "topic", weight)


def by_distributions(outliers: DataFrame, scored: DataFrame, key: str, text: str = "text", threshold: float = 0.0, digits: int = 5, **windows) -> DataFrame:
    """The default strategy: topics of the windows of each outlier's tokens."""
    sims = distribution.window_similarities(distribution.window_terms(outliers, key, text, **windows), scored, key)
    return best(distribution.distribution(sims, key).withColumn("weight", F.round("weight", digits)), key, "weight", threshold)


def by_probabilities(outliers: DataFrame, probabilities: DataFrame, key: str, threshold: float = 0.0) -> DataFrame:
    """``probabilities``: key, topic, probability in long form."""
    return best(probabilities.join(outliers.select(key), key, "left_semi"), key, "probability", threshold)


def by_term_scores(outliers: DataFrame, scored: DataFrame, key: str, text: str = "text", threshold: float = 0.0, digits: int = 6) -> DataFrame:
    """Cosine of a row's terms, weighted by idf, and the topics' scores. In a large topic a rare term's cosine rounds to 0; it is the best topic all the same."""
    scored = cut(scored.select("topic", "term", "idf", "score"))
    counts = cut(tk.term_counts(outliers, key, text))
    idf = scored.groupBy("term").agg(F.max("idf").alias("idf"))
    w = F.col("n") * F.col("idf")
    own = counts.join(idf, "term").groupBy(key).agg(F.sqrt(F.sum(w * w)).alias("own"))
    dots = counts.join(scored, "term").groupBy(key, "topic").agg(F.sum(w * F.col("score")).alias("dot"))
    norms = scored.groupBy("topic").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"))
    sims = dots.join(own, key).join(norms, "topic").withColumn("__exact", F.col("dot") / (F.col("own") * F.col("norm")))
    return best(sims.withColumn("similarity", F.round("__exact", digits)), key, "similarity", threshold, "__exact")


def by_vectors(outliers: DataFrame, centers: DataFrame, key: str, vector: str = "vector", threshold: float = 0.0) -> DataFrame:
    """Cosine with the topics' vectors."""
    found = similarity.nearest(outliers.select(key, vector), centers, vector, threshold=threshold)
    return found.where(F.col("topic") != OUTLIER).select(key, "topic", "similarity")


def reassign(docs: DataFrame, found: DataFrame, key: str, topic: str = "topic") -> DataFrame:
    """``docs`` with the found topics in place of -1; an outlier that found none stays one."""
    given = found.select(key, F.col("topic").alias("__to"))
    return docs.join(given, key, "left").withColumn(topic, F.when(F.col(topic) == OUTLIER, F.coalesce("__to", F.lit(OUTLIER))).otherwise(F.col(topic))).drop("__to")

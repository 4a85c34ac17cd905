"""Tuning of topic words: representative documents, words near them, patterns of words.

A tuner takes topic words and gives topic words, so tuners can follow one another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..functions import vectors as v
from ..plans.tables import cut

Tuner = Callable[[DataFrame], DataFrame]


def representative_documents(docs: DataFrame, scored: DataFrame, key: str, topic: str, text: str = "text", n: int = 3, digits: int = 9) -> DataFrame:
    """key, topic, rank, similarity: the ``n`` documents of each topic most similar to it by term scores. Every document is scored; none is sampled."""
    counts = docs.select(key, F.col(topic).alias("topic"), F.explode(tk.tokens(F.col(text))).alias("term")).groupBy(key, "topic", "term").agg(F.count(F.lit(1)).alias("c"))
    scored = cut(scored.select("topic", "term", "idf", "score"))
    met = counts.join(scored.select("topic", "term", "idf", "score"), ["topic", "term"])
    norms = scored.groupBy("topic").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"))
    w = F.col("c") * F.col("idf")
    sums = met.groupBy(key, "topic").agg(F.sum(w * F.col("score")).alias("dot"), F.sqrt(F.sum(w * w)).alias("own"))
    value = F.round(F.col("dot") / (F.col("own") * F.col("norm")), digits)
    order = Window.partitionBy("topic").orderBy(F.desc("similarity"), key)
    ranked = sums.join(norms, "topic").withColumn("similarity", value).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= n).select(key, "topic", F.col("rank").cast("long").alias("rank"), "similarity")


def nearest_words(candidates: DataFrame, word_vectors: DataFrame, document_vectors: DataFrame, n: int = 10, digits: int = 9) -> DataFrame:
    """topic, rank, term, score: candidates (topic, term) by similarity to the mean of their topic's representative documents (topic, vector)."""
    centers = v.mean_vectors(document_vectors, "topic", "vector").withColumnRenamed("vector", "__c")
    joined = candidates.select("topic", "term").join(word_vectors.select("term", v.doubles(F.col("vector")).alias("__w")), "term").join(centers, "topic")
    scored = joined.withColumn("score", F.round(v.cosine(F.col("__w"), F.col("__c")), digits))
    order = Window.partitionBy("topic").orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n).select("topic", "rank", "term", "score")


def tagged_words(words: DataFrame, tags: DataFrame, allowed: tuple[str, ...] = ("NOUN", "ADJ"), n: int = 10) -> DataFrame:
    """Topic words whose tag (term, tag; from a tagger or a lexicon) is allowed, ranked anew by score."""
    kept = words.join(tags.where(F.col("tag").isin(*allowed)).select("term").distinct(), "term", "left_semi")
    order = Window.partitionBy("topic").orderBy(F.desc("score"), "term")
    return kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def classified(words: DataFrame, scores: DataFrame, least: float = 0.8) -> DataFrame:
    """topic, label: candidate labels (topic, label, probability; from a classifier) above ``least``, several a topic if so."""
    return scores.where(F.col("probability") > least).join(words.select("topic").distinct(), "topic", "left_semi").select("topic", "label")


def chain(*tuners: Tuner) -> Tuner:
    """Tuners one after the other."""

    def run(words: DataFrame) -> DataFrame:
        for t in tuners:
            words = t(words)
        return words

    return run


def padded(words: DataFrame, topics: DataFrame, n: int = 10) -> DataFrame:
    """Exactly ``n`` words a topic: missing places hold an empty word of score 0.00001. For display only."""
    places = topics.select("topic").distinct().withColumn("rank", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))))
    full = places.join(words.select("topic", "rank", "term", "score"), ["topic", "rank"], "left")
    return full.select("topic", "rank", F.coalesce("term", F.lit("")).alias("term"), F.coalesce("score", F.lit(0.00001)).alias("score"))

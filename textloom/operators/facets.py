"""Topics seen by class and over time.

Every bin and class is a grouping key of one plan; nothing loops over them. A facet's scores are made with the fitted
idf, set to sum to one, and averaged with the topic's overall scores. A term that a facet lacks has half its overall
score there, and no such term can beat the overall best ones, which have at least that: so the candidates for a facet's
``n`` best words are its own terms and the topic's ``n`` best overall.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens
from ..plans.tables import cut


def bins(rows: DataFrame, stamp: str, n: int) -> DataFrame:
    """``rows`` with ``bin_left``: the left edge of one of ``n`` equal bins over the range of ``stamp`` (a number), closed on the right; the first edge lies 0.1 % of the range lower."""
    span = rows.agg(F.min(stamp).alias("lo"), F.max(stamp).alias("hi"))
    joined = rows.crossJoin(F.broadcast(span))  # one row
    lo, width = F.col("lo"), (F.col("hi") - F.col("lo")) / F.lit(n)
    place = F.greatest(F.lit(1), F.ceil((F.col(stamp) - lo) / width))
    left = F.when(place == 1, lo - 0.001 * (F.col("hi") - lo)).otherwise(lo + (place - 1) * width)
    return joined.withColumn("bin_left", left.cast("long")).drop("lo", "hi")


def facet_words(docs: DataFrame, scored: DataFrame, facet: str, topic: str, text: str = "text", n: int = 5, tuning: bool = True, digits: int = 9) -> DataFrame:
    """facet, topic, words (the ``n`` best, comma-joined), frequency. ``scored`` comes from the fit over all documents."""
    keys = [facet, "topic"]
    rows = docs.withColumn("topic", F.col(topic))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("frequency"))
    bow = rows.select(*keys, F.explode(tokens.tokens(F.col(text))).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))
    bow = cut(bow)
    overall = F.col("score") / F.sum("score").over(Window.partitionBy("topic"))
    fitted = cut(scored.select("topic", "term", "idf", overall.alias("overall")))
    own = bow.join(fitted, ["topic", "term"])
    size = bow.groupBy(*keys).agg(F.sum("n").alias("size"))
    own = own.join(size, keys).withColumn("value", F.col("n") / F.col("size") * F.col("idf"))
    if tuning:
        sums = own.groupBy(*keys).agg(F.sum("value").alias("sum"))
        own = own.join(sums, keys).withColumn("value", (F.col("overall") + F.col("value") / F.col("sum")) / 2)
        order = Window.partitionBy("topic").orderBy(F.desc(F.round(F.col("overall") / 2, digits)), "term")
        best = fitted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
        lacking = counts.select(*keys).join(best.select("topic", "term", (F.col("overall") / 2).alias("value")), "topic").join(bow.select(*keys, "term"), [*keys, "term"], "left_anti")
        own = own.select(*keys, "term", "value").unionByName(lacking.select(*keys, "term", "value"))
    order = Window.partitionBy(*keys).orderBy(F.desc("value"), "term")
    top = own.withColumn("value", F.round("value", digits)).where("value > 0").withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    words = top.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda s: s["term"]), ", ").alias("words"))
    return counts.join(words, keys, "left").select(*keys, "words", "frequency")


def smoothed(scores: DataFrame, bin_col: str) -> DataFrame:
    """Scores of each (topic, term) averaged with those of the topic's previous bin; a term new in a bin is halved."""
    dense = F.dense_rank().over(Window.partitionBy("topic").orderBy(bin_col))
    now = scores.withColumn("__bin", dense)
    before = now.select("topic", "term", (F.col("__bin") + 1).alias("__bin"), F.col("value").alias("__before"))
    return now.join(before, ["topic", "term", "__bin"], "left").withColumn("value", F.when(F.col("__bin") == 1, F.col("value")).otherwise((F.col("value") + F.coalesce("__before", F.lit(0.0))) / 2)).drop("__bin", "__before")


def normalized_frequency(facets: DataFrame, frequency: str = "frequency") -> Column:
    """A topic's frequencies divided by their L2 norm."""
    return F.col(frequency) / F.sqrt(F.sum(F.col(frequency) * F.col(frequency)).over(Window.partitionBy("topic")))

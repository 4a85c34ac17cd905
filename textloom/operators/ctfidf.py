"""Class-based TF-IDF: how typical a term is of a topic against all topics.

Everything stays in long form, (topic, term, n), written once before it is used several times. Totals by term are a window over rows already grouped, totals by topic a
small aggregate joined back; nothing is concatenated or collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens
from ..plans.tables import cut, ranked


def bag_of_words(docs: DataFrame, topic: str, text: str = "text", **options) -> DataFrame:
    """topic, term, n."""
    return tokens.term_counts(docs, topic, text, **options).withColumnRenamed(topic, "topic")


def bigrams_across(docs: DataFrame, topic: str, order: str, text: str = "text") -> DataFrame:
    """topic, term, n of pairs of neighbouring tokens, where a topic's documents follow one another by ``order``.

    Pairs inside a document are formed there; the one pair across a border comes from the documents' first and last
    tokens, a row for each document, which are numbered in order by ranges, so a topic's texts are never put together and
    no task gets all documents of a topic.
    """
    words = cut(docs.select(F.col(topic).alias("topic"), F.col(order).alias("__o"), tokens.tokens(F.col(text)).alias("w")).where(F.size("w") > 0))
    inner = words.select("topic", F.explode(tokens.ngrams(F.col("w"), 2, 2)).alias("term"))
    edge = words.select("topic", "__o", F.col("w")[0].alias("first"), F.element_at("w", -1).alias("last"))
    edge = cut(ranked(edge, "topic", "__o"))
    after = edge.select(F.col("topic").alias("__t"), (F.col("rank") - 1).alias("__r"), F.col("first").alias("after"))
    border = edge.join(after, F.col("topic").eqNullSafe(F.col("__t")) & (F.col("rank") == F.col("__r"))).select("topic", F.concat_ws(" ", "last", "after").alias("term"))
    return inner.unionByName(border).groupBy("topic", "term").agg(F.count(F.lit(1)).alias("n"))


def inverse_frequency(mean: Column, total: Column, bm25: bool) -> Column:
    if bm25:
        return F.log(1 + (mean - total + 0.5) / (total + 0.5))
    return F.log(mean / total + 1)


def score(bow: DataFrame, bm25: bool = False, sqrt: bool = False, seeds: DataFrame | None = None) -> DataFrame:
    """topic, term, n, total, idf, score.

    ``bm25`` and ``sqrt`` choose the variants; ``seeds`` (term, multiplier) raises the weight of given terms. Terms without
    a topic (null) count in the mean size but have no score and no part in a term's total.
    """
    bow = cut(bow)
    sizes = bow.groupBy("topic").agg(F.sum("n").alias("size"))
    mean = F.floor(F.avg("size").over(Window.partitionBy()))
    sizes = sizes.withColumn("mean", mean)
    rows = bow.where("topic is not null").withColumn("total", F.sum("n").over(Window.partitionBy("term"))).join(sizes, "topic")
    rows = rows.withColumn("idf", inverse_frequency(F.col("mean"), F.col("total"), bm25))
    if seeds is not None:
        rows = rows.join(seeds, "term", "left").withColumn("idf", F.col("idf") * F.coalesce("multiplier", F.lit(1.0))).drop("multiplier")
    tf = F.col("n") / F.col("size")
    return rows.withColumn("score", (F.sqrt(tf) if sqrt else tf) * F.col("idf")).select("topic", "term", "n", "total", "idf", "score")


def top_words(scored: DataFrame, n: int = 10, by: str = "topic", digits: int = 9) -> DataFrame:
    """The ``n`` best terms of each topic with a total order: score (rounded), then term. Scores of 0 and below don't count."""
    value = F.round("score", digits)
    order = Window.partitionBy(by).orderBy(F.desc("score"), "term")
    rows = scored.withColumn("score", value).where("score > 0")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("long"))


def representation(scored: DataFrame, n: int = 10) -> DataFrame:
    """topic, words: the best terms of each topic as an array in order."""
    ranked = top_words(scored, n).groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("r"))
    return ranked.select("topic", F.transform("r", lambda x: x["term"]).alias("words"))

"""Topics as tables: sizes, numbering, labels, information, mappings and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


OUTLIER = -1


def sizes(docs: DataFrame, topic: str = "topic") -> DataFrame:
    return docs.groupBy(F.col(topic).alias("topic")).agg(F.count(F.lit(1)).alias("size"))


def renumbering(topic_sizes: DataFrame) -> DataFrame:
    """from_topic, to_topic: numbers by falling size, then by old number; outliers stay ``-1``."""
    order = Window.partitionBy((F.col("topic") == OUTLIER)).orderBy(F.desc("size"), "topic")
    to = F.when(F.col("topic") == OUTLIER, F.lit(OUTLIER)).otherwise(F.row_number().over(order) - 1)
    return topic_sizes.select(F.col("topic").alias("from_topic"), to.cast("long").alias("to_topic"))


def compose(first: DataFrame, then: DataFrame) -> DataFrame:
    """from_topic, to_topic of two mappings in a row; what the second doesn't know becomes an outlier."""
    after = then.select(F.col("from_topic").alias("to_topic"), F.col("to_topic").alias("__end"))
    return first.join(after, "to_topic", "left").select("from_topic", F.coalesce("__end", F.lit(OUTLIER)).alias("to_topic"))


def remap(docs: DataFrame, mapping: DataFrame, topic: str = "topic") -> DataFrame:
    """``docs`` with topics renamed; unknown topics become outliers."""
    m = mapping.select(F.col("from_topic").alias("__from"), F.col("to_topic").alias("__to"))
    return docs.join(m, F.col(topic) == F.col("__from"), "left").withColumn(topic, F.coalesce("__to", F.lit(OUTLIER))).drop("__from", "__to")


def remap_weights(weights: DataFrame, mapping: DataFrame) -> DataFrame:
    """doc_id, topic, weight summed over topics that became one; outliers carry no weight."""
    return remap(weights, mapping).where(F.col("topic") != OUTLIER).groupBy("doc_id", "topic").agg(F.sum("weight").alias("weight"))


def merge_mapping(topics: DataFrame, groups: list[list[int]]) -> DataFrame:
    """from_topic, to_topic that puts each group's topics into its first. Groups are typed in by hand, so they are few."""
    to = F.col("topic")
    for group in groups:
        to = F.when(F.col("topic").isin(*group), F.lit(group[0])).otherwise(to)
    return topics.select(F.col("topic").alias("from_topic"), to.cast("long").alias("to_topic"))


def label(topic: Column, words: Column, n: int = 4, separator: str = "_", word_length: int | None = None, prefix: bool = True) -> Column:
    """``{topic}_w1_w2_w3_w4`` and its variants."""
    cut = F.slice(words, 1, n)
    if word_length:
        cut = F.transform(cut, lambda w: F.substring(w, 1, word_length))
    joined = F.array_join(cut, separator)
    return F.concat_ws(separator, topic.cast("string"), joined) if prefix else joined


def custom_labels(labels: DataFrame, given: DataFrame) -> DataFrame:
    """topic, label: the given label of a topic, or else the label it has."""
    return labels.join(given.withColumnRenamed("label", "given"), "topic", "left").select("topic", F.coalesce("given", "label").alias("label"))


def topic_info(topic_sizes: DataFrame, words: DataFrame) -> DataFrame:
    """topic, count, name, representation."""
    named = words.select("topic", label(F.col("topic"), F.col("words")).alias("name"), F.col("words").alias("representation"))
    return topic_sizes.join(named, "topic", "left").withColumnRenamed("size", "count")


def document_info(docs: DataFrame, info: DataFrame, representatives: DataFrame, topic: str = "topic") -> DataFrame:
    """``docs`` with their topic's name and words and whether they represent it (``representatives`` has doc_id)."""
    joined = docs.join(info.drop("count"), topic, "left")
    marks = representatives.select("doc_id", F.lit(True).alias("representative")).distinct()
    return joined.join(marks, "doc_id", "left").withColumn("representative", F.coalesce("representative", F.lit(False)))


def outliers(docs: DataFrame, topic: str = "topic") -> DataFrame:
    """outliers: 1 if any document is an outlier, else 0."""
    return docs.agg(F.coalesce(F.max((F.col(topic) == OUTLIER).cast("int")), F.lit(0)).alias("outliers"))


def set_differences(old: DataFrame, new: DataFrame, topic: str = "topic") -> DataFrame:
    """topic, kind: ``new`` or ``missing`` topics of a batch against those known."""
    a, b = old.select(topic).distinct(), new.select(topic).distinct()
    return b.join(a, topic, "left_anti").withColumn("kind", F.lit("new")).unionByName(a.join(b, topic, "left_anti").withColumn("kind", F.lit("missing")))

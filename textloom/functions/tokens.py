"""Tokens, n-grams and windows of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of two letters, digits or underscores and more; the same class in every engine, unlike ``\w``.
TOKEN = r"[\p{L}\p{N}_]{2,}"


def tokens(text: Column, lower: bool = True) -> Column:
    """The text's tokens in order; null gives null."""
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(TOKEN), F.lit(0))


def ngrams(words: Column, low: int = 1, high: int = 1) -> Column:
    """All n-grams of ``low`` to ``high`` tokens, joined by blanks."""

    def spans(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))

    parts = [words if n == 1 else spans(n) for n in range(low, high + 1)]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def term_counts(docs: DataFrame, key: str, text: str = "text", low: int = 1, high: int = 1, stop_words: list[str] | None = None, lower: bool = True) -> DataFrame:
    """key, term, n: a bag of words for each value of ``key``, counted in one aggregation with map-side sums."""
    words = tokens(F.col(text), lower)
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(*stop_words))
    return docs.select(F.col(key), F.explode(ngrams(words, low, high)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def bounded_terms(bow: DataFrame, key: str, min_df: int = 1, max_df: float = 1.0, max_features: int | None = None) -> DataFrame:
    """``bow`` without terms in fewer than ``min_df`` groups or more than the share ``max_df`` of groups; at most the most frequent ``max_features``."""
    groups = bow.select(key).distinct().count()
    terms = bow.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("total")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * groups))
    if max_features:
        terms = terms.orderBy(F.desc("total"), "term").limit(max_features)
    return bow.join(terms.select("term"), "term", "left_semi")


def windows(words: Column, size: int = 4, stride: int = 1, padding: bool = False) -> Column:
    """Windows of tokens as (first, last) positions from 1. A text no longer than ``size`` is one window; none without tokens.

    ``padding`` adds the shorter windows that begin or end a text.
    """
    n = F.size(words)
    if padding:
        ends = F.when(n > 0, F.sequence(F.lit(1), n + size - 1, F.lit(stride)))
        spans = F.transform(ends, lambda e: F.struct(F.greatest(F.lit(1), e - size + 1).alias("first"), F.least(n, e).alias("last")))
        return F.when(n > 0, F.array_distinct(spans))
    starts = F.when(n > size, F.sequence(F.lit(1), n - size + 1, F.lit(stride))).when(n > 0, F.array(F.lit(1)))
    return F.transform(starts, lambda s: F.struct(s.alias("first"), F.least(n, s + size - 1).alias("last")))

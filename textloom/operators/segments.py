"""Segments of responses: one row to many and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import finalize, upper

FAILED = "NA"
BROKEN = "PROCESSING_ERROR"


def split_sentences(rows: DataFrame, keys: list[str], text: str, pattern: str = r"[.!?;]+|\n") -> DataFrame:
    """keys, segment_id (from 1), segment: the parts of each text between ``pattern``, without empty ones."""
    parts = F.filter(F.transform(F.split(F.col(text), pattern), lambda s: F.trim(s)), lambda s: s != "")
    return rows.select(*keys, F.posexplode(parts).alias("p", "segment")).select(*keys, (F.col("p") + 1).cast("long").alias("segment_id"), "segment")


def label(text: Column, words: int = 3) -> Column:
    """A label without a language model: the first words in upper case, joined by underscores; ``NA`` without words."""
    found = F.slice(F.regexp_extract_all(upper(text), F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0)), 1, words)
    return F.when(F.size(found) > 0, F.array_join(found, "_")).otherwise(F.lit(FAILED))


def with_labels(rows: DataFrame, text: str, words: int = 3) -> DataFrame:
    return rows.withColumn("label", label(F.col(text), words))


def statistics(rows: DataFrame, key: str, label: str, failed: tuple[str, ...] = (FAILED, BROKEN)) -> DataFrame:
    """labels (distinct), mean_words of a label, several (responses of more than one segment); ``failed`` labels don't count."""
    real = ~F.col(label).isin(*failed)
    of_labels = rows.agg(F.count_distinct(F.when(real, F.col(label))).alias("labels"), F.round(F.avg(F.when(real, F.size(F.split(label, "_")))), 6).alias("mean_words"))
    of_rows = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("several"))
    return of_labels.join(of_rows)  # one row each


def nest(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, segments: the segments of each response as an ordered array of structs. A response is a few rows."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("segments"))


def flatten(nested: DataFrame, key: str, texts: list[str], missing: str = FAILED) -> DataFrame:
    """The rows of :func:`nest` again; null texts become ``missing``."""
    rows = nested.select(key, F.explode("segments").alias("s")).select(key, "s.*")
    return rows.withColumns({c: F.coalesce(c, F.lit(missing)) for c in texts})


def described(segments: DataFrame, text: str = "segment", out: str = "description") -> DataFrame:
    """``segments`` with a description: the finished text of the segment. The rule where no language model is given."""
    return segments.withColumn(out, finalize(F.col(text)))


def with_fallbacks(rows: DataFrame, answer: str, failed: str | None = None, empty: str = FAILED, error: str = BROKEN) -> DataFrame:
    """``rows`` whose ``answer`` is whole: ``error`` where the batch failed (a boolean column), ``empty`` where nothing came back for the row."""
    lost = F.coalesce(F.col(failed), F.lit(False)) if failed else F.lit(False)
    blank = F.col(answer).isNull() | (F.trim(answer) == "")
    return rows.withColumn(answer, F.when(lost, F.lit(error)).when(blank, F.lit(empty)).otherwise(F.col(answer)))

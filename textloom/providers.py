"""Places for outside models: embedding, labelling, grading. Each has a deterministic default that needs no network.

A provider sees a table of distinct inputs and gives a table of answers, so equal inputs are asked once; calls run where
the data are, in Arrow batches, and are repeated on failure.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    def embed(self, rows: DataFrame, text: str, out: str) -> DataFrame: ...


class HashingEmbedder:
    """Hashed TF-IDF vectors of fixed length, from ``pyspark.ml``; fitted on the rows first seen."""

    def __init__(self, size: int = 256):
        self.size, self._model = size, None

    def embed(self, rows: DataFrame, text: str, out: str = "vector") -> DataFrame:
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
        from pyspark.ml.functions import vector_to_array

        if self._model is None:
            steps = [
                RegexTokenizer(inputCol=text, outputCol="__w", pattern=r"[^\p{L}\p{N}_]+"),
                HashingTF(inputCol="__w", outputCol="__tf", numFeatures=self.size),
                IDF(inputCol="__tf", outputCol="__idf"),
                Normalizer(inputCol="__idf", outputCol="__n", p=2.0),
            ]
            self._model = Pipeline(stages=steps).fit(rows)
        return self._model.transform(rows).withColumn(out, vector_to_array("__n")).drop("__w", "__tf", "__idf", "__n")


class ReducedEmbedder:
    """The fallback where no model is named: hashed TF-IDF vectors turned onto their ``size`` main directions, fitted on the rows first seen."""

    def __init__(self, size: int = 100, buckets: int = 1024):
        self.size, self._wide, self._model = size, HashingEmbedder(buckets), None

    def embed(self, rows: DataFrame, text: str, out: str = "vector") -> DataFrame:
        from pyspark.ml.feature import PCA
        from pyspark.ml.functions import array_to_vector, vector_to_array

        wide = self._wide.embed(rows, text, "__wide").withColumn("__wide", array_to_vector("__wide"))
        if self._model is None:
            self._model = PCA(k=min(self.size, self._wide.size), inputCol="__wide", outputCol="__main").fit(wide)
        return self._model.transform(wide).withColumn(out, vector_to_array("__main")).drop("__wide", "__main")


class PairEmbedder:
    """One embedder for words and another for documents."""

    def __init__(self, words: Embedder, documents: Embedder):
        self.words, self.documents = words, documents

    def embed(self, rows: DataFrame, text: str, out: str = "vector", kind: str = "document") -> DataFrame:
        return embed(self, rows, text, out, kind)


def choose_embedder(model: Embedder | str | None = None) -> Embedder:
    """An embedder as it is; by name ``hashing`` or ``reduced``; without one the fallback."""
    named = {"hashing": HashingEmbedder, "reduced": ReducedEmbedder, None: ReducedEmbedder}
    if model is None or isinstance(model, str):
        if model not in named:
            raise ValueError(f"no embedder {model!r}: hashing, reduced, or an object with embed()")
        return named[model]()
    if not hasattr(model, "embed"):
        raise ValueError("an embedder needs embed(rows, text, out)")
    return model


def embed(model: Embedder, rows: DataFrame, text: str, out: str = "vector", kind: str = "document") -> DataFrame:
    """Embeds words, or documents, or pictures by their captions (``kind``), with the part of the model that is meant for them."""
    if kind not in ("word", "document", "picture"):
        raise ValueError(f"unknown kind {kind!r}: word, document or picture")
    if isinstance(model, PairEmbedder):
        model = model.words if kind == "word" else model.documents
    return model.embed(rows, text, out)


def label_topics(topics: DataFrame, call: Callable[[list[str]], list[str]], template: str, size: int = 20) -> DataFrame:
    """topic, label: ``call`` answers the prompts made of each topic's words and documents (arrays); where it gives nothing, the first words."""
    from .functions.text import fill_prompt

    asked = topics.withColumn("__prompt", fill_prompt(F.lit(template), F.col("words"), F.col("documents")))
    told = map_batches(asked, "__prompt", call, "label", size)
    return told.select("topic", F.coalesce(F.when(F.trim("label") != "", F.trim("label")), F.array_join(F.slice("words", 1, 3), "_")).alias("label"))


def once_each(rows: DataFrame, key: str, call: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` joined with ``call`` of their distinct ``key`` values."""
    return rows.join(call(rows.select(key).where(F.col(key).isNotNull()).distinct()), key, "left")


def retrying(call: Callable, tries: int = 3, delay: float = 1.0, factor: float = 2.0, sleep: Callable[[float], None] = time.sleep, linear: bool = False, jitter: float = 0.0) -> Callable:
    """``call`` repeated on failure with growing delays (by a factor, or by one more ``delay`` each if ``linear``), each longer by up to ``jitter`` of itself; the last failure is raised."""

    def run(*args, **kwargs):
        wait = delay
        for k in range(tries):
            try:
                return call(*args, **kwargs)
            except Exception:
                if k == tries - 1:
                    raise
                sleep(wait * (1 + jitter * random.random()))
                wait = wait + delay if linear else wait * factor

    return run


def map_batches(rows: DataFrame, column: str, call: Callable[[list[str]], list[str]], out: str, size: int = 100) -> DataFrame:
    """``rows`` with ``out``, answered by ``call`` in batches of ``size`` on the executors; a batch that fails three times gives nulls."""
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*rows.schema.fields, StructField(out, StringType())])

    def run(frames):
        ask = retrying(call)
        for f in frames:
            answers = []
            for at in range(0, len(f), size):
                part = f[column].iloc[at : at + size].tolist()
                try:
                    answers += ask(part)
                except Exception:
                    answers += [None] * len(part)
            f[out] = answers
            yield f

    return rows.mapInPandas(run, schema)

"""A corpus pipeline of five operators, from raw documents to token ids.

Each stage reads all that its predecessor kept. The last stage's columns are those of :func:`encoded`.

Defined cases, for all stages: a row is told from others by all its columns, not by its id, so null and repeated ids lose
nothing; a null text is an empty one (the quality rules reject it); columns beyond those used pass through whatever their
names, but for the last stage, which returns its own; texts are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, pii, quality_rules, simhash_dedup, source_mixing
from textloom.llm._common import materialize, prepare, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: not rejected by the base rule, nor by their host's verdicts. A null source is a host of its own."""
    prepare(spark)
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id, null ids last; of rows equal in all columns, one."""
    prepare(spark)
    return simhash_dedup.keep_one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind; a null text stays null."""
    prepare(spark)
    return pii.redact_documents(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix by shard, as often as it takes them; drawn blocks may cut a text. A null source is the last of the sources."""
    prepare(spark)
    return source_mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids and the text that the ids decode to; a row for each row, nulls in the first three kept."""
    prepare(spark)
    vocabulary = bpe.load_vocabulary(spark, public_tokenizers.path("word_bpe_49k.json"))
    both = bpe.code_documents(docs, vocabulary, keep=["doc_id", "source", "lang"])
    return both.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("personal data", personal_data), ("mixing", mixing), ("encoding", encoded)]

#: Fingerprints and tokens can't be had in SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what each returns is written as Parquet and read again by the next."""
    docs = read_table(prepare(spark), sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs

"""The survey pipeline: clean, grade, segment, embed, cluster, label, export. Each step is a table; steps are cut by written tables, the stage cache."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import clusters, codebook, export, quality, segments
from ..providers import Embedder, HashingEmbedder
from .tables import cut


@dataclass
class SurveyPipeline:
    """``key`` names the respondent, ``response`` the answer. Outside models are replaced by rules and hashed vectors unless given."""

    key: str = "respondent_id"
    response: str = "response"
    variable: str = "Q"
    n_clusters: int = 8
    embedder: Embedder | None = None

    def preprocess(self, raw: DataFrame) -> DataFrame:
        """Typed, normalised, finished answers with preliminary missing codes."""
        r = F.col(self.response)
        rows = raw.select(self.key, r.alias("response"), quality.response_type(r, F.lit(True)).alias("response_type"))
        rows = cut(rows.withColumn("normalized", tx.normalize(F.col("response"))))
        rows = rows.withColumn("code", quality.missing_code(F.col("response"), F.col("normalized")))
        return cut(rows.withColumn("cleaned", F.when(F.col("code").isNull(), tx.finalize(F.col("normalized")))))

    def grade(self, rows: DataFrame, question: str | None = None) -> DataFrame:
        """Grades by rule for what has no code yet."""
        grade = quality.rule_grade(F.col("cleaned"), F.lit(question) if question else None)
        code = F.coalesce("code", grade)
        return cut(rows.withColumn("quality_code", code)).withColumn("quality_filter", F.col("quality_code") != 0)

    def segment(self, graded: DataFrame) -> DataFrame:
        kept = graded.where(~F.col("quality_filter"))
        return segments.with_labels(segments.split_sentences(kept, [self.key], "cleaned"), "segment")

    def cluster(self, rows: DataFrame) -> DataFrame:
        embedded = cut((self.embedder or HashingEmbedder()).embed(rows, "segment", "vector"))
        found = clusters.kmeans(embedded, self.n_clusters).withColumn("cluster", F.col("cluster").cast("long"))
        return cut(clusters.filter_and_remap(found))

    def label(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(segments with theme and concept, codebook): each cluster is a concept named by its most frequent label; concepts of one first word share a theme."""
        counted = rows.where("cluster is not null").groupBy("cluster", "label").count()
        named = counted.groupBy("cluster").agg(F.max(F.struct("count", "label"))["label"].alias("label"))
        book = named.select("cluster", "label", F.split("label", "_")[0].alias("theme"))
        book = book.withColumn("concept_id", F.concat_ws(".", "theme", "cluster"))
        labels = codebook.final_labels(rows.select("cluster").where("cluster is not null").distinct(), book.select("cluster", F.col("label").alias("concept")), book.select("label", "theme", "concept_id").dropDuplicates(["label"]))
        return codebook.segment_codes(rows, labels), book

    def export(self, raw: DataFrame, graded: DataFrame, coded: DataFrame, themes: list[str], concepts: list[str]) -> DataFrame:
        assigned = coded.where("theme is not null").select(self.key, "theme", F.col("concept_id").alias("concept"))
        codes = graded.where("quality_filter").select(self.key, F.col("quality_code").alias("code"))
        return export.indicators(raw, assigned, codes, self.key, self.variable, themes, concepts)

"""A topic model over four tables: counts, scores, words and vectors."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..functions import vectors as v
from ..operators import clusters, ctfidf, hierarchy, outliers, similarity, topics, tuners
from ..sources import files


@dataclass
class TopicModelParams:
    language: str = "english"
    top_n_words: int = 10
    ngram_range: tuple[int, int] = (1, 1)
    min_topic_size: int = 10
    nr_topics: int | None = None
    bm25: bool = False
    reduce_frequent_words: bool = False
    stop_words: list[str] = field(default_factory=list)
    zeroshot_min_similarity: float = 0.7
    clusterer: str = "given"
    n_clusters: int = 10


@dataclass
class TopicModel:
    """Fitted tables, lazily planned; ``fit`` takes documents with an id, a text and, if topics aren't given, a vector."""

    params: TopicModelParams
    bow: DataFrame | None = None
    scores: DataFrame | None = None
    vectors: DataFrame | None = None
    sizes: DataFrame | None = None
    labelled: DataFrame | None = None

    @classmethod
    def fit(cls, docs: DataFrame, params: TopicModelParams | None = None, key: str = "doc_id", text: str = "text", topic: str = "topic", vector: str = "vector") -> TopicModel:
        p = params or TopicModelParams()
        if p.clusterer == "kmeans":
            docs = clusters.kmeans(docs, p.n_clusters, vector).withColumn(topic, F.col("cluster").cast("long")).drop("cluster")
        elif p.clusterer == "density":
            found = clusters.density_clusters(docs, key, vector, p.min_topic_size)
            docs = docs.join(found.withColumnRenamed("cluster", topic), key)
        elif p.clusterer != "given":
            raise ValueError(f"unknown clusterer {p.clusterer!r}: given, kmeans or density")
        has_vectors = vector in docs.columns
        if p.clusterer != "given":
            docs = topics.remap(docs, topics.renumbering(topics.sizes(docs, topic)), topic)
        if p.nr_topics and has_vectors:
            centers = v.mean_vectors(docs.where(F.col(topic) != -1), topic, vector).withColumnRenamed(topic, "topic")
            docs = topics.remap(docs, hierarchy.reduction_mapping(docs.sparkSession, centers, p.nr_topics), topic)
        model = cls(p, labelled=docs)
        return model._describe(docs, text, topic, vector if has_vectors else None)

    def _describe(self, docs: DataFrame, text: str, topic: str, vector: str | None) -> TopicModel:
        p = self.params
        bow = tk.term_counts(docs.select(topic, text), topic, text, *p.ngram_range, stop_words=p.stop_words or None).withColumnRenamed(topic, "topic")
        return TopicModel(p, bow, ctfidf.score(bow, p.bm25, p.reduce_frequent_words), v.mean_vectors(docs, topic, vector).withColumnRenamed(topic, "topic") if vector else self.vectors, topics.sizes(docs, topic), docs)

    def words(self) -> DataFrame:
        return ctfidf.top_words(self.scores, self.params.top_n_words).select("topic", "rank", "term", "score")

    def info(self) -> DataFrame:
        return topics.topic_info(self.sizes, ctfidf.representation(self.scores, self.params.top_n_words))

    def transform(self, docs: DataFrame, vector: str = "vector") -> DataFrame:
        """``docs`` with the nearest topic and its similarity; works on a streaming table too."""
        return similarity.nearest(docs, self.vectors.where("topic <> -1"), vector)

    def representative_documents(self, key: str = "doc_id", text: str = "text", topic: str = "topic", n: int = 3) -> DataFrame:
        """key, topic, rank, similarity: the documents of each topic most like its words."""
        return tuners.representative_documents(self.labelled, self.scores, key, topic, text, n)

    def tuned(self, *steps: tuners.Tuner) -> DataFrame:
        """The topics' words after one tuner or several."""
        return tuners.chain(*steps)(self.words())

    def reduce_outliers(self, key: str = "doc_id", text: str = "text", topic: str = "topic", vector: str = "vector", strategy: str = "distributions", threshold: float = 0.0, probabilities: DataFrame | None = None) -> DataFrame:
        """The labelled documents with topics for outliers where the strategy finds one; put them in force with :meth:`update`."""
        lost, scored = self.labelled.where(F.col(topic) == outliers.OUTLIER), self.scores.where(F.col("topic") != outliers.OUTLIER)
        if strategy == "distributions":
            found = outliers.by_distributions(lost, scored, key, text, threshold)
        elif strategy == "probabilities":
            if probabilities is None:
                raise ValueError("this strategy needs probabilities: key, topic, probability")
            found = outliers.by_probabilities(lost, probabilities, key, threshold)
        elif strategy == "c-tf-idf":
            found = outliers.by_term_scores(lost, scored, key, text, threshold)
        elif strategy == "embeddings":
            found = outliers.by_vectors(lost, self.vectors.where(F.col("topic") != outliers.OUTLIER), key, vector, threshold)
        else:
            raise ValueError(f"unknown strategy {strategy!r}: distributions, probabilities, c-tf-idf or embeddings")
        return outliers.reassign(self.labelled, found, key, topic)

    def reduce(self, n: int | str, text: str = "text", topic: str = "topic", vector: str = "vector") -> TopicModel:
        """Fewer topics: ``n`` of them, or, by ``"auto"``, one for each dense group of their vectors."""
        centers = self.vectors.where("topic <> -1")
        mapping = hierarchy.auto_mapping(centers) if n == "auto" else hierarchy.reduction_mapping(centers.sparkSession, centers, n)
        kept = mapping.unionByName(self.sizes.where("topic = -1").select(F.col("topic").alias("from_topic"), F.col("topic").alias("to_topic")))
        docs = topics.remap(self.labelled, kept, topic)
        docs = topics.remap(docs, topics.renumbering(topics.sizes(docs, topic)), topic)
        return self._describe(docs, text, topic, vector if vector in docs.columns else None)

    def merge(self, groups: list[list[int]], text: str = "text", topic: str = "topic", vector: str = "vector") -> TopicModel:
        docs = topics.remap(self.labelled, topics.merge_mapping(self.sizes, groups), topic)
        return self._describe(docs, text, topic, vector if vector in docs.columns else None)

    def update(self, params: TopicModelParams | None = None, text: str = "text", topic: str = "topic", vector: str = "vector", docs: DataFrame | None = None) -> TopicModel:
        """The model described anew by other parameters, or for other topics (``docs``, labelled) without a new clustering."""
        docs = self.labelled if docs is None else docs
        return TopicModel(params or self.params, labelled=docs)._describe(docs, text, topic, vector if vector in docs.columns else None)

    def hierarchy(self) -> DataFrame:
        return hierarchy.tree(self.vectors.sparkSession, self.vectors.where("topic <> -1"))

    def save(self, path: str) -> None:
        tables = {"bow": self.bow, "ctfidf": self.scores, "topic_words": self.words(), "topic_sizes": self.sizes}
        files.save_model(tables | ({"topic_vectors": self.vectors} if self.vectors is not None else {}), asdict(self.params), path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TopicModel:
        tables, config = files.load_model(spark, path)
        config["ngram_range"] = tuple(config["ngram_range"])
        return cls(TopicModelParams(**config), tables["bow"], tables["ctfidf"], tables.get("topic_vectors"), tables["topic_sizes"])

"""Online learning: term counts that decay, topics that arrive, over batches or a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ctfidf


def decayed(batches: DataFrame, decay: float, last: int) -> DataFrame:
    """topic, term, n after all batches at once: each batch's counts times ``(1 - decay)`` for every batch behind it. ``batches``: batch, topic, term, n."""
    weight = F.pow(F.lit(1.0 - decay), F.lit(last) - F.col("batch"))
    return batches.groupBy("topic", "term").agg(F.sum(F.col("n") * weight).alias("n"))


def update(state: DataFrame | None, counts: DataFrame, decay: float = 0.0, least: float = 0.0) -> DataFrame:
    """The state after one more batch: old counts decay, new ones are added, terms below ``least`` in total are dropped.

    One aggregation over both, with map-side sums, rather than a full join.
    """
    new = counts.select("topic", "term", F.col("n").cast("double").alias("n"))
    both = new if state is None else state.select("topic", "term", (F.col("n") * (1.0 - decay)).alias("n")).unionByName(new)
    summed = both.groupBy("topic", "term").agg(F.sum("n").alias("n"))
    if least:
        kept = summed.groupBy("term").agg(F.sum("n").alias("t")).where(F.col("t") >= least).select("term")
        summed = summed.join(kept, "term", "left_semi")
    return summed


def new_topics(known: DataFrame, batch: DataFrame, topic: str = "topic") -> DataFrame:
    """from_topic, to_topic for labels of a batch that are not known: numbered on from the largest topic."""
    from pyspark.sql import Window

    fresh = batch.select(F.col(topic).alias("from_topic")).distinct().join(known.select(F.col("from_topic")), "from_topic", "left_anti")
    top = F.broadcast(known.agg(F.coalesce(F.max("to_topic"), F.lit(-1)).alias("top")))  # one row
    return fresh.crossJoin(top).select("from_topic", (F.col("top") + F.row_number().over(Window.orderBy("from_topic"))).cast("long").alias("to_topic"))


def moved_centers(centers: DataFrame, batch: DataFrame, vector: str = "vector", decay: float = 0.0) -> DataFrame:
    """topic, vector, n: cluster centres (topic, vector, n) after a batch. Each moves to the mean of what it stood for, less ``decay``, and what the batch brings it; one without rows stays."""
    from ..functions import vectors as v
    from ..operators import similarity

    near = similarity.nearest(batch.select(vector), centers, vector)
    rows = near.select("topic", v.doubles(F.col(vector)).alias("vector"), F.lit(1.0).alias("n"))
    old = centers.select("topic", v.doubles(F.col("vector")).alias("vector"), (F.col("n") * (1.0 - decay)).alias("n"))
    both = old.unionByName(rows)
    means = v.mean_vectors(both, "topic", "vector", "n")
    return means.join(both.groupBy("topic").agg(F.sum("n").alias("n")), "topic")


class OnlineTerms:
    """Keeps term counts of a stream of documents in a folder, one version for each batch.

    ``absorb`` is a ``foreachBatch`` function. A version is written whole before the batch's pointer, a small file in the
    folder ``pointers``, names it, and a batch that comes again (after a failure) starts from the version before it, so
    counts are right exactly once, and go on after a restart with a new object on the same folders.
    """

    def __init__(self, spark: SparkSession, path: str, topic: str, text: str = "text", decay: float = 0.0, least: float = 0.0):
        self.spark, self.path, self.topic, self.text, self.decay, self.least = spark, path.rstrip("/"), topic, text, decay, least
        self.pointers = f"{self.path}/pointers"

    def _folder(self):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.pointers)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _batches(self) -> list[int]:
        where, fs = self._folder()
        names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _version(self, batch_id: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/" + self.spark.read.text(f"{self.pointers}/{batch_id}").first()[0])

    def _point(self, batch_id: int, version: str) -> None:
        """Writes the pointer beside its place and moves it there, so that it is there whole or not at all."""
        where, fs = self._folder()
        new, old = (self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where, n) for n in (f"new-{version}", str(batch_id)))
        out = fs.create(new, True)
        out.write(bytearray(version.encode()))
        out.close()
        fs.delete(old, False)
        fs.rename(new, old)

    def absorb(self, batch: DataFrame, batch_id: int) -> None:
        before = max((k for k in self._batches() if k < batch_id), default=None)
        state = None if before is None else self._version(before)
        counts = ctfidf.bag_of_words(batch.select(self.topic, self.text), self.topic, self.text)
        version = f"v{batch_id}-{uuid.uuid4().hex}"
        update(state, counts, self.decay, self.least).write.parquet(f"{self.path}/{version}")
        self._point(batch_id, version)

    def state(self) -> DataFrame:
        return self._version(self._batches()[-1])

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Reads all that the stream has now."""
        q = stream.writeStream.foreachBatch(self.absorb).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()


def windowed_counts(events: DataFrame, stamp: str, kind: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, kind, n over tumbling windows; on a stream, with a watermark."""
    rows = events.withWatermark(stamp, late) if events.isStreaming else events
    return rows.groupBy(F.window(stamp, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")

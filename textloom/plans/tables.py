"""Reading input tables, and guards that keep joins safe at any size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a cross join is broadcast only if it was counted and has at most this many rows.
BROADCAST_ROWS = 50_000
SCRATCH = "textloom-"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table. Documents in fewer files than there are cores are spread over the cores, as taking texts apart is what costs; with files enough, nothing is moved."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and len(df.inputFiles()) < cores else df


def counted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, written once, with a broadcast hint if it is small; else as written. For cross joins, which can't be planned anew when sizes are known;
    equality joins need no hint: adaptive execution measures their sides and broadcasts a small one."""
    df = cut(df)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def scratch(spark: SparkSession) -> str:
    """A new folder of this application's under the one that executors share (``spark.checkpoint.dir``); a temporary one of ours where none is named, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{SCRATCH}{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Removes all that :func:`cut` has written for this application; results that haven't been read yet can't be read after it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{SCRATCH}{spark.sparkContext.applicationId}")
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written in the shared folder and read again: what follows is planned afresh and survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """``df`` with each row's place from 0 in the ``order``; sorted by ranges, so that no task gets all rows."""
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = cut(df.orderBy(*order).withColumns({"__part": F.spark_partition_id(), "__at": at}))
    sizes = sorted((r["__part"], r["count"]) for r in rows.groupBy("__part").count().collect())
    starts, start = [], 0
    for part, n in sizes:
        starts.append((part, start))
        start += n
    offsets = df.sparkSession.createDataFrame(starts, "__part int, __start long")
    return rows.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")

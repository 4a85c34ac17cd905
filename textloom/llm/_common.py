"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows, and bytes, of one Arrow batch handed to Python: bounds a worker's memory even where texts are long.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20

#: A word is a run of anything but ASCII white space; the same class is what ``bytes.split()`` cuts at.
WORD = r"[^\x20\x09-\x0D]+"

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches and lets Python workers import this package from where the driver found it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, PACKAGE_ROOT])
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark's own reader (so any store that Spark reaches will do)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a temporary one of ours where it is unset (local tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: the lineage is cut, and a lost executor costs nothing that was written."""
    path = f"{shared_dir(prepare(df.sparkSession))}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder of ours from whatever store it is in."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(spark: SparkSession, table: str) -> None:
    """Drops a table that was written in the shared folder, its files included."""
    spark.sql(f"DROP TABLE IF EXISTS `{table}`")
    delete_folder(spark, f"{shared_dir(spark)}/{table}")


def drop_old_shuffles(spark: SparkSession) -> None:
    """Has the driver collect its garbage: Spark then removes the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; looks at no more than one row beyond them."""
    return df.limit(max_rows + 1).count() <= max_rows


def checked_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has been counted and found small; otherwise as it is, to be joined by shuffling."""
    return F.broadcast(df) if small_enough(df, max_rows) else df


def free_name(taken: Iterable[str], wish: str) -> str:
    """``wish``, or ``wish`` with underscores in front, that clashes with none of ``taken`` (whatever the case)."""
    lower = {x.lower() for x in taken}
    while wish.lower() in lower:
        wish = "_" + wish
    return wish


#: What a worker keeps from one task to the next, as (module, name of a dict or list).
KEPT = (("textloom.llm.bpe", "_LOADED"), ("textloom.llm.pii", "_AUTO"))


def trim() -> None:
    """Gives freed memory back to the system; without it a worker stays as large as it ever was."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc
        libc.malloc_trim(0)


def let_go(owner: str) -> None:
    """Drops what tasks of other modules than ``owner`` left in this worker: Spark gives its workers to whatever runs next, and an idle one holds on to all it has."""
    dropped = False
    for module, name in KEPT:
        if module != owner and module in sys.modules and (kept := getattr(sys.modules[module], name)):
            kept.clear()
            dropped = True
    if dropped:
        trim()


def map_text(df: DataFrame, text_col: str, fn, fields: list[T.StructField], keep: list[str], also: Iterable[str] = ()) -> DataFrame:
    """Runs ``fn(list of texts, *lists of also) -> list of columns`` batch by batch; returns the ``keep`` columns and the new ``fields``.

    Null texts reach ``fn`` as ``None``. The text itself goes back to the JVM only if it is among ``keep``.
    """
    prepare(df.sparkSession)
    wanted, also = list(dict.fromkeys([*keep, text_col, *also])), list(also)
    out = T.StructType([df.schema[c] for c in keep] + fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, owner = to_arrow_schema(out), fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(owner)
        for batch in batches:
            columns = fn(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (text_col, *also)])
            made = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            made = [c.cast(arrow.field(i).type) if c.type != arrow.field(i).type else c for i, c in enumerate(made)]
            made += [c if isinstance(c, pa.Array) else pa.array(c, type=arrow.field(len(keep) + i).type) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(made, schema=arrow)
        batch = columns = made = None
        trim()

    return df.select(*[F.col(f"`{c}`") for c in wanted]).mapInArrow(run, out)

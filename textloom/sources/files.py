"""Files in and out: typed CSV with nested cells as JSON, variable profiles, stage caches, saved models."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sav import read_sav

NESTED = (T.ArrayType, T.StructType, T.MapType)


def encode_nested(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    return df.select(*[F.to_json(c.name).alias(c.name) if isinstance(c.dataType, NESTED) else F.col(c.name) for c in df.schema])


def decode_nested(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns typed by ``schema``: nested ones from JSON, others by cast; what can't be read is null."""
    return df.select(*[(F.from_json(c.name, c.dataType) if isinstance(c.dataType, NESTED) else F.col(c.name).try_cast(c.dataType)).alias(c.name) for c in schema])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    encode_nested(df).write.mode(mode).csv(path, header=True, nullValue="", quote='"', escape='"')


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV by its schema; nothing is inferred, so the file is read once."""
    flat = T.StructType([T.StructField(c.name, T.StringType()) for c in schema])
    return decode_nested(spark.read.csv(path, header=True, schema=flat, quote='"', escape='"', multiLine=True), schema)


def read_survey(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """A survey table, from an SPSS file (kind ``sav``) or by one of Spark's readers."""
    if kind == "sav":
        return read_sav(spark, path, **options)
    return spark.read.format(kind).options(**options).load(path)


def variables(df: DataFrame) -> dict[str, str]:
    """Labels by column."""
    return {f.name: f.metadata.get("label", "") for f in df.schema}


def variable(df: DataFrame, name: str, key: str | None = None) -> DataFrame:
    missing = [c for c in (name, key) if c and c not in df.columns]
    if missing:
        raise ValueError(f"no variable {missing[0]!r}")
    return df.select(*([key] if key else []), name)


class StageCache:
    """Stage results as Parquet with a table of metadata beside them; the newest entry of (file, step) counts.

    Metadata rows are only appended: an upsert is a later row, and readers take the latest, so two writers don't lose
    each other's entries.
    """

    SCHEMA = "filename string, step string, path string, created_at timestamp, seconds double, status string, entry string"

    def __init__(self, spark: SparkSession, root: str, max_age_days: int = 30):
        self.spark, self.root, self.max_age_days = spark, root.rstrip("/"), max_age_days

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(f"{self.root}/metadata")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], self.SCHEMA)
            raise

    def entries(self) -> DataFrame:
        latest = self._log().groupBy("filename", "step").agg(F.max_by(F.struct("path", "created_at", "seconds", "status"), F.struct("created_at", "entry")).alias("e"))
        return latest.select("filename", "step", "e.*").where("status = 'active'")

    def _note(self, filename: str, step: str, path: str, seconds: float, status: str) -> None:
        row = [(filename, step, path, datetime.now(timezone.utc).replace(tzinfo=None), seconds, status, uuid.uuid4().hex)]
        self.spark.createDataFrame(row, self.SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/metadata")

    def save(self, df: DataFrame, filename: str, step: str, seconds: float = 0.0) -> bool:
        """Writes a stage; an empty one is refused."""
        if df.isEmpty():
            return False
        path = f"{self.root}/{step}-{filename}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self._note(filename, step, path, seconds, "active")
        return True

    def valid(self, now: datetime | None = None) -> DataFrame:
        """Entries no older than the limit."""
        stamp = F.lit(now) if now else F.current_timestamp()
        return self.entries().where(F.col("created_at") >= stamp - F.make_dt_interval(F.lit(self.max_age_days)))

    def load(self, filename: str, step: str) -> DataFrame | None:
        """A stage, or None if it isn't there, is too old or can't be read (then it is struck off)."""
        row = self.valid().where((F.col("filename") == filename) & (F.col("step") == step)).first()
        if row is None:
            return None
        try:
            return self.spark.read.parquet(row["path"])
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise  # the store may be away for a while; the entry stays
            self.invalidate(filename, step)
            return None

    def invalidate(self, filename: str, step: str) -> None:
        self._note(filename, step, "", 0.0, "deleted")

    def save_intermediate(self, df: DataFrame, filename: str, key: str) -> bool:
        """Keeps an intermediate table under a key of its own."""
        return self.save(df, filename, f"intermediate-{key}")

    def load_intermediate(self, filename: str, key: str, expected=None) -> DataFrame | None:
        """An intermediate table; None if it isn't there or lacks a column of ``expected`` (a schema), or has one of another type."""
        found = self.load(filename, f"intermediate-{key}")
        if found is None or expected is None:
            return found
        has = {f.name: f.dataType for f in found.schema}
        return found if all(has.get(f.name) == f.dataType for f in expected) else None

    def statistics(self) -> DataFrame:
        return self.entries().groupBy("step").agg(F.count(F.lit(1)).alias("entries"), F.sum("seconds").alias("seconds"))


MODEL_TABLES = ("bow", "ctfidf", "topic_words", "topic_vectors", "topic_sizes", "mapping")


def plain(value):
    """What JSON has no word for, as what it has: numpy numbers and arrays, times, sets; anything else as text."""
    if hasattr(value, "tolist"):
        return value.tolist()
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return sorted(value, key=str) if isinstance(value, (set, frozenset)) else str(value)


def package_versions(names: tuple[str, ...] = ("pyspark", "numpy", "pandas", "pyarrow")) -> dict[str, str]:
    """Versions of the packages that a model was saved with; those that are missing are left out."""
    from importlib.metadata import PackageNotFoundError, version

    found = {}
    for name in names:
        try:
            found[name] = version(name)
        except PackageNotFoundError:
            continue
    return found


def save_model(tables: dict[str, DataFrame], config: dict, path: str) -> None:
    """A model's tables as Parquet and its settings as JSON text."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        if name not in MODEL_TABLES:
            raise ValueError(f"{name!r} is no table of a model")
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(config | {"versions": package_versions()}, sort_keys=True, default=plain),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def load_model(spark: SparkSession, path: str, names: tuple[str, ...] = MODEL_TABLES) -> tuple[dict[str, DataFrame], dict]:
    """(tables that are there, settings)."""
    config = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/config").collect()))
    config.pop("versions", None)
    found = {}
    for name in names:
        try:
            found[name] = spark.read.parquet(f"{path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return found, config

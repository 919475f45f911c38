"""Reading and writing: formats by name, one place where timestamps become session-zone timestamps, access contexts."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def normalised(df: DataFrame) -> DataFrame:
    """Zoneless timestamps as timestamps of the session's zone, which is to be UTC."""
    naive = [f.name for f in df.schema.fields if isinstance(f.dataType, TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """There is one notion of a missing value."""
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c, t in df.dtypes if t in ("double", "float")})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return normalised(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


@dataclass(frozen=True)
class SourceConfig:
    name: str
    path: str
    format: str = "parquet"
    options: dict[str, str] = field(default_factory=dict)
    schema: str | None = None
    sample: int | None = None


_READERS: dict[str, Callable[[SparkSession, SourceConfig], DataFrame]] = {}


def register_format(name: str):
    """A reader for sources of a format."""

    def deco(f):
        _READERS[name] = f
        return f

    return deco


def _plain(spark: SparkSession, source: SourceConfig) -> DataFrame:
    reader = spark.read.format(source.format).options(**source.options)
    return (reader.schema(source.schema) if source.schema else reader).load(source.path)


for _name in ("parquet", "orc", "json", "text"):
    register_format(_name)(_plain)


@register_format("csv")
def _csv(spark: SparkSession, source: SourceConfig) -> DataFrame:
    """Header line by default. Types are inferred only where no schema is given, which reads the file twice."""
    options = {"header": "true", "inferSchema": str(source.schema is None).lower()} | source.options
    reader = spark.read.options(**options)
    return (reader.schema(source.schema) if source.schema else reader).csv(source.path)


@register_format("table")
def _catalog(spark: SparkSession, source: SourceConfig) -> DataFrame:
    return spark.table(source.path)


@register_format("delta")
def _delta(spark: SparkSession, source: SourceConfig) -> DataFrame:
    """Needs the Delta package on the class path; options such as versionAsOf travel in time."""
    return _plain(spark, source)


def load(spark: SparkSession, source: SourceConfig) -> DataFrame:
    if source.format not in _READERS:
        raise ValueError(f"format {source.format} is not registered: {sorted(_READERS)}")
    df = normalised(_READERS[source.format](spark, source))
    return df if source.sample is None else df.limit(source.sample)


@dataclass(frozen=True)
class LoadResult:
    """What a source turned out to be; error instead of an exception."""

    name: str
    rows: int = 0
    columns: tuple[str, ...] = ()
    duplicates: tuple[str, ...] = ()
    error: str | None = None


def try_load(spark: SparkSession, source: SourceConfig) -> tuple[DataFrame | None, LoadResult]:
    try:
        df = load(spark, source)
        return df, LoadResult(source.name, df.count(), tuple(df.columns), tuple(duplicate_columns(df.columns)))
    except Exception as e:  # noqa: BLE001  whatever a reader says is reported
        return None, LoadResult(source.name, error=str(e).splitlines()[0])


def save_with_metadata(df: DataFrame, path: str, metadata: dict[str, str], partition_by: list[str] | None = None) -> None:
    """Parquet whose first column's field carries the metadata, such as an aggregation's reference date."""
    first = df.columns[0]
    df = df.withMetadata(first, {**df.schema[first].metadata, **metadata})
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def metadata_of(df: DataFrame) -> dict[str, str]:
    return dict(df.schema[df.columns[0]].metadata)


class Catalog:
    """Sources by name."""

    def __init__(self):
        self.sources: dict[str, SourceConfig] = {}

    def register(self, source: SourceConfig) -> None:
        if source.name in self.sources:
            raise ValueError(f"source {source.name} is registered already")
        self.sources[source.name] = source

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        return load(spark, self.sources[name])


def duplicate_columns(columns: list[str]) -> list[str]:
    seen: set[str] = set()
    return [c for c in columns if c.lower() in seen or seen.add(c.lower())]


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """target with the rows of source merged in by keys: matched rows take source's values of the columns in update (all
    if None), others are inserted. One shuffle of either side."""
    update = [c for c in target.columns if c not in keys] if update is None else update
    t, s = target.alias("t"), source.withColumn("_in", F.lit(True)).alias("s")
    on = functools.reduce(lambda a, b: a & b, (F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys))
    both = t.withColumn("_out", F.lit(True)).alias("t").join(s, on, "full_outer")

    def value(c: str):
        if c in keys:
            return F.when(F.col("_out"), F.col(f"t.{c}")).otherwise(F.col(f"s.{c}"))
        new = F.col(f"s.{c}") if c in source.columns else F.lit(None)
        if c in update and c in source.columns:
            return F.when(F.col("_in"), new).otherwise(F.col(f"t.{c}"))
        return F.when(F.col("_out"), F.col(f"t.{c}")).otherwise(new)

    return both.select(*[value(c).alias(c) for c in target.columns])


def append_keep_last(target: DataFrame, source: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Union of both, of which each key's row with the largest order stays (source's of equal ones)."""
    from ..operators.cleaning import keep_last

    both = target.withColumn("_new", F.lit(0)).unionByName(source.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, [order, "_new"]).drop("_new")


CONTEXTS = {
    "exploration": {"raw", "snapshot", "feature"},
    "training": {"snapshot", "feature"},
    "inference": {"feature", "snapshot"},
    "backfill": {"raw", "snapshot", "feature"},
    "admin": {"raw", "snapshot", "feature", "label"},
}


class AccessDenied(PermissionError):
    pass


def guarded(context: str, kind: str) -> None:
    if context not in CONTEXTS:
        raise ValueError(f"context {context} is none of {sorted(CONTEXTS)}")
    if kind not in CONTEXTS[context]:
        raise AccessDenied(f"{kind} data may not be read in context {context}")


def requires(*contexts: str):
    """Decorator of functions that take context=..., which must be one of contexts."""

    def deco(f):
        @functools.wraps(f)
        def inner(*args, context: str, **kw):
            if context not in contexts:
                raise AccessDenied(f"{f.__name__} may run in {contexts} only")
            return f(*args, **kw)

        return inner

    return deco

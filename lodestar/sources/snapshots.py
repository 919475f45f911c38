"""Versioned, hash-checked training snapshots as Parquet folders."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..time import as_time

FEATURE_TIME, LABEL_TIME, AVAILABLE = "feature_timestamp", "label_timestamp", "label_available_flag"


def content_hash(df: DataFrame) -> str:
    """Of the rows in whatever order, over name-sorted columns."""
    h = F.xxhash64(*[F.col(c).cast("string") for c in sorted(df.columns)])
    row = df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum((h % 1_000_000_007).cast("decimal(38,0)")).alias("s")).first()
    return f"{row.n}-{(row.x or 0) & (1 << 64) - 1:016x}-{row.s or 0}"


def eligible(df: DataFrame, cutoff: str | datetime) -> DataFrame:
    """Rows with an available label and features from no later than the cutoff."""
    missing = {FEATURE_TIME, LABEL_TIME, AVAILABLE} - set(df.columns)
    if missing:
        raise ValueError(f"columns {sorted(missing)} are missing")
    return df.where(F.col(AVAILABLE) & (F.col(FEATURE_TIME) <= as_time(cutoff)))


@dataclass
class Snapshot:
    name: str
    version: int
    path: str
    cutoff: str
    rows: int
    columns: list[str]
    hash: str


class Snapshots:
    """Snapshots under a folder that driver and executors share; metadata is a one-row JSON table beside each."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self, name: str) -> list[int]:
        fs, p = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v"))

    def create(self, df: DataFrame, name: str, cutoff: str) -> Snapshot:
        kept = eligible(df, cutoff)
        version = max(self.versions(name), default=0) + 1
        path = f"{self.root}/{name}/v{version}"
        kept.write.parquet(f"{path}/data")
        stored = self.spark.read.parquet(f"{path}/data")
        meta = Snapshot(name, version, path, str(cutoff), stored.count(), stored.columns, content_hash(stored))
        self.spark.createDataFrame([(json.dumps(asdict(meta)),)], "value string").coalesce(1).write.text(f"{path}/meta")
        return meta

    def meta(self, name: str, version: int | None = None) -> Snapshot:
        version = version or max(self.versions(name))
        return Snapshot(**json.loads(self.spark.read.text(f"{self.root}/{name}/v{version}/meta").first()[0]))

    def load(self, name: str, version: int | None = None) -> DataFrame:
        meta = self.meta(name, version)
        df = self.spark.read.parquet(f"{meta.path}/data")
        if content_hash(df) != meta.hash:
            raise ValueError(f"snapshot {name} v{meta.version} is not what was written")
        return df

    def compare(self, name: str, a: int, b: int) -> dict:
        x, y = self.meta(name, a), self.meta(name, b)
        return {"rows": y.rows - x.rows, "added": sorted(set(y.columns) - set(x.columns)), "removed": sorted(set(x.columns) - set(y.columns)), "same": x.hash == y.hash}


def snapshot_or(store: Snapshots, name: str, otherwise: DataFrame) -> tuple[DataFrame, bool]:
    """The newest snapshot of that name, and True; else the given table, and False."""
    return (store.load(name), True) if store.versions(name) else (otherwise, False)


def prune(store: Snapshots, name: str, keep: int = 5) -> list[int]:
    """Deletes all but the newest versions; returns those that are gone."""
    gone = store.versions(name)[:-keep]
    for v in gone:
        fs, p = store._fs(f"{store.root}/{name}/v{v}")
        fs.delete(p, True)
    return gone

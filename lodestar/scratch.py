"""Tables written to the folder that driver and executors share, to cut lineage or to fix a partitioning."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


#: What this process has put into the shared folder, for `clean`.
_PUT: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where none is named and all runs on one machine (tests) one of our own, which
    goes with the process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="lodestar-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
    return named


def shared_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A path of its own in the shared folder. keep: `clean` leaves it, as executors may fetch it at any time."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not keep:
        _PUT.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor costs a reread."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop_path(spark: SparkSession, path: str):
    """The Hadoop file system of a path and the path itself."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def put_bytes(spark: SparkSession, path: str, data: bytes) -> str:
    """Writes a file where Spark can write, and returns its URI."""
    fs, p = hadoop_path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return fs.makeQualified(p).toString()


def clean(spark: SparkSession, since: int = 0) -> None:
    """Deletes what this process has put into the shared folder, from the since-th path on. Results that read it must have
    been written elsewhere."""
    for path in _PUT[since:]:
        fs, p = hadoop_path(spark, path)
        fs.delete(p, True)
    del _PUT[since:]


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What is put into the shared folder inside goes at the end."""
    since = len(_PUT)
    try:
        yield
    finally:
        clean(spark, since)

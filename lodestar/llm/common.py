"""What the corpus operators share: the shared folder, written tables, text constants."""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..scratch import put_bytes, shared_path, written  # noqa: F401  used by the operators

#: Fixed value: words of the benchmark and licence contracts, on texts whose A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed value: its complement, for splitting.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text whose letters are as they were.
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a key beyond which it is split over several tasks.
HOT_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extended(schema: StructType, more: str) -> StructType:
    """schema with further fields, given as DDL; all may be null."""
    return StructType([StructField(f.name, f.dataType) for f in [*schema.fields, *StructType.fromDDL(more).fields]])


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def about(want: int, of: int, *key: str) -> Column:
    """Whether a row is among about `want` of `of` rows by the hash of a key: a cut that every task makes for itself, after
    which the smallest hashes can be ranked in one place."""
    u = F.pmod(F.xxhash64(*key), F.lit(1 << 40)) / float(1 << 40)
    return F.lit(True) if of <= want else u < want / of


def ascii_lower(c: Column) -> Column:
    """A-Z only; every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words of a text whose letters are lower-cased already; a null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), NOT_WORD)
    return F.filter(parts, lambda w: w != "")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands this package to the executors, once for each application: their Python workers import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    spark.sparkContext.addPyFile(put_bytes(spark, shared_path(spark, "lodestar", keep=True) + ".zip", data.getvalue()))
    _SHIPPED.add(app)


def short(df: DataFrame, rows: int) -> bool:
    """Whether df, a written table, has at most so many rows."""
    return df.limit(rows + 1).count() <= rows


def keyed_join(many: DataFrame, one: DataFrame, on: list[str], rows: int, how: str = "inner", n: str = "n", hot_rows: int | None = None) -> DataFrame:
    """many with the row of `one` that has its key. one: a written table with a row for each key (no null among them), and
    in column n, which goes, how many rows of many have it, about. Up to `rows` rows it is broadcast. Beyond, both sides are
    shuffled, and a key of over hot_rows rows is dealt over as many tasks as these make; the list of such keys, which is
    broadcast, is hot_rows times shorter than many."""
    if rows and short(one, rows):
        return many.join(F.broadcast(one.drop(n)), on, how)
    hot_rows = hot_rows or HOT_ROWS
    parts = F.ceil(F.col(n) / hot_rows).cast("int")
    hot = one.where(F.col(n) > hot_rows).select(*on, parts.alias("_parts"))
    dealt = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(*many.columns), F.col("_parts")).cast("int")).otherwise(F.lit(0))
    left = many.join(F.broadcast(hot), on, "left").withColumn("_part", dealt).drop("_parts")
    right = one.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop(n)
    return left.join(right, [*on, "_part"], how).drop("_part")

"""Partial dependence, nearest rows, counterfactual search: over any scoring function of a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[DataFrame], DataFrame]


def partial_dependence(df: DataFrame, column: str, grid: Sequence[float], score: Scorer, by: str = "score") -> DataFrame:
    """Mean score with the column set to each value of the grid in turn."""
    points = df.sparkSession.createDataFrame([(float(g),) for g in grid], "grid double")
    spread = df.drop(column).join(F.broadcast(points), F.lit(True)).withColumn(column, F.col("grid"))  # the grid's length
    return score(spread).groupBy("grid").agg(F.avg(by).alias("mean_score"))


def nearest(df: DataFrame, key: str, columns: Sequence[str], of, k: int = 5) -> DataFrame:
    """The k rows nearest to one row by scaled distance: a report of that many rows."""
    sd = df.agg(*[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    own = df.where(F.col(key) == F.lit(of)).select(*[F.col(c).alias(f"_o_{c}") for c in columns]).limit(1)
    d = df.where(F.col(key) != F.lit(of)).join(F.broadcast(sd)).join(F.broadcast(own))  # one row each
    square = sum((F.coalesce(F.pow(F.try_divide(F.col(c) - F.col(f"_o_{c}"), F.col(f"_s_{c}")), F.lit(2.0)), F.lit(0.0)) for c in columns), F.lit(0.0))
    return d.select(key, F.sqrt(square).alias("distance")).orderBy("distance", key).limit(k)


def counterfactual(df: DataFrame, key: str, changes: dict[str, Sequence[float]], score: Scorer, threshold: float = 0.5, by: str = "score") -> DataFrame:
    """Per row the first single change, in the given order, that brings its score under the threshold."""
    options = [(n, c, float(v)) for n, (c, v) in enumerate((c, v) for c, vs in changes.items() for v in vs)]
    table = df.sparkSession.createDataFrame(options, "_n int, _column string, _value double")
    d = df.join(F.broadcast(table), F.lit(True))  # a list of options
    d = d.withColumns({c: F.when(F.col("_column") == c, F.col("_value")).otherwise(F.col(c)) for c in changes})
    hit = score(d).where(F.col(by) < threshold)
    best = F.min(F.struct("_n", F.col("_column").alias("column"), F.col("_value").alias("value"), F.col(by).alias("new_score")))
    return hit.groupBy(key).agg(best.alias("b")).select(key, "b.column", "b.value", "b.new_score")

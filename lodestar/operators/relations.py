"""How features relate to a target and to each other, and what that suggests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import with_quantiles
from ..functions.stats import correlations


def numeric_effects(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Per column: means of the classes 0 and 1, Cohen's d (1 minus 0, pooled sample deviation), correlation with the target;
    one aggregation."""
    y = F.col(target)

    def side(c: str, k: int):
        return F.when(y == k, F.col(c).cast("double"))

    def effect(c: str):
        a, b = side(c, 0), side(c, 1)
        na, nb = F.count(a), F.count(b)
        sd = F.sqrt(F.try_divide((na - 1) * F.var_samp(a) + (nb - 1) * F.var_samp(b), (na + nb - 2).cast("double")))
        return F.struct(F.avg(a).alias("mean_0"), F.avg(b).alias("mean_1"), F.try_divide(F.avg(b) - F.avg(a), sd).alias("cohens_d"), F.corr(c, target).alias("correlation")).alias(c)

    row = df.agg(*[effect(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])).alias("r")).select("r.column", "r.s.*")


def recommendations(df: DataFrame, columns: Sequence[str], target: str, strong: float = 0.5, weak: float = 0.1, twin: float = 0.7) -> DataFrame:
    """(kind, subject, value): strong and weak predictors by |d|, and pairs of columns that say nearly the same."""
    e = numeric_effects(df, columns, target)
    d = F.abs("cohens_d")
    kind = F.when(d >= strong, "strong_predictor").when(d < weak, "weak_predictor")
    single = e.select(kind.alias("kind"), F.col("column").alias("subject"), F.col("cohens_d").alias("value")).where("kind is not null")
    if len(columns) < 2:
        return single
    pairs = correlations(df, columns).where(F.abs("correlation") >= twin)
    return single.unionByName(pairs.select(F.lit("multicollinear").alias("kind"), F.concat("x", F.lit(" ~ "), "y").alias("subject"), F.col("correlation").alias("value")))


def group_statistics(df: DataFrame, group: str, value: str) -> DataFrame:
    each = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return with_quantiles(each, df, group, {"q25": (value, 0.25), "median": (value, 0.5), "q75": (value, 0.75)})

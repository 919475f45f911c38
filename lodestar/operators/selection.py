"""Feature selection and capacity from one correlation aggregation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import correlations


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, variance, cv) in one pass."""
    row = df.agg(*[F.struct(F.var_samp(c).alias("variance"), F.try_divide(F.stddev_samp(c), F.abs(F.avg(c))).alias("cv")).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])).alias("r")).select("r.column", "r.s.*")


def select(df: DataFrame, columns: Sequence[str], least_variance: float = 0.01, most_correlation: float = 0.95, most: int | None = None) -> dict[str, list[str]]:
    """Kept and dropped columns: too little variance; of a pair with too high a correlation the one of lower variance;
    beyond `most` those of the lowest variance. Two aggregations; their rows, one for each column and pair, are judged on
    the driver."""
    variance = {r.column: r.variance or 0.0 for r in moments(df, columns).collect()}
    kept = [c for c in columns if variance[c] >= least_variance]
    low = [c for c in columns if c not in kept]
    twin: list[str] = []
    if len(kept) > 1:
        for r in correlations(df, kept).collect():
            if r.correlation is not None and abs(r.correlation) > most_correlation and r.x not in twin and r.y not in twin:
                twin.append(r.x if variance[r.x] < variance[r.y] else r.y)
    kept = [c for c in kept if c not in twin]
    rest = sorted(kept, key=lambda c: (-variance[c], c))[most:] if most is not None else []
    return {"kept": [c for c in kept if c not in rest], "low_variance": low, "correlated": twin, "over_limit": rest}


def multicollinear(df: DataFrame, columns: Sequence[str], least: float = 0.7) -> DataFrame:
    return correlations(df, columns).where(F.abs("correlation") >= least)


def effective_features(df: DataFrame, columns: Sequence[str], share: float = 0.95) -> int:
    """Eigenvalues of the correlation matrix that it takes to reach the share of its trace."""
    at = {c: i for i, c in enumerate(columns)}
    m = np.eye(len(columns))
    for r in correlations(df, columns).collect():
        m[at[r.x], at[r.y]] = m[at[r.y], at[r.x]] = r.correlation or 0.0
    values = np.sort(np.linalg.eigvalsh(m))[::-1]
    return int(np.searchsorted(np.cumsum(values) / values.sum(), share - 1e-12) + 1)


def capacity(df: DataFrame, target: str, segment: str | None = None, per_feature: int = 10) -> DataFrame:
    """Features that the rarer class supports, at so many events for each."""
    by = [segment] if segment else []
    each = df.where(F.col(target).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.sum((F.col(target) == 1).cast("bigint")).alias("ones"))
    events = F.least(F.col("ones"), F.col("n") - F.col("ones"))
    return each.select(*by, "n", events.alias("minority"), F.floor(events / per_feature).alias("features"))


def availability_actions(shares: dict[str, float], least: float = 0.95, few: float = 0.30) -> dict[str, list[str]]:
    """What can be done about columns that are only partly there."""
    out = {}
    for c, s in shares.items():
        if s < least:
            out[c] = ["remove", "indicator", "filter_window", *(["segment", "impute"] if s >= few else [])]
    return out

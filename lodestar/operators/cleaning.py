"""Missing values, outliers and duplicates. Fitted values come from one aggregation each and are plain parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import along, quantile_row, quantiles, quantiles_by

MAD_SCALE = 1.4826


def fit_fill(df: DataFrame, strategies: dict[str, str], constants: dict | None = None) -> dict:
    """Per column the value that fills it: mean, median, mode (the smallest of equally frequent ones) or constant."""
    out = {c: (constants or {})[c] for c, s in strategies.items() if s == "constant"}
    means, medians, modes = ([c for c, s in strategies.items() if s == kind] for kind in ("mean", "median", "mode"))
    if means:
        out |= df.agg(*[F.avg(c).alias(c) for c in means]).first().asDict()
    if medians:
        out |= {c: q and q[0] for c, q in quantiles(df, medians, [0.5]).items()}
    for c in modes:
        top = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).first()
        out[c] = top and top[0]
    if empty := sorted(c for c, v in out.items() if v is None):
        raise ValueError(f"columns {empty} have no value to fill with")
    return out


def fill(df: DataFrame, values: dict, indicator: bool = False) -> DataFrame:
    if indicator:
        df = df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in values})
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def fill_along(df: DataFrame, column: str, order: Sequence[str], partition: Sequence[str] = (), method: str = "ffill") -> DataFrame:
    """ffill, bfill, or linear interpolation between the neighbours by row number (after the last value: that value). Without
    a partition rows are dealt by ranges of the order, so that no task sees all of them."""
    if method not in ("ffill", "bfill", "linear"):
        raise ValueError(f"method {method} is none of ffill, bfill, linear")
    c = F.col(column)
    if partition:
        by = Window.partitionBy(*partition).orderBy(*order)
        back, fore = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
        d = df.withColumn("_n", F.row_number().over(by))
        n = F.when(c.isNotNull(), F.col("_n"))
        d = d.withColumns({"_b": F.last(c, True).over(back), "_a": F.first(c, True).over(fore), "_nb": F.last(n, True).over(back), "_na": F.first(n, True).over(fore)})
    else:
        d = along(df, column, order)
    line = F.col("_b") + (F.col("_a") - F.col("_b")) * (F.col("_n") - F.col("_nb")) / (F.col("_na") - F.col("_nb"))
    made = {"ffill": F.col("_b"), "bfill": F.col("_a"), "linear": F.when(c.isNotNull(), c).when(F.col("_a").isNull(), F.col("_b")).otherwise(line)}[method]
    return d.withColumn(column, made).drop("_n", "_b", "_a", "_nb", "_na")


def outlier_bounds(df: DataFrame, columns: Sequence[str], method: str = "iqr", factor: float | None = None) -> dict[str, tuple[float, float]]:
    """Bounds by iqr (1.5), zscore (3, sample deviation), modified_zscore (3.5 times the scaled median deviation) or
    percentile (1 and 99)."""
    c = [F.col(x).cast("double").alias(x) for x in columns]
    d = df.select(*c)
    if method == "iqr":
        k = 1.5 if factor is None else factor
        row = quantiles(d, columns, [0.25, 0.75])
        return {x: (row[x][0] - k * (row[x][1] - row[x][0]), row[x][1] + k * (row[x][1] - row[x][0])) for x in columns if row[x]}
    if method == "zscore":
        k = 3.0 if factor is None else factor
        row = d.agg(*[F.struct(F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).alias(x) for x in columns]).first()
        return {x: (row[x].m - k * (row[x].s or 0), row[x].m + k * (row[x].s or 0)) for x in columns if row[x].m is not None}
    if method == "modified_zscore":
        k = 3.5 if factor is None else factor
        mid = {x: q[0] for x, q in quantiles(d, columns, [0.5]).items() if q}
        mad = {x: q[0] for x, q in quantiles(d.select(*[F.abs(F.col(x) - F.lit(m)).alias(x) for x, m in mid.items()]), list(mid), [0.5]).items()} if mid else {}
        return {x: (m - k * MAD_SCALE * mad[x], m + k * MAD_SCALE * mad[x]) for x, m in mid.items()}
    if method == "percentile":
        p = 0.01 if factor is None else factor
        row = quantiles(d, columns, [p, 1 - p])
        return {x: tuple(row[x]) for x in columns if row[x]}
    raise ValueError(f"method {method} is not known")


def treat_outliers(df: DataFrame, bounds: dict[str, tuple[float, float]], treatment: str = "cap") -> DataFrame:
    """cap (also called clip or winsorize), drop, indicator, log or sqrt (signed), none. Nulls are never outliers."""
    inside = {c: F.col(c).isNull() | F.col(c).between(lo, hi) for c, (lo, hi) in bounds.items()}
    if treatment in ("cap", "clip", "winsorize"):
        return df.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(c).cast("double")))) for c, (lo, hi) in bounds.items()})
    if treatment == "drop":
        for ok in inside.values():
            df = df.where(ok)
        return df
    if treatment == "indicator":
        return df.withColumns({f"{c}_outlier": (~ok).cast("int") for c, ok in inside.items()})
    if treatment == "log":
        return df.withColumns({c: F.signum(c) * F.log1p(F.abs(F.col(c))) for c in bounds})
    if treatment == "sqrt":
        return df.withColumns({c: F.signum(c) * F.sqrt(F.abs(F.col(c))) for c in bounds})
    if treatment == "none":
        return df
    raise ValueError(f"treatment {treatment} is not known")


def _fences(q: Column, k: float = 1.5) -> list[Column]:
    return [(q[0] - k * (q[1] - q[0])), (q[1] + k * (q[1] - q[0]))]


def segment_outliers(df: DataFrame, column: str, segment: str) -> DataFrame:
    """Per segment: rows, outliers by all rows' fences, by the segment's own, and those that only the former sees."""
    lo, hi = _fences(F.col(column))
    whole = quantile_row(df, [column], [0.25, 0.75]).select(lo.alias("_lo"), hi.alias("_hi"))
    lo, hi = _fences(F.col("values"))
    own = quantiles_by(df, segment, column, [0.25, 0.75]).select(F.col("key").alias(segment), lo.alias("_slo"), hi.alias("_shi"))
    d = df.select(segment, column).join(F.broadcast(whole)).join(own, segment)  # one row; a row for each segment
    out, own_out = ~F.col(column).between(F.col("_lo"), F.col("_hi")), ~F.col(column).between(F.col("_slo"), F.col("_shi"))
    return d.groupBy(segment).agg(F.count("*").alias("rows"), F.count(F.when(out, 1)).alias("global_outliers"), F.count(F.when(own_out, 1)).alias("segment_outliers"), F.count(F.when(out & ~own_out, 1)).alias("false_outliers"))


def _keep(df: DataFrame, keys: Sequence[str], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each key's rows the first in order. Only the first of each partition is shuffled."""
    return _keep(df, keys, [F.col(c).asc() for c in order])


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _keep(df, keys, [F.col(c).desc() for c in order])


def drop_exact(df: DataFrame) -> DataFrame:
    return df.distinct()


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with several rows, how many, and in how many columns these differ."""
    others = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.count("*").alias("rows"), *[F.count_distinct(c).alias(f"_{c}") for c in others]).where("rows > 1")
    conflicts = sum(((F.col(f"_{c}") > 1).cast("int") for c in others), F.lit(0))
    return out.select(*keys, "rows", conflicts.alias("conflicting_columns"))

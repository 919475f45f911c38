"""Drift, association, effect sizes and calibration as aggregations."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import quantiles, running


def skewness(c: Column) -> Column:
    """Bias-corrected."""
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt((n * (n - 1)).cast("double")) / (n - 2))


def kurtosis(c: Column) -> Column:
    """Bias-corrected excess."""
    n = F.count(c).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def bin_of(x: Column, edges: Sequence[float]) -> Column:
    """Number of the bin from 0: bins hold their lower edge, the last one its upper edge too; outside null."""
    n = len(edges) - 1
    out = F.lit(None).cast("int")
    for i in range(n - 1, -1, -1):
        upper = x <= edges[i + 1] if i == n - 1 else x < edges[i + 1]
        out = F.when((x >= edges[i]) & upper, i).otherwise(out)
    return out


def cut(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins, of which the first holds its lower edge; outside null."""
    out = F.lit(None).cast("string")
    for i in range(len(labels) - 1, -1, -1):
        low = x >= edges[i] if i == 0 else x > edges[i]
        out = F.when(low & (x <= edges[i + 1]), labels[i]).otherwise(out)
    return out


def even_edges(a: DataFrame, b: DataFrame, column: str, bins: int = 10) -> list[float]:
    """Equal bins over both sides' range."""
    row = a.select(F.col(column).cast("double").alias("x")).unionByName(b.select(F.col(column).cast("double").alias("x"))).agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    return [row.lo + (row.hi - row.lo) * i / bins for i in range(bins)] + [row.hi]


def _shares(a: DataFrame, b: DataFrame, key_a: Column, key_b: Column) -> DataFrame:
    """Per bin the counts of either side and their totals, one row each."""
    both = a.select(key_a.alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(key_b.alias("k"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    each = both.where("k is not null").groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return each.join(F.broadcast(each.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))))  # one row


def psi_numeric(base: DataFrame, current: DataFrame, column: str, edges: Sequence[float], floor: float = 1e-4) -> DataFrame:
    """Population stability index over given bins; shares are at least floor."""
    x = bin_of(F.col(column).cast("double"), edges)
    spine = base.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("k"))
    s = spine.join(_shares(base, current, x, x), "k", "left")
    share = lambda n, t: F.greatest(F.coalesce(F.col(n) / F.col(t), F.lit(0.0)), F.lit(floor))
    p, q = share("a", "na"), share("b", "nb")
    return s.agg(F.sum((q - p) * F.log(q / p)).alias("psi"))


def psi_even(base: DataFrame, current: DataFrame, column: str, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """Over equal bins of the joint range, with eps added to the shares."""
    edges = even_edges(base, current, column, bins)
    x = bin_of(F.col(column).cast("double"), edges)
    spine = base.sparkSession.range(bins).select(F.col("id").cast("int").alias("k"))
    s = spine.join(_shares(base, current, x, x), "k", "left")
    p, q = (F.coalesce(F.col(n) / F.col(t), F.lit(0.0)) + eps for n, t in (("a", "na"), ("b", "nb")))
    return s.agg(F.sum((q - p) * F.log(q / p)).alias("psi"))


def psi_categorical(base: DataFrame, current: DataFrame, column: str, floor: float = 1e-4) -> DataFrame:
    s = _shares(base, current, F.col(column).cast("string"), F.col(column).cast("string"))
    p, q = F.greatest(F.col("a") / F.col("na"), F.lit(floor)), F.greatest(F.col("b") / F.col("nb"), F.lit(floor))
    return s.agg(F.sum((q - p) * F.log(q / p)).alias("psi"))


def ks(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and the sizes. Values are counted first; running counts are summed within
    ranges of values and then over ranges, so no task reads all values in order."""
    both = a.select(F.col(column).cast("double").alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(F.col(column).cast("double").alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    each = both.where("x is not null").groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ran = running(each, "x", ["a", "b"])
    total = each.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    d = ran.join(F.broadcast(total)).agg(F.max(F.abs(F.col("a_running") / F.col("na") - F.col("b_running") / F.col("nb"))).alias("ks"), F.first("na").alias("n_a"), F.first("nb").alias("n_b"))  # one row
    return d


def ks_p_value(d: float, n: int, m: int) -> float:
    """Asymptotic."""
    e = math.sqrt(n * m / (n + m))
    lam = (e + 0.12 + 0.11 / e) * d
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))))


def cohens_d(df: DataFrame, value: str, group: str, a, b, pooled: bool = False) -> DataFrame:
    """a minus b over the root of the mean of population variances; or, pooled, b minus a over the pooled sample
    deviation."""
    va, vb = (F.when(F.col(group) == g, F.col(value).cast("double")) for g in (a, b))
    na, nb = F.count(va), F.count(vb)
    if pooled:
        sd = F.sqrt(F.try_divide((na - 1) * F.var_samp(va) + (nb - 1) * F.var_samp(vb), (na + nb - 2).cast("double")))
        d = F.try_divide(F.avg(vb) - F.avg(va), sd)
    else:
        d = F.try_divide(F.avg(va) - F.avg(vb), F.sqrt((F.var_pop(va) + F.var_pop(vb)) / 2))
    return df.agg(d.alias("cohens_d"))


def cramers_v(df: DataFrame, x: str, y: str) -> DataFrame:
    """With Yates' correction for two by two tables. Margins come from the counted table."""
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").cast("double").alias("n"))
    rows, cols = cells.groupBy("x").agg(F.sum("n").alias("nx")), cells.groupBy("y").agg(F.sum("n").alias("ny"))
    size = cells.agg(F.sum("n").alias("t"), F.count_distinct("x").alias("r"), F.count_distinct("y").alias("c"))
    grid = rows.crossJoin(cols).join(cells, ["x", "y"], "left").join(F.broadcast(size))  # cells of the margins, not of the input
    e = F.col("nx") * F.col("ny") / F.col("t")
    diff = F.abs(F.coalesce("n", F.lit(0.0)) - e)
    diff = F.when((F.col("r") == 2) & (F.col("c") == 2), diff - F.least(F.lit(0.5), diff)).otherwise(diff)
    s = grid.agg(F.sum(diff * diff / e).alias("chi2"), F.first("t").alias("t"), F.first("r").alias("r"), F.first("c").alias("c"))
    return s.select("chi2", F.sqrt(F.try_divide(F.col("chi2"), F.col("t") * (F.least("r", "c") - 1))).alias("cramers_v"), ((F.col("r") - 1) * (F.col("c") - 1)).alias("dof"))


def chi_square_proportions(df: DataFrame, column: str, expected: dict[str, float]) -> DataFrame:
    """Against baseline shares of values."""
    want = df.sparkSession.createDataFrame(list(expected.items()), "k string, p double")
    seen = df.groupBy(F.col(column).cast("string").alias("k")).agg(F.count("*").alias("n"))
    total = seen.join(F.broadcast(want), "k").agg(F.sum("n").alias("t"))
    d = want.join(seen, "k", "left").join(F.broadcast(total))
    e = F.col("p") * F.col("t")
    return d.agg(F.sum(F.pow(F.coalesce("n", F.lit(0)) - e, F.lit(2.0)) / e).alias("chi2"), (F.count("*") - 1).alias("dof"))


def quantile_edges(df: DataFrame, column: str, bins: int = 10) -> list[float]:
    return sorted(set(quantiles(df, [column], [i / bins for i in range(bins + 1)])[column] or []))


def information_value(df: DataFrame, column: str, target: str, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """Over quantile bins without double edges; shares of 0 count as floor."""
    edges = quantile_edges(df, column, bins)
    at = F.lit(0)
    for i, e in enumerate(edges[1:-1], 1):
        at = F.when(F.col(column) > e, i).otherwise(at)
    each = df.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.sum((F.col(target) == 1).cast("int")).alias("a"), F.sum((F.col(target) == 0).cast("int")).alias("b"))
    d = each.join(F.broadcast(each.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))))  # one row
    p, q = (F.when(F.col(n) == 0, floor).otherwise(F.col(n) / F.col(t)) for n, t in (("a", "na"), ("b", "nb")))
    return d.agg(F.sum((p - q) * F.log(p / q)).alias("information_value"), F.count("*").alias("bins"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x, y, correlation) of all pairs, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"c{n}") for n, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{n}").alias("correlation")) for n, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")


def drift_summary(base: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: mean shift in base deviations, ratio of variances, change of the missing share."""

    def side(df: DataFrame, p: str) -> DataFrame:
        row = df.agg(*[F.struct(F.avg(c).alias(f"{p}mean"), F.stddev_samp(c).alias(f"{p}sd"), (1 - F.count(c) / F.count("*")).alias(f"{p}missing")).alias(c) for c in columns])
        return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])).alias("r")).select("r.column", "r.s.*")

    d = side(base, "a_").join(side(current, "b_"), "column")
    return d.select("column", F.try_divide(F.col("b_mean") - F.col("a_mean"), F.col("a_sd")).alias("mean_shift"), F.try_divide(F.pow("b_sd", F.lit(2.0)), F.pow("a_sd", F.lit(2.0))).alias("variance_ratio"), (F.col("b_missing") - F.col("a_missing")).alias("missing_change"))


def sample_size(baseline: float, lift: float, alpha: float = 0.05, power: float = 0.8) -> int:
    """Rows of each arm for a two-sided test of proportions."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf
    p2 = baseline * (1 + lift)
    mean = (baseline + p2) / 2
    top = z(1 - alpha / 2) * math.sqrt(2 * mean * (1 - mean)) + z(power) * math.sqrt(baseline * (1 - baseline) + p2 * (1 - p2))
    return math.ceil(top * top / (p2 - baseline) ** 2)

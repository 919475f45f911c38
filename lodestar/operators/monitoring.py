"""Drift against a stored baseline, alerts, champion and challenger, gates of models, budgets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import bin_of, quantile_edges

#: Warning and critical thresholds.
LIMITS = {"psi": (0.10, 0.20), "ks": (0.05, 0.10), "mean_shift": (0.5, 1.0)}


@dataclass(frozen=True)
class Baseline:
    """What is kept of a column: edges and shares of its quantile bins, moments, share of missing values."""

    column: str
    edges: list[float]
    shares: list[float]
    mean: float
    sd: float
    missing: float


def fit_baseline(df: DataFrame, column: str, bins: int = 10) -> Baseline:
    edges = quantile_edges(df, column, bins)
    if len(edges) < 2:
        edges = [(edges or [0.0])[0], (edges or [0.0])[0] + 1.0]
    open_ = [float("-inf"), *edges[1:-1], float("inf")]
    row = df.agg(F.avg(column).alias("m"), F.stddev_samp(column).alias("s"), (1 - F.try_divide(F.count(column).cast("double"), F.count("*").cast("double"))).alias("missing")).first()
    n = {r.b: r["n"] for r in df.where(F.col(column).isNotNull()).groupBy(bin_of(F.col(column).cast("double"), open_).alias("b")).agg(F.count("*").alias("n")).collect()}
    total = sum(n.values()) or 1
    return Baseline(column, open_, [n.get(i, 0) / total for i in range(len(open_) - 1)], row.m or 0.0, row.s or 0.0, row.missing or 0.0)


def drift(df: DataFrame, baselines: Sequence[Baseline], floor: float = 1e-4) -> DataFrame:
    """(column, psi, ks, mean_shift, variance_ratio, missing_change, severity) in one pass over df. ks is that of the
    binned distributions."""
    aggs = []
    for i, b in enumerate(baselines):
        at = bin_of(F.col(b.column).cast("double"), b.edges)
        counts = [F.count(F.when(at == k, 1)) for k in range(len(b.shares))]
        aggs.append(F.struct(F.array(*counts).alias("n"), F.avg(b.column).alias("m"), F.var_samp(b.column).alias("v"), (1 - F.try_divide(F.count(b.column).cast("double"), F.count("*").cast("double"))).alias("missing")).alias(f"c{i}"))
    row = df.agg(*aggs)
    out = []
    for i, b in enumerate(baselines):
        total = F.aggregate(f"c{i}.n", F.lit(0).cast("bigint"), lambda a, x: a + x)
        q = [F.coalesce(F.try_divide(F.col(f"c{i}.n")[k].cast("double"), total.cast("double")), F.lit(0.0)) for k in range(len(b.shares))]
        up = [(max(p, floor), F.greatest(x, F.lit(floor))) for p, x in zip(b.shares, q, strict=True)]
        psi = sum(((x - F.lit(p)) * F.log(x / F.lit(p)) for p, x in up), F.lit(0.0))
        gaps = [F.abs(sum(q[: k + 1], F.lit(0.0)) - F.lit(sum(b.shares[: k + 1]))) for k in range(len(q))]
        shift = F.try_divide(F.abs(F.col(f"c{i}.m") - b.mean), F.lit(b.sd))
        out.append(F.struct(F.lit(b.column).alias("column"), psi.alias("psi"), F.array_max(F.array(*gaps)).alias("ks"), shift.alias("mean_shift"), F.try_divide(F.col(f"c{i}.v"), F.lit(b.sd * b.sd)).alias("variance_ratio"), (F.col(f"c{i}.missing") - b.missing).alias("missing_change")))
    d = row.select(F.explode(F.array(*out)).alias("r")).select("r.*")
    over = lambda j: F.greatest(*[F.coalesce((F.col(n) >= l[j]).cast("int"), F.lit(0)) for n, l in LIMITS.items()]) == 1
    return d.withColumn("severity", F.when(over(1), "critical").when(over(0), "warning").otherwise("none"))


#: Alert ids, metric, comparison and severity.
ALERTS = (
    ("AL001", "roc_auc", "<", 0.70, "critical"), ("AL002", "roc_auc_drop", ">", 0.05, "warning"), ("AL003", "psi", ">=", 0.20, "critical"), ("AL004", "psi", ">=", 0.10, "warning"), ("AL005", "missing_change", ">", 0.10, "warning"),
    ("AL006", "volume_change", ">", 0.50, "warning"), ("AL007", "target_shift", ">", 0.10, "critical"), ("AL008", "latency_ms", ">", 200.0, "warning"), ("AL009", "model_age_days", ">", 90.0, "info"),
)


def alerts(metrics: DataFrame, suppressed: Sequence[str] = ()) -> DataFrame:
    """metrics: (subject, metric, value). One row for each rule that a value breaks, of each subject the gravest rule of a
    metric only."""
    rules = metrics.sparkSession.createDataFrame([r for r in ALERTS if r[0] not in suppressed], "alert_id string, metric string, op string, bound double, severity string")
    v, b = F.col("value"), F.col("bound")
    broken = F.when(F.col("op") == "<", v < b).when(F.col("op") == ">=", v >= b).otherwise(v > b)
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    hit = metrics.join(F.broadcast(rules), "metric").where(broken)  # nine rules
    best = F.min(F.struct(rank.alias("r"), "alert_id", "severity", "value", "bound"))
    return hit.groupBy("subject", "metric").agg(best.alias("b")).select("subject", "metric", "b.alert_id", "b.severity", "b.value", "b.bound")


def champion(current: dict[str, float], challenger: dict[str, float], metric: str = "roc_auc", least_gain: float = 0.01, guards: dict[str, float] | None = None) -> str:
    """promote if the challenger gains enough and loses no guarded metric by more than its bound; else keep."""
    if challenger[metric] - current[metric] < least_gain:
        return "keep"
    return "keep" if any(current[m] - challenger[m] > bound for m, bound in (guards or {}).items()) else "promote"


def model_validity(metrics: dict[str, float]) -> list[tuple[str, str]]:
    """(check, severity) for scores that are too good, too bad, or too different between training and test."""
    auc, gap = metrics.get("test_auc", 0.5), metrics.get("train_auc", 0.5) - metrics.get("test_auc", 0.5)
    rules = [("MV001", "critical", auc > 0.95), ("MV002", "high", 0.90 < auc <= 0.95), ("MV003", "critical", auc < 0.55), ("MV004", "high", gap > 0.10), ("MV005", "medium", 0.05 < gap <= 0.10), ("MV006", "high", metrics.get("recall", 1.0) < 0.10), ("MV007", "medium", metrics.get("cv_std", 0.0) > 0.05), ("MV008", "high", metrics.get("top_importance", 0.0) > 0.50)]
    return [(check, severity) for check, severity, hit in rules if hit]


def budget(options: Sequence[tuple[str, float, float]], total: float) -> list[str]:
    """Names of (name, cost, value) options, taken greedily by value over cost while the budget lasts."""
    out, left = [], total
    for name, cost, _ in sorted(options, key=lambda o: (-(o[2] / o[1]) if o[1] else float("-inf"), o[0])):
        if cost <= left:
            out.append(name)
            left -= cost
    return out

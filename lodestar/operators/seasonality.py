"""Seasonal and volume patterns of event tables, and how windows and recency tell targets apart. Series have a row for each
period, so their ordered windows are as long as the calendar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import quantile_row, with_quantiles
from ..time import days_between


def weekly(events: DataFrame, time: str, least_cv: float = 0.15) -> DataFrame:
    """Coefficient of variation (sample) of the events by day of the week, and whether it is seasonal."""
    each = events.groupBy(F.weekday(F.col(time).cast("timestamp")).alias("day")).agg(F.count("*").alias("n"))
    cv = F.try_divide(F.stddev_samp("n"), F.avg("n"))
    return each.agg(cv.alias("cv"), (cv > least_cv).alias("seasonal"), F.max(F.struct("n", (-F.col("day")).alias("d")))["d"].alias("_d")).withColumn("peak_day", -F.col("_d")).drop("_d")


def year_by_month(events: DataFrame, time: str) -> DataFrame:
    t = F.col(time).cast("timestamp")
    d = events.select(F.year(t).alias("year"), F.month(t).alias("month"))
    return d.groupBy("year").pivot("month", list(range(1, 13))).agg(F.count(F.lit(1)))


def peak_months(events: DataFrame, time: str, k: int = 3) -> DataFrame:
    """The k months with the most events and the k with the fewest: a report of that many rows."""
    each = events.groupBy(F.month(F.col(time).cast("timestamp")).alias("month")).agg(F.count("*").alias("n"))
    top = each.orderBy(F.desc("n"), "month").limit(k).withColumn("kind", F.lit("peak"))
    return top.unionByName(each.orderBy("n", "month").limit(k).withColumn("kind", F.lit("trough")))


def volume_trend(periods: DataFrame, least: float = 0.25) -> DataFrame:
    """Mean of the later half of the periods over that of the earlier half: growing, declining or stable."""
    rank = F.row_number().over(Window.orderBy("period"))
    d = periods.withColumn("_r", rank).join(F.broadcast(periods.agg(F.count("*").alias("_k"))))  # one row
    late = F.col("_r") > F.floor(F.col("_k") / 2)
    out = d.agg(F.avg(F.when(~late, F.col("n"))).alias("earlier"), F.avg(F.when(late, F.col("n"))).alias("later"))
    change = F.try_divide(F.col("later") - F.col("earlier"), F.col("earlier"))
    return out.withColumns({"change": change, "trend": F.when(change > least, "growing").when(change < -least, "declining").otherwise("stable")})


def new_entities(events: DataFrame, entity: str, time: str, period: str = "month") -> DataFrame:
    first = events.groupBy(entity).agg(F.min(F.col(time).cast("timestamp")).alias("t"))
    return first.groupBy(F.date_trunc(period, "t").alias("period")).agg(F.count("*").alias("new_entities"))


def eta_squared(df: DataFrame, value: str, group: str) -> DataFrame:
    """Share of the value's variance between groups."""
    each = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count(value).alias("n"), F.sum(F.col(value).cast("double")).alias("s"), F.sum(F.pow(F.col(value).cast("double"), F.lit(2.0))).alias("q"))
    t = each.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    base = F.col("s") * F.col("s") / F.col("n")
    return t.select(F.try_divide(F.col("b") - base, F.col("q") - base).alias("eta_squared"))


def recency_by_target(events: DataFrame, entity: str, time: str, target: str, reference: Column, cap: float = 0.99) -> DataFrame:
    """Per class of entities: days since the last event (capped at that quantile of all): count, mean and median."""
    each = events.groupBy(entity).agg(days_between(reference, F.max(F.col(time).cast("timestamp"))).alias("_d"), F.max(target).alias(target))
    top = quantile_row(each, ["_d"], [cap]).select(F.col("_d")[0].alias("_c"))
    d = each.join(F.broadcast(top)).withColumn("_d", F.least(F.col("_d").cast("double"), F.col("_c")))  # one row
    groups = d.groupBy(target).agg(F.count("*").alias("n"), F.avg("_d").alias("mean_days"))
    return with_quantiles(groups, d, target, {"median_days": ("_d", 0.5)})


def daily_change(events: DataFrame, time: str, value: str, rows: int = 1) -> DataFrame:
    """Daily means with their change to `rows` observed days before (velocity) and the change of that (acceleration)."""
    w = Window.orderBy("day")
    d = events.groupBy(F.to_date(F.col(time).cast("timestamp")).alias("day")).agg(F.avg(value).alias("mean"))
    d = d.withColumn("velocity", F.col("mean") - F.lag("mean", rows).over(w))
    return d.withColumn("acceleration", F.col("velocity") - F.lag("velocity", rows).over(w))


def cohort_series(events: DataFrame, time: str, value: str, cohort: str, period: str = "month") -> DataFrame:
    """Per cohort and period the mean, and its change to the period before."""
    p = F.date_trunc(period, F.col(time).cast("timestamp"))
    d = events.groupBy(cohort, p.alias("period")).agg(F.avg(value).alias("mean"))
    return d.withColumn("velocity", F.col("mean") - F.lag("mean").over(Window.partitionBy(cohort).orderBy("period")))


def recommend_windows(lives: DataFrame, windows: Sequence[int], least_share: float = 0.1) -> DataFrame:
    """Windows of days that at least that share of entities with events can fill twice over: lives has duration_days."""
    row = lives.agg(F.count("*").alias("_n"), *[F.count(F.when(F.col("duration_days") >= 2 * w, 1)).alias(f"w{w}") for w in windows])
    d = row.select(F.col("_n"), F.explode(F.array(*[F.struct(F.lit(w).alias("days"), F.col(f"w{w}").alias("entities")) for w in windows])).alias("r"))
    share = F.try_divide(F.col("r.entities").cast("double"), F.col("_n").cast("double"))
    return d.select("r.days", "r.entities", share.alias("share"), (share >= least_share).alias("recommended"))

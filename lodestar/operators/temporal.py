"""Per-entity temporal features: lagged windows and their differences, lifecycle thirds, recency, regularity, cohorts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import quantile_row, running
from ..scratch import written
from ..time import as_time, days_between, exact_days

AGGREGATES = {"sum": lambda v: F.coalesce(F.sum(v), F.lit(0.0)), "mean": F.avg, "count": F.count, "max": F.max, "min": F.min}


def lagged_windows(events: DataFrame, entity: str, time: str, value: str, reference: str | datetime, days: int = 30, lags: int = 4, functions: Sequence[str] = ("sum", "mean", "count")) -> DataFrame:
    """`lag{i}_{value}_{f}`: events from i to i + 1 times `days` days before the reference."""
    at = F.floor(days_between(as_time(reference), F.col(time).cast("timestamp")) / days)
    return events.groupBy(entity).agg(*[AGGREGATES[f](F.when(at == i, F.col(value).cast("double"))).alias(f"lag{i}_{value}_{f}") for i in range(lags) for f in functions])


def velocity(lagged: DataFrame, value: str, function: str = "sum", days: int = 30) -> DataFrame:
    """Change per day between the two newest windows, and relative to the older one (null where that is 0)."""
    a, b = F.col(f"lag0_{value}_{function}"), F.col(f"lag1_{value}_{function}")
    return lagged.withColumns({f"{value}_velocity": (a - b) / days, f"{value}_velocity_pct": F.try_divide(a - b, b)})


def acceleration(lagged: DataFrame, value: str, function: str = "sum", days: int = 30) -> DataFrame:
    """Change of the velocity from lags 1-2 to lags 0-1, and momentum: the newest value times the newest velocity."""
    v = [F.col(f"lag{i}_{value}_{function}") for i in range(3)]
    v01, v12 = (v[0] - v[1]) / days, (v[1] - v[2]) / days
    return lagged.withColumns({f"{value}_acceleration": v01 - v12, f"{value}_momentum": v[0] * v01})


def lifecycle(events: DataFrame, entity: str, time: str, value: str, splits: tuple[float, float] = (0.33, 0.66), least_days: int = 60) -> DataFrame:
    """Sums over the beginning, middle and end of each entity's history, and end / beginning; null for histories under
    least_days."""
    w = Window.partitionBy(entity)
    t = F.col(time).cast("timestamp")
    first, last = F.min(t).over(w), F.max(t).over(w)
    span = F.unix_micros(last) - F.unix_micros(first)
    share = F.try_divide((F.unix_micros(t) - F.unix_micros(first)).cast("double"), span.cast("double"))
    placed = events.select(entity, F.col(value).cast("double").alias("_v"), share.alias("_s"), days_between(last, first).alias("_days"))
    parts = {"beginning": F.col("_s") < splits[0], "middle": (F.col("_s") >= splits[0]) & (F.col("_s") < splits[1]), "end": F.col("_s") >= splits[1]}
    sums = placed.groupBy(entity).agg(F.max("_days").alias("_days"), *[F.coalesce(F.sum(F.when(c, F.col("_v"))), F.lit(0.0)).alias(f"{value}_{n}") for n, c in parts.items()])
    long_ = F.col("_days") >= least_days
    out = sums.select(entity, *[F.when(long_, F.col(f"{value}_{n}")).alias(f"{value}_{n}") for n in parts])
    return out.withColumn(f"{value}_trend_ratio", F.try_divide(F.col(f"{value}_end"), F.col(f"{value}_beginning")))


def recency(events: DataFrame, entity: str, time: str, reference: str | datetime) -> DataFrame:
    t, ref = F.col(time).cast("timestamp"), as_time(reference)
    out = events.groupBy(entity).agg(F.max(t).alias("_l"), F.min(t).alias("_f"))
    last, first = days_between(ref, F.col("_l")), days_between(ref, F.col("_f"))
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(last.cast("double"), first.cast("double"))))
    return out.select(entity, last.alias("days_since_last"), first.alias("days_since_first"), days_between(F.col("_l"), F.col("_f")).alias("active_span_days"), ratio.alias("recency_ratio"))


def gaps(events: DataFrame, entity: str, time: str) -> DataFrame:
    """Rows with _gap, the whole days since the entity's previous event."""
    t = F.col(time).cast("timestamp")
    return events.withColumn("_gap", days_between(t, F.lag(t).over(Window.partitionBy(entity).orderBy(t))))


def regularity(events: DataFrame, entity: str, time: str) -> DataFrame:
    """Events per 30 days, gaps in whole days, and max(0, 1 - std / mean); null under two events."""
    t = F.col(time).cast("timestamp")
    g = gaps(events, entity, time).groupBy(entity).agg(
        F.count("*").alias("_n"), days_between(F.max(t), F.min(t)).alias("_span"), F.avg("_gap").alias("gap_mean"), F.stddev_samp("_gap").alias("gap_std"), F.max("_gap").alias("gap_max")
    )
    some = F.col("_n") >= 2
    score = F.greatest(F.lit(0.0), 1 - F.try_divide(F.col("gap_std"), F.col("gap_mean")))
    return g.select(entity, F.when(some, F.try_divide(F.col("_n") * 30.0, F.col("_span").cast("double"))).alias("event_frequency"), "gap_mean", "gap_std", "gap_max", F.when(some, score).alias("regularity_score"))


def cohort_comparison(df: DataFrame, column: str) -> DataFrame:
    """Against all rows: difference from the mean, share of it, and z-score by the sample deviation."""
    c = F.col(column)
    both = df.join(F.broadcast(df.agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))))  # one row
    return both.withColumns({f"{column}_vs_mean": c - F.col("_m"), f"{column}_pct_of_mean": F.try_divide(c, F.col("_m")), f"{column}_zscore": F.try_divide(c - F.col("_m"), F.col("_s"))}).drop("_m", "_s")


def entity_lifecycle(events: DataFrame, entity: str, time: str) -> DataFrame:
    t = F.col(time).cast("timestamp")
    out = events.groupBy(entity).agg(F.min(t).alias("first_event"), F.max(t).alias("last_event"), F.count("*").alias("event_count"))
    return out.withColumn("duration_days", days_between(F.col("last_event"), F.col("first_event")))


def events_per_entity(lives: DataFrame) -> DataFrame:
    """Distribution of the entities' numbers of events: one row."""
    q = quantile_row(lives, ["event_count"], [0.25, 0.5, 0.75]).select(*[F.col("event_count")[i].alias(n) for i, n in enumerate(("q25", "median", "q75"))])
    n = F.col("event_count").cast("double")
    return lives.agg(F.count("*").alias("entities"), F.min(n).alias("min"), F.max(n).alias("max"), F.avg(n).alias("mean"), F.coalesce(F.stddev_samp(n), F.lit(0.0)).alias("std")).join(F.broadcast(q))  # one row


def pooled_gap(events: DataFrame, entity: str, time: str) -> DataFrame:
    """Mean days between successive events of an entity, over all entities: from each one's span and number, unsorted."""
    t = F.unix_micros(F.col(time).cast("timestamp"))
    each = events.groupBy(entity).agg((F.max(t) - F.min(t)).alias("span"), (F.count(t) - 1).alias("gaps")).where("gaps > 0")
    return each.agg(F.try_divide(F.sum("span") / 86_400_000_000.0, F.sum("gaps").cast("double")).alias("mean_gap_days"))


def lifecycle_quadrants(lives: DataFrame) -> DataFrame:
    """Long or short by the median duration, intense or sparse by the median of events per day (a day at least)."""
    d = lives.withColumn("intensity", F.col("event_count") / F.greatest(F.col("duration_days"), F.lit(1)))
    cut = quantile_row(d, ["duration_days", "intensity"], [0.5]).select(F.col("duration_days")[0].alias("_d"), F.col("intensity")[0].alias("_i"))
    long_, busy = F.col("duration_days") >= F.col("_d"), F.col("intensity") >= F.col("_i")
    name = F.when(long_ & busy, "steady_loyal").when(long_, "occasional_loyal").when(busy, "intense_brief").otherwise("one_shot")
    return d.join(F.broadcast(cut)).withColumn("quadrant", name).drop("_d", "_i")  # one row


def activity_segments(lives: DataFrame) -> DataFrame:
    q = quantile_row(lives, ["event_count"], [0.25, 0.75]).select(F.col("event_count")[0].alias("_a"), F.col("event_count")[1].alias("_b"))
    n = F.col("event_count")
    name = F.when(n <= 1, "one_time").when(n <= F.col("_a"), "low").when(n <= F.col("_b"), "medium").otherwise("high")
    return lives.join(F.broadcast(q)).withColumn("activity", name).drop("_a", "_b")  # one row


def period_counts(events: DataFrame, time: str, period: str = "month") -> DataFrame:
    return events.groupBy(F.date_trunc(period, F.col(time).cast("timestamp")).alias("period")).agg(F.count("*").alias("n"))


def growth(periods: DataFrame) -> DataFrame:
    """Change to the period before, and the running total. periods has a row for each period, so the single partition
    of this window is as long as the calendar."""
    w = Window.orderBy("period")
    before = F.lag("n").over(w)
    return periods.withColumns({"pct_change": F.try_divide((F.col("n") - before).cast("double"), before.cast("double")), "cumulative": F.sum("n").over(w)})


def trend(periods: DataFrame, time: str, value: str) -> DataFrame:
    """Least squares of value on days since the first time: slope, intercept, r squared, rows."""
    start = periods.agg(F.min(F.col(time).cast("timestamp")).alias("_start"))
    x = exact_days(F.col(time).cast("timestamp"), F.col("_start"))
    d = periods.join(F.broadcast(start)).select(x.alias("x"), F.col(value).cast("double").alias("y"))  # one row
    return d.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.count("*").alias("n"))


def autocorrelation(series: DataFrame, order: str, value: str, lags: Sequence[int]) -> DataFrame:
    """Pearson correlation of value with itself some rows before, one row for each lag, over series of any length: rows are
    numbered by running counts and met by number. Values of order are to be distinct."""
    d = written(running(series.select(F.col(order).alias("o"), F.col(value).cast("double").alias("x"), F.lit(1).alias("one")), "o", ["one"]).select(F.col("one_running").alias("n"), "x"), "series")
    earlier = d.select(F.explode(F.array(*map(F.lit, lags))).alias("lag"), "n", F.col("x").alias("y")).select("lag", (F.col("n") + F.col("lag")).alias("n"), "y")
    found = d.join(earlier, "n").groupBy("lag").agg(F.corr("x", "y").alias("correlation"))
    every = series.sparkSession.createDataFrame([(k,) for k in lags], "lag int")
    return every.join(F.broadcast(found), "lag", "left").select("lag", "correlation")  # a row for each lag


#: Names of periods.
PERIODS = {7: "weekly", 14: "bi-weekly", 21: "tri-weekly", 30: "monthly", 90: "quarterly", 180: "semi-annual", 365: "yearly"}


def acf_seasonality(series: DataFrame, order: str, value: str, lags: Sequence[int] = (7, 14, 21, 30), least: float = 0.3, most: int = 3) -> DataFrame:
    """Periods of the series, by rows: lags under half of its length at which the autocovariance over the variance (both
    about the mean of all rows) is above `least`, the `most` strongest. Rows are numbered by running counts and met with
    the rows a lag before them by number; no task holds the series."""
    rows = series.where(F.col(value).isNotNull()).select(F.struct(order, value).alias("o"), F.col(value).cast("double").alias("x"), F.lit(1).alias("one"))
    d = written(running(rows, "o", ["one"]).select(F.col("one_running").alias("n"), "x"), "series")
    stats = d.agg(F.count("*").alias("rows"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"))
    shifted = d.select(F.explode(F.array(*map(F.lit, lags))).alias("lag"), "n", F.col("x").alias("y")).select("lag", (F.col("n") + F.col("lag")).alias("n"), "y")
    both = d.join(shifted, "n").join(F.broadcast(stats))  # one row
    each = both.groupBy("lag", "rows", "var").agg(F.avg((F.col("x") - F.col("mean")) * (F.col("y") - F.col("mean"))).alias("cov"))
    name = F.create_map(*[F.lit(x) for kv in PERIODS.items() for x in kv])[F.col("lag")]
    strength = F.coalesce(F.try_divide("cov", "var"), F.lit(0.0))
    found = each.select(F.col("lag").alias("period"), F.coalesce(name, F.concat(F.col("lag").cast("string"), F.lit("-day"))).alias("name"), strength.alias("strength"), "rows")
    return found.where((F.col("strength") > least) & (F.col("rows") >= 14) & (F.col("period") < F.floor(F.col("rows") / 2))).orderBy(F.desc("strength"), "period").limit(most).drop("rows")


def momentum(events: DataFrame, entity: str, time: str, value: str, reference: str | datetime, short: int = 7, long: int = 30) -> DataFrame:
    """Mean of the short window over mean of the long one; 1 where that is not defined."""
    age = days_between(as_time(reference), F.col(time).cast("timestamp"))
    mean = lambda d: F.avg(F.when((age >= 0) & (age < d), F.col(value)))
    return events.groupBy(entity).agg(F.coalesce(F.try_divide(mean(short), mean(long)), F.lit(1.0)).alias("momentum"))


def scd(df: DataFrame, entity: str, columns: Sequence[str]) -> DataFrame:
    """Per column: share of entities whose value changes, most and mean number of changes, and the slowly changing
    dimension type these suggest. One pass."""
    each = df.groupBy(entity).agg(*[(F.greatest(F.count_distinct(c), F.lit(1)) - 1).alias(c) for c in columns])
    stats = each.agg(*[F.struct(F.avg((F.col(c) > 0).cast("double")).alias("changed"), F.max(c).alias("most"), F.avg(c).alias("mean")).alias(c) for c in columns])
    rows = stats.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])).alias("r")).select("r.column", "r.s.*")
    kind = F.when(F.col("changed") == 0, 0).when(F.col("changed") < 0.05, 1).when(F.col("most") <= 1, 3).otherwise(2)
    return rows.withColumn("scd_type", kind)


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c

"""Buckets, segments, cohorts, target rates and clusters of entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import quantile_row, with_quantiles
from ..time import days_between

RECENCY = ((7, "0-7d"), (30, "8-30d"), (90, "31-90d"), (180, "91-180d"))
TENURE = ((90, "new"), (180, "developing"), (365, "established"))
#: Three sets of cut-offs for risk, each from the highest down.
RISK = {
    "batch": ((0.75, "Critical"), (0.50, "High"), (0.25, "Medium")),
    "realtime": ((0.80, "Critical"), (0.50, "High"), (0.30, "Medium")),
    "profile": ((0.80, "Critical"), (0.60, "High"), (0.40, "Medium"), (0.20, "Low")),
}
LOWEST = {"batch": "Low", "realtime": "Low", "profile": "Very Low"}


def up_to(x: Column, cuts: Sequence[tuple[float, str]], above: str) -> Column:
    """The label of the first cut that x does not exceed."""
    out = F.lit(above)
    for edge, label in reversed(cuts):
        out = F.when(x <= edge, label).otherwise(out)
    return F.when(x.isNotNull(), out)


def from_down(x: Column, cuts: Sequence[tuple[float, str]], below: str) -> Column:
    """The label of the first cut that x reaches."""
    out = F.lit(below)
    for edge, label in reversed(cuts):
        out = F.when(x >= edge, label).otherwise(out)
    return F.when(x.isNotNull(), out)


def risk_segment(probability: Column, kind: str = "batch") -> Column:
    return from_down(probability, RISK[kind], LOWEST[kind])


def recency_bucket(days: Column) -> Column:
    return up_to(days, RECENCY, "180d+")


def tenure_bucket(days: Column) -> Column:
    return up_to(days, TENURE, "mature")


def value_frequency(df: DataFrame, value: str, frequency: str) -> DataFrame:
    """Halves by the medians of both."""
    m = quantile_row(df, [value, frequency], [0.5]).select(F.col(value)[0].alias("_v"), F.col(frequency)[0].alias("_f"))
    high, often = F.col(value) >= F.col("_v"), F.col(frequency) >= F.col("_f")
    name = F.when(high & often, "High_Value_Frequent").when(high, "High_Value_Infrequent").when(often, "Low_Value_Frequent").otherwise("Low_Value_Infrequent")
    return df.join(F.broadcast(m)).withColumn("segment", name).drop("_v", "_f")  # one row


def engagement_score(opens: Column, clicks: Column, percent: bool = False) -> Column:
    """0.6 of the open rate and 0.4 of the click rate, given as shares or in percent."""
    by = 100.0 if percent else 1.0
    return 0.6 * opens / by + 0.4 * clicks / by


def engagement_segment(score: Column) -> Column:
    return from_down(score, ((0.7, "High"), (0.3, "Medium")), "Low")


def behaviour(df: DataFrame, created: str, first: str, last: str, orders: str, reference: Column) -> DataFrame:
    """Tenure, account age in months, days since the last and to the first order, active days, orders per month of tenure,
    and recency over tenure."""
    t = lambda c: F.col(c).cast("timestamp")
    tenure, since = days_between(reference, t(created)), days_between(reference, t(last))
    return df.withColumns({
        "tenure_days": tenure, "account_age_months": tenure / 30.44, "days_since_last_order": since, "days_to_first_order": days_between(t(first), t(created)), "active_period_days": days_between(t(last), t(first)),
        "order_frequency": F.try_divide(F.col(orders).cast("double"), tenure / 30.44), "recency_ratio": F.try_divide(since.cast("double"), tenure.cast("double")), "recency_bucket": recency_bucket(since), "tenure_bucket": tenure_bucket(tenure),
    })


def cohorts(events: DataFrame, entity: str, time: str, period: str = "month") -> DataFrame:
    """Entities of each first-event period that are active in each later one, by number of periods."""
    t = F.col(time).cast("timestamp")
    active = events.select(entity, F.date_trunc(period, t).alias("at")).distinct()
    born = active.withColumn("cohort", F.min("at").over(Window.partitionBy(entity)))
    n = F.round(F.months_between("at", "cohort")).cast("int") if period == "month" else days_between(F.col("at"), F.col("cohort"))
    d = born.groupBy("cohort", n.alias("n")).agg(F.count("*").alias("active"))
    size = F.first("active").over(Window.partitionBy("cohort").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return d.withColumn("retention", F.col("active") / size)


def category_rates(df: DataFrame, category: str, target: str, least: int = 10) -> DataFrame:
    """Per category of at least `least` rows: rows, retained ones (target 1), rate, lift over all rows' rate, share of rows."""
    d = df.where(F.col(category).isNotNull() & F.col(target).isNotNull())
    each = d.groupBy(category).agg(F.count("*").alias("n"), F.sum((F.col(target) == 1).cast("bigint")).alias("retained"))
    whole = each.agg(F.sum("n").alias("_n"), F.sum("retained").alias("_r"))
    rate, base = F.col("retained") / F.col("n"), F.col("_r") / F.col("_n")
    return each.join(F.broadcast(whole)).where(F.col("n") >= least).select(category, "n", "retained", rate.alias("rate"), F.try_divide(rate, base).alias("lift"), (F.col("n") / F.col("_n")).alias("share"))  # one row


def period_rates(df: DataFrame, time: str, target: str, least: int = 10) -> DataFrame:
    """Target rates by year, month, quarter and day of the week, in one pass with grouping sets."""
    t = F.col(time).cast("timestamp")
    d = df.where(F.col(target).isNotNull() & t.isNotNull()).select(F.year(t).alias("year"), F.month(t).alias("month"), F.quarter(t).alias("quarter"), F.weekday(t).alias("day_of_week"), F.col(target).cast("double").alias("y"))
    names = ["year", "month", "quarter", "day_of_week"]
    g = d.groupingSets([[d[n]] for n in names], *[d[n] for n in names]).agg(F.count("*").alias("n"), F.avg("y").alias("rate"))
    part = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in names])
    out = g.select(part.alias("part"), F.coalesce(*names).alias("value"), "n", "rate")
    return out.where((F.col("n") >= least) | (F.col("part") == "day_of_week"))


def recency_target(df: DataFrame, days: str, target: str) -> DataFrame:
    """Target rates by recency bucket."""
    return df.groupBy(recency_bucket(F.col(days)).alias("bucket")).agg(F.count("*").alias("n"), F.avg(F.col(target).cast("double")).alias("rate"))


def target_to_entity(df: DataFrame, entity: str, target: str, how: str = "max", time: str | None = None) -> DataFrame:
    made = {"max": F.max, "mean": F.avg, "sum": F.sum, "first": lambda c: F.min_by(c, time), "last": lambda c: F.max_by(c, time)}
    return df.groupBy(entity).agg(made[how](target).alias(target))


def target_level(df: DataFrame, entity: str, target: str) -> DataFrame:
    """Share of entities whose target varies; under 5 percent it is an entity's, not an event's."""
    each = df.groupBy(entity).agg(F.count_distinct(target).alias("k"))
    v = each.agg(F.avg((F.col("k") > 1).cast("double")).alias("varying"))
    return v.withColumn("level", F.when(F.col("varying") < 0.05, "entity").otherwise("event"))


def clusters(df: DataFrame, columns: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """k-means on standardised columns; rows with nulls are left out."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    d = VectorAssembler(inputCols=list(columns), outputCol="_x", handleInvalid="skip").transform(df)
    d = StandardScaler(inputCol="_x", outputCol="_z", withMean=True).fit(d).transform(d)
    return KMeans(k=k, seed=seed, featuresCol="_z", predictionCol="cluster").fit(d).transform(d).drop("_x", "_z")


def segment_profiles(df: DataFrame, segment: str, columns: Sequence[str]) -> DataFrame:
    each = df.groupBy(segment).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"{c}_mean") for c in columns])
    return with_quantiles(each, df, segment, {f"{c}_median": (c, 0.5) for c in columns})


def coverage(events: DataFrame, entity: str, time: str, windows: Sequence[int], reference: Column) -> DataFrame:
    """Per window of days: entities with an event in it, and their share of all; one pass."""
    age = days_between(reference, F.col(time).cast("timestamp"))
    row = events.agg(F.count_distinct(entity).alias("_n"), *[F.count_distinct(F.when((age >= 0) & (age < w), F.col(entity))).alias(f"w{w}") for w in windows])
    return row.select("_n", F.explode(F.array(*[F.struct(F.lit(w).alias("days"), F.col(f"w{w}").alias("entities")) for w in windows])).alias("r")).select("r.*", (F.col("r.entities") / F.col("_n")).alias("coverage"))


def availability(df: DataFrame, time: str, columns: Sequence[str]) -> DataFrame:
    """First and last day on which each column has a value, and the share of rows with one."""
    day = F.to_date(F.col(time).cast("timestamp"))
    row = df.agg(*[F.struct(F.min(F.when(F.col(c).isNotNull(), day)).cast("string").alias("first_day"), F.max(F.when(F.col(c).isNotNull(), day)).cast("string").alias("last_day"), (F.count(c) / F.count("*")).alias("share")).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])).alias("r")).select("r.column", "r.s.*")

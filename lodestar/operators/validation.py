"""Quality gates, temporal quality, leakage checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import quantile_row, running
from ..time import days_between, exact_days


def _rows(row: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias(key), F.col(f"c{i}").alias("s")) for i, n in enumerate(names)])).alias("r")).select(f"r.{key}", "r.s.*")


def date_order(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which a date is later than the next one of the chain, of those with both."""
    pairs = list(zip(columns, columns[1:], strict=False))
    row = df.agg(*[F.struct(F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias("both"), F.count(F.when(F.col(a) > F.col(b), 1)).alias("violations")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return _rows(row, "pair", [f"{a} <= {b}" for a, b in pairs])


RANGES = {"percentage": lambda c: (c >= 0) & (c <= 100), "fraction": lambda c: (c >= 0) & (c <= 1), "binary": lambda c: c.isin(0, 1), "non_negative": lambda c: c >= 0}


def ranges(df: DataFrame, rules: dict[str, str | tuple[float, float]]) -> DataFrame:
    """Values that break a rule: a name from RANGES, or (least, most)."""
    ok = {c: RANGES[r](F.col(c)) if isinstance(r, str) else F.col(c).between(*r) for c, r in rules.items()}
    row = df.agg(*[F.struct(F.count(c).alias("n"), F.count(F.when(~x, 1)).alias("violations")).alias(f"c{i}") for i, (c, x) in enumerate(ok.items())])
    return _rows(row, "column", list(rules))


def temporal_quality(df: DataFrame, entity: str, time: str, as_of: Column, sequence: str | None = None) -> DataFrame:
    """Repeated entity and time (TQ001), future times (TQ003), and rows whose time is before that of the entity's row before
    it in sequence (TQ004); counts and shares."""
    t = F.col(time).cast("timestamp")
    repeated = df.groupBy(entity, t.alias("t")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).withColumn("check_id", F.lit("TQ001"))
    late = df.agg(F.count(F.when(t > as_of, 1)).alias("violations"), F.count("*").alias("n")).withColumn("check_id", F.lit("TQ003"))
    out = repeated.unionByName(late)
    if sequence:
        back = t < F.lag(t).over(Window.partitionBy(entity).orderBy(sequence))
        out = out.unionByName(df.select(back.alias("b")).agg(F.count(F.when(F.col("b"), 1)).alias("violations"), F.count("*").alias("n")).withColumn("check_id", F.lit("TQ004")))
    return out.select("check_id", "violations", "n", F.try_divide(F.col("violations").cast("double"), F.col("n").cast("double")).alias("share"))


def gap_islands(df: DataFrame, time: str, factor: float = 3.0) -> DataFrame:
    """Gaps between the distinct days of a table that exceed factor days (TQ002): start, end and days. Days are counted
    first: the ordered window sees one row for each day."""
    days = df.select(F.to_date(F.col(time).cast("timestamp")).alias("day")).where("day is not null").distinct()
    d = days.withColumn("before", F.lag("day").over(Window.orderBy("day")))
    return d.select(F.col("before").cast("string").alias("gap_start"), F.col("day").cast("string").alias("gap_end"), F.datediff("day", "before").alias("days")).where(F.col("days") > factor)


def series_shape(df: DataFrame, entity: str, time: str) -> DataFrame:
    """Rows and entities, median hours between an entity's events, and the kind of table that suggests."""
    t = F.col(time).cast("timestamp")
    g = df.select(entity, (exact_days(t, F.lag(t).over(Window.partitionBy(entity).orderBy(t))) * 24).alias("h"))
    out = g.agg(F.count("*").alias("rows"), F.count_distinct(entity).alias("entities")).join(F.broadcast(quantile_row(g, ["h"], [0.5]).select(F.col("h")[0].alias("median_gap_hours"))))  # one row
    per = F.try_divide(F.col("rows").cast("double"), F.col("entities").cast("double"))
    h = F.col("median_gap_hours")
    frequency = F.when(h.isNull(), "none").when(h <= 2, "hourly").when(h <= 36, "daily").when(h <= 240, "weekly").when(h <= 1080, "monthly").otherwise("irregular")
    return out.withColumns({"rows_per_entity": per, "frequency": frequency, "kind": F.when(per <= 1, "snapshot").otherwise("events")})


#: Hours of an expected frequency.
HOURS = {"hourly": 1, "daily": 24, "weekly": 168, "monthly": 720, "quarterly": 2184, "yearly": 8760}


def series_validation(df: DataFrame, entity: str, time: str, frequency: str | None = None, sequence: str | None = None, allowed: int = 3) -> DataFrame:
    """One row over all entities: times that repeat, entities whose times are out of order in `sequence`, gaps of more than
    `allowed` periods (of the given frequency, or of the median gap), the entities with such gaps, the largest in periods,
    the percentage of entities without, and a score from 100 that these lower."""
    t = F.col(time).cast("timestamp")
    again = df.where(t.isNotNull()).groupBy(entity, t.alias("t")).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("repeated_times"), F.count_distinct(entity).alias("entities_repeated"))
    steps = df.select(F.col(entity).alias("e"), (exact_days(t, F.lag(t).over(Window.partitionBy(entity).orderBy(t))) * 24).alias("h"), ((t < F.lag(t).over(Window.partitionBy(entity).orderBy(sequence))) if sequence else F.lit(False)).alias("back"))
    period = quantile_row(steps, ["h"], [0.5]).select(F.col("h")[0].alias("_p")) if frequency is None else df.sparkSession.createDataFrame([(float(HOURS[frequency]),)], "_p double")
    wide = F.col("h") > F.col("_p") * allowed
    each = steps.join(F.broadcast(period)).groupBy("e").agg(F.count(F.when(wide, 1)).alias("gaps"), F.max(F.when(wide, F.floor(F.col("h") / F.col("_p")))).alias("widest"), F.count(F.when(F.col("back"), 1)).alias("back"))  # one row
    one = each.agg(F.count("*").alias("entities"), F.count(F.when(F.col("gaps") > 0, 1)).alias("entities_with_gaps"), F.coalesce(F.sum("gaps"), F.lit(0)).alias("gaps"), F.coalesce(F.max("widest"), F.lit(0)).alias("largest_gap"), F.count(F.when(F.col("back") > 0, 1)).alias("entities_out_of_order"))
    one = one.join(F.broadcast(again))  # one row
    rate = lambda c: F.try_divide(F.col(c).cast("double"), F.col("entities").cast("double"))
    some = lambda c: F.when(rate(c) > 0.1, 20).when(rate(c) > 0.01, 10).otherwise(0)
    gap = F.when(rate("entities_with_gaps") > 0.2, 20).when(rate("entities_with_gaps") > 0.1, 10).when(rate("entities_with_gaps") > 0.05, 5).otherwise(0)
    return one.withColumns({"coverage_pct": 100 * (1 - rate("entities_with_gaps")), "score": 100 - some("entities_repeated") - some("entities_out_of_order") - gap})


def leakage(df: DataFrame, features: Sequence[str], target: str, high: float = 0.9, medium: float = 0.7) -> DataFrame:
    """Per feature: correlation with a 0/1 target, whether the classes' ranges are apart, overlap of the ranges in percent of
    their union, and a severity."""
    y = F.col(target)
    one, zero = (lambda c: F.when(y == 1, F.col(c).cast("double"))), (lambda c: F.when(y == 0, F.col(c).cast("double")))
    row = df.agg(*[F.struct(F.corr(c, target).alias("correlation"), F.min(one(c)).alias("l1"), F.max(one(c)).alias("h1"), F.min(zero(c)).alias("l0"), F.max(zero(c)).alias("h0")).alias(f"c{i}") for i, c in enumerate(features)])
    d = _rows(row, "feature", list(features))
    apart = (F.col("l1") > F.col("h0")) | (F.col("l0") > F.col("h1"))
    shared = F.greatest(F.lit(0.0), F.least("h1", "h0") - F.greatest("l1", "l0"))
    overlap = F.coalesce(F.try_divide(100 * shared, F.greatest("h1", "h0") - F.least("l1", "l0")), F.lit(100.0))
    r = F.abs(F.col("correlation"))
    severity = F.when((r >= high) | apart, "critical").when(r >= medium, "high").otherwise("none")
    return d.select("feature", "correlation", apart.alias("separated"), overlap.alias("overlap_pct"), severity.alias("severity"))


def feature_auc(df: DataFrame, feature: str, target: str) -> DataFrame:
    """Area under the curve of one feature by ranks (larger side): values are counted first, ranks are running counts."""
    each = df.where(F.col(feature).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(feature).cast("double").alias("x")).agg(F.sum((F.col(target) == 1).cast("bigint")).alias("p"), F.sum((F.col(target) == 0).cast("bigint")).alias("q"))
    r = running(each, "x", ["q"])
    won = F.sum(F.col("p") * (F.col("q_running") - F.col("q") / 2))
    auc = r.agg(F.try_divide(won, (F.sum("p") * F.sum("q")).cast("double")).alias("a"))
    return auc.select(F.greatest(F.col("a"), 1 - F.col("a")).alias("auc"))


def quality_score(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Completeness (share of values that are there), uniqueness (share of distinct keys), their weighted score (.6, .4) and
    grade by 90, 70 and 50 percent."""
    n = F.count("*").cast("double")
    whole = df.agg((sum(F.count(c) for c in df.columns) / (n * len(df.columns))).alias("completeness"))
    distinct = df.groupBy(*keys).agg(F.count("*").alias("n")).agg((F.count("*") / F.sum("n")).alias("uniqueness"))
    d = whole.join(F.broadcast(distinct))  # one row
    s = 100 * (0.6 * F.col("completeness") + 0.4 * F.col("uniqueness"))
    return d.withColumns({"score": s, "grade": F.when(s >= 90, "A").when(s >= 70, "B").when(s >= 50, "C").otherwise("D")})


def late_days(df: DataFrame, earlier: str, later: str) -> Column:
    return days_between(F.col(later).cast("timestamp"), F.col(earlier).cast("timestamp"))


def same_scores(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Two scoring paths compared: per column rows, differing rows, largest difference, and a severity by the share that
    differs (any: low, over 1 percent: medium, over 10: high)."""
    from .joins import compare_on_key

    d = compare_on_key(a, b, key, columns, tolerance)
    share = F.try_divide(F.col("differ").cast("double"), F.col("rows").cast("double"))
    return d.withColumn("severity", F.when(share > 0.10, "high").when(share > 0.01, "medium").when(share > 0, "low").otherwise("none"))


def business_gate(facts: dict[str, float | bool]) -> list[str]:
    """What stands in the way of use: no explanation, a return below 1, missing sign-offs, unfair selection."""
    rules = {"not explainable": not facts.get("explainable", False), "return below 1": facts.get("roi", 0.0) < 1.0, "no sign-off": not facts.get("signed_off", False), "disparate impact": facts.get("disparate_impact", 1.0) < 0.8}
    return [n for n, hit in rules.items() if hit]

"""Event tables to entity features over many time windows: one aggregation for all windows, columns and functions, and
two small ones for each column whose distinct values are counted."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..time import as_time, days_between, inside

#: Functions of a value column and its time, on rows where keep holds. Sums and counts of no rows are 0, others null.
FUNCTIONS = {
    "sum": lambda v, t: F.coalesce(F.sum(v.cast("double")), F.lit(0.0)),
    "mean": lambda v, t: F.avg(v),
    "max": lambda v, t: F.max(v),
    "min": lambda v, t: F.min(v),
    "count": lambda v, t: F.count(v),
    "std": lambda v, t: F.stddev_samp(v),
    "median": lambda v, t: F.median(v),
    "nunique": None,
    "first": lambda v, t: F.min_by(v, F.when(v.isNotNull(), t)),
    "last": lambda v, t: F.max_by(v, F.when(v.isNotNull(), t)),
    "mode": lambda v, t: F.mode(v, True),
}
TEXT_FUNCTIONS = {"count", "nunique", "first", "last", "mode", "max", "min"}


@dataclass(frozen=True)
class WindowPlan:
    """What is computed, without computing it."""

    windows: Sequence[str]
    values: dict[str, Sequence[str]]
    event_count: bool = True
    recency: bool = True
    tenure: bool = True
    names: list[str] = field(init=False)

    def __post_init__(self):
        unknown = {f for fs in self.values.values() for f in fs} - set(FUNCTIONS)
        if unknown:
            raise ValueError(f"functions {sorted(unknown)} are none of {sorted(FUNCTIONS)}")
        names = [f"event_count_{w}" for w in self.windows if self.event_count]
        names += [f"{c}_{f}_{w}" for w in self.windows for c, fs in self.values.items() for f in fs]
        object.__setattr__(self, "names", names + ["days_since_last_event"] * self.recency + ["days_since_first_event"] * self.tenure)


def aggregate(events: DataFrame, entity: str, time: str, plan: WindowPlan, reference: str | datetime | None = None, upper_bound: bool = True) -> DataFrame:
    """One row for each entity of events. reference: a time, by default the last event's. With upper_bound False events
    after the reference count too. Entities without events in a window get 0 for counts and sums and null otherwise."""
    t = F.col(time).cast("timestamp")
    if reference is None:
        events = events.join(F.broadcast(events.agg(F.max(t).alias("_reference"))))  # one row
        ref: Column = F.col("_reference")
    else:
        ref = as_time(reference)
    out, distinct = [], sorted({c for c, fs in plan.values.items() if "nunique" in fs})
    kinds = dict(events.dtypes)
    for w in plan.windows:
        keep = inside(t, ref, w, upper_bound)
        if plan.event_count:
            out.append(F.count(F.when(keep, 1)).alias(f"event_count_{w}"))
        for c, functions in plan.values.items():
            for f in functions:
                if f == "nunique":
                    continue
                text = kinds[c] == "string" and f not in TEXT_FUNCTIONS
                v = F.when(keep, F.lit(None).cast("double") if text else F.col(c))
                out.append(FUNCTIONS[f](v, t).alias(f"{c}_{f}_{w}"))
    seen = t if not upper_bound else F.when(t <= ref, t)
    if plan.recency:
        out.append(days_between(F.first(ref), F.max(seen)).alias("days_since_last_event"))
    if plan.tenure:
        out.append(days_between(F.first(ref), F.min(seen)).alias("days_since_first_event"))
    whole = events.groupBy(entity).agg(*out) if out else events.select(entity).distinct()
    for c in distinct:
        whole = whole.join(_distinct_values(events, entity, c, t, ref, plan, upper_bound), F.col(entity).eqNullSafe(F.col("_entity"))).drop("_entity")
    return whole.select(entity, *plan.names)


def _distinct_values(events: DataFrame, entity: str, column: str, t: Column, ref: Column, plan: WindowPlan, upper_bound: bool) -> DataFrame:
    """Distinct values of all windows in two aggregations: windows end together, so a value is in a window if its last
    occurrence is."""
    last = F.max(t if not upper_bound else F.when(t <= ref, t)).alias("_last")
    each = events.groupBy(F.col(entity).alias("_entity"), F.col(column).alias("_v")).agg(last, F.first(ref).alias("_ref"))
    seen = lambda w: F.when(F.col("_v").isNotNull() & inside(F.col("_last"), F.col("_ref"), w, upper_bound), 1)
    return each.groupBy("_entity").agg(*[F.count(seen(w)).alias(f"{column}_nunique_{w}") for w in plan.windows if "nunique" in plan.values[column]])


def category_features(events: DataFrame, entity: str, column: str, time: str, window: str, reference: str | datetime, values: Sequence[str] = ()) -> DataFrame:
    """Entropy in bits, share of the commonest value among the window's rows (null ones count as rows), and counts of the
    given values, per entity; two levels of aggregation, so no entity's values are gathered."""
    keep = inside(F.col(time).cast("timestamp"), as_time(reference), window)
    each = events.groupBy(entity, column).agg(F.count(F.when(keep, 1)).alias("n"))
    known = F.when(F.col(column).isNotNull(), F.col("n"))
    # -sum(p log p) = log N - sum(n log n) / N
    n, s = F.sum(known), F.sum(F.when(known > 0, known * F.log2(known)))
    out = each.groupBy(entity).agg(
        F.when(n > 0, F.log2(n) - s / n).alias("_h"),
        F.try_divide(F.max(known), F.sum("n")).alias(f"{column}_mode_ratio_{window}"),
        *[F.coalesce(F.sum(F.when(F.col(column) == v, F.col("n"))), F.lit(0)).alias(f"{column}_{v}_count_{window}") for v in values],
    )
    return out.withColumn(f"{column}_entropy_{window}", F.when(F.abs("_h") < 1e-12, 0.0).otherwise(F.col("_h"))).drop("_h")

"""Feature and label times: discovery of time columns, derivation, scenarios, cut-offs."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import quantile_row
from ..sources.snapshots import AVAILABLE, FEATURE_TIME, LABEL_TIME
from ..time import as_time

#: Words in names by role.
ROLES = {
    "label": ("churn", "unsub", "cancel", "label", "outcome", "end"),
    "activity": ("last", "recent", "latest", "login", "activity"),
    "origin": ("created", "signup", "first", "start", "birth", "registered"),
}


def discover(df: DataFrame, least: float = 0.8) -> DataFrame:
    """(column, how, median_day, role) of columns that hold times: timestamps and dates, texts that parse in that share,
    and whole numbers that lie between 2000 and 2100 as seconds or milliseconds. In order of their medians."""
    tries = []
    for c, kind in df.dtypes:
        if kind.startswith(("timestamp", "date")):
            tries.append((c, "time", F.col(c).cast("timestamp")))
        elif kind == "string":
            tries.append((c, "text", F.expr(f"try_cast(`{c}` as timestamp)")))
        elif kind in ("bigint", "int"):
            x = F.col(c).cast("bigint")
            tries.append((c, "seconds", F.when(x.between(946_684_800, 4_102_444_800), F.timestamp_seconds(x))))
            tries.append((c, "milliseconds", F.when(x.between(946_684_800_000, 4_102_444_800_000), F.timestamp_millis(x))))
    if not tries:
        return df.sparkSession.createDataFrame([], "column string, how string, median_day string, role string")
    row = df.agg(*[F.struct(F.try_divide(F.count(t).cast("double"), F.count(c).cast("double")).alias("share")).alias(f"c{i}") for i, (c, _, t) in enumerate(tries)])
    medians = quantile_row(df.select(*[F.unix_micros(t).alias(f"m{i}") for i, (_, _, t) in enumerate(tries)]), [f"m{i}" for i in range(len(tries))], [0.5])
    row = row.join(F.broadcast(medians)).withColumns({f"c{i}": F.struct(F.col(f"c{i}.share").alias("share"), F.col(f"m{i}")[0].alias("mid")) for i in range(len(tries))})  # one row
    rows = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(how).alias("how"), F.col(f"c{i}").alias("s")) for i, (c, how, _) in enumerate(tries)])).alias("r")).select("r.column", "r.how", "r.s.*")
    role = F.lit("other")
    for name, words in reversed(ROLES.items()):
        role = F.when(F.lower("column").rlike("|".join(words)), name).otherwise(role)
    day = F.date_format(F.timestamp_micros(F.col("mid").cast("bigint")), "yyyy-MM-dd")
    return rows.where(F.col("share") >= least).select("column", "how", day.alias("median_day"), role.alias("role"), "mid").orderBy("mid", "column").drop("mid")


def last_action(columns: Sequence[str]) -> Column:
    """The first of the columns, from the latest kind of action to the earliest, that has a value."""
    return F.coalesce(*[F.col(c).cast("timestamp") for c in columns])


def with_times(df: DataFrame, strategy: str, feature: str | None = None, label: str | None = None, window_days: int = 180, as_of: str | datetime | None = None, key: str | None = None, seed: int = 42) -> DataFrame:
    """feature_timestamp, label_timestamp and label_available_flag by a strategy: production (both columns are there; a
    missing label time is the feature time plus the window), derived (label from feature), fixed (feature is as_of), index
    (as_of less a day for each key, in the order of the keys modulo a year) or random (as_of less a hash of the key,
    within a year)."""
    start = as_time(as_of) if as_of is not None else None
    if strategy in ("production", "derived"):
        f = F.col(feature).cast("timestamp")
    elif strategy == "fixed":
        f = start
    elif strategy in ("index", "random"):
        n = F.pmod(F.col(key).cast("bigint"), F.lit(365)) if strategy == "index" else F.pmod(F.crc32(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), F.lit(365))
        f = start - F.make_dt_interval(n.cast("int"))
    else:
        raise ValueError(f"strategy {strategy} is not known")
    later = f + F.make_dt_interval(F.lit(window_days))
    l = F.coalesce(F.col(label).cast("timestamp"), later) if strategy == "production" and label else later
    out = df.withColumns({FEATURE_TIME: f, LABEL_TIME: l})
    known = F.col(LABEL_TIME) <= start if start is not None else F.col(LABEL_TIME).isNotNull()
    return out.withColumn(AVAILABLE, F.coalesce(known, F.lit(False)))


def scenario(found: Sequence[tuple[str, str]]) -> str:
    """From (column, role) of discovered times: production if feature and label times are there, partial if one is, derived
    if only origins or activity, none otherwise."""
    names, roles = {c for c, _ in found}, {r for _, r in found}
    if {FEATURE_TIME, LABEL_TIME} <= names:
        return "production"
    if names & {FEATURE_TIME, LABEL_TIME} or "label" in roles and roles & {"activity", "origin"}:
        return "partial"
    return "derived" if roles & {"activity", "origin"} else "none"


def cutoffs(df: DataFrame, time: str, bins: int = 20) -> DataFrame:
    """Equal bins of time: rows, running rows and the share of rows up to each bin's end. Rows are counted by bin first."""
    t = F.unix_micros(F.col(time).cast("timestamp"))
    ends = df.agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    at = F.least(F.floor(F.coalesce(F.try_divide((t - F.col("_lo")).cast("double"), (F.col("_hi") - F.col("_lo")).cast("double")), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    each = df.where(F.col(time).isNotNull()).join(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # one row
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    from pyspark.sql import Window

    w = Window.orderBy("bin")  # `bins` rows
    d = spine.join(F.broadcast(each), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return d.withColumns({"running": F.sum("n").over(w), "train_share": F.try_divide(F.sum("n").over(w).cast("double"), total.cast("double"))})


def consistent_times(registry: dict[str, datetime | str]) -> bool:
    """Whether all data sets were cut at the same time."""
    return len({str(v) for v in registry.values()}) <= 1

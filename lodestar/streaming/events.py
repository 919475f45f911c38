"""Event windows, sessions, lateness, triggers and scores: batch plans, and their twins on streams.

Batch windows are aligned to the first event. On a stream no first event is known, so windows are aligned to the epoch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import running
from ..time import UNITS, as_time, exact_days

#: Event types and the sources that emit them.
SOURCES = {"page_view": "web", "click": "web", "view": "web", "signup": "web", "login": "app", "logout": "app", "purchase": "pos", "refund": "pos", "email_open": "email", "email_click": "email", "error": "app"}
#: Weights of the early-warning signals, and levels of the score.
SIGNALS = {"activity_drop": 0.35, "recency": 0.30, "errors": 0.25, "value_drop": 0.20, "low_sessions": 0.20}
LEVELS = ((0.90, "critical"), (0.50, "high"), (0.30, "medium"))


def _micros(text: str) -> int:
    unit = {"m": 60_000_000, "s": 1_000_000} | UNITS
    return int(text[:-1]) * unit[text[-1]]


def tumbling(events: DataFrame, time: str, size: str, aggregates: Sequence[Column], slide: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Windows of size, every slide, from the first event on (which is read in a pass of its own); empty ones are left out.
    window_start and window_end are seconds since the epoch."""
    t = F.col(time).cast("timestamp")
    size_, step = _micros(size), _micros(slide or size)
    first = events.agg(F.min(F.unix_micros(t)).alias("_first"))
    d = events.join(F.broadcast(first)).withColumn("_x", F.unix_micros(t) - F.col("_first"))  # one row
    last = F.floor(F.col("_x") / step)
    low = F.greatest(F.lit(0), F.floor((F.col("_x") - size_) / step) + 1)
    d = d.withColumn("_w", F.explode(F.sequence(low, last)))
    start = F.col("_first") + F.col("_w") * step
    return d.groupBy(*by, (start / 1_000_000).cast("bigint").alias("window_start"), ((start + size_) / 1_000_000).cast("bigint").alias("window_end")).agg(*aggregates)


def tumbling_stream(events: DataFrame, time: str, size: str, aggregates: Sequence[Column], delay: str, slide: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, delay).groupBy(w, *by).agg(*aggregates)


def sessions(events: DataFrame, key: str, time: str, gap: str, aggregates: Sequence[Column] = ()) -> DataFrame:
    """A session ends before the event that comes more than gap after the one before; its end is its last event."""
    t = F.col(time).cast("timestamp")
    w = Window.partitionBy(key).orderBy(t)
    fresh = F.unix_micros(t) - F.unix_micros(F.lag(t).over(w)) > _micros(gap)
    d = events.withColumn("session", F.sum(F.coalesce(fresh, F.lit(False)).cast("int")).over(w))
    out = d.groupBy(key, "session").agg(F.min(F.unix_micros(t)).alias("_a"), F.max(F.unix_micros(t)).alias("_b"), F.count("*").alias("events"), *aggregates)
    return out.withColumns({"start": F.floor(F.col("_a") / 1_000_000), "end": F.floor(F.col("_b") / 1_000_000), "seconds": (F.col("_b") - F.col("_a")) / 1e6}).drop("_a", "_b")


def sessions_stream(events: DataFrame, key: str, time: str, gap: str, delay: str, aggregates: Sequence[Column]) -> DataFrame:
    return events.withWatermark(time, delay).groupBy(key, F.session_window(time, gap)).agg(*aggregates)


def lateness(events: DataFrame, time: str, delay: str, arrival: str) -> DataFrame:
    """Each event as valid (later than the watermark), late (up to one more delay) or dropped. The watermark is the largest
    time so far, in order of arrival (distinct numbers), less the delay; the maxima run by ranges of arrival."""
    d = running(events.withColumn("_t", F.unix_micros(F.col(time).cast("timestamp"))), arrival, ["_t"], "max")
    t, mark = F.col("_t"), F.col("_t_running") - _micros(delay)
    return d.withColumn("lateness", F.when(t > mark, "valid").when(t >= mark - _micros(delay), "late").otherwise("dropped")).drop("_t", "_t_running")


def lateness_at_end(events: DataFrame, time: str, delay: str, by: Sequence[str] = ()) -> DataFrame:
    """The same against the watermark of the whole batch, or of each group's: counts by lateness."""
    t = F.unix_micros(F.col(time).cast("timestamp"))
    if by:
        marked = events.withColumn("_m", F.max(t).over(Window.partitionBy(*by)))
    else:
        marked = events.join(F.broadcast(events.agg(F.max(t).alias("_m"))))  # one row
    mark = F.col("_m") - _micros(delay)
    return marked.groupBy(*by, F.when(t > mark, "valid").when(t >= mark - _micros(delay), "late").otherwise("dropped").alias("lateness")).agg(F.count("*").alias("n"))


def validate(events: DataFrame, as_of: Column, source: str | None = None) -> DataFrame:
    """errors: missing ids, future or over 30 days old times, unknown types, sources that don't emit the type."""
    t = F.col("ts").cast("timestamp")
    known = F.create_map(*[F.lit(x) for kv in SOURCES.items() for x in kv])[F.col("event_type")]
    found = [
        F.when(F.col("event_id").isNull(), "no event_id"), F.when(F.col("user_id").isNull(), "no user_id"), F.when(t > as_of, "in the future"), F.when(exact_days(as_of, t) > 30, "too old"), F.when(known.isNull(), "unknown type"),
    ] + ([F.when(F.col(source) != known, "wrong source")] if source else [])
    return events.withColumn("errors", F.array_compact(F.array(*found)))


def property_stats(events: DataFrame, path: str, by: Sequence[str], column: str = "props") -> DataFrame:
    """Count, sum, mean, least and largest of a numeric property of JSON; other values don't count, nothing sums to 0."""
    v = F.expr(f"try_cast(get_json_object(`{column}`, '{path}') as double)")
    return events.groupBy(*by).agg(F.count("*").alias("events"), F.count(v).alias("values"), F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.min(v), F.lit(0.0)).alias("least"), F.coalesce(F.max(v), F.lit(0.0)).alias("largest"))


def keyed_state(events: DataFrame, key: str, field: str, value: str, time: str, as_of: Column, ttl: str) -> DataFrame:
    """The state that increments of field by value leave behind: sums and last times, of those not yet expired."""
    t = F.unix_micros(F.col(time).cast("timestamp"))
    out = events.groupBy(key, field).agg(F.coalesce(F.sum(F.col(value).cast("double")), F.lit(0.0)).alias("state"), F.max(t).alias("_t"))
    return out.where(F.unix_micros(as_of) - F.col("_t") <= _micros(ttl)).withColumn("updated", F.floor(F.col("_t") / 1_000_000)).drop("_t")


def threshold_trigger(events: DataFrame, key: str, time: str, condition: Column, cooldown: str, daily_cap: int = 3) -> DataFrame:
    """Firings: per key the events with the condition, of which those within cooldown after one that fired are left out,
    and per day the first daily_cap. A fold over each key's matching times in order, which carries the last firing and the
    day's firings: a step takes the same time however many fired before."""
    t = F.unix_micros(F.col(time).cast("timestamp"))
    hits = events.where(condition).groupBy(key).agg(F.array_sort(F.collect_list(t)).alias("_ts"))
    state = "struct<last:bigint,day:bigint,n:int,fired:array<bigint>>"
    zero = F.struct(F.lit(None).cast("bigint").alias("last"), F.lit(None).cast("bigint").alias("day"), F.lit(0).alias("n"), F.array().cast("array<bigint>").alias("fired")).cast(state)

    def step(acc: Column, x: Column) -> Column:
        day = F.floor(x / UNITS["d"])
        today = F.when(acc["day"] == day, acc["n"]).otherwise(0)
        fires = acc["last"].isNull() | ((x - acc["last"] >= _micros(cooldown)) & (today < daily_cap))
        return F.when(fires, F.struct(x.alias("last"), day.alias("day"), (today + 1).alias("n"), F.concat(acc["fired"], F.array(x)).alias("fired"))).otherwise(acc).cast(state)

    fold = F.aggregate("_ts", zero, step, lambda acc: acc["fired"])
    return hits.select(key, F.explode(fold).alias("_at")).select(key, F.floor(F.col("_at") / 1_000_000).alias("fired_at"))


def sequence_trigger(events: DataFrame, key: str, time: str, kind: str, pattern: Sequence[str]) -> DataFrame:
    """Keys whose events hold the pattern as an ordered subsequence, with the time at which it was complete."""
    out = events.where(F.col(kind) == pattern[0]).groupBy(key).agg(F.min(F.unix_micros(F.col(time).cast("timestamp"))).alias("_t"))
    for p in pattern[1:]:
        later = events.where(F.col(kind) == p).select(key, F.unix_micros(F.col(time).cast("timestamp")).alias("_u"))
        out = later.join(out, key).where("_u > _t").groupBy(key).agg(F.min("_u").alias("_t"))
    return out.select(key, F.floor(F.col("_t") / 1_000_000).alias("completed_at"))


def anomaly_trigger(series: DataFrame, key: str, order: str, value: str, z: float = 3.0, least: int = 5) -> DataFrame:
    """Rows that are z sample deviations away from the mean of the key's rows before."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    score = F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w))
    return series.withColumns({"_n": F.count(value).over(w), "zscore": score}).where((F.col("_n") >= least) & (F.abs("zscore") >= z)).drop("_n")


def composite_trigger(df: DataFrame, conditions: Sequence[Column], logic: str = "AND") -> DataFrame:
    """df with triggered: all of the conditions hold, or any of them. A condition on null doesn't hold."""
    if logic not in ("AND", "OR"):
        raise ValueError(f"logic {logic} is neither AND nor OR")
    held = [F.coalesce(c, F.lit(False)) for c in conditions]
    out = F.lit(logic == "AND")
    for c in held:
        out = out & c if logic == "AND" else out | c
    return df.withColumn("triggered", out)


def schema_errors(events: DataFrame, required: dict[str, Sequence[str]], schema: str = "event_type", column: str = "props") -> DataFrame:
    """Each event with errors: properties that its schema requires and its JSON lacks, or that there is no such schema."""
    keys = F.coalesce(F.json_object_keys(column), F.array().cast("array<string>"))
    wanted = F.create_map(*[x for name, p in required.items() for x in (F.lit(name), F.array(*map(F.lit, p)).cast("array<string>"))])[F.col(schema)]
    missing = F.transform(F.array_sort(F.array_except(wanted, keys)), lambda p: F.concat(F.lit("missing "), p))
    return events.withColumn("errors", F.coalesce(missing, F.array(F.lit("no schema"))))


#: Types of visits and of actions in a session, and gaps in seconds from which it is idle.
VISITS, ACTIONS, IDLE_SECONDS = ("page_view", "app_session"), ("click", "app_action"), 30


def entity_features(events: DataFrame, key: str, time: str, kind: str, counted: dict[str, str], as_of: Column, visits: Sequence[str] = VISITS, actions: Sequence[str] = ACTIONS, pages: Sequence[str] = ("page_view",)) -> DataFrame:
    """Per key: events of each type in counted ({column: type}), minutes since the last event (0 at least), visits, and its
    events as one session: minutes, pages, actions, and idle seconds (the sum of gaps over IDLE_SECONDS)."""
    t = F.unix_micros(F.col(time).cast("timestamp"))
    gap = (t - F.lag(t).over(Window.partitionBy(key).orderBy(t))) / 1e6
    d = events.select(key, F.col(kind).alias("_kind"), t.alias("_t"), gap.alias("_gap"))
    n = lambda kinds: F.count(F.when(F.col("_kind").isin(*kinds), 1))
    return d.groupBy(key).agg(
        *[n([k]).alias(c) for c, k in counted.items()], F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.max("_t")) / 6e7).alias("minutes_since_last"), n(visits).alias("visits"),
        ((F.max("_t") - F.min("_t")) / 6e7).alias("session_minutes"), n(pages).alias("session_pages"), n(actions).alias("session_actions"), F.coalesce(F.sum(F.when(F.col("_gap") > IDLE_SECONDS, F.col("_gap"))), F.lit(0.0)).alias("session_idle_seconds"),
    )


def anomaly_score(current: Column, mean: Column, sd: Column) -> Column:
    """Deviations from a baseline; a deviation of 0 or none counts as 1."""
    return (current - mean) / F.when(F.coalesce(sd, F.lit(0.0)) == 0, 1.0).otherwise(sd)


def early_warning(df: DataFrame, signals: dict[str, Column]) -> DataFrame:
    """Weighted sum of signals (0 to 1) within 0 and 1, its level, and the signal that weighs most."""
    parts = {n: SIGNALS[n] * F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in signals.items()}
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum(parts.values(), F.lit(0.0))))
    level = F.lit("low")
    for edge, name in reversed(LEVELS):
        level = F.when(score >= edge, name).otherwise(level)
    primary = F.array_max(F.array(*[F.struct(c.alias("v"), F.lit(n).alias("n")) for n, c in parts.items()]))["n"]
    return df.withColumns({"score": score, "level": level, "primary_signal": primary})


def combine_scores(batch: Column, stream: Column, how: str, age_hours: Column | None = None, freshness: float = 24.0, weight: float = 0.7) -> Column:
    """batch_only, override (the stream's while it is fresh), ensemble, max or boost (.1 more, 1 at most)."""
    s = stream if age_hours is None else F.when(age_hours <= freshness, stream)
    made = {
        "batch_only": batch, "override": F.coalesce(s, batch), "ensemble": F.when(s.isNull(), batch).otherwise(weight * batch + (1 - weight) * s),
        "max": F.greatest(batch, s), "boost": F.when(s > batch, F.least(F.lit(1.0), batch + 0.1)).otherwise(batch),
    }
    return made[how]


class OnlineStore:
    """Keyed feature records with history: rows (key, feature, value, updated_at) appended to a table."""

    SCHEMA = "customer_id string, feature_name string, feature_value double, updated_at timestamp"

    def __init__(self, history: DataFrame):
        self.history = history

    def current(self, as_of, ttl_seconds: int | None = None) -> DataFrame:
        """The newest record of each key and feature from no later than as_of, unless it is older than the time to live."""
        now = as_time(as_of)
        d = self.history.where(F.col("updated_at") <= now).groupBy("customer_id", "feature_name").agg(F.max_by("feature_value", "updated_at").alias("feature_value"), F.max("updated_at").alias("updated_at"))
        return d if ttl_seconds is None else d.where(F.unix_micros(now) - F.unix_micros("updated_at") <= ttl_seconds * 1_000_000)

    def lookup(self, keys: DataFrame, features: dict[str, float], as_of, ttl_seconds: int | None = None) -> DataFrame:
        """keys with a column for each feature, its default where there is no live record."""
        wide = self.current(as_of, ttl_seconds).groupBy("customer_id").pivot("feature_name", list(features)).agg(F.first("feature_value"))
        return keys.join(wide, "customer_id", "left").select(*keys.columns, *[F.coalesce(F.col(f), F.lit(d)).alias(f) for f, d in features.items()])

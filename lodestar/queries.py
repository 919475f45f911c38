"""Named queries over the test tables, each with its SQL. Doubles are rounded to six places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import stats
from .operators import cleaning, gates, interpret, joins, modeling, monitoring, profiling, reduce, relations, seasonality, segments, selection, temporal, timestamps, transforms, validation, windows
from .plans import spec
from .sources import features
from .sources import tables as io
from .streaming import events as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
REF, ORDERS_REF = "2024-01-31 00:00:00", "2001-08-02 00:00:00"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return io.table(self.spark, self.sf_dir, name)


def query(name: str, keys: str, doubles: str = "", sql: str | None = None):
    """Registers f(tables) -> DataFrame under name, cut to the given columns."""

    def deco(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(Tables(spark, sf_dir))
            return df.select(*keys.split(), *[(F.round(F.col(c).cast("double"), 6) + F.lit(0.0)).alias(c) for c in doubles.split()])

        QUERIES[name] = run
        if sql:
            cut = ", ".join([*(f'"{c}"' for c in keys.split()), *(f'round(cast("{c}" as double), 6) + 0.0 as "{c}"' for c in doubles.split())])
            SQL[name] = f"select {cut} from ({sql}) result"
        return f

    return deco


def _days(a: str, b: str) -> str:
    return f"cast(floor((epoch_us({a}) - epoch_us({b})) / 86400000000.0) as bigint)"


# Window aggregation

PLAN = windows.WindowPlan(["7d", "30d", "24h", "all_time"], {"value": ["sum", "mean", "max", "min", "count", "std", "median", "nunique", "first", "last"], "event_type": ["nunique", "mode", "last"]})
_TEXT = [n for n in PLAN.names if n.startswith("event_type_mode") or n.startswith("event_type_last")]
_DOUBLE = [n for n in PLAN.names if n.startswith("value_") and not n.startswith(("value_count", "value_nunique"))]


def _window_sql() -> str:
    out = []
    for w in PLAN.windows:
        days = {"7d": 7, "30d": 30, "24h": 1, "all_time": None}[w]
        k = f"(ts <= timestamp '{REF}'" + (f" and ts >= timestamp '{REF}' - interval {days} day)" if days else ")")
        out.append(f"count(*) filter (where {k}) as event_count_{w}")
        for f, e in {"sum": "coalesce(sum(value) filter (where {k}), 0.0)", "mean": "avg(value) filter (where {k})", "max": "max(value) filter (where {k})", "min": "min(value) filter (where {k})", "count": "count(value) filter (where {k})", "std": "stddev_samp(value) filter (where {k})", "median": "quantile_cont(value, 0.5) filter (where {k})", "nunique": "count(distinct value) filter (where {k})", "first": "arg_min(value, ts) filter (where {k})", "last": "arg_max(value, ts) filter (where {k})"}.items():
            out.append(f"{e.format(k=k)} as value_{f}_{w}")
        out.append(f"count(distinct event_type) filter (where {k}) as event_type_nunique_{w}")
        out.append(f"arg_max(event_type, ts) filter (where {k}) as event_type_last_{w}")
    out.append(f"{_days(f'''timestamp '{REF}' ''', f'''max(ts) filter (where ts <= timestamp '{REF}')''')} as days_since_last_event")
    out.append(f"{_days(f'''timestamp '{REF}' ''', f'''min(ts) filter (where ts <= timestamp '{REF}')''')} as days_since_first_event")
    modes = ", ".join(f"(select event_type from (select event_type, count(*) as n from events e where e.user_id = g.user_id and e.ts <= timestamp '{REF}'" + (f" and e.ts >= timestamp '{REF}' - interval {d} day" if d else "") + f" group by event_type) order by n desc, event_type limit 1) as event_type_mode_{w}" for w, d in (("7d", 7), ("30d", 30), ("24h", 1), ("all_time", None)))
    return f"select g.*, {modes} from (select user_id, {', '.join(out)} from events group by user_id) g"


@query("window_aggregate", " ".join(["user_id", *(n for n in PLAN.names if n not in _DOUBLE)]), " ".join(_DOUBLE), _window_sql())
def _window_aggregate(t: Tables) -> DataFrame:
    return windows.aggregate(t.events, "user_id", "ts", PLAN, REF)


@query("window_category_features", "user_id event_type_click_count_30d event_type_view_count_30d", "event_type_mode_ratio_30d event_type_entropy_30d", f"""
  select user_id, max(n) / sum(n)::double as event_type_mode_ratio_30d, -sum(case when n > 0 then n / t::double * log2(n / t::double) end) as event_type_entropy_30d,
    cast(sum(case when event_type = 'click' then n else 0 end) as bigint) as event_type_click_count_30d, cast(sum(case when event_type = 'view' then n else 0 end) as bigint) as event_type_view_count_30d
  from (select user_id, event_type, n, sum(n) over (partition by user_id) as t from (
    select user_id, event_type, count(*) filter (where ts <= timestamp '{REF}' and ts >= timestamp '{REF}' - interval 30 day) as n from events group by user_id, event_type)) group by user_id""")
def _category(t: Tables) -> DataFrame:
    return windows.category_features(t.events, "user_id", "event_type", "ts", "30d", REF, ["click", "view"])


_LAGS = ", ".join(f"coalesce(sum(case when b = {i} then value end), 0.0) as lag{i}_value_sum, avg(case when b = {i} then value end) as lag{i}_value_mean, count(case when b = {i} then value end) as lag{i}_value_count" for i in range(4))
_LAG_SQL = f"select user_id, {_LAGS} from (select user_id, value, cast(floor({_days(f'''timestamp '{REF}' ''', 'ts')} / 7.0) as bigint) as b from events) group by user_id"


def _lagged(t: Tables) -> DataFrame:
    return temporal.lagged_windows(t.events, "user_id", "ts", "value", REF, days=7)


@query("lagged_windows", "user_id " + " ".join(f"lag{i}_value_count" for i in range(4)), " ".join(f"lag{i}_value_sum lag{i}_value_mean" for i in range(4)), _LAG_SQL)
def _lag_query(t: Tables) -> DataFrame:
    return _lagged(t)


@query("velocity_acceleration", "user_id", "value_velocity value_velocity_pct value_acceleration value_momentum", f"""
  select user_id, (a - b) / 7 as value_velocity, case when b <> 0 then (a - b) / b end as value_velocity_pct, (a - b) / 7 - (b - c) / 7 as value_acceleration, a * ((a - b) / 7) as value_momentum
  from (select user_id, lag0_value_sum as a, lag1_value_sum as b, lag2_value_sum as c from ({_LAG_SQL}))""")
def _velocity(t: Tables) -> DataFrame:
    return temporal.acceleration(temporal.velocity(_lagged(t), "value", days=7), "value", days=7)


@query("lifecycle_thirds", "user_id", "value_beginning value_middle value_end value_trend_ratio", f"""
  select user_id, b as value_beginning, m as value_middle, e as value_end, case when b <> 0 then e / b end as value_trend_ratio
  from (select user_id, case when d >= 10 then b end as b, case when d >= 10 then m end as m, case when d >= 10 then e end as e from (
    select user_id, max(d) as d, coalesce(sum(case when s < 0.33 then value end), 0.0) as b, coalesce(sum(case when s >= 0.33 and s < 0.66 then value end), 0.0) as m, coalesce(sum(case when s >= 0.66 then value end), 0.0) as e
    from (select user_id, value, {_days('l', 'f')} as d, case when l > f then (epoch_us(ts) - epoch_us(f))::double / (epoch_us(l) - epoch_us(f)) end as s
      from (select *, min(ts) over (partition by user_id) as f, max(ts) over (partition by user_id) as l from events)) group by user_id))""")
def _lifecycle(t: Tables) -> DataFrame:
    return temporal.lifecycle(t.events, "user_id", "ts", "value", least_days=10)


@query("recency_features", "user_id days_since_last days_since_first active_span_days", "recency_ratio", f"""
  select *, case when days_since_first <> 0 then greatest(0.0, least(1.0, days_since_last / days_since_first::double)) end as recency_ratio from (
    select user_id, {_days(f'''timestamp '{REF}' ''', 'max(ts)')} as days_since_last, {_days(f'''timestamp '{REF}' ''', 'min(ts)')} as days_since_first, {_days('max(ts)', 'min(ts)')} as active_span_days from events group by user_id)""")
def _recency(t: Tables) -> DataFrame:
    return temporal.recency(t.events, "user_id", "ts", REF)


@query("regularity_features", "user_id gap_max", "event_frequency gap_mean gap_std regularity_score", f"""
  select user_id, gap_max, gap_mean, gap_std, case when n >= 2 and span <> 0 then n * 30.0 / span end as event_frequency, case when n >= 2 and gap_mean <> 0 then greatest(0.0, 1 - gap_std / gap_mean) when n >= 2 then 0.0 end as regularity_score
  from (select user_id, count(*) as n, {_days('max(ts)', 'min(ts)')} as span, avg(g) as gap_mean, stddev_samp(g) as gap_std, max(g) as gap_max
    from (select user_id, ts, {_days('ts', 'lag(ts) over (partition by user_id order by ts)')} as g from events) group by user_id)""")
def _regularity(t: Tables) -> DataFrame:
    return temporal.regularity(t.events, "user_id", "ts")


@query("cohort_comparison", "c_custkey", "c_acctbal_vs_mean c_acctbal_pct_of_mean c_acctbal_zscore", """
  select c_custkey, c_acctbal - m as c_acctbal_vs_mean, c_acctbal / m as c_acctbal_pct_of_mean, (c_acctbal - m) / s as c_acctbal_zscore from customer, (select avg(c_acctbal) as m, stddev_samp(c_acctbal) as s from customer)""")
def _cohort(t: Tables) -> DataFrame:
    return temporal.cohort_comparison(t.customer, "c_acctbal")


_LIVES = f"select user_id, count(*) as event_count, {_days('max(ts)', 'min(ts)')} as duration_days from events group by user_id"


@query("lifecycle_quadrants", "user_id event_count duration_days quadrant", "intensity", f"""
  select l.*, case when duration_days >= d and intensity >= i then 'steady_loyal' when duration_days >= d then 'occasional_loyal' when intensity >= i then 'intense_brief' else 'one_shot' end as quadrant
  from (select *, event_count / greatest(duration_days, 1)::double as intensity from ({_LIVES})) l,
    (select quantile_cont(duration_days, 0.5) as d, quantile_cont(event_count / greatest(duration_days, 1)::double, 0.5) as i from ({_LIVES}))""")
def _quadrants(t: Tables) -> DataFrame:
    return temporal.lifecycle_quadrants(temporal.entity_lifecycle(t.events, "user_id", "ts"))


@query("activity_segments", "user_id event_count activity", "", f"""
  select user_id, event_count, case when event_count <= 1 then 'one_time' when event_count <= a then 'low' when event_count <= b then 'medium' else 'high' end as activity
  from ({_LIVES}), (select quantile_cont(event_count, 0.25) as a, quantile_cont(event_count, 0.75) as b from ({_LIVES}))""")
def _activity(t: Tables) -> DataFrame:
    return temporal.activity_segments(temporal.entity_lifecycle(t.events, "user_id", "ts"))


@query("period_growth", "month n cumulative", "pct_change", """
  select strftime(p, '%Y-%m') as month, n, cast(sum(n) over (order by p) as bigint) as cumulative, (n - lag(n) over (order by p)) / (lag(n) over (order by p))::double as pct_change from (select date_trunc('month', o_orderdate) as p, count(*) as n from orders group by 1)""")
def _growth(t: Tables) -> DataFrame:
    return temporal.growth(temporal.period_counts(t.orders, "o_orderdate")).withColumn("month", F.date_format("period", "yyyy-MM"))


@query("trend", "n", "slope intercept r2", """
  select count(*) as n, regr_slope(y, x) as slope, regr_intercept(y, x) as intercept, regr_r2(y, x) as r2 from (select (epoch_us(d) - min(epoch_us(d)) over ()) / 86400000000.0 as x, y from (select date_trunc('day', ts) as d, sum(value) as y from events group by 1))""")
def _trend(t: Tables) -> DataFrame:
    daily = t.events.groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.sum("value").alias("y"))
    return temporal.trend(daily, "day", "y")


@query("autocorrelation", "lag", "correlation", "\n union all ".join(f"select {k} as lag, corr(y, l) as correlation from (select y, lag(y, {k}) over (order by d) as l from (select date_trunc('day', ts) as d, avg(value) as y from events group by 1))" for k in range(1, 8)))
def _autocorrelation(t: Tables) -> DataFrame:
    daily = t.events.groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.avg("value").alias("y"))
    return temporal.autocorrelation(daily, "day", "y", range(1, 8))


@query("momentum", "user_id", "momentum", f"""
  select user_id, coalesce(case when l <> 0 then s / l end, 1.0) as momentum from (select user_id, avg(case when a >= 0 and a < 7 then value end) as s, avg(case when a >= 0 and a < 30 then value end) as l from (select user_id, value, {_days(f'''timestamp '{REF}' ''', 'ts')} as a from events) group by user_id)""")
def _momentum(t: Tables) -> DataFrame:
    return temporal.momentum(t.events, "user_id", "ts", "value", REF)


@query("scd_types", "column most scd_type", "changed mean", "\n union all ".join(f"""select '{c}' as "column", max(k) as most, case when avg(case when k > 0 then 1.0 else 0.0 end) = 0 then 0 when avg(case when k > 0 then 1.0 else 0.0 end) < 0.05 then 1 when max(k) <= 1 then 3 else 2 end as scd_type, avg(case when k > 0 then 1.0 else 0.0 end) as changed, avg(k) as mean from (select o_custkey, greatest(count(distinct {c}), 1) - 1 as k from orders group by o_custkey)""" for c in ("o_orderstatus", "o_orderpriority")))
def _scd(t: Tables) -> DataFrame:
    return temporal.scd(t.orders, "o_custkey", ["o_orderstatus", "o_orderpriority"])


# Joins


@query("asof_backward", "o_orderkey o_custkey", "o_totalprice prior_price", """
  select o.o_orderkey, o.o_custkey, o.o_totalprice, p.price as prior_price from orders o asof left join (select o_custkey as k, o_orderdate + interval 1 day as t, max(o_totalprice) as price from orders group by 1, 2) p on o.o_custkey = p.k and o.o_orderdate >= p.t""")
def _asof(t: Tables) -> DataFrame:
    prior = t.orders.groupBy("o_custkey", (F.col("o_orderdate") + F.expr("interval 1 day")).alias("known")).agg(F.max("o_totalprice").alias("prior_price"))
    return joins.asof(t.orders, prior, ["o_custkey"], "o_orderdate", "known", ["prior_price"])


@query("asof_forward", "event_id user_id next_purchase", "", """
  select e.event_id, e.user_id, p.event_id as next_purchase from events e asof left join (select user_id, ts, event_id from events where event_type = 'purchase') p on e.user_id = p.user_id and e.ts <= p.ts""")
def _asof_forward(t: Tables) -> DataFrame:
    p = t.events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("next_purchase"))
    return joins.asof(t.events, p, ["user_id"], "ts", "ts", ["next_purchase"], "forward")


@query("point_in_time_by_entity", "user_id", "value", """
  select e.user_id, arg_max(e.value, e.ts) filter (where e.value is not null) as value from events e join (select user_id, max(ts) as cut from events where event_type = 'purchase' group by user_id) b on e.user_id = b.user_id and e.ts <= b.cut group by e.user_id""")
def _pit(t: Tables) -> DataFrame:
    base = t.events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("base_ts"))
    return joins.point_in_time_by_entity(base, t.events.select("user_id", "ts", "value"), "user_id", "base_ts", "ts", ["value"])


@query("merge_sources", "c_custkey c_name n_name r_name orders", "", """
  select c_custkey, c_name, n_name, r_name, orders from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey left join (select o_custkey, count(*) as orders from orders group by 1) o on c_custkey = o_custkey""")
def _merge(t: Tables) -> DataFrame:
    o = t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"))
    return joins.merge_sources(t.customer, [(t.nation, {"c_nationkey": "n_nationkey"}, "left"), (t.region, {"n_regionkey": "r_regionkey"}, "left"), (o, {"c_custkey": "o_custkey"}, "left")])


@query("key_overlap", "left_keys right_keys shared_keys cardinality", "score", """
  select a.n as left_keys, b.n as right_keys, s.n as shared_keys, case when am <= 1 then '1' else 'N' end || ':' || case when bm <= 1 then '1' else 'N' end as cardinality, least(1.0, 2.0 * s.n / (a.n + b.n)) as score
  from (select count(*) as n, max(k) as am from (select c_custkey, count(*) as k from customer group by 1)) a, (select count(*) as n, max(k) as bm from (select o_custkey, count(*) as k from orders group by 1)) b, (select count(*) as n from (select c_custkey from customer intersect select o_custkey from orders)) s""")
def _overlap(t: Tables) -> DataFrame:
    return joins.key_overlap(t.customer, "c_custkey", t.orders, "o_custkey")


@query("missing_keys", "p_partkey", "", "select distinct p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)")
def _missing(t: Tables) -> DataFrame:
    big = t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return joins.missing_keys(t.part, big, "p_partkey")


@query("compare_outputs", "column rows differ", "largest", """
  select 'price' as "column", count(*) as rows, count(*) filter (where abs(a - b) > 1000) as differ, max(abs(a - b)) as largest from (select o_orderkey, o_totalprice as a from orders) join (select l_orderkey, sum(l_extendedprice) as b from lineitem group by 1) on o_orderkey = l_orderkey""")
def _compare(t: Tables) -> DataFrame:
    a = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    b = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("price"))
    return joins.compare_on_key(a, b, "k", ["price"], tolerance=1000)


@query("upsert", "c_custkey c_mktsegment", "c_acctbal", """
  select coalesce(c.c_custkey, s.k) as c_custkey, coalesce(s.seg, c.c_mktsegment) as c_mktsegment, coalesce(s.bal, c.c_acctbal) as c_acctbal from customer c full join (select c_custkey + 100 as k, 'NEW' as seg, c_acctbal * 2 as bal from customer where c_nationkey < 5) s on c.c_custkey = s.k""")
def _upsert(t: Tables) -> DataFrame:
    target = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    source = t.customer.where("c_nationkey < 5").select((F.col("c_custkey") + 100).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"), (F.col("c_acctbal") * 2).alias("c_acctbal"))
    return io.upsert(target, source, ["c_custkey"])


# Cleaning and transforms


@query("impute", "l_orderkey l_linenumber l_quantity_missing", "l_quantity l_tax", """
  select l_orderkey, l_linenumber, case when q is null then 1 else 0 end as l_quantity_missing, coalesce(q, (select quantile_cont(q, 0.5) from (select case when l_linenumber = 3 then null else l_quantity end as q from lineitem))) as l_quantity, coalesce(l_tax, 0) as l_tax
  from (select *, case when l_linenumber = 3 then null else l_quantity end as q from lineitem)""")
def _impute(t: Tables) -> DataFrame:
    d = t.lineitem.withColumn("l_quantity", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")))
    return cleaning.fill(d, cleaning.fit_fill(d, {"l_quantity": "median", "l_tax": "mean"}), indicator=True)


@query("fill_along", "event_id user_id", "forward linear", """
  select event_id, user_id, last_value(v ignore nulls) over w as forward, case when v is not null then v when a is null then last_value(v ignore nulls) over w else b + (a - b) * (n - nb) / (na - nb) end as linear
  from (select *, last_value(v ignore nulls) over w as b, first_value(v ignore nulls) over f as a, last_value(case when v is not null then n end ignore nulls) over w as nb, first_value(case when v is not null then n end ignore nulls) over f as na
    from (select event_id, user_id, ts, case when event_type <> 'error' then value end as v, row_number() over (partition by user_id order by ts, event_id) as n from events)
    window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row), f as (partition by user_id order by ts, event_id rows between current row and unbounded following))
  window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)""")
def _fill_along(t: Tables) -> DataFrame:
    d = t.events.withColumn("forward", F.when(F.col("event_type") != "error", F.col("value"))).withColumn("linear", F.col("forward"))
    d = cleaning.fill_along(d, "forward", ["ts", "event_id"], ["user_id"])
    return cleaning.fill_along(d, "linear", ["ts", "event_id"], ["user_id"], "linear")


_OUT = {"iqr": "q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)", "zscore": "m - 3 * s, m + 3 * s", "percentile": "p1, p99"}


@query("outlier_capping", "p_partkey", "capped", """
  select p_partkey, greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), x)) as capped from (select p_partkey, p_retailprice * p_size * p_size as x from part), (select quantile_cont(p_retailprice * p_size * p_size, 0.25) as q1, quantile_cont(p_retailprice * p_size * p_size, 0.75) as q3 from part)""")
def _cap(t: Tables) -> DataFrame:
    d = t.part.withColumn("capped", F.col("p_retailprice") * F.col("p_size") * F.col("p_size"))
    return cleaning.treat_outliers(d, cleaning.outlier_bounds(d, ["capped"]), "cap")


@query("outlier_indicators", "l_orderkey l_linenumber z m p", "", """
  select l_orderkey, l_linenumber, case when x between m0 - 2 * s0 and m0 + 2 * s0 then 0 else 1 end as z, case when x between md - 1.0 * 1.4826 * mad and md + 1.0 * 1.4826 * mad then 0 else 1 end as m, case when x between p1 and p99 then 0 else 1 end as p
  from (select l_orderkey, l_linenumber, l_extendedprice as x from lineitem), (select avg(l_extendedprice) as m0, stddev_samp(l_extendedprice) as s0, quantile_cont(l_extendedprice, 0.01) as p1, quantile_cont(l_extendedprice, 0.99) as p99, quantile_cont(l_extendedprice, 0.5) as md from lineitem),
    (select quantile_cont(abs(l_extendedprice - (select quantile_cont(l_extendedprice, 0.5) from lineitem)), 0.5) as mad from lineitem)""")
def _indicators(t: Tables) -> DataFrame:
    d = t.lineitem.select("l_orderkey", "l_linenumber", *[F.col("l_extendedprice").alias(c) for c in ("zz", "mm", "pp")])
    for c, method, factor in (("zz", "zscore", 2.0), ("mm", "modified_zscore", 1.0), ("pp", "percentile", None)):
        d = cleaning.treat_outliers(d, cleaning.outlier_bounds(d, [c], method, factor), "indicator")
    return d.select("l_orderkey", "l_linenumber", F.col("zz_outlier").alias("z"), F.col("mm_outlier").alias("m"), F.col("pp_outlier").alias("p"))


@query("segment_outliers", "p_type rows global_outliers segment_outliers false_outliers", "", """
  select p.p_type, count(*) as rows, count(*) filter (where not x between gl and gh) as global_outliers, count(*) filter (where not x between sl and sh) as segment_outliers, count(*) filter (where not x between gl and gh and x between sl and sh) as false_outliers
  from (select p_type, p_retailprice * p_size as x from part) p, (select q1 - 1.5 * (q3 - q1) as gl, q3 + 1.5 * (q3 - q1) as gh from (select quantile_cont(p_retailprice * p_size, 0.25) as q1, quantile_cont(p_retailprice * p_size, 0.75) as q3 from part)),
    (select p_type, q1 - 1.5 * (q3 - q1) as sl, q3 + 1.5 * (q3 - q1) as sh from (select p_type, quantile_cont(p_retailprice * p_size, 0.25) as q1, quantile_cont(p_retailprice * p_size, 0.75) as q3 from part group by 1)) s
  where p.p_type = s.p_type group by 1""")
def _segment_outliers(t: Tables) -> DataFrame:
    return cleaning.segment_outliers(t.part.withColumn("x", F.col("p_retailprice") * F.col("p_size")), "x", "p_type")


@query("deduplicate_keep_last", "o_orderkey o_custkey", "o_totalprice", "select o_orderkey, o_custkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) where r = 1")
def _keep_last(t: Tables) -> DataFrame:
    return cleaning.keep_last(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("duplicate_keys", "l_orderkey rows conflicting_columns", "", """
  select l_orderkey, count(*) as rows, cast(count(distinct l_partkey) > 1 as int) + cast(count(distinct l_returnflag) > 1 as int) as conflicting_columns from lineitem group by 1 having count(*) > 1""")
def _duplicates(t: Tables) -> DataFrame:
    return cleaning.duplicate_keys(t.lineitem.select("l_orderkey", "l_partkey", "l_returnflag"), ["l_orderkey"])


@query("scale_columns", "c_custkey", "standard minmax robust maxabs", """
  select c_custkey, (c_acctbal - m) / s as standard, (c_acctbal - lo) / (hi - lo) as minmax, (c_acctbal - md) / (q3 - q1) as robust, c_acctbal / ma as maxabs
  from customer, (select avg(c_acctbal) as m, stddev_pop(c_acctbal) as s, min(c_acctbal) as lo, max(c_acctbal) as hi, quantile_cont(c_acctbal, 0.5) as md, quantile_cont(c_acctbal, 0.25) as q1, quantile_cont(c_acctbal, 0.75) as q3, max(abs(c_acctbal)) as ma from customer)""")
def _scale(t: Tables) -> DataFrame:
    methods = ("standard", "minmax", "robust", "maxabs")
    d = t.customer.select("c_custkey", *[F.col("c_acctbal").alias(m) for m in methods])
    for m in methods:
        d = transforms.fit_scaler(d, [m], m).transform(d)
    return d


@query("power_transforms", "p_partkey", "a b c yj", "select p_partkey, ln(p_retailprice) as a, ln(1 + p_retailprice) as b, sqrt(p_retailprice) as c, (power(p_retailprice + 1, 0.5) - 1) / 0.5 as yj from part")
def _power(t: Tables) -> DataFrame:
    d = t.part.select("p_partkey", *[F.col("p_retailprice").alias(x) for x in "abc"], transforms.yeo_johnson(F.col("p_retailprice"), 0.5).alias("yj"))
    return transforms.power(transforms.power(transforms.power(d, "a", "log"), "b", "log1p"), "c", "sqrt")


@query("date_parts", "o_orderkey year month day day_of_week day_of_year week_of_year quarter hour minute is_weekend is_month_start is_month_end is_quarter_start is_quarter_end", "month_sin month_cos", """
  select o_orderkey, year(d) as year, month(d) as month, day(d) as day, isodow(d) - 1 as day_of_week, dayofyear(d) as day_of_year, weekofyear(d) as week_of_year, quarter(d) as quarter, hour(d) as hour, minute(d) as minute, cast(isodow(d) >= 6 as int) as is_weekend, cast(day(d) = 1 as int) as is_month_start,
    cast(month(d + interval 1 day) <> month(d) as int) as is_month_end, cast(d = date_trunc('quarter', d) as int) as is_quarter_start, cast(quarter(d + interval 1 day) <> quarter(d) as int) as is_quarter_end, sin(2 * pi() * month(d) / 12) as month_sin, cos(2 * pi() * month(d) / 12) as month_cos
  from (select o_orderkey, o_orderdate as d from orders)""")
def _date_parts(t: Tables) -> DataFrame:
    d = t.orders.select("o_orderkey", *[c.alias(n) for n, c in transforms.date_parts(F.col("o_orderdate")).items()])
    sin, cos = transforms.cyclical(F.col("month"), 12)
    return d.withColumns({"month_sin": sin, "month_cos": cos})


@query("encoders", "c_custkey c_mktsegment label c_mktsegment_BUILDING c_mktsegment_HOUSEHOLD", "frequency target", """
  select c_custkey, c.c_mktsegment, cast(label as int) as label, cast(c.c_mktsegment = 'BUILDING' as int) as "c_mktsegment_BUILDING", cast(c.c_mktsegment = 'HOUSEHOLD' as int) as "c_mktsegment_HOUSEHOLD", n / t as frequency, (s + 10 * m) / (n + 10) as target
  from customer c join (select c_mktsegment, count(*)::double as n, sum(c_acctbal) as s, row_number() over (order by c_mktsegment) - 1 as label from customer group by 1) g on c.c_mktsegment = g.c_mktsegment, (select count(*)::double as t, avg(c_acctbal) as m from customer)""")
def _encode(t: Tables) -> DataFrame:
    d = t.customer.withColumns({"label": F.col("c_mktsegment"), "frequency": F.col("c_mktsegment"), "target": F.col("c_mktsegment"), "kept": F.col("c_mktsegment")})
    for kind in ("label", "frequency", "target"):
        d = transforms.fit_encoder(d, kind, kind, "c_acctbal" if kind == "target" else None).transform(d)
    return transforms.fit_encoder(d, "c_mktsegment", "one_hot").transform(d).withColumnRenamed("kept", "c_mktsegment")


@query("encode_by_join", "l_orderkey l_linenumber", "l_partkey_target l_partkey_frequency", """
  select l_orderkey, l_linenumber, (s + 10 * m) / (n + 10) as l_partkey_target, n / t as l_partkey_frequency from lineitem l join (select l_partkey, count(*)::double as n, sum(l_discount) as s from lineitem group by 1) g on l.l_partkey = g.l_partkey, (select count(*)::double as t, avg(l_discount) as m from lineitem)""")
def _encode_join(t: Tables) -> DataFrame:
    return transforms.encode_by_join(transforms.encode_by_join(t.lineitem, "l_partkey", "target", "l_discount"), "l_partkey", "frequency")


@query("interactions", "l_orderkey l_linenumber", "l_extendedprice_ratio_l_tax l_quantity_product_l_discount l_discount_sum_l_tax l_discount_difference_l_tax", """
  select l_orderkey, l_linenumber, case when l_tax <> 0 then l_extendedprice / l_tax end as l_extendedprice_ratio_l_tax, l_quantity * l_discount as l_quantity_product_l_discount, l_discount + l_tax as l_discount_sum_l_tax, l_discount - l_tax as l_discount_difference_l_tax from lineitem""")
def _interactions(t: Tables) -> DataFrame:
    return transforms.interactions(t.lineitem, [("ratio", "l_extendedprice", "l_tax"), ("product", "l_quantity", "l_discount"), ("sum", "l_discount", "l_tax"), ("difference", "l_discount", "l_tax")])


@query("consistent_text", "p_partkey p_name p_type p_brand", "", "select p_partkey, lower(trim(p_name)) as p_name, lower(trim(p_type)) as p_type, upper(trim(p_brand)) as p_brand from part")
def _consistent(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", transforms.consistent(F.col("p_name")).alias("p_name"), transforms.consistent(F.col("p_type")).alias("p_type"), transforms.consistent(F.col("p_brand"), "upper").alias("p_brand"))


# Profiles and checks

_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("profile_universal", "column rows nulls distinct", "null_pct distinct_pct", "\n union all ".join(f"""select '{c}' as "column", count(*) as rows, count(*) - count({c}) as nulls, count(distinct {c}) as "distinct", 100.0 * (count(*) - count({c})) / count(*) as null_pct, 100.0 * count(distinct {c}) / count({c}) as distinct_pct from customer""" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")))
def _universal(t: Tables) -> DataFrame:
    return profiling.universal(t.customer)


@query("profile_numeric", "column n zeros negatives infinite iqr_outliers z_outliers", "mean std min q25 q50 q75 max skewness kurtosis", "\n union all ".join(f"""
  select '{c}' as "column", count({c}) as n, count(*) filter (where {c} = 0) as zeros, count(*) filter (where {c} < 0) as negatives, count(*) filter (where isinf({c})) as infinite, count(*) filter (where {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) as iqr_outliers, count(*) filter (where abs({c} - m) > 3 * s) as z_outliers,
    avg({c}) as mean, stddev_samp({c}) as std, min({c}) as min, quantile_cont({c}, 0.25) as q25, quantile_cont({c}, 0.5) as q50, quantile_cont({c}, 0.75) as q75, max({c}) as max, skewness({c}) as skewness, kurtosis({c}) as kurtosis
  from lineitem, (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3, avg({c}) as m, stddev_samp({c}) as s from lineitem)""" for c in _NUM))
def _numeric(t: Tables) -> DataFrame:
    return profiling.numeric(t.lineitem, _NUM)


@query("histogram", "bin n", "", "select cast(least(floor((o_totalprice - lo) / (hi - lo) * 10), 9) as int) as bin, count(*) as n from orders, (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders) group by 1")
def _histogram(t: Tables) -> DataFrame:
    return profiling.histogram(t.orders, "o_totalprice")


@query("top_values", "value n", "", "select p_brand as value, count(*) as n from part group by 1 order by n desc, value limit 10")
def _top(t: Tables) -> DataFrame:
    return profiling.top_values(t.part, "p_brand")


@query("profile_categorical", "cardinality rare_categories unknown_tokens padded_values case_variants", "entropy top_share rare_pct", """
  select count(*) as cardinality, count(*) filter (where p < 0.01) as rare_categories, count(*) filter (where lower(v) in ('unknown', 'n/a', 'na', 'none', 'null', 'missing', 'undefined', '?', '-')) as unknown_tokens, count(*) filter (where v <> trim(v)) as padded_values, cast(0 as bigint) as case_variants,
    -sum(p * log2(p)) as entropy, max(p) as top_share, 100 * coalesce(sum(p) filter (where p < 0.01), 0) as rare_pct from (select p_name as v, count(*) / (select count(*)::double from part) as p from part group by 1)""")
def _categorical(t: Tables) -> DataFrame:
    return profiling.categorical(t.part, "p_name")


@query("profile_text", "n min_length max_length empty with_email with_phone with_ssn", "mean_length mean_words", r"""
  select count(text) as n, min(length(text)) as min_length, max(length(text)) as max_length, count(*) filter (where trim(text) = '') as empty, count(*) filter (where regexp_matches(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')) as with_email, count(*) filter (where regexp_matches(text, '\b\d{3}[-.]?\d{3}[-.]?\d{4}\b')) as with_phone,
    count(*) filter (where regexp_matches(text, '\b\d{3}-\d{2}-\d{4}\b')) as with_ssn, avg(length(text)) as mean_length, avg(len(string_split(text, ' '))) as mean_words from documents""")
def _text(t: Tables) -> DataFrame:
    return profiling.text(t.documents, "text")


@query("profile_identifier", "n distinct duplicated_values min_length max_length nulls", "", """
  select cast(sum(n) as bigint) as n, count(*) as "distinct", count(*) filter (where n > 1) as duplicated_values, min(length(v)) as min_length, max(length(v)) as max_length, cast(0 as bigint) as nulls from (select cast(o_custkey as varchar) as v, count(*) as n from orders group by 1)""")
def _identifier(t: Tables) -> DataFrame:
    return profiling.identifier(t.orders, "o_custkey")


@query("profile_target", "classes minority", "minority_pct imbalance_ratio", """
  select count(*) as classes, arg_min(c, n) as minority, 100.0 * min(n) / sum(n) as minority_pct, max(n) / min(n)::double as imbalance_ratio from (select cast(toxic as varchar) as c, count(*) as n from labels group by 1)""")
def _target(t: Tables) -> DataFrame:
    return profiling.target(t.labels, "toxic")


@query("profile_datetime", "n first last future placeholders", "weekend_share", f"""
  select count(ts) as n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last, count(*) filter (where ts > timestamp '2024-01-20') as future, cast(0 as bigint) as placeholders, avg(case when isodow(ts) >= 6 then 1.0 else 0.0 end) as weekend_share from events""")
def _datetime(t: Tables) -> DataFrame:
    return profiling.datetimes(t.events, "ts", F.lit("2024-01-20").cast("timestamp"))


@query("quality_checks", "column check_id severity passed", "", """
  with p as (select count(*) as n, count(*) filter (where x < q1 - 1.5 * (q3 - q1) or x > q3 + 1.5 * (q3 - q1)) as o, count(*) filter (where x = 0) as z, count(*) filter (where x < 0) as neg, count(*) filter (where x = floor(x)) as w, skewness(x) as sk, stddev_samp(x) as sd
    from (select p_retailprice * p_size * p_size as x from part), (select quantile_cont(p_retailprice * p_size * p_size, 0.25) as q1, quantile_cont(p_retailprice * p_size * p_size, 0.75) as q3 from part))
  select 'x' as "column", c.check_id, c.severity, c.passed from p, unnest([
    {'check_id': 'NC001', 'severity': 'high', 'passed': not 100.0 * o / n > 5}, {'check_id': 'NC002', 'severity': 'medium', 'passed': not 100.0 * o / n > 1}, {'check_id': 'NC003', 'severity': 'medium', 'passed': not abs(sk) > 2}, {'check_id': 'NC004', 'severity': 'medium', 'passed': not 100.0 * z / n > 50},
    {'check_id': 'NC005', 'severity': 'high', 'passed': not neg > 0}, {'check_id': 'NC006', 'severity': 'critical', 'passed': true}, {'check_id': 'NC007', 'severity': 'high', 'passed': not sd = 0}, {'check_id': 'NUM002', 'severity': 'medium', 'passed': not abs(sk) > 1}, {'check_id': 'NUM003', 'severity': 'medium', 'passed': not 100.0 * o / n > 5},
    {'check_id': 'NUM004', 'severity': 'low', 'passed': not 100.0 * z / n > 50}, {'check_id': 'FQ005', 'severity': 'high', 'passed': not 100.0 * o / n > 50}, {'check_id': 'FQ011', 'severity': 'critical', 'passed': not o = n}, {'check_id': 'NC008', 'severity': 'low', 'passed': not (n > 10 and w = n)}]) u(c)""")
def _checks(t: Tables) -> DataFrame:
    d = t.part.select((F.col("p_retailprice") * F.col("p_size") * F.col("p_size")).alias("x"))
    return profiling.run_checks(profiling.numeric(d, ["x"]), "numeric")


@query("similar_values", "a b", "similarity", """
  select a.v as a, b.v as b, 1 - levenshtein(a.v, b.v) / greatest(length(a.v), length(b.v))::double as similarity from (select p_brand as v from part group by 1 order by count(*) desc, v limit 100) a, (select p_brand as v from part group by 1 order by count(*) desc, v limit 100) b
  where a.v < b.v and 1 - levenshtein(a.v, b.v) / greatest(length(a.v), length(b.v))::double > 0.8""")
def _similar(t: Tables) -> DataFrame:
    return profiling.similar_values(t.part, "p_brand")


@query("granularity", "rows entities granularity", "rows_per_entity", "select count(*) as rows, count(distinct user_id) as entities, case when count(*) / count(distinct user_id)::double > 1.5 then 'event' else 'entity' end as granularity, count(*) / count(distinct user_id)::double as rows_per_entity from events")
def _granularity(t: Tables) -> DataFrame:
    return profiling.granularity(t.events, "user_id")


@query("date_order", "pair both violations", "", "select 'o_orderdate <= l_shipdate' as pair, count(*) as both, count(*) filter (where o_orderdate > l_shipdate) as violations from orders join lineitem on o_orderkey = l_orderkey")
def _date_order(t: Tables) -> DataFrame:
    d = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return validation.date_order(d, ["o_orderdate", "l_shipdate"])


@query("range_rules", "column n violations", "", "\n union all ".join(f"""select '{c}' as "column", count({c}) as n, count(*) filter (where not ({rule})) as violations from lineitem""" for c, rule in (("l_discount", "l_discount between 0 and 1"), ("l_quantity", "l_quantity between 5 and 45"), ("l_tax", "l_tax >= 0"), ("l_linenumber", "l_linenumber in (0, 1)"))))
def _ranges(t: Tables) -> DataFrame:
    return validation.ranges(t.lineitem, {"l_discount": "fraction", "l_quantity": (5, 45), "l_tax": "non_negative", "l_linenumber": "binary"})


_GATED = """(select o_orderkey, o_custkey, o_orderdate, case when o_orderkey % 5 > 1 then 1 end as half, case when o_orderkey % 5 > 2 then 1 end as most, cast(o_custkey as varchar) as number,
  o_orderdate + case when o_orderkey % 3 = 0 then interval 1 day else interval (-1) day end as created, o_orderdate as firstorder, case when o_orderkey % 97 > 0 then cast(o_orderkey % 20 = 0 as int) end as y from orders)"""


@query("quality_gate", "check_id subject severity affected total", "", f"""
  with d as {_GATED}, t as (select count(*) as total from d)
  select case when n / total::double > 0.5 then 'DQ001' else 'DQ002' end as check_id, subject, case when n / total::double > 0.5 then 'critical' else 'high' end as severity, n as affected, total
  from (select 'half' as subject, count(*) filter (where half is null) as n from d union all select 'most', count(*) filter (where most is null) from d), t where n / total::double > 0.3
  union all select case when a / total::double > 0.1 then 'DQ011' else 'DQ012' end, 'o_custkey', case when a / total::double > 0.1 then 'high' else 'medium' end, a, total from (select cast(sum(n - 1) as bigint) as a from (select count(*) as n from d group by o_custkey)), t where a > 0
  union all select 'DQ021', 'y', 'critical', n, total from (select count(*) filter (where y is null) as n from d), t where n > 0
  union all select case when n / total::double < 0.01 then 'DQ022' else 'DQ023' end, 'y', case when n / total::double < 0.01 then 'high' else 'medium' end, n, total from (select min(k) as n, count(*) as c from (select count(*) as k from d where y is not null group by y)), t where c > 1 and n / total::double < 0.1
  union all select 'DQ030', 'o_orderdate', 'high', n, total from (select count(*) filter (where o_orderdate > timestamp '2001-01-01') as n from d), t where n > 0
  union all select 'DQ031', 'created,firstorder', 'high', n, total from (select count(*) filter (where created > firstorder) as n from d), t where n > 0
  union all select 'DQ040', 'number', 'medium', total, total from t""")
def _gate(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    d = t.orders.select(
        "o_orderkey", "o_custkey", "o_orderdate", F.when(k % 5 > 1, 1).alias("half"), F.when(k % 5 > 2, 1).alias("most"), F.col("o_custkey").cast("string").alias("number"),
        F.when(k % 3 == 0, F.col("o_orderdate") + F.expr("interval 1 day")).otherwise(F.col("o_orderdate") - F.expr("interval 1 day")).alias("created"), F.col("o_orderdate").alias("firstorder"), F.when(k % 97 > 0, (k % 20 == 0).cast("int")).alias("y"),
    )
    return gates.data_quality(d, ["o_custkey"], "y", ["o_orderdate"], ["number"], F.lit("2001-01-01").cast("timestamp"))


@query("temporal_quality", "check_id violations n", "share", """
  select 'TQ001' as check_id, cast(sum(k - 1) as bigint) as violations, cast(sum(k) as bigint) as n, sum(k - 1) / sum(k)::double as share from (select count(*) as k from orders group by o_custkey, o_orderdate)
  union all select 'TQ003', count(*) filter (where o_orderdate > timestamp '2001-01-01'), count(*), count(*) filter (where o_orderdate > timestamp '2001-01-01') / count(*)::double from orders
  union all select 'TQ004', count(*) filter (where b), count(*), count(*) filter (where b) / count(*)::double from (select o_orderdate < lag(o_orderdate) over (partition by o_custkey order by o_orderkey) as b from orders)""")
def _temporal_quality(t: Tables) -> DataFrame:
    return validation.temporal_quality(t.orders, "o_custkey", "o_orderdate", F.lit("2001-01-01").cast("timestamp"), "o_orderkey")


@query("time_gaps", "gap_start gap_end days", "", """
  select cast(b as varchar) as gap_start, cast(d as varchar) as gap_end, cast(d - b as int) as days from (select d, lag(d) over (order by d) as b from (select distinct cast(o_orderdate as date) as d from orders where month(o_orderdate) <> 3 or day(o_orderdate) > 9)) where d - b > 3""")
def _gaps(t: Tables) -> DataFrame:
    spring = (F.month("o_orderdate") == 3) & (F.dayofmonth("o_orderdate") <= 9)
    return validation.gap_islands(t.orders.withColumn("o_orderdate", F.when(~spring, F.col("o_orderdate"))), "o_orderdate")


@query("series_shape", "rows entities frequency kind", "median_gap_hours rows_per_entity", """
  select rows, entities, case when h is null then 'none' when h <= 2 then 'hourly' when h <= 36 then 'daily' when h <= 240 then 'weekly' when h <= 1080 then 'monthly' else 'irregular' end as frequency, case when rows / entities::double <= 1 then 'snapshot' else 'events' end as kind, h as median_gap_hours, rows / entities::double as rows_per_entity
  from (select count(*) as rows, count(distinct user_id) as entities, quantile_cont(g, 0.5) as h from (select user_id, (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts))) / 3600000000.0 as g from events))""")
def _shape(t: Tables) -> DataFrame:
    return validation.series_shape(t.events, "user_id", "ts")


@query("leakage_checks", "feature separated severity", "correlation overlap_pct", "\n union all ".join(f"""
  select '{c}' as feature, l1 > h0 or l0 > h1 as separated, case when abs(r) >= 0.9 or l1 > h0 or l0 > h1 then 'critical' when abs(r) >= 0.7 then 'high' else 'none' end as severity, r as correlation, coalesce(100 * greatest(0.0, least(h1, h0) - greatest(l1, l0)) / nullif(greatest(h1, h0) - least(l1, l0), 0), 100.0) as overlap_pct
  from (select corr({c}, y) as r, min(case when y = 1 then {c} end)::double as l1, max(case when y = 1 then {c} end)::double as h1, min(case when y = 0 then {c} end)::double as l0, max(case when y = 0 then {c} end)::double as h0 from (select *, case when l_quantity > 25 then 1 else 0 end as y from lineitem))""" for c in ("l_quantity", "l_extendedprice", "l_discount")))
def _leakage(t: Tables) -> DataFrame:
    return validation.leakage(t.lineitem.withColumn("y", (F.col("l_quantity") > 25).cast("int")), ["l_quantity", "l_extendedprice", "l_discount"], "y")


_AUC = "select sum(p * (r - q / 2.0)) / (sum(p) * sum(q)) as a from (select p, q, sum(q) over (order by x) as r from (select {x} as x, sum(case when y = 1 then 1 else 0 end) as p, sum(case when y = 0 then 1 else 0 end) as q from {t} group by 1))"
_SCORED = "(select l.doc_id, quality as y, toxic, lang, n_chars % 101 / 101.0 as p, n_chars from labels l join documents d on l.doc_id = d.doc_id) s"


def _scored(t: Tables) -> DataFrame:
    """A truth and a score that is a plain function of the row."""
    d = t.labels.join(t.documents, "doc_id")
    return d.select("doc_id", F.col("quality").alias("y"), "toxic", "lang", (F.col("n_chars") % 101 / 101.0).alias("p"), "n_chars")


@query("feature_auc", "", "auc", f"select greatest(a, 1 - a) as auc from ({_AUC.format(x='n_chars', t=_SCORED)})")
def _feature_auc(t: Tables) -> DataFrame:
    return validation.feature_auc(_scored(t), "n_chars", "y")


@query("quality_score", "grade", "completeness uniqueness score", """
  select case when s >= 90 then 'A' when s >= 70 then 'B' when s >= 50 then 'C' else 'D' end as grade, c as completeness, u as uniqueness, s as score from (select c, u, 100 * (0.6 * c + 0.4 * u) as s from (select 1.0 as c), (select count(distinct o_custkey) / count(*)::double as u from orders))""")
def _score(t: Tables) -> DataFrame:
    return validation.quality_score(t.orders, ["o_custkey"])


# Statistics

_EDGES = [0.0, 50_000.0, 100_000.0, 200_000.0, 300_000.0, 500_000.0]


def _halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.orders.where("o_orderdate < '1998-01-01'"), t.orders.where("o_orderdate >= '1998-01-01'")


_A, _B = "(select * from orders where o_orderdate < timestamp '1998-01-01')", "(select * from orders where o_orderdate >= timestamp '1998-01-01')"


def _psi_sql(key: str, spine: str, p: str) -> str:
    return f"""select sum((q - p) * ln(q / p)) as psi from (select {p.format(n='a.n', t='a.t')} as p, {p.format(n='b.n', t='b.t')} as q from ({spine}) s left join (select k, n, sum(n) over () as t from (select {key} as k, count(*) as n from {_A} group by 1) where k is not null) a on s.k = a.k
      left join (select k, n, sum(n) over () as t from (select {key} as k, count(*) as n from {_B} group by 1) where k is not null) b on s.k = b.k)"""


_BINS = "case " + " ".join(f"when o_totalprice >= {a} and o_totalprice {'<=' if i == len(_EDGES) - 2 else '<'} {b} then {i}" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:], strict=False))) + " end"


@query("psi_numeric", "", "psi", _psi_sql(_BINS, "select unnest(range(5)) as k", "greatest(coalesce({n} / {t}::double, 0.0), 0.0001)"))
def _psi(t: Tables) -> DataFrame:
    return stats.psi_numeric(*_halves(t), "o_totalprice", _EDGES)


@query("psi_even", "", "psi", _psi_sql("least(cast(floor((o_totalprice - (select min(o_totalprice) from orders)) / ((select max(o_totalprice) - min(o_totalprice) from orders) / 10)) as int), 9)", "select unnest(range(10)) as k", "coalesce({n} / {t}::double, 0.0) + 0.000001"))
def _psi_even(t: Tables) -> DataFrame:
    return stats.psi_even(*_halves(t), "o_totalprice")


@query("psi_categorical", "", "psi", _psi_sql("o_orderpriority", "select distinct o_orderpriority as k from orders", "greatest(coalesce({n} / {t}::double, 0.0), 0.0001)"))
def _psi_categorical(t: Tables) -> DataFrame:
    return stats.psi_categorical(*_halves(t), "o_orderpriority")


@query("ks_two_sample", "n_a n_b", "ks", f"""
  select max(abs(ra / na::double - rb / nb::double)) as ks, cast(max(na) as bigint) as n_a, cast(max(nb) as bigint) as n_b from (select sum(a) over (order by x) as ra, sum(b) over (order by x) as rb, sum(a) over () as na, sum(b) over () as nb from (
    select o_totalprice as x, sum(case when o_orderdate < timestamp '1998-01-01' then 1 else 0 end) as a, sum(case when o_orderdate >= timestamp '1998-01-01' then 1 else 0 end) as b from orders group by 1))""")
def _ks(t: Tables) -> DataFrame:
    return stats.ks(*_halves(t), "o_totalprice")


@query("cohens_d", "", "cohens_d", "select (avg(a) - avg(b)) / sqrt((var_pop(a) + var_pop(b)) / 2) as cohens_d from (select case when o_orderstatus = 'F' then o_totalprice end as a, case when o_orderstatus = 'O' then o_totalprice end as b from orders)")
def _cohen(t: Tables) -> DataFrame:
    return stats.cohens_d(t.orders, "o_totalprice", "o_orderstatus", "F", "O")


@query("cohens_d_pooled", "", "cohens_d", "select (avg(b) - avg(a)) / sqrt(((count(a) - 1) * var_samp(a) + (count(b) - 1) * var_samp(b)) / (count(a) + count(b) - 2)) as cohens_d from (select case when o_orderstatus = 'F' then o_totalprice end as a, case when o_orderstatus = 'O' then o_totalprice end as b from orders)")
def _cohen_pooled(t: Tables) -> DataFrame:
    return stats.cohens_d(t.orders, "o_totalprice", "o_orderstatus", "F", "O", pooled=True)


def _cramer_sql(x: str, y: str, table: str, two: bool) -> str:
    d = "abs(coalesce(n, 0) - e)"
    d = f"({d} - least(0.5, {d}))" if two else d
    return f"""select chi2, sqrt(chi2 / (t * (least(r, c) - 1))) as cramers_v, (r - 1) * (c - 1) as dof from (select sum({d} * {d} / e) as chi2, max(t) as t, max(r) as r, max(c) as c from (
      select n, nx * ny / t as e, t, r, c from (select {x} as x, count(*)::double as nx from {table} group by 1) a cross join (select {y} as y, count(*)::double as ny from {table} group by 1) b
      left join (select {x} as x, {y} as y, count(*) as n from {table} group by 1, 2) g on g.x = a.x and g.y = b.y cross join (select count(*)::double as t, count(distinct {x}) as r, count(distinct {y}) as c from {table}) z))"""


@query("cramers_v", "dof", "chi2 cramers_v", _cramer_sql("o_orderstatus", "o_orderpriority", "orders", False))
def _cramer(t: Tables) -> DataFrame:
    return stats.cramers_v(t.orders, "o_orderstatus", "o_orderpriority")


@query("cramers_v_two_by_two", "dof", "chi2 cramers_v", _cramer_sql("quality", "toxic", "labels", True))
def _cramer_two(t: Tables) -> DataFrame:
    return stats.cramers_v(t.labels, "quality", "toxic")


@query("chi_square_proportions", "dof", "chi2", "select sum(power(coalesce(n, 0) - p * t, 2) / (p * t)) as chi2, count(*) - 1 as dof from (values ('F', 0.3), ('O', 0.4), ('P', 0.3)) w(k, p) left join (select o_orderstatus as k, count(*) as n from orders group by 1) s on w.k = s.k, (select count(*) as t from orders where o_orderstatus in ('F', 'O', 'P'))")
def _chi(t: Tables) -> DataFrame:
    return stats.chi_square_proportions(t.orders, "o_orderstatus", {"F": 0.3, "O": 0.4, "P": 0.3})


@query("information_value", "bins", "information_value", f"""
  select count(*) as bins, sum((p - q) * ln(p / q)) as information_value from (select case when a = 0 then 0.0001 else a / na end as p, case when b = 0 then 0.0001 else b / nb end as q from (
    select sum(y)::double as a, sum(1 - y)::double as b, sum(sum(y)) over ()::double as na, sum(sum(1 - y)) over ()::double as nb from (
      select y, len(list_filter(e[2:10], lambda v: n_chars > v)) as bin from {_SCORED}, (select list_sort(list_distinct(quantile_cont(n_chars, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) as e from {_SCORED}) z) group by bin))""")
def _iv(t: Tables) -> DataFrame:
    return stats.information_value(_scored(t), "n_chars", "y")


@query("correlations", "x y", "correlation", "\n union all ".join(f"select '{a}' as x, '{b}' as y, corr({a}, {b}) as correlation from lineitem" for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]))
def _correlations(t: Tables) -> DataFrame:
    return stats.correlations(t.lineitem, _NUM)


@query("drift_summary", "column", "mean_shift variance_ratio missing_change", f"""
  select 'o_totalprice' as "column", (bm - am) / a_sd as mean_shift, b_sd * b_sd / (a_sd * a_sd) as variance_ratio, 0.0 as missing_change from (select avg(o_totalprice) as am, stddev_samp(o_totalprice) as a_sd from {_A}), (select avg(o_totalprice) as bm, stddev_samp(o_totalprice) as b_sd from {_B})""")
def _drift(t: Tables) -> DataFrame:
    return stats.drift_summary(*_halves(t), ["o_totalprice"])


# Segments


@query("behaviour_features", "o_custkey tenure_days days_since_last_order active_period_days recency_bucket tenure_bucket", "account_age_months order_frequency recency_ratio", f"""
  select o_custkey, tenure_days, days_since_last_order, active_period_days, case when days_since_last_order <= 7 then '0-7d' when days_since_last_order <= 30 then '8-30d' when days_since_last_order <= 90 then '31-90d' when days_since_last_order <= 180 then '91-180d' else '180d+' end as recency_bucket,
    case when tenure_days <= 90 then 'new' when tenure_days <= 180 then 'developing' when tenure_days <= 365 then 'established' else 'mature' end as tenure_bucket, tenure_days / 30.44 as account_age_months, n / (tenure_days / 30.44) as order_frequency, days_since_last_order / tenure_days::double as recency_ratio
  from (select o_custkey, count(*) as n, {_days(f'''timestamp '{ORDERS_REF}' ''', 'min(o_orderdate)')} as tenure_days, {_days(f'''timestamp '{ORDERS_REF}' ''', 'max(o_orderdate)')} as days_since_last_order, {_days('max(o_orderdate)', 'min(o_orderdate)')} as active_period_days from orders group by 1)""")
def _behaviour(t: Tables) -> DataFrame:
    d = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.count("*").alias("orders"))
    return segments.behaviour(d, "first", "first", "last", "orders", F.lit(ORDERS_REF).cast("timestamp"))


_RFM = "(select o_custkey, sum(o_totalprice) as v, count(*) as f from orders group by 1)"


@query("value_frequency_segments", "o_custkey segment", "", f"""
  select o_custkey, case when v >= mv and f >= mf then 'High_Value_Frequent' when v >= mv then 'High_Value_Infrequent' when f >= mf then 'Low_Value_Frequent' else 'Low_Value_Infrequent' end as segment from {_RFM}, (select quantile_cont(v, 0.5) as mv, quantile_cont(f, 0.5) as mf from {_RFM})""")
def _value_frequency(t: Tables) -> DataFrame:
    d = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"), F.count("*").alias("f"))
    return segments.value_frequency(d, "v", "f")


@query("cohort_retention", "cohort_day n active", "retention", """
  select cast(c as varchar) as cohort_day, datediff('day', c, d) as n, count(*) as active, count(*) / max(s)::double as retention from (select user_id, d, min(d) over (partition by user_id) as c from (select distinct user_id, cast(ts as date) as d from events)) join (select c as k, count(*) as s from (select min(cast(ts as date)) as c from events group by user_id) group by 1) on c = k group by 1, 2""")
def _cohorts(t: Tables) -> DataFrame:
    return segments.cohorts(t.events, "user_id", "ts", "day").withColumn("cohort_day", F.date_format("cohort", "yyyy-MM-dd"))


@query("category_target_rates", "lang n retained", "rate lift share", f"""
  select * from (select lang, n, retained, retained / n::double as rate, (retained / n::double) / (sum(retained) over () / sum(n) over ()) as lift, n / (sum(n) over ())::double as share from (select lang, count(*) as n, cast(sum(y) as bigint) as retained from {_SCORED} group by 1)) where n >= 10""")
def _category_rates(t: Tables) -> DataFrame:
    return segments.category_rates(_scored(t), "lang", "y")


@query("period_target_rates", "part value n", "rate", "\n union all ".join(f"select '{n}' as part, {e} as value, count(*) as n, avg(case when o_orderstatus = 'F' then 1.0 else 0.0 end) as rate from orders group by 2 {'' if n == 'day_of_week' else 'having count(*) >= 10'}" for n, e in (("year", "year(o_orderdate)"), ("month", "month(o_orderdate)"), ("quarter", "quarter(o_orderdate)"), ("day_of_week", "isodow(o_orderdate) - 1"))))
def _period_rates(t: Tables) -> DataFrame:
    return segments.period_rates(t.orders.withColumn("y", (F.col("o_orderstatus") == "F").cast("int")), "o_orderdate", "y")


@query("target_level", "level", "varying", "select case when v < 0.05 then 'entity' else 'event' end as level, v as varying from (select avg(case when k > 1 then 1.0 else 0.0 end) as v from (select count(distinct o_orderstatus) as k from orders group by o_custkey))")
def _target_level(t: Tables) -> DataFrame:
    return segments.target_level(t.orders, "o_custkey", "o_orderstatus")


@query("window_coverage", "days entities", "coverage", "\n union all ".join(f"select {w} as days, count(distinct user_id) filter (where a >= 0 and a < {w}) as entities, count(distinct user_id) filter (where a >= 0 and a < {w}) / count(distinct user_id)::double as coverage from (select user_id, {_days(f'''timestamp '{REF}' ''', 'ts')} as a from events)" for w in (1, 7, 30)))
def _coverage(t: Tables) -> DataFrame:
    return segments.coverage(t.events, "user_id", "ts", [1, 7, 30], F.lit(REF).cast("timestamp"))


@query("feature_availability", "column first_day last_day", "share", """select 'value' as "column", cast(min(cast(ts as date)) filter (where event_type = 'signup') as varchar) as first_day, cast(max(cast(ts as date)) filter (where event_type = 'signup') as varchar) as last_day, count(*) filter (where event_type = 'signup') / count(*)::double as share from events""")
def _availability(t: Tables) -> DataFrame:
    return segments.availability(t.events.withColumn("value", F.when(F.col("event_type") == "signup", F.col("value"))), "ts", ["value"])


# Models


@query("evaluation", "", "tp fp fn tn accuracy precision recall f1 balanced_accuracy brier log_loss", f"""
  select tp, fp, fn, tn, (tp + tn) / (tp + fp + fn + tn) as accuracy, tp / nullif(tp + fp, 0) as precision, tp / nullif(tp + fn, 0) as recall, 2 * tp / nullif(2 * tp + fp + fn, 0) as f1, (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 as balanced_accuracy, brier, log_loss
  from (select count(*) filter (where y = 1 and p >= 0.5)::double as tp, count(*) filter (where y <> 1 and p >= 0.5)::double as fp, count(*) filter (where y = 1 and p < 0.5)::double as fn, count(*) filter (where y <> 1 and p < 0.5)::double as tn, avg(power(p - y, 2)) as brier,
    avg(-case when y = 1 then ln(greatest(1e-15, least(1 - 1e-15, p))) else ln(1 - greatest(1e-15, least(1 - 1e-15, p))) end) as log_loss from {_SCORED})""")
def _evaluation(t: Tables) -> DataFrame:
    return modeling.confusion(_scored(t), "y", "p")


@query("ranking_metrics", "", "roc_auc average_precision", f"""
  select (select a from ({_AUC.format(x='p', t=_SCORED)})) as roc_auc, sum(a * (ra / (ra + rb)::double)) / sum(a) as average_precision
  from (select a, sum(a) over (order by p desc) as ra, sum(b) over (order by p desc) as rb from (select p, sum(case when y = 1 then 1 else 0 end) as a, sum(case when y = 0 then 1 else 0 end) as b from {_SCORED} group by 1))""")
def _ranking(t: Tables) -> DataFrame:
    return modeling.ranking(_scored(t), "y", "p")


@query("lift_and_gain", "percent", "lift gain", "\n union all ".join(f"select {k} as percent, (sum(y) filter (where r <= floor(n * {k} / 100.0)) / count(*) filter (where r <= floor(n * {k} / 100.0))) / (sum(y) / max(n)::double) as lift, sum(y) filter (where r <= floor(n * {k} / 100.0)) / sum(y)::double as gain from (select y, row_number() over (order by p desc, doc_id) as r, count(*) over () as n from {_SCORED})" for k in (10, 20)))
def _lift(t: Tables) -> DataFrame:
    return modeling.lift(_scored(t), "y", "p", "doc_id")


@query("threshold_search", "", "threshold cost f1 f2 precision recall", f"""
  select t / 100.0 as threshold, fp + 5 * fn as cost, 2 * tp / nullif(2 * tp + fp + fn, 0) as f1, 5 * tp / nullif(5 * tp + fp + 4 * fn, 0) as f2, tp / nullif(tp + fp, 0) as precision, tp / nullif(tp + fn, 0) as recall
  from (select t, count(*) filter (where y = 1 and c >= t)::double as tp, count(*) filter (where y = 0 and c >= t)::double as fp, count(*) filter (where y = 1 and c < t)::double as fn from (select y, least(floor(p * 100 + 1e-9), 99) as c from {_SCORED}), (select unnest(range(1, 100)) as t) group by t)""")
def _thresholds(t: Tables) -> DataFrame:
    return modeling.thresholds(_scored(t), "y", "p")


_CAL = f"select cast(least(floor(p * 10), 9) as int) as bin, count(*) as n, avg(p) as predicted, avg(y) as observed from {_SCORED} group by 1"


@query("calibration", "bin n", "predicted observed", _CAL)
def _calibration(t: Tables) -> DataFrame:
    return modeling.calibration(_scored(t), "y", "p")


@query("calibration_error", "", "ece mce", f"select sum(n * abs(predicted - observed)) / sum(n) as ece, max(abs(predicted - observed)) as mce from ({_CAL})")
def _calibration_error(t: Tables) -> DataFrame:
    return modeling.calibration_error(modeling.calibration(_scored(t), "y", "p"))


@query("fairness", "lang n", "selected tpr fpr disparate_impact", f"""
  select lang, n, selected, tpr, fpr, selected / max(selected) over () as disparate_impact from (select lang, count(*) as n, avg(case when p >= 0.5 then 1.0 else 0.0 end) as selected, avg(case when p >= 0.5 then 1.0 else 0.0 end) filter (where y = 1) as tpr, avg(case when p >= 0.5 then 1.0 else 0.0 end) filter (where y = 0) as fpr from {_SCORED} group by 1)""")
def _fairness(t: Tables) -> DataFrame:
    return modeling.fairness(_scored(t), "y", "p", "lang")


@query("segment_performance", "lang n", "accuracy precision recall", f"""
  select lang, count(*) as n, avg(case when (p >= 0.5) = (y = 1) then 1.0 else 0.0 end) as accuracy, count(*) filter (where p >= 0.5 and y = 1) / nullif(count(*) filter (where p >= 0.5), 0)::double as precision, count(*) filter (where p >= 0.5 and y = 1) / nullif(count(*) filter (where y = 1), 0)::double as recall from {_SCORED} group by 1""")
def _segment_performance(t: Tables) -> DataFrame:
    return modeling.segment_performance(_scored(t), "y", "p", "lang")


@query("error_analysis", "kind confidence n", "", f"""
  select case when p >= 0.5 then 'false_positive' else 'false_negative' end as kind, case when abs(p - 0.5) >= 0.3 then 'high' when abs(p - 0.5) >= 0.15 then 'medium' else 'low' end as confidence, count(*) as n from {_SCORED} where (p >= 0.5) <> (y = 1) group by 1, 2""")
def _errors(t: Tables) -> DataFrame:
    return modeling.errors(_scored(t), "y", "p")


@query("batch_scores", "doc_id risk_segment predicted_churn", "churn_probability", f"select doc_id, case when p >= 0.75 then 'Critical' when p >= 0.5 then 'High' when p >= 0.25 then 'Medium' else 'Low' end as risk_segment, cast(p >= 0.5 as int) as predicted_churn, p as churn_probability from {_SCORED}")
def _batch_scores(t: Tables) -> DataFrame:
    return modeling.batch_scores(_scored(t), "doc_id", F.col("p"))


@query("campaign_list", "doc_id risk_segment", "churn_probability", f"select doc_id, case when p >= 0.75 then 'Critical' when p >= 0.5 then 'High' when p >= 0.25 then 'Medium' else 'Low' end as risk_segment, p as churn_probability from {_SCORED} order by p desc, doc_id limit 25")
def _campaign(t: Tables) -> DataFrame:
    return modeling.campaign_list(modeling.batch_scores(_scored(t), "doc_id", F.col("p")), "doc_id", 25)


@query("intervention_roi", "risk_segment name n", "total_cost saved_value roi", f"""
  select risk_segment, name, n, n * cost as total_cost, n * risk * rate * 500 as saved_value, (n * risk * rate * 500 - n * cost) / (n * cost) as roi from (select case when p >= 0.75 then 'Critical' when p >= 0.5 then 'High' when p >= 0.25 then 'Medium' else 'Low' end as risk_segment, count(*) as n, avg(p) as risk from {_SCORED} group by 1), (values ('email', 1.0, 0.05), ('call', 15.0, 0.2)) i(name, cost, rate)""")
def _roi(t: Tables) -> DataFrame:
    i = t.spark.createDataFrame([("email", 1.0, 0.05), ("call", 15.0, 0.2)], "name string, cost double, success_rate double")
    return modeling.roi(modeling.batch_scores(_scored(t), "doc_id", F.col("p")), i, 500.0)


@query("class_weights", "y", "weight", f"select y, (sum(n) over ()) / (count(*) over () * n)::double as weight from (select y, count(*) as n from {_SCORED} group by 1)")
def _class_weights(t: Tables) -> DataFrame:
    return modeling.class_weights(_scored(t), "y")


@query("temporal_split", "split n", "", "select case when o_orderdate <= timestamp '2000-01-01' then 'train' else 'score' end as split, count(*) as n from orders group by 1")
def _temporal_split(t: Tables) -> DataFrame:
    return modeling.temporal_split(t.orders, "o_orderdate", "2000-01-01").groupBy("split").agg(F.count("*").alias("n"))


@query("stratified_split", "o_orderstatus split n", "", "select o_orderstatus, s.split, case when s.split = 'test' then cast(round(n * 0.2) as bigint) else n - cast(round(n * 0.2) as bigint) end as n from (select o_orderstatus, count(*) as n from orders group by 1), (values ('test'), ('train')) s(split)")
def _stratified(t: Tables) -> DataFrame:
    return modeling.stratified_split(t.orders, "o_orderkey", "o_orderstatus").groupBy("o_orderstatus", "split").agg(F.count("*").alias("n"))


# Streams, as batches


def _windows_sql(size: int, slide: int) -> str:
    return f"""select window_start, window_start + {size} as window_end, count(*) as n, sum(value) as total from (select value, cast(floor((first + w * {slide}000000) / 1000000.0) as bigint) as window_start
      from (select value, first, unnest(range(greatest(0, cast(floor((x - {size}000000) / {slide}000000.0) as bigint) + 1), cast(floor(x / {slide}000000.0) as bigint) + 1)) as w from (select value, epoch_us(ts) - min(epoch_us(ts)) over () as x, min(epoch_us(ts)) over () as first from events))) group by 1"""


@query("tumbling_windows", "window_start window_end n", "total", _windows_sql(3600, 3600))
def _tumbling(t: Tables) -> DataFrame:
    return stream.tumbling(t.events, "ts", "1h", [F.count("*").alias("n"), F.sum("value").alias("total")])


@query("sliding_windows", "window_start window_end n", "total", _windows_sql(7200, 1800))
def _sliding(t: Tables) -> DataFrame:
    return stream.tumbling(t.events, "ts", "2h", [F.count("*").alias("n"), F.sum("value").alias("total")], "30m")


@query("session_windows", "user_id session start end events", "seconds", """
  select user_id, session, cast(floor(min(epoch_us(ts)) / 1000000.0) as bigint) as start, cast(floor(max(epoch_us(ts)) / 1000000.0) as bigint) as "end", count(*) as events, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 as seconds
  from (select *, cast(sum(case when epoch_us(ts) - epoch_us(b) > 43200000000 then 1 else 0 end) over (partition by user_id order by ts) as bigint) as session from (select *, lag(ts) over (partition by user_id order by ts) as b from events)) group by 1, 2""")
def _sessions(t: Tables) -> DataFrame:
    return stream.sessions(t.events, "user_id", "ts", "12h")


@query("lateness", "lateness n", "", "select case when ts > m - interval 1 day then 'valid' when ts >= m - interval 2 day then 'late' else 'dropped' end as lateness, count(*) as n from (select ts, max(ts) over (order by (event_id * 7919) % 10007, event_id) as m from events) group by 1")
def _lateness(t: Tables) -> DataFrame:
    arrival = F.struct(((F.col("event_id") * 7919) % 10007).alias("a"), "event_id")
    return stream.lateness(t.events.withColumn("arrival", arrival), "ts", "1d", "arrival").groupBy("lateness").agg(F.count("*").alias("n"))


@query("property_statistics", "event_type events values", "sum mean least largest", """
  select event_type, count(*) as events, count(v) as "values", coalesce(sum(v), 0.0) as sum, coalesce(avg(v), 0.0) as mean, coalesce(min(v), 0.0) as least, coalesce(max(v), 0.0) as largest from (select event_type, try_cast(json_extract_string(props, '$.k') as double) as v from events) group by 1""")
def _properties(t: Tables) -> DataFrame:
    return stream.property_stats(t.events, "$.k", ["event_type"])


@query("event_validation", "error n", "", """
  select error, count(*) as n from (select unnest(['in the future']) as error from events where ts > timestamp '2024-01-25' union all select 'too old' from events where epoch_us(timestamp '2024-02-10') - epoch_us(ts) > 30 * 86400000000 and false union all select 'unknown type' from events where event_type not in ('click', 'view', 'signup', 'purchase', 'error')) group by 1""")
def _validation(t: Tables) -> DataFrame:
    d = stream.validate(t.events, F.lit("2024-01-25").cast("timestamp"))
    return d.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("n"))


@query("keyed_state", "user_id event_type updated", "state", f"select user_id, event_type, cast(floor(max(epoch_us(ts)) / 1000000.0) as bigint) as updated, coalesce(sum(value), 0.0) as state from events group by 1, 2 having epoch_us(timestamp '{REF}') - max(epoch_us(ts)) <= 10 * 86400000000")
def _state(t: Tables) -> DataFrame:
    return stream.keyed_state(t.events, "user_id", "event_type", "value", "ts", F.lit(REF).cast("timestamp"), "10d")


@query("sequence_trigger", "user_id completed_at", "", """
  with a as (select user_id, min(ts) as t from events where event_type = 'view' group by 1), b as (select e.user_id, min(e.ts) as t from events e join a on e.user_id = a.user_id and e.ts > a.t where event_type = 'click' group by 1)
  select e.user_id, cast(floor(min(epoch_us(e.ts)) / 1000000.0) as bigint) as completed_at from events e join b on e.user_id = b.user_id and e.ts > b.t where event_type = 'purchase' group by 1""")
def _sequence(t: Tables) -> DataFrame:
    return stream.sequence_trigger(t.events, "user_id", "ts", "event_type", ["view", "click", "purchase"])


@query("threshold_trigger", "user_id fired_at", "")
def _threshold(t: Tables) -> DataFrame:
    return stream.threshold_trigger(t.events, "user_id", "ts", F.col("value") > 30, "6h", 2)


@query("anomaly_trigger", "user_id event_id", "value zscore", """
  select user_id, event_id, value, (value - m) / s as zscore from (select *, avg(value) over w as m, stddev_samp(value) over w as s, count(value) over w as n from events window w as (partition by user_id order by ts rows between unbounded preceding and 1 preceding)) where n >= 5 and s <> 0 and abs((value - m) / s) >= 3""")
def _anomaly(t: Tables) -> DataFrame:
    return stream.anomaly_trigger(t.events, "user_id", "ts", "value")


_WARN = f"(select user_id, case when count(*) filter (where ts >= timestamp '{REF}' - interval 7 day) = 0 then 1.0 else 0.0 end as drop_, least(1.0, {_days(f'''timestamp '{REF}' ''', 'max(ts)')} / 7.0) as rec, count(*) filter (where event_type = 'error') / count(*)::double as err from events group by 1)"


@query("early_warning", "user_id level primary_signal", "score", f"""
  select user_id, case when s >= 0.9 then 'critical' when s >= 0.5 then 'high' when s >= 0.3 then 'medium' else 'low' end as level, case when a >= r and a >= e and a > 0 and not (a = r) then 'activity_drop' when r >= e and r >= a then 'recency' else case when e > a then 'errors' else 'activity_drop' end end as primary_signal, s as score
  from (select user_id, 0.35 * drop_ as a, 0.30 * rec as r, 0.25 * err as e, greatest(0.0, least(1.0, 0.35 * drop_ + 0.30 * rec + 0.25 * err)) as s from {_WARN})""")
def _warning(t: Tables) -> DataFrame:
    ref = F.lit(REF).cast("timestamp")
    d = t.events.groupBy("user_id").agg(F.count(F.when(F.col("ts") >= ref - F.expr("interval 7 days"), 1)).alias("recent"), F.max("ts").alias("last"), F.avg((F.col("event_type") == "error").cast("double")).alias("errors"))
    from .time import days_between

    return stream.early_warning(d, {"activity_drop": (F.col("recent") == 0), "recency": F.least(F.lit(1.0), days_between(ref, F.col("last")) / 7.0), "errors": F.col("errors")})


@query("online_store_lookup", "customer_id", "click purchase", f"""
  select c.customer_id, coalesce(max(v) filter (where event_type = 'click'), -1.0) as click, coalesce(max(v) filter (where event_type = 'purchase'), -1.0) as purchase from (select distinct cast(user_id as varchar) as customer_id from events) c
  left join (select cast(user_id as varchar) as customer_id, event_type, arg_max(value, ts) as v from events where ts <= timestamp '2024-01-20' group by 1, 2 having max(epoch_us(ts)) >= epoch_us(timestamp '2024-01-20') - 5 * 86400000000) f on c.customer_id = f.customer_id group by 1""")
def _online(t: Tables) -> DataFrame:
    h = t.events.select(F.col("user_id").cast("string").alias("customer_id"), F.col("event_type").alias("feature_name"), F.col("value").alias("feature_value"), F.col("ts").alias("updated_at"))
    return stream.OnlineStore(h).lookup(h.select("customer_id").distinct(), {"click": -1.0, "purchase": -1.0}, "2024-01-20", 5 * 86400)


# Times, selection, monitoring, interpretation, plans


@query("time_discovery", "column how median_day role", "", """
  select 'o_orderdate' as "column", 'time' as how, strftime(make_timestamp(cast(floor(quantile_cont(epoch_us(o_orderdate), 0.5)) as bigint)), '%Y-%m-%d') as median_day, 'other' as role from orders
  union all select 'last_order', 'text', strftime(make_timestamp(cast(floor(quantile_cont(epoch_us(o_orderdate), 0.5)) as bigint)), '%Y-%m-%d'), 'activity' from orders""")
def _discovery(t: Tables) -> DataFrame:
    return timestamps.discover(t.orders.withColumn("last_order", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")))


@query("derived_times", "o_orderkey feature_day label_day label_available_flag", "", """
  select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as feature_day, strftime(o_orderdate + interval 180 day, '%Y-%m-%d') as label_day, o_orderdate + interval 180 day <= timestamp '2001-01-01' as label_available_flag from orders""")
def _derived(t: Tables) -> DataFrame:
    d = timestamps.with_times(t.orders, "derived", feature="o_orderdate", as_of="2001-01-01")
    return d.withColumns({"feature_day": F.date_format("feature_timestamp", "yyyy-MM-dd"), "label_day": F.date_format("label_timestamp", "yyyy-MM-dd")})


@query("cutoff_analysis", "bin n running", "train_share", """
  select bin, coalesce(n, 0) as n, cast(sum(coalesce(n, 0)) over (order by bin) as bigint) as running, sum(coalesce(n, 0)) over (order by bin) / (sum(coalesce(n, 0)) over ())::double as train_share from (select unnest(range(20)) as bin) s
  left join (select cast(least(floor((epoch_us(ts) - lo) / (hi - lo)::double * 20), 19) as int) as b, count(*) as n from events, (select min(epoch_us(ts)) as lo, max(epoch_us(ts)) as hi from events) group by 1) on bin = b""")
def _cutoffs(t: Tables) -> DataFrame:
    return timestamps.cutoffs(t.events, "ts")


@query("feature_moments", "column", "variance cv", "\n union all ".join(f"""select '{c}' as "column", var_samp({c}) as variance, stddev_samp({c}) / abs(avg({c})) as cv from lineitem""" for c in _NUM))
def _moments(t: Tables) -> DataFrame:
    return selection.moments(t.lineitem, _NUM)


@query("multicollinearity", "x y", "correlation", "select 'l_quantity' as x, 'double_quantity' as y, 1.0 as correlation")
def _multicollinear(t: Tables) -> DataFrame:
    d = t.lineitem.withColumn("double_quantity", F.col("l_quantity") * 2 + 1)
    return selection.multicollinear(d, ["l_quantity", "double_quantity", "l_discount", "l_tax"])


@query("feature_selection", "kind column", "", """select * from (values ('kept', 'double_price'), ('kept', 'l_quantity'), ('correlated', 'l_extendedprice'), ('low_variance', 'l_tax'), ('low_variance', 'l_discount')) t("kind", "column")""")
def _selection(t: Tables) -> DataFrame:
    d = t.lineitem.withColumn("double_price", F.col("l_extendedprice") * 2)
    found = selection.select(d, ["l_quantity", "l_extendedprice", "double_price", "l_tax", "l_discount"])
    return t.spark.createDataFrame([(k, c) for k, cs in found.items() for c in cs], "kind string, column string")


@query("feature_capacity", "lang n minority features", "", f"select lang, count(*) as n, cast(least(sum(y), count(*) - sum(y)) as bigint) as minority, cast(floor(least(sum(y), count(*) - sum(y)) / 10) as bigint) as features from {_SCORED} group by 1")
def _capacity(t: Tables) -> DataFrame:
    return selection.capacity(_scored(t), "y", "lang")


_Q = f"(select quantile_cont(o_totalprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as e from {_A})"


@query("baseline_drift", "column severity", "psi ks mean_shift variance_ratio missing_change", f"""
  with a as (select len(list_filter(e, lambda v: o_totalprice >= v)) as b, count(*) / (select count(*)::double from {_A}) as p from {_A}, {_Q} group by 1), c as (select len(list_filter(e, lambda v: o_totalprice >= v)) as b, count(*) / (select count(*)::double from {_B}) as q from {_B}, {_Q} group by 1),
  j as (select b, p, coalesce(q, 0) as q, sum(coalesce(q, 0) - p) over (order by b) as d from a left join c using (b)),
  s as (select (select sum((greatest(q, 0.0001) - greatest(p, 0.0001)) * ln(greatest(q, 0.0001) / greatest(p, 0.0001))) from j) as psi, (select max(abs(d)) from j) as ks, abs(bm - am) / a_sd as mean_shift, bv / (a_sd * a_sd) as variance_ratio, 0.0 as missing_change from (select avg(o_totalprice) as am, stddev_samp(o_totalprice) as a_sd from {_A}), (select avg(o_totalprice) as bm, var_samp(o_totalprice) as bv from {_B}))
  select 'o_totalprice' as "column", case when psi >= 0.2 or ks >= 0.1 or mean_shift >= 1 then 'critical' when psi >= 0.1 or ks >= 0.05 or mean_shift >= 0.5 then 'warning' else 'none' end as severity, * from s""")
def _baseline_drift(t: Tables) -> DataFrame:
    a, b = _halves(t)
    return monitoring.drift(b, [monitoring.fit_baseline(a, "o_totalprice")])


@query("alerts", "subject metric alert_id severity", "value bound", """
  select subject, 'psi' as metric, case when value >= 0.2 then 'AL003' else 'AL004' end as alert_id, case when value >= 0.2 then 'critical' else 'warning' end as severity, value, case when value >= 0.2 then 0.2 else 0.1 end as bound from (select p_brand as subject, avg(p_size) / 100 as value from part group by 1) where value >= 0.1""")
def _alerts(t: Tables) -> DataFrame:
    return monitoring.alerts(t.part.groupBy(F.col("p_brand").alias("subject")).agg(F.lit("psi").alias("metric"), (F.avg("p_size") / 100).alias("value")))


def _linear(df: DataFrame) -> DataFrame:
    return df.withColumn("score", 1 / (1 + F.exp(-(F.col("p_size") - 25) / 10 - F.col("p_retailprice") / 10_000)))


_LINEAR = "1 / (1 + exp(-({s} - 25) / 10.0 - p_retailprice / 10000))"


@query("partial_dependence", "", "grid mean_score", f"select grid, avg({_LINEAR.format(s='grid')}) as mean_score from part, (values (5.0), (25.0), (45.0)) g(grid) group by 1")
def _pdp(t: Tables) -> DataFrame:
    return interpret.partial_dependence(t.part, "p_size", [5, 25, 45], _linear)


@query("nearest_rows", "p_partkey", "distance", """
  select p.p_partkey, sqrt(power((p.p_size - o.p_size) / s, 2) + power((p.p_retailprice - o.p_retailprice) / r, 2)) as distance from part p, (select * from part where p_partkey = 7) o, (select stddev_pop(p_size) as s, stddev_pop(p_retailprice) as r from part) where p.p_partkey <> 7 order by 2, 1 limit 5""")
def _nearest(t: Tables) -> DataFrame:
    return interpret.nearest(t.part, "p_partkey", ["p_size", "p_retailprice"], 7)


@query("counterfactuals", "p_partkey column", "value new_score", f"""
  select p_partkey, 'p_size' as "column", case when {_LINEAR.format(s='20.0')} < 0.5 then 20.0 else 10.0 end as value, case when {_LINEAR.format(s='20.0')} < 0.5 then {_LINEAR.format(s='20.0')} else {_LINEAR.format(s='10.0')} end as new_score from part where {_LINEAR.format(s='10.0')} < 0.5""")
def _counterfactual(t: Tables) -> DataFrame:
    return interpret.counterfactual(t.part, "p_partkey", {"p_size": [20, 10]}, _linear)


@query("embedding_components", "vec_id", "e_pc0 e_pc1")
def _components(t: Tables) -> DataFrame:
    mean, components = reduce.fit_pca(t.embeddings, "embedding")
    return reduce.project(t.embeddings, "embedding", mean, components, "e")


@query("layered_plan", "c_custkey c_mktsegment orders", "c_acctbal", """
  select c_custkey, lower(trim(c_mktsegment)) as c_mktsegment, n as orders, (greatest(lo, least(hi, c_acctbal)) - m) / s as c_acctbal
  from (select c.*, n from customer c left join (select o_custkey, count(*) as n from orders group by 1) on c_custkey = o_custkey), (select q1 - 0.5 * (q3 - q1) as lo, q3 + 0.5 * (q3 - q1) as hi from (select quantile_cont(c_acctbal, 0.25) as q1, quantile_cont(c_acctbal, 0.75) as q3 from customer)),
    (select avg(x) as m, stddev_pop(x) as s from (select greatest(lo, least(hi, c_acctbal)) as x from customer, (select q1 - 0.5 * (q3 - q1) as lo, q3 + 0.5 * (q3 - q1) as hi from (select quantile_cont(c_acctbal, 0.25) as q1, quantile_cont(c_acctbal, 0.75) as q3 from customer))))""")
def _plan(t: Tables) -> DataFrame:
    from .operators.cleaning import outlier_bounds

    o = t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"))
    bounds = {c: list(b) for c, b in outlier_bounds(t.customer, ["c_acctbal"], "iqr", 0.5).items()}
    plan = spec.Plan([
        spec.Step("bronze", "consistent", {"columns": ["c_mktsegment"]}), spec.Step("bronze", "outliers", {"columns": ["c_acctbal"]}, bounds),
        spec.Step("silver", "join", {"source": "orders", "on": {"c_custkey": "o_custkey"}}), spec.Step("gold", "scale", {"columns": ["c_acctbal"]}),
    ])
    return plan.run(t.customer, {"orders": o})


@query("registry_features", "user_id clicks_7d", "spend_30d top_7d", f"""
  select user_id, coalesce(sum(value) filter (where ts <= timestamp '{REF}' and ts >= timestamp '{REF}' - interval 30 day), 0.0) as spend_30d, max(value) filter (where ts <= timestamp '{REF}' and ts >= timestamp '{REF}' - interval 7 day) as top_7d, count(value) filter (where ts <= timestamp '{REF}' and ts >= timestamp '{REF}' - interval 7 day) as clicks_7d from events group by 1""")
def _registry(t: Tables) -> DataFrame:
    r = features.Registry()
    r.register(features.FeatureDefinition("spend_30d", "value", "sum", "30d"), features.FeatureDefinition("top_7d", "value", "max", "7d"), features.FeatureDefinition("clicks_7d", "value", "count", "7d"))
    return r.compute(t.events, "user_id", "ts", REF)


@query("combined_scores", "doc_id", "batch_only override ensemble most boost", f"""
  select doc_id, p as batch_only, coalesce(case when a <= 24 then q end, p) as override, case when a <= 24 then 0.7 * p + 0.3 * q else p end as ensemble, greatest(p, case when a <= 24 then q end) as most, case when a <= 24 and q > p then least(1.0, p + 0.1) else p end as boost from (select doc_id, p, n_chars % 97 / 97.0 as q, n_chars % 48 as a from {_SCORED})""")
def _combined(t: Tables) -> DataFrame:
    d = _scored(t).withColumns({"q": F.col("n_chars") % 97 / 97.0, "a": F.col("n_chars") % 48})
    return d.select("doc_id", *[stream.combine_scores(F.col("p"), F.col("q"), how, F.col("a")).alias(n) for n, how in (("batch_only", "batch_only"), ("override", "override"), ("ensemble", "ensemble"), ("most", "max"), ("boost", "boost"))])


@query("recency_target_rates", "bucket n", "rate", f"""
  select case when d <= 7 then '0-7d' when d <= 30 then '8-30d' when d <= 90 then '31-90d' when d <= 180 then '91-180d' else '180d+' end as bucket, count(*) as n, avg(y) as rate from (select {_days(f'''timestamp '{ORDERS_REF}' ''', 'o_orderdate')} as d, case when o_orderstatus = 'F' then 1.0 else 0.0 end as y from orders) group by 1""")
def _recency_target(t: Tables) -> DataFrame:
    from .time import as_time, days_between

    d = t.orders.select(days_between(as_time(ORDERS_REF), F.col("o_orderdate")).alias("d"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return segments.recency_target(d, "d", "y")


@query("segment_profiles", "c_mktsegment n", "c_acctbal_mean c_acctbal_median", "select c_mktsegment, count(*) as n, avg(c_acctbal) as c_acctbal_mean, quantile_cont(c_acctbal, 0.5) as c_acctbal_median from customer group by 1")
def _segment_profiles(t: Tables) -> DataFrame:
    return segments.segment_profiles(t.customer, "c_mktsegment", ["c_acctbal"])


@query("future_rows", "column violations", "", """select 'l_shipdate' as "column", count(*) filter (where l_shipdate > o_orderdate) as violations from orders join lineitem on o_orderkey = l_orderkey""")
def _future_rows(t: Tables) -> DataFrame:
    return joins.future_rows(t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")), "o_orderdate", ["l_shipdate"])


# Seasonal patterns and explorations


@query("weekly_seasonality", "seasonal peak_day", "cv", "select s / m > 0.15 as seasonal, d as peak_day, s / m as cv from (select stddev_samp(n) as s, avg(n) as m, arg_max(d, n * 10 - d) as d from (select isodow(o_orderdate) - 1 as d, count(*) as n from orders group by 1))")
def _weekly(t: Tables) -> DataFrame:
    return seasonality.weekly(t.orders, "o_orderdate")


@query("year_by_month", "year jan jun dec", "", "select year(o_orderdate) as year, nullif(count(*) filter (where month(o_orderdate) = 1), 0) as jan, nullif(count(*) filter (where month(o_orderdate) = 6), 0) as jun, nullif(count(*) filter (where month(o_orderdate) = 12), 0) as dec from orders group by 1")
def _year_month(t: Tables) -> DataFrame:
    return seasonality.year_by_month(t.orders, "o_orderdate").withColumnsRenamed({"1": "jan", "6": "jun", "12": "dec"})


@query("peak_months", "month n kind", "", "select * from (select month(o_orderdate) as month, count(*) as n, 'peak' as kind from orders group by 1 order by n desc, month limit 3) union all select * from (select month(o_orderdate) as month, count(*) as n, 'trough' as kind from orders group by 1 order by n, month limit 3)")
def _peaks(t: Tables) -> DataFrame:
    return seasonality.peak_months(t.orders, "o_orderdate")


@query("volume_trend", "trend", "earlier later change", "select case when (l - e) / e > 0.25 then 'growing' when (l - e) / e < -0.25 then 'declining' else 'stable' end as trend, e as earlier, l as later, (l - e) / e as change from (select avg(n) filter (where r <= floor(k / 2.0)) as e, avg(n) filter (where r > floor(k / 2.0)) as l from (select count(*) as n, row_number() over (order by date_trunc('month', o_orderdate)) as r, count(*) over () as k from orders group by date_trunc('month', o_orderdate)))")
def _volume(t: Tables) -> DataFrame:
    return seasonality.volume_trend(temporal.period_counts(t.orders, "o_orderdate"))


@query("new_entities", "month new_entities", "", "select strftime(date_trunc('month', d), '%Y-%m') as month, count(*) as new_entities from (select min(o_orderdate) as d from orders group by o_custkey) group by 1")
def _new_entities(t: Tables) -> DataFrame:
    return seasonality.new_entities(t.orders, "o_custkey", "o_orderdate").withColumn("month", F.date_format("period", "yyyy-MM"))


@query("eta_squared", "", "eta_squared", "select sum(n * power(m - g, 2)) / max(t) as eta_squared from (select count(*) as n, avg(o_totalprice) as m from orders group by o_orderpriority), (select avg(o_totalprice) as g, var_pop(o_totalprice) * count(*) as t from orders)")
def _eta(t: Tables) -> DataFrame:
    return seasonality.eta_squared(t.orders, "o_totalprice", "o_orderpriority")


@query("recency_by_target", "y n", "mean_days median_days", f"""
  with e as (select {_days(f'''timestamp '{REF}' ''', 'max(ts)')} as d, max(case when event_type = 'purchase' then 1 else 0 end) as y from events group by user_id) select y, count(*) as n, avg(x) as mean_days, quantile_cont(x, 0.5) as median_days from (select y, least(d::double, (select quantile_cont(d, 0.99) from e)) as x from e) group by y""")
def _recency_by_target(t: Tables) -> DataFrame:
    d = t.events.withColumn("y", (F.col("event_type") == "purchase").cast("int"))
    return seasonality.recency_by_target(d, "user_id", "ts", "y", F.lit(REF).cast("timestamp"))


@query("daily_change", "d", "mean velocity acceleration", "select d, mean, v as velocity, v - lag(v) over (order by d) as acceleration from (select d, mean, mean - lag(mean) over (order by d) as v from (select strftime(ts, '%Y-%m-%d') as d, avg(value) as mean from events group by 1))")
def _daily_change(t: Tables) -> DataFrame:
    return seasonality.daily_change(t.events, "ts", "value").withColumn("d", F.date_format("day", "yyyy-MM-dd"))


@query("cohort_series", "event_type week", "mean velocity", "select event_type, strftime(w, '%Y-%m-%d') as week, mean, mean - lag(mean) over (partition by event_type order by w) as velocity from (select event_type, date_trunc('week', ts) as w, avg(value) as mean from events group by 1, 2)")
def _cohort_series(t: Tables) -> DataFrame:
    return seasonality.cohort_series(t.events, "ts", "value", "event_type", "week").withColumn("week", F.date_format("period", "yyyy-MM-dd"))


@query("window_recommendation", "days entities recommended", "share", "\n union all ".join(f"select {w} as days, count(*) filter (where duration_days >= {2 * w}) as entities, count(*) filter (where duration_days >= {2 * w}) / count(*)::double >= 0.1 as recommended, count(*) filter (where duration_days >= {2 * w}) / count(*)::double as share from ({_LIVES})" for w in (1, 7, 14, 30)))
def _recommend(t: Tables) -> DataFrame:
    return seasonality.recommend_windows(temporal.entity_lifecycle(t.events, "user_id", "ts"), [1, 7, 14, 30])


@query("exploration_failures", "column check_id severity", "", """select 'c_acctbal' as "column", 'NC005' as check_id, 'high' as severity from customer having min(c_acctbal) < 0 union all select 'c_nationkey', 'NC008', 'low' from customer having count(distinct c_nationkey) > 20""")
def _explore(t: Tables) -> DataFrame:
    d = t.customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    types = {"c_custkey": "identifier", "c_nationkey": "numeric_continuous", "c_acctbal": "numeric_continuous", "c_mktsegment": "categorical_nominal"}
    return profiling.explore(d, F.lit(REF).cast("timestamp"), types).where("not passed")


# Relations, experiments, comparisons


_EFFECT = "from (select *, case when l_returnflag = 'A' then 1 else 0 end as y from lineitem)"


@query("numeric_effects", "column", "mean_0 mean_1 cohens_d correlation", "\n union all ".join(f"""select '{c}' as "column", avg(a) as mean_0, avg(b) as mean_1, (avg(b) - avg(a)) / sqrt(((count(a) - 1) * var_samp(a) + (count(b) - 1) * var_samp(b)) / (count(a) + count(b) - 2)) as cohens_d, corr({c}, y) as correlation from (select {c}, y, case when y = 0 then {c} end as a, case when y = 1 then {c} end as b {_EFFECT})""" for c in _NUM))
def _effects(t: Tables) -> DataFrame:
    return relations.numeric_effects(t.lineitem.withColumn("y", (F.col("l_returnflag") == "A").cast("int")), _NUM, "y")


@query("group_statistics", "p_type n", "mean std q25 median q75", "select p_type, count(p_retailprice) as n, avg(p_retailprice) as mean, stddev_samp(p_retailprice) as std, quantile_cont(p_retailprice, 0.25) as q25, quantile_cont(p_retailprice, 0.5) as median, quantile_cont(p_retailprice, 0.75) as q75 from part group by 1")
def _group_statistics(t: Tables) -> DataFrame:
    return relations.group_statistics(t.part, "p_type", "p_retailprice")


@query("experiment_arms", "c_mktsegment arm n", "", "select c_mktsegment, arm, cast(case when arm = 'control' then ceil(n / 2.0) else floor(n / 2.0) end as bigint) as n from (select c_mktsegment, count(*) as n from customer group by 1), (values ('control'), ('treatment')) a(arm)")
def _arms(t: Tables) -> DataFrame:
    return modeling.assign_arms(t.customer, "c_custkey", "c_mktsegment").groupBy("c_mktsegment", "arm").agg(F.count("*").alias("n"))


@query("scoring_paths", "column rows differ severity", "largest", f"""select 'p' as "column", count(*) as rows, count(*) filter (where n_chars % 7 = 0) as differ, case when count(*) filter (where n_chars % 7 = 0) > 0.1 * count(*) then 'high' when count(*) filter (where n_chars % 7 = 0) > 0.01 * count(*) then 'medium' else 'low' end as severity, max(case when n_chars % 7 = 0 then 0.25 else 0.0 end) as largest from {_SCORED}""")
def _paths(t: Tables) -> DataFrame:
    a = _scored(t)
    b = a.withColumn("p", F.when(F.col("n_chars") % 7 == 0, F.col("p") + 0.25).otherwise(F.col("p")))
    return validation.same_scores(a, b, "doc_id", ["p"])


from . import more_queries  # noqa: E402, F401  registers its queries here

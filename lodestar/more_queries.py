"""Queries of the quality checks by kind, the gates, what distributions suggest, folds, series, streams and transforms, each
with its SQL. They register themselves beside those of `queries`, which imports this module last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import gates, joins, modeling, profiling, temporal, transforms, validation
from .queries import _AUC, QUERIES, REF, SQL, Tables, query
from .scratch import shared_path
from .sources import snapshots, tables
from .streaming import events as stream

_CHECK = "column check_id severity passed"


def _checked(column: str, source: str, checks: list[tuple[str, str, str]]) -> str:
    """SQL of check rows over a one-row source: (id, severity or a case, condition that fails)."""
    of = lambda s: s if s.startswith("case ") else f"'{s}'"
    return "\n union all ".join(f"""select '{column}' as "column", '{i}' as check_id, {of(s)} as severity, not coalesce({bad}, false) as passed from ({source})""" for i, s, bad in checks)


# Quality checks by kind

_FQ001 = ("FQ001", "case when null_pct > 95 then 'critical' when null_pct > 70 then 'high' when null_pct > 20 then 'medium' else 'critical' end", "null_pct > 70")
_SPARSE = {"one": "1", "quarter": "case when o_orderkey % 4 = 0 then o_custkey end", "fiftieth": "case when o_orderkey % 50 = 0 then 1 end", "most": "case when o_orderkey % 4 > 0 then o_custkey end", "o_custkey": "o_custkey"}
_UNIVERSAL = "select 100.0 * (count(*) - count({0})) / count(*) as null_pct, count(distinct {0}) as d from orders"


@query("checks_universal", _CHECK, "", "\n union all ".join(_checked(c, _UNIVERSAL.format(f"({e})"), [_FQ001, ("FQ003", "critical", "d = 1"), ("NUM001", "low", "d < 10")]) for c, e in _SPARSE.items()))
def _checks_universal(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    d = t.orders.select(F.lit(1).alias("one"), F.when(k % 4 == 0, c).alias("quarter"), F.when(k % 50 == 0, 1).alias("fiftieth"), F.when(k % 4 > 0, c).alias("most"), "o_custkey")
    profile = profiling.universal(d)
    return profiling.run_checks(profile, "universal").unionByName(profiling.run_checks(profile, "universal_numeric"))


_MESSY = "(select case when p_partkey % 7 = 0 then upper(p_type) when p_partkey % 11 = 0 then ' ' || p_type when p_partkey % 13 = 0 then 'N/A' else p_type end as c, p_name as name from part)"
_CATEGORIES = """select sum(k) as n, count(*) as card, count(*) filter (where k / t::double < 0.01) as rare, 100 * sum(k) filter (where k / t::double < 0.01) / max(t) as rare_pct,
  count(*) filter (where lower(trim(v, ' ')) in ('unknown', 'n/a', 'na', 'none', 'null', 'missing', 'undefined', '?', '-')) as unknown, count(*) filter (where v <> trim(v, ' ')) as padded, count(*) - count(distinct lower(v)) as cases
  from (select {0} as v, count(*) as k from """ + _MESSY + " group by 1), (select count({0}) as t from " + _MESSY + ")"
_CN = [
    ("CN001", "high", "card > 100"), ("CN002", "medium", "card > 50"), ("CN003", "medium", "rare > 10"), ("CN004", "high", "rare_pct > 20"), ("CN005", "low", "cases > 0"), ("CN006", "low", "padded > 0"), ("CN007", "high", "card = 1"),
    ("CAT003", "medium", "rare_pct > 20"), ("CAT004", "low", "unknown > 0"), ("FQ009", "medium", "card > 1000"), ("CAT001", "medium", "card > 0.95 * n"),
]


@query("checks_categorical", _CHECK, "", "\n union all ".join(_checked(c, _CATEGORIES.format(c), _CN) for c in ("c", "name")))
def _checks_categorical(t: Tables) -> DataFrame:
    k, c = F.col("p_partkey"), F.col("p_type")
    d = t.part.select(F.when(k % 7 == 0, F.upper(c)).when(k % 11 == 0, F.concat(F.lit(" "), c)).when(k % 13 == 0, "N/A").otherwise(c).alias("c"), F.col("p_name").alias("name"))
    return profiling.run_checks(profiling.categorical(d, "c"), "categorical", "c").unionByName(profiling.run_checks(profiling.categorical(d, "name"), "categorical", "name"))


_IDENTIFIERS = {"o_orderkey": "cast(o_orderkey as varchar)", "mixed": "case when o_orderkey % 9 = 0 then 'X-' || cast(o_custkey as varchar) when o_orderkey % 31 > 0 then cast(o_custkey as varchar) end"}
_IDENTIFIER = """select count(*) filter (where k > 1 and v is not null) as again, sum(k) filter (where v is null) as nulls, (select 100.0 * max(k) / sum(k) from (select sum(k) as k from (select {0} as v, count(*) as k from orders group by 1) where v is not null
  group by regexp_replace(regexp_replace(v, '[A-Za-z]+', 'a', 'g'), '[0-9]+', '0', 'g'))) as pct from (select {0} as v, count(*) as k from orders group by 1)"""


@query("checks_identifier", _CHECK, "", "\n union all ".join(_checked(c, _IDENTIFIER.format(e), [("ID001", "critical", "again > 0"), ("ID002", "medium", "pct < 95"), ("ID003", "high", "nulls > 0")]) for c, e in _IDENTIFIERS.items()))
def _checks_identifier(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    d = t.orders.select(k.cast("string").alias("o_orderkey"), F.when(k % 9 == 0, F.concat(F.lit("X-"), c)).when(k % 31 > 0, c).alias("mixed"))
    return profiling.run_checks(profiling.identifier(d, "o_orderkey"), "identifier", "o_orderkey").unionByName(profiling.run_checks(profiling.identifier(d, "mixed"), "identifier", "mixed"))


_TARGETS = {"toxic": "toxic", "rare": "case when l_linenumber > 6 then 'c' when l_quantity < 2 then 'b' else 'a' end", "same": "1", "holes": "case when o_orderkey % 3 > 0 then o_orderkey % 3 end"}
_TARGET = "select coalesce(sum(k) filter (where v is null), 0) as nulls, count(v) as classes, 100.0 * min(k) filter (where v is not null) / sum(k) filter (where v is not null) as pct, max(k) filter (where v is not null) / min(k) filter (where v is not null)::double as ratio, count(*) filter (where v not in ('0', '1')) as odd from (select cast({0} as varchar) as v, count(*) as k from {1} group by 1)"
_TG = [("TG001", "critical", "nulls > 0"), ("TG004", "high", "odd > 0"), ("TG002", "high", "pct < 1"), ("TG003", "medium", "pct < 10"), ("TG005", "critical", "classes = 1"), ("CAT002", "high", "ratio > 5")]


@query("checks_target", _CHECK, "", "\n union all ".join(_checked(c, _TARGET.format(e, {"toxic": "labels", "rare": "lineitem", "same": "orders", "holes": "orders"}[c]), _TG) for c, e in _TARGETS.items()))
def _checks_target(t: Tables) -> DataFrame:
    check = lambda df, c: profiling.run_checks(profiling.target(df, c, ["0", "1"]), "target", c)
    rare = F.when(F.col("l_linenumber") > 6, "c").when(F.col("l_quantity") < 2, "b").otherwise("a")
    k = F.col("o_orderkey")
    out = check(t.labels, "toxic").unionByName(check(t.lineitem.select(rare.alias("rare")), "rare"))
    return out.unionByName(check(t.orders.select(F.lit(1).alias("same")), "same")).unionByName(check(t.orders.select(F.when(k % 3 > 0, k % 3).alias("holes")), "holes"))


_BINARIES = {"flag": "case when o_orderkey % 200 = 0 then 'Yes' else 'no ' end", "three": "case when o_orderkey % 3 = 0 then 'y' when o_orderkey % 3 = 1 then 'n' else 'maybe' end", "same": "'1'"}
_BINARY = "select count(distinct {0}) as d, 100.0 * count(*) filter (where lower(trim({0}, ' ')) in ('1', '1.0', 'true', 'yes', 'y', 't')) / count(*) filter (where lower(trim({0}, ' ')) in ('1', '1.0', 'true', 'yes', 'y', 't', '0', '0.0', 'false', 'no', 'n', 'f')) as pct, count(*) filter (where lower(trim({0}, ' ')) not in ('1', '1.0', 'true', 'yes', 'y', 't', '0', '0.0', 'false', 'no', 'n', 'f')) as odd from (select {1} as {0} from orders)"


@query("checks_binary", _CHECK, "", "\n union all ".join(_checked(c, _BINARY.format(c, e), [("BN001", "critical", "d <> 2"), ("BN002", "medium", "pct < 1 or pct > 99"), ("BN003", "high", "d = 1"), ("BN004", "high", "odd > 0")]) for c, e in _BINARIES.items()))
def _checks_binary(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    d = t.orders.select(F.when(k % 200 == 0, "Yes").otherwise("no ").alias("flag"), F.when(k % 3 == 0, "y").when(k % 3 == 1, "n").otherwise("maybe").alias("three"), F.lit("1").alias("same"))
    out = [profiling.run_checks(profiling.binary(d, c), "binary", c) for c in _BINARIES]
    return out[0].unionByName(out[1]).unionByName(out[2])


_DATES = {"o_orderdate": "o_orderdate", "placed": "case when o_orderkey % 500 = 0 then timestamp '1900-01-01' else o_orderdate end"}
_DATE = "select count({0}) as n, count(*) filter (where {0} > timestamp '2001-01-01') as future, count(*) filter (where cast({0} as date) in (date '1970-01-01', date '1900-01-01', date '9999-12-31')) as placeholders, (epoch_us(max({0})) - epoch_us(min({0}))) / (365.25 * 86400000000) as years from (select {1} as {0} from orders)"


@query("checks_datetime", _CHECK, "", "\n union all ".join(_checked(c, _DATE.format(c, e), [("DT001", "high", "future > 0"), ("DT002", "medium", "100.0 * placeholders / n > 0.05"), ("DT006", "medium", "years > 50"), ("FQ012", "high", "years > 100")]) for c, e in _DATES.items()))
def _checks_datetime(t: Tables) -> DataFrame:
    d = t.orders.select("o_orderdate", F.when(F.col("o_orderkey") % 500 == 0, F.lit("1900-01-01").cast("timestamp")).otherwise(F.col("o_orderdate")).alias("placed"))
    out = [profiling.run_checks(profiling.datetimes(d, c, F.lit("2001-01-01").cast("timestamp")), "datetime", c) for c in _DATES]
    return out[0].unionByName(out[1])


_DATE_TEXTS = "(select case when o_orderkey % 10 = 0 then 'soon' when o_orderkey % 10 = 1 then strftime(o_orderdate, '%d.%m.%Y') when o_orderkey % 10 = 2 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') else strftime(o_orderdate, '%Y-%m-%d') end as c from orders)"


@query("checks_date_texts", _CHECK, "", _checked("c", f"select 100.0 * count(*) filter (where regexp_full_match(c, '\\d{{4}}-\\d\\d-\\d\\d')) / count(*) as pct, count(*) filter (where c = 'soon') as invalid, count(distinct case when ends_with(c, 'Z') then 'Z' else '' end) as zones from {_DATE_TEXTS}", [("DT003", "medium", "pct < 95"), ("DT004", "medium", "zones > 1"), ("DT005", "critical", "invalid > 0")]))
def _checks_date_texts(t: Tables) -> DataFrame:
    k, d = F.col("o_orderkey") % 10, F.col("o_orderdate")
    c = F.when(k == 0, "soon").when(k == 1, F.date_format(d, "dd.MM.yyyy")).when(k == 2, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return profiling.run_checks(profiling.date_texts(t.orders.select(c.alias("c")), "c"), "date_texts", "c")


_TEXTS = {"text": "documents", "p_brand": "part"}
_TEXT = r"""select count({0}) as n, count(distinct {0}) as d, avg(length({0})) as mean, count(*) filter (where trim({0}, ' ') = '') as empty, count(*) filter (where regexp_matches({0}, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}') or regexp_matches({0}, '\b\d{{3}}[-.]?\d{{3}}[-.]?\d{{4}}\b') or regexp_matches({0}, '\b\d{{3}}-\d{{2}}-\d{{4}}\b') or regexp_matches({0}, '\b\d{{4}}[-\s]?\d{{4}}[-\s]?\d{{4}}[-\s]?\d{{4}}\b')) as pii from {1}"""


@query("checks_text", _CHECK, "", "\n union all ".join(_checked(c, _TEXT.format(c, table), [("TX001", "critical", "pii > 0"), ("TX002", "high", "100.0 * empty / n > 50"), ("TX003", "medium", "mean < 10"), ("TX004", "medium", "d > 0.95 * n")]) for c, table in _TEXTS.items()))
def _checks_text(t: Tables) -> DataFrame:
    return profiling.run_checks(profiling.text(t.documents, "text"), "text", "text").unionByName(profiling.run_checks(profiling.text(t.part, "p_brand"), "text", "p_brand"))


@query("checks_meaning", _CHECK, "", """select * from (values ('c_custkey', 'FQ008', 'medium', true), ('c_custkey', 'LEAK001', 'critical', false), ('void', 'FQ008', 'medium', false), ('void', 'LEAK001', 'critical', true), ('c_acctbal', 'FQ008', 'medium', true), ('c_acctbal', 'LEAK001', 'critical', true)) v("column", check_id, severity, passed)""")
def _checks_meaning(t: Tables) -> DataFrame:
    d = t.customer.select("c_custkey", F.lit(None).cast("string").alias("void"), "c_acctbal")
    rows = [(c, kind, c in ("c_custkey", "c_acctbal")) for c, kind in profiling.semantic_types(d).items()]
    return profiling.run_checks(d.sparkSession.createDataFrame(rows, "column string, type string, feature boolean"), "meaning")


@query("checks_similar", _CHECK, "", _checked("p_brand", "select count(*) as pairs from (select distinct p_brand as a from part), (select distinct p_brand as b from part) where a < b and 1 - levenshtein(a, b) / greatest(length(a), length(b))::double > 0.8", [("CN008", "medium", "pairs > 0")]))
def _checks_similar(t: Tables) -> DataFrame:
    return profiling.run_checks(profiling.similar_values(t.part, "p_brand").agg(F.count("*").alias("pairs")), "similar", "p_brand")


# What distributions suggest

_SHAPES = {"flat": "l_quantity", "tailed": "power(l_extendedprice, 4)", "zeros": "case when l_linenumber > 4 then power(l_quantity, 3) else 0 end", "signed": "power(l_quantity - 10, 5)", "same": "1.0"}


@query("distribution_advice", "column n highly_skewed zero_inflated transform priority", "skewness zero_pct outlier_pct", "\n union all ".join(f"""
  select '{c}' as "column", n, coalesce(abs(sk) > 2, false) as highly_skewed, z > 30 as zero_inflated,
    case when z > 30 then 'zero_inflation_handling' when neg > 0 and abs(sk) > 2 then 'yeo_johnson' when abs(sk) > 2 and o > 5 then 'cap_then_log' when abs(sk) > 2 and lo > 0 then 'log_transform' when abs(sk) > 2 then 'yeo_johnson' when abs(sk) > 1 and lo >= 0 then 'sqrt_transform' when abs(sk) > 1 then 'yeo_johnson' when o > 5 then 'cap_outliers' else 'none' end as transform,
    case when abs(sk) > 2 then 'high' when z > 30 or abs(sk) > 1 or o > 5 then 'medium' else 'low' end as priority, sk as skewness, z as zero_pct, o as outlier_pct
  from (select count(x) as n, skewness(x) as sk, min(x) as lo, 100.0 * count(*) filter (where x = 0) / count(x) as z, count(*) filter (where x < 0) as neg, 100.0 * count(*) filter (where x < q1 - 1.5 * (q3 - q1) or x > q3 + 1.5 * (q3 - q1)) / count(x) as o
    from (select cast({e} as double) as x from lineitem), (select quantile_cont(cast({e} as double), 0.25) as q1, quantile_cont(cast({e} as double), 0.75) as q3 from lineitem))""" for c, e in _SHAPES.items() if c != "same"))
def _distribution(t: Tables) -> DataFrame:
    q, one = F.col("l_quantity").cast("double"), F.lit
    d = t.lineitem.select(q.alias("flat"), F.pow(F.col("l_extendedprice").cast("double"), one(4.0)).alias("tailed"), F.when(F.col("l_linenumber") > 4, F.pow(q, one(3.0))).otherwise(0.0).alias("zeros"), F.pow(q - 10, one(5.0)).alias("signed"))
    return profiling.distribution(d, d.columns)


_ENCODED = {"p_brand": "part", "p_type": "part", "o_orderstatus": "orders", "toxic": "labels", "o_custkey": "orders"}


@query("encoding_advice", "column categories rare imbalanced low_diversity concentrated encoding priority", "imbalance_ratio normalized_entropy top3_pct", "\n union all ".join(f"""
  select '{c}' as "column", k as categories, rare, ratio > 10 as imbalanced, h < 0.5 as low_diversity, top3 > 90 as concentrated, case when k = 2 then 'binary' when k <= 5 then 'one_hot' when k <= 20 and rare > 0 then 'target' when k <= 20 then 'one_hot' else 'target' end as encoding,
    case when k <= 5 then 'low' when k <= 20 and rare > 0 then 'medium' when k <= 20 then 'low' else 'high' end as priority, ratio as imbalance_ratio, h as normalized_entropy, top3 as top3_pct
  from (select count(*) as k, count(*) filter (where n / t::double < 0.01) as rare, max(n) / min(n)::double as ratio, -sum(n / t::double * log2(n / t::double + 1e-10)) / case when count(*) > 1 then log2(count(*)) else 1 end as h, 100.0 * sum(n) filter (where r <= 3) / max(t) as top3
    from (select n, sum(n) over () as t, row_number() over (order by n desc) as r from (select count(*) as n from {table} where {c} is not null group by {c})))""" for c, table in _ENCODED.items()))
def _encoding(t: Tables) -> DataFrame:
    out = None
    for c, table in _ENCODED.items():
        one = profiling.category_distribution(getattr(t, table), c)
        out = one if out is None else out.unionByName(one)
    return out


# Gates

_LEAKY = """(select l_quantity, l_discount, cast(l_quantity > 25 as int) as y, cast(l_quantity > 25 as int) * 2.0 as twice, l_quantity + l_linenumber as days_since, l_quantity * 2 - l_linenumber as churn_score, l_discount * l_quantity as global_avg, l_extendedprice as y_price, l_linenumber as target_line,
  timestamp '2001-01-01' as feature_timestamp, case when l_orderkey % 50 = 0 then timestamp '2000-12-31' else timestamp '2001-02-01' end as label_timestamp, l_shipdate from lineitem)"""
_LEAKY_NUMBERS = ("l_quantity", "l_discount", "twice", "days_since", "churn_score", "global_avg", "y_price", "target_line")


def _leaky(t: Tables) -> DataFrame:
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    y, day = (q > 25).cast("int"), lambda s: F.lit(s).cast("timestamp")
    return t.lineitem.select(
        "l_quantity", "l_discount", y.alias("y"), (y * 2.0).alias("twice"), (q + n).alias("days_since"), (q * 2 - n).alias("churn_score"), (F.col("l_discount") * q).alias("global_avg"), F.col("l_extendedprice").alias("y_price"), n.alias("target_line"),
        day("2001-01-01").alias("feature_timestamp"), F.when(F.col("l_orderkey") % 50 == 0, day("2000-12-31")).otherwise(day("2001-02-01")).alias("label_timestamp"), "l_shipdate",
    )


def _split(c: str) -> str:
    return f"select corr({c}, y) as r, min({c}) filter (where y = 1) as l1, max({c}) filter (where y = 1) as h1, min({c}) filter (where y = 0) as l0, max({c}) filter (where y = 0) as h0, var_samp({c}) filter (where y = 1) as v1, var_samp({c}) filter (where y = 0) as v0, avg({c}) filter (where y = 1) as m1, avg({c}) filter (where y = 0) as m0 from {_LEAKY}"


@query("leakage_gate", "check_id feature severity", "value", "\n union all ".join(f"""
  select case when abs(r) >= 0.9 then 'LK001' else 'LK002' end as check_id, '{c}' as feature, case when abs(r) >= 0.9 then 'critical' else 'high' end as severity, r as value from ({_split(c)}) where abs(r) >= 0.7
  union all select 'LK003', '{c}', 'critical', null from ({_split(c)}) where h0 < l1 or h1 < l0
  union all select 'LK008', '{c}', 'high', null from ({_split(c)}) where v0 < 0.01 and v1 < 0.01 and abs(m0 - m1) > 0.1""" for c in _LEAKY_NUMBERS) + f"""
  union all select 'LK004', 'l_shipdate', 'critical', n from (select count(*) as n from {_LEAKY} where l_shipdate > timestamp '2001-06-01') where n > 0
  union all select 'LK009', 'feature_timestamp', 'critical', n from (select count(*) as n from {_LEAKY} where feature_timestamp > label_timestamp) where n > 0
  union all select 'LK010', 'l_shipdate', 'critical', n from (select count(*) as n from {_LEAKY} where l_shipdate > feature_timestamp) where n > 0
  union all select 'LK011', 'l_discount', 'high', 80.0 union all select 'LK012', 'y_price', 'high', 40.0""")
def _leakage_gate(t: Tables) -> DataFrame:
    seen = {"l_discount": ("new_tracking", 80.0), "y_price": (None, 40.0), "l_quantity": (None, 90.0)}
    return gates.leakage(_leaky(t), "y", reference=F.lit("2001-06-01").cast("timestamp"), dates=["l_shipdate"], availability=seen)


def _detected() -> str:
    out = []
    for c in _LEAKY_NUMBERS:
        s = f"select abs(r) as r, coalesce(100 * greatest(0.0, least(h1, h0) - greatest(l1, l0)) / nullif(greatest(h1, h0) - least(l1, l0), 0), 100.0) as o from ({_split(c)})"
        out.append(f"select case when r > 0.9 then 'LD001' when r > 0.7 then 'LD002' else 'LD003' end as check_id, '{c}' as feature, case when r > 0.9 then 'critical' when r > 0.7 then 'high' else 'medium' end as severity, r as value from ({s}) where r > 0.5")
        out.append(f"select case when o <= 0 then 'LD010' when o < 1 then 'LD011' else 'LD012' end, '{c}', case when o <= 0 then 'critical' when o < 1 then 'high' else 'medium' end, o from ({s}) where o < 5")
        out.append(f"select 'LD052', '{c}', 'critical', " + ("null" if c in ("y_price",) else f"r from ({s}) where r > 0.99"))
        if c == "days_since":
            out.append(f"select 'LD022', '{c}', case when r > 0.7 then 'high' else 'medium' end, r from ({s}) where r > 0.5")
        if c == "churn_score":
            out.append(f"select 'LD053', '{c}', case when r > 0.7 then 'critical' when r > 0.5 then 'high' else 'medium' end, r from ({s})")
        if c == "global_avg":
            out.append(f"select 'LD060', '{c}', case when r > 0.5 then 'high' else 'medium' end, r from ({s})")
        auc = f"select greatest(a, 1 - a) as a from ({_AUC.format(x=c, t=_LEAKY)})"
        out.append(f"select '{'LD031' if c == 'days_since' else 'LD030'}', '{c}', '{'high' if c == 'days_since' else 'critical'}', a from ({auc}) where a > 0.9")
        if c != "days_since":
            out.append(f"select 'LD031', '{c}', 'high', a from ({auc}) where a > 0.8 and a <= 0.9")
    out.append(f"select 'LD040', 'feature_timestamp', 'critical', n from (select count(*) as n from {_LEAKY} where feature_timestamp > label_timestamp) where n > 0")
    out.append(f"select 'LD041', 'l_shipdate', case when p > 5 then 'critical' else 'high' end, p from (select 100.0 * count(*) filter (where l_shipdate > feature_timestamp) / count(*) as p from {_LEAKY}) where p > 0")
    out.append("select 'LD050', 'feature_timestamp', 'high', 0")
    return "\n union all ".join(out)


@query("leakage_detector", "check_id feature severity", "value", _detected())
def _leakage_detector(t: Tables) -> DataFrame:
    return gates.detect_leakage(_leaky(t), "y")


@query("feature_aucs", "feature", "auc", "\n union all ".join(f"select '{c}' as feature, greatest(a, 1 - a) as auc from ({_AUC.format(x=c, t=_LEAKY)})" for c in ("l_quantity", "l_discount", "y_price")))
def _aucs(t: Tables) -> DataFrame:
    return gates.feature_aucs(_leaky(t), ["l_quantity", "l_discount", "y_price"], "y")


@query("split_overlap", "check_id feature severity rows", "percent", "select 'LD061' as check_id, 'o_orderdate' as feature, 'critical' as severity, count(*) filter (where o_orderdate >= (select min(o_orderdate) from orders where o_orderkey % 5 = 0)) as rows, 100.0 * count(*) filter (where o_orderdate >= (select min(o_orderdate) from orders where o_orderkey % 5 = 0)) / count(*) as percent from orders where o_orderkey % 5 > 0")
def _split_overlap(t: Tables) -> DataFrame:
    test = F.col("o_orderkey") % 5 == 0
    return gates.split_overlap(t.orders.where(~test), t.orders.where(test), "o_orderdate")


# Relations, folds, series


@query("relationship", "left_column right_column cardinality join", "score left_coverage right_coverage", """
  select 'c_custkey' as left_column, 'o_custkey' as right_column, case when (select max(n) from (select count(*) as n from orders group by o_custkey)) > 1 then '1:N' else '1:1' end as cardinality, case when (select max(n) from (select count(*) as n from orders group by o_custkey)) > 1 then 'left' else 'inner' end as "join",
    2.0 * s / (a + b) as score, s / a::double as left_coverage, s / b::double as right_coverage
  from (select count(distinct c_custkey) as a from customer), (select count(distinct o_custkey) as b, count(distinct o_custkey) filter (where o_custkey in (select c_custkey from customer)) as s from orders)""")
def _relationship(t: Tables) -> DataFrame:
    return joins.relationship(t.customer, t.orders, pairs=[("c_custkey", "o_custkey"), ("c_nationkey", "o_orderkey")])


@query("cv_folds", "kind fold n", "", """
  select 'stratified' as kind, f as fold, cast(sum((n - f + 4) // 5) as bigint) as n from (select count(*) as n from orders group by o_orderstatus), (select unnest(range(5)) as f) group by f
  union all select 'time', cast(greatest(0, 4 - (n - r) // (n // 5)) as int), count(*) from (select row_number() over (order by o_orderdate, o_orderkey) as r, count(*) over () as n from orders) group by 2""")
def _folds(t: Tables) -> DataFrame:
    a = modeling.cv_folds(t.orders, "o_orderkey", 5, "stratified", "o_orderstatus").groupBy("fold").agg(F.count("*").alias("n")).withColumn("kind", F.lit("stratified"))
    b = modeling.cv_folds(t.orders, "o_orderkey", 4, "time", "o_orderdate").groupBy("fold").agg(F.count("*").alias("n")).withColumn("kind", F.lit("time"))
    return a.unionByName(b)


@query("series_validation", "entities repeated_times entities_repeated entities_with_gaps gaps largest_gap entities_out_of_order score", "coverage_pct", """
  with s as (select o_custkey as e, (epoch_us(o_orderdate) - epoch_us(lag(o_orderdate) over (partition by o_custkey order by o_orderdate))) / 3600000000.0 as h, o_orderdate < lag(o_orderdate) over (partition by o_custkey order by o_orderkey) as back from orders),
  p as (select quantile_cont(h, 0.5) as p from s),
  e as (select e, count(*) filter (where h > p * 3) as gaps, max(floor(h / p)) filter (where h > p * 3) as widest, count(*) filter (where back) as back from s, p group by e),
  r as (select count(*) as repeated_times, count(distinct o_custkey) as entities_repeated from (select o_custkey, o_orderdate from orders group by all having count(*) > 1)),
  o as (select count(*) as entities, count(*) filter (where gaps > 0) as entities_with_gaps, cast(sum(gaps) as bigint) as gaps, cast(coalesce(max(widest), 0) as bigint) as largest_gap, count(*) filter (where back > 0) as entities_out_of_order from e)
  select *, 100 - case when entities_repeated > 0.1 * entities then 20 when entities_repeated > 0.01 * entities then 10 else 0 end - case when entities_out_of_order > 0.1 * entities then 20 when entities_out_of_order > 0.01 * entities then 10 else 0 end
    - case when entities_with_gaps > 0.2 * entities then 20 when entities_with_gaps > 0.1 * entities then 10 when entities_with_gaps > 0.05 * entities then 5 else 0 end as score, 100 * (1 - entities_with_gaps / entities::double) as coverage_pct from o, r""")
def _series_validation(t: Tables) -> DataFrame:
    return validation.series_validation(t.orders, "o_custkey", "o_orderdate", sequence="o_orderkey")


@query("acf_seasonality", "period name", "strength", """
  with d as (select row_number() over (order by d) as n, y from (select date_trunc('day', ts) as d, date_diff('day', timestamp '2024-01-01', date_trunc('day', ts)) % 7 + avg(value) / 1000 as y from events group by 1, date_diff('day', timestamp '2024-01-01', date_trunc('day', ts)))),
  s as (select count(*) as k, avg(y) as m, var_pop(y) as v from d)
  select lag as period, case lag when 7 then 'weekly' else 'bi-weekly' end as name, c / v as strength from (select lag, avg((a.y - m) * (b.y - m)) as c, max(v) as v, max(k) as k from (values (7), (14)) l(lag), d a join d b on true, s where b.n = a.n + lag group by lag) where c / v > 0.3 and lag < k // 2""")
def _acf(t: Tables) -> DataFrame:
    day = F.date_trunc("day", "ts")
    d = t.events.groupBy(day.alias("d")).agg(F.avg("value").alias("v"))
    return temporal.acf_seasonality(d.withColumn("y", F.datediff("d", F.lit("2024-01-01")) % 7 + F.col("v") / 1000), "d", "y")


@query("events_per_entity", "entities", "min max mean std q25 median q75", "select count(*) as entities, min(n) as min, max(n) as max, avg(n) as mean, coalesce(stddev_samp(n), 0) as std, quantile_cont(n, 0.25) as q25, quantile_cont(n, 0.5) as median, quantile_cont(n, 0.75) as q75 from (select count(*)::double as n from events group by user_id)")
def _events_per_entity(t: Tables) -> DataFrame:
    return temporal.events_per_entity(temporal.entity_lifecycle(t.events, "user_id", "ts"))


@query("pooled_gap", "", "mean_gap_days", "select avg(g) as mean_gap_days from (select (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts))) / 86400000000.0 as g from events)")
def _pooled_gap(t: Tables) -> DataFrame:
    return temporal.pooled_gap(t.events, "user_id", "ts")


# Streams

QUERIES.pop("threshold_trigger")


@query("threshold_trigger", "user_id fired_at", "", """
  with recursive h as (select user_id, epoch_us(ts) as t from events where value > 30),
  fired as (
    select user_id, min(t) as t, 1 as n from h group by user_id
    union all select user_id, u, case when u // 86400000000 = t // 86400000000 then n + 1 else 1 end
    from (select f.user_id, f.t, f.n, min(h.t) as u from fired f join h on f.user_id = h.user_id and h.t - f.t >= 21600000000 and (f.n < 2 or h.t // 86400000000 > f.t // 86400000000) group by f.user_id, f.t, f.n))
  select user_id, cast(t // 1000000 as bigint) as fired_at from fired""")
def _threshold(t: Tables) -> DataFrame:
    return stream.threshold_trigger(t.events, "user_id", "ts", F.col("value") > 30, "6h", 2)


@query("composite_trigger", "event_id all_of any_of", "", "select event_id, value > 20 and event_type = 'error' as all_of, value > 20 or event_type = 'error' as any_of from events")
def _composite(t: Tables) -> DataFrame:
    conditions = [F.col("value") > 20, F.col("event_type") == "error"]
    d = stream.composite_trigger(t.events, conditions).withColumnRenamed("triggered", "all_of")
    return stream.composite_trigger(d, conditions, "OR").withColumnRenamed("triggered", "any_of")


@query("entity_features", "user_id clicks purchases visits session_pages session_actions", "minutes_since_last session_minutes session_idle_seconds", f"""
  select user_id, count(*) filter (where event_type = 'click') as clicks, count(*) filter (where event_type = 'purchase') as purchases, count(*) filter (where event_type = 'view') as visits, count(*) filter (where event_type = 'view') as session_pages, count(*) filter (where event_type = 'click') as session_actions,
    greatest(0.0, (epoch_us(timestamp '{REF}') - max(epoch_us(ts))) / 60000000.0) as minutes_since_last, (max(epoch_us(ts)) - min(epoch_us(ts))) / 60000000.0 as session_minutes, coalesce(sum(g) filter (where g > 30), 0) as session_idle_seconds
  from (select *, (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts))) / 1000000.0 as g from events) group by user_id""")
def _entity_features(t: Tables) -> DataFrame:
    return stream.entity_features(t.events, "user_id", "ts", "event_type", {"clicks": "click", "purchases": "purchase"}, F.lit(REF).cast("timestamp"), ("view",), ("click",), ("view",))


@query("schema_errors", "event_type errors n", "", """
  select event_type, case when event_type = 'signup' then 'no schema' when event_type = 'purchase' then 'missing price' else '' end as errors, count(*) as n from events where event_type in ('signup', 'purchase', 'click') group by 1, 2""")
def _schema_errors(t: Tables) -> DataFrame:
    d = t.events.where("event_type in ('signup', 'purchase', 'click')").withColumn("props", F.lit('{"page": 1, "query": "x"}'))
    d = stream.schema_errors(d, {"purchase": ["price", "page"], "click": ["page"]})
    return d.groupBy("event_type", F.array_join("errors", ",").alias("errors")).agg(F.count("*").alias("n"))


# Transforms


@query("days_since", "o_orderkey days_since_o_orderdate", "", "select o_orderkey, cast(floor((epoch_us(timestamp '2002-01-01') - epoch_us(o_orderdate)) / 86400000000.0) as bigint) as days_since_o_orderdate from orders")
def _days_since(t: Tables) -> DataFrame:
    return transforms.days_since(t.orders, "o_orderdate", F.lit("2002-01-01").cast("timestamp"))


@query("box_cox", "p_partkey", "b y", "select p_partkey, (power(p_retailprice, 0.3) - 1) / 0.3 as b, ln(p_size + 1) as y from part")
def _box_cox(t: Tables) -> DataFrame:
    return t.part.withColumns({"b": transforms.box_cox(F.col("p_retailprice"), 0.3), "y": transforms.yeo_johnson(F.col("p_size"), 0.0)})


@query("hash_split", "rows both", "", "select count(*) as rows, cast(0 as bigint) as both from orders")
def _hash_split(t: Tables) -> DataFrame:
    """Rows, and groups that stand on both sides: none."""
    d = modeling.hash_split(t.orders, "o_custkey")
    return d.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct("split").alias("k")).agg(F.sum("n").alias("rows"), F.count(F.when(F.col("k") > 1, 1)).alias("both"))


@query("cyclical_names", "event_id", "day_sin day_cos", """
  select event_id, sin(2 * pi() * d / 7) as day_sin, cos(2 * pi() * d / 7) as day_cos from (select event_id, list_position(['monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday'], lower(dayname(ts))) - 1 as d from events)""")
def _cyclical_names(t: Tables) -> DataFrame:
    return transforms.cyclical_names(t.events.withColumn("day", F.date_format("ts", "EEEE")), "day")


@query("binary_mapping", "o_orderkey flag rest", "", "select o_orderkey, case when o_orderkey % 3 = 0 then 1 else 0 end as flag, case when o_orderkey % 2 = 0 then 1 else 0 end as rest from orders")
def _binary_mapping(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    d = t.orders.select("o_orderkey", F.when(k % 3 == 0, "Yes").otherwise("no").alias("flag"), F.when(k % 2 == 0, "west").otherwise("east").alias("rest"))
    return transforms.binary(transforms.binary(d, "flag"), "rest")


@query("useless_columns", "column", "", """select * from (values ('c_custkey'), ('void'), ('same')) v("column")""")
def _useless(t: Tables) -> DataFrame:
    d = t.customer.select("c_custkey", "c_acctbal", F.when(F.col("c_custkey") % 50 == 0, F.col("c_custkey")).alias("void"), F.lit(1).alias("same"))
    return d.sparkSession.createDataFrame([(c,) for c in transforms.useless_columns(d, ["c_custkey"])], "column string")


# Joins by entity


@query("first_target", "event_id user_id event_type", "", """
  select event_id, user_id, first as event_type from events join (select user_id, min((ts, event_type)) filter (where event_type <> 'view') as f from events group by user_id) using (user_id), lateral (select f[2] as first)""")
def _first_target(t: Tables) -> DataFrame:
    return joins.with_first_target(t.events.withColumn("event_type", F.when(F.col("event_type") != "view", F.col("event_type"))), "user_id", "event_type", "ts")


@query("training_labels", "o_orderkey o_orderstatus", "", "select o_orderkey, o_orderstatus from orders where o_orderdate <= timestamp '1999-01-01'")
def _training_labels(t: Tables) -> DataFrame:
    return joins.training_labels(t.orders, "o_orderkey", "o_orderstatus", "o_orderdate", "1999-01-01")


@query("common_rows", "o_orderkey o_custkey", "", "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 0)")
def _common_rows(t: Tables) -> DataFrame:
    return joins.common_rows(t.orders, t.customer.where("c_acctbal > 0").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")


# Sources: written to the shared folder and read again

_PLACES = "n_nationkey n_name n_regionkey"


def _stored(t: Tables, kind: str, **options: str) -> DataFrame:
    path = shared_path(t.spark, kind)
    writer = t.nation.select(*_PLACES.split()).write
    (writer.option("header", "true") if kind == "csv" else writer).format(kind).save(path)
    return tables.load(t.spark, tables.SourceConfig("nation", path, kind, options, "n_nationkey int, n_name string, n_regionkey int"))


for _kind in ("csv", "json", "orc", "parquet"):
    query(f"{_kind}_source", _PLACES, "", "select n_nationkey, n_name, n_regionkey from nation")(lambda t, kind=_kind: _stored(t, kind))


@query("metadata_source", "c_custkey reference_date", "", "select c_custkey, '2024-01-31' as reference_date from customer")
def _metadata(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "metadata")
    tables.save_with_metadata(t.customer.select("c_custkey"), path, {"reference_date": "2024-01-31"})
    d = tables.load(t.spark, tables.SourceConfig("customer", path))
    return d.withColumn("reference_date", F.lit(tables.metadata_of(d)["reference_date"]))


@query("snapshot", "o_orderkey version", "", "select o_orderkey, 2 as version from orders where o_orderdate <= timestamp '1999-01-01' and o_orderstatus <> 'P'")
def _snapshot(t: Tables) -> DataFrame:
    """The second version, verified by its hash when it is loaded."""
    store = snapshots.Snapshots(t.spark, shared_path(t.spark, "snapshots"))
    d = t.orders.select("o_orderkey", F.col("o_orderdate").alias("feature_timestamp"), F.col("o_orderdate").alias("label_timestamp"), (F.col("o_orderstatus") != "P").alias("label_available_flag"))
    store.create(d.where("o_orderkey % 2 = 0"), "orders", "1998-01-01")
    return store.load("orders", store.create(d, "orders", "1999-01-01").version).withColumn("version", F.lit(max(store.versions("orders"))))


@query("append_keep_last", "c_custkey c_mktsegment", "c_acctbal", "select c_custkey, case when c_custkey % 3 = 0 then 'NEW' else c_mktsegment end as c_mktsegment, c_acctbal + case when c_custkey % 3 = 0 then 1 else 0 end as c_acctbal from customer")
def _append(t: Tables) -> DataFrame:
    newer = t.customer.where("c_custkey % 3 = 0").withColumns({"c_mktsegment": F.lit("NEW"), "c_acctbal": F.col("c_acctbal") + 1})
    return tables.append_keep_last(t.customer.withColumn("o", F.lit(1)), newer.withColumn("o", F.lit(1)), ["c_custkey"], "o")


assert set(SQL) <= set(QUERIES)

"""Gates before training: data quality, leakage by content, leakage by names and times. Each is a list of issues, one row for
each, from one wide aggregation and a few counted tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import running

#: Shares from which missing values, repeated keys and classes are issues.
MISSING_CRITICAL, MISSING_HIGH, REPEATED_HIGH, RARE_SEVERE, RARE_MODERATE = 0.5, 0.3, 0.1, 0.01, 0.1
#: Correlations from which a feature is suspected, by the gate and by the detector.
GATE_CORRELATION = (0.90, 0.70)
CORRELATION, OVERLAP, AUC = (0.90, 0.70, 0.50), (0.0, 1.0, 5.0), (0.90, 0.80)
#: What names of features say.
TEMPORAL_NAME = r"(?i)(days|since|tenure|recency|last|ago|date|time)"
DOMAIN_NAME = r"(?i)(churn|reten|cancel|unsubscribe|attrit|lapse|defect|convert|active|inactive|leave|stay|renew|expir|terminat|close|deactivat)"
CROSS_ENTITY_NAME = r"(?i)(global|population|all_user|cross_entity|market_avg|cohort_avg|overall_mean|overall_std|benchmark|percentile_rank)"
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _numeric(df: DataFrame, columns: Sequence[str]) -> list[str]:
    kinds = dict(df.dtypes)
    return [c for c in columns if kinds[c] in NUMBERS or kinds[c].startswith("decimal")]


def _time(df: DataFrame, column: str) -> Column:
    """A column as times; texts that are none are null."""
    return F.expr(f"try_cast(`{column}` as timestamp)") if dict(df.dtypes)[column] == "string" else F.col(column).cast("timestamp")


def _issues(row: DataFrame, rows: Sequence[Column]) -> DataFrame:
    """Rows of structs whose first field, the check's id, is not null."""
    return row.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("check_id is not null")


def data_quality(df: DataFrame, keys: Sequence[str] = (), target: str | None = None, dates: Sequence[str] = (), numbers: Sequence[str] = (), as_of: Column | None = None, order: Sequence[tuple[str, str]] = (("created", "firstorder"),)) -> DataFrame:
    """(check_id, subject, severity, affected, total). Missing values over half (DQ001) or .3 (DQ002); keys that are no
    columns (DQ010), rows that repeat keys, over a tenth (DQ011) or some (DQ012); a target that is no column (DQ020) or has
    nulls (DQ021), its rarest class under .01 (DQ022) or .1 (DQ023) of all rows; dates after as_of (DQ030) or after the
    other one of their pair (DQ031); columns declared as numbers that are text, all of which parses (DQ040)."""
    spark, total = df.sparkSession, F.count("*")
    kinds = dict(df.dtypes)
    issue = lambda id_, subject, severity, affected: F.struct(id_.alias("check_id"), F.lit(subject).alias("subject"), severity.alias("severity"), affected.cast("bigint").alias("affected"), F.col("total").alias("total"))
    aggs, rows = [total.alias("total")], []

    def count(condition: Column) -> Column:
        aggs.append(F.count(F.when(condition, 1)).alias(f"a{len(aggs)}"))
        return F.col(f"a{len(aggs) - 1}")

    for c in df.columns:
        n = count(F.col(c).isNull())
        share = F.try_divide(n.cast("double"), F.col("total").cast("double"))
        rows.append(issue(F.when(share > MISSING_CRITICAL, "DQ001").when(share > MISSING_HIGH, "DQ002"), c, F.when(share > MISSING_CRITICAL, "critical").otherwise("high"), n))
    if target in df.columns:
        n = count(F.col(target).isNull())
        rows.append(issue(F.when(n > 0, "DQ021"), target, F.lit("critical"), n))
    for c in dates if as_of is not None else ():
        if c in df.columns:
            n = count(_time(df, c) > as_of)
            rows.append(issue(F.when(n > 0, "DQ030"), c, F.lit("high"), n))
    for a, b in order:
        if a in df.columns and b in df.columns:
            n = count(_time(df, a) > _time(df, b))
            rows.append(issue(F.when(n > 0, "DQ031"), f"{a},{b}", F.lit("high"), n))
    for c in numbers:
        if kinds.get(c) == "string":
            n = count(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` as double)").isNull())
            rows.append(issue(F.when(n == 0, "DQ040"), c, F.lit("medium"), F.col("total")))
    out = _issues(df.agg(*aggs), rows)
    fixed = []
    if absent := [k for k in keys if k not in df.columns]:
        fixed.append(("DQ010", ",".join(absent), "high", None, None))
    elif keys:
        d = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("again"))
        many = F.try_divide(F.col("again").cast("double"), F.col("total").cast("double")) > REPEATED_HIGH
        out = out.unionByName(_issues(d, [issue(F.when(many, "DQ011").when(F.col("again") > 0, "DQ012"), ",".join(keys), F.when(many, "high").otherwise("medium"), F.col("again"))]))
    if target and target not in df.columns:
        fixed.append(("DQ020", target, "critical", None, None))
    elif target:
        d = df.groupBy(F.col(target).alias("c")).agg(F.count("*").alias("n")).agg(F.sum("n").alias("total"), F.min(F.when(F.col("c").isNotNull(), F.col("n"))).alias("least"), F.count("c").alias("classes"))
        share = F.when(F.col("classes") > 1, F.col("least") / F.col("total"))
        out = out.unionByName(_issues(d, [issue(F.when(share < RARE_SEVERE, "DQ022").when(share < RARE_MODERATE, "DQ023"), target, F.when(share < RARE_SEVERE, "high").otherwise("medium"), F.col("least"))]))
    return out.unionByName(spark.createDataFrame(fixed, "check_id string, subject string, severity string, affected bigint, total bigint")) if fixed else out


def _classes(df: DataFrame, target: str) -> tuple | None:
    """The two classes of a target, the smaller first; None if there aren't two."""
    row = df.agg(F.min(target).alias("a"), F.max(target).alias("b"), F.count_distinct(target).alias("n")).first()
    return (row.a, row.b) if row["n"] == 2 else None


def leakage(df: DataFrame, target: str, features: Sequence[str] | None = None, reference: Column | None = None, dates: Sequence[str] = (), feature_time: str = "feature_timestamp", label_time: str = "label_timestamp", availability: dict[str, tuple[str | None, float]] | None = None, coverage: float = 50.0) -> DataFrame:
    """(check_id, feature, severity, value). Correlation with the target of .9 (LK001) or .7 (LK002), classes whose values are
    apart (LK003), dates after the reference (LK004), nearly constant within each class (LK008), feature times after
    label times (LK009), dates after feature times (LK010); tracking that began late, ended, or did both (LK011), and
    coverage under `coverage` percent without that (LK012): availability is {feature: (new_tracking, retired,
    partial_window or None, percent)}."""
    features = [c for c in features or df.columns if c not in (target, feature_time, label_time)]
    two = _classes(df, target)
    issue = lambda id_, subject, severity, value: F.struct(id_.alias("check_id"), F.lit(subject).alias("feature"), F.lit(severity).alias("severity"), value.cast("double").alias("value"))
    aggs, rows = [F.count("*").alias("total")], []

    def agg(c: Column) -> Column:
        aggs.append(c.alias(f"a{len(aggs)}"))
        return F.col(f"a{len(aggs) - 1}")

    none = F.lit(None)
    for c in _numeric(df, features):
        x = F.col(c).cast("double")
        if target in _numeric(df, [target]):
            r = agg(F.corr(x, F.col(target).cast("double")))
            rows += [issue(F.when(F.abs(r) >= GATE_CORRELATION[0], "LK001"), c, "critical", r), issue(F.when((F.abs(r) >= GATE_CORRELATION[1]) & (F.abs(r) < GATE_CORRELATION[0]), "LK002"), c, "high", r)]
        if two:
            a, b = (F.when(F.col(target) == v, x) for v in two)
            low, high, v, m = ([agg(f(s)) for s in (a, b)] for f in (F.min, F.max, F.var_samp, F.avg))
            rows.append(issue(F.when((high[0] < low[1]) | (high[1] < low[0]), "LK003"), c, "critical", none))
            rows.append(issue(F.when((v[0] < 0.01) & (v[1] < 0.01) & (F.abs(m[0] - m[1]) > 0.1), "LK008"), c, "high", none))
    for c in dates if reference is not None else ():
        n = agg(F.count(F.when(_time(df, c) > reference, 1)))
        rows.append(issue(F.when(n > 0, "LK004"), c, "critical", n))
    if feature_time in df.columns:
        if label_time in df.columns:
            n = agg(F.count(F.when(_time(df, feature_time) > _time(df, label_time), 1)))
            rows.append(issue(F.when(n > 0, "LK009"), feature_time, "critical", n))
        kinds = dict(df.dtypes)
        for c in (c for c in features if kinds[c] in ("date", "timestamp", "timestamp_ntz", "string")):
            n = agg(F.count(F.when(_time(df, c) > _time(df, feature_time), 1)))
            rows.append(issue(F.when(n > 0, "LK010"), c, "critical", n))
    for c, (kind, percent) in (availability or {}).items():
        if c in features and (kind or percent < coverage):
            rows.append(issue(F.lit("LK011" if kind else "LK012"), c, "high", F.lit(float(percent))))
    return _issues(df.agg(*aggs), rows or [issue(none.cast("string"), "", "", none)])


def feature_aucs(df: DataFrame, features: Sequence[str], target: str, least: int = 5) -> DataFrame:
    """(feature, auc): area under the curve of each feature alone by ranks, the larger side; .5 if a class has under `least`
    rows. Values of all features are counted first; ranks are running counts by ranges."""
    y = F.col(target).cast("int")
    long = df.where(y.isin(0, 1)).select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])).alias("r"), y.alias("y"))
    each = long.where("r.x is not null and not isnan(r.x)").groupBy("r.feature", "r.x").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    r = running(each.select(F.struct("feature", "x").alias("at"), "p", "q"), "at", ["q"]).select("at.feature", "p", "q", "q_running")
    won = F.sum(F.col("p") * (F.col("q_running") - F.col("q") / 2)) - F.min(F.col("q_running") - F.col("q")) * F.sum("p")
    auc = F.try_divide(won, (F.sum("p") * F.sum("q")).cast("double"))
    return r.groupBy("feature").agg(F.when(F.least(F.sum("p"), F.sum("q")) >= least, F.greatest(auc, 1 - auc)).otherwise(0.5).alias("auc"))


def detect_leakage(df: DataFrame, target: str, features: Sequence[str] | None = None, name: str | None = None, feature_time: str = "feature_timestamp", label_time: str = "label_timestamp") -> DataFrame:
    """(check_id, feature, severity, value) of a 0/1 target. Correlation over .9, .7, .5 (LD001-3); overlap of the classes'
    ranges of 0, under 1, under 5 percent (LD010-12); names of times with a correlation over .5 (LD022); area under the
    curve of the feature alone over .9, .8 (LD030, LD031; names of times: LD031 over .9); feature times after label times
    (LD040), dates after feature times (LD041, value in percent); feature times that are all the same, or within a minute
    (LD050); the target among the features, by name or with a correlation over .99 (LD052); names that speak of the target's
    domain (LD053) and of other entities (LD060)."""
    features = [c for c in features or df.columns if c not in (target, feature_time, label_time)]
    name = name or target
    numeric, kinds = _numeric(df, features), dict(df.dtypes)
    y = F.col(target)
    issue = lambda id_, subject, severity, value: F.struct(id_.alias("check_id"), F.lit(subject).alias("feature"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), value.cast("double").alias("value"))
    aggs, rows = [F.count("*").alias("total")], []

    def agg(c: Column) -> Column:
        aggs.append(c.alias(f"a{len(aggs)}"))
        return F.col(f"a{len(aggs) - 1}")

    by_name = [c for c in df.columns if c != target and (f"{name}_".lower() in c.lower() or f"_{name}".lower() in c.lower())]
    rows += [issue(F.lit("LD052"), c, "critical", F.lit(None)) for c in by_name]
    for c in numeric:
        x = F.col(c).cast("double")
        r = F.coalesce(F.abs(agg(F.corr(x, y.cast("double")))), F.lit(0.0))
        rows.append(issue(F.when(r > CORRELATION[0], "LD001").when(r > CORRELATION[1], "LD002").when(r > CORRELATION[2], "LD003"), c, F.when(r > CORRELATION[0], "critical").when(r > CORRELATION[1], "high").otherwise("medium"), r))
        one, zero = F.when(y == 1, x), F.when(y == 0, x)
        l1, h1, l0, h0 = agg(F.min(one)), agg(F.max(one)), agg(F.min(zero)), agg(F.max(zero))
        o = F.coalesce(F.try_divide(100 * F.greatest(F.lit(0.0), F.least(h1, h0) - F.greatest(l1, l0)), F.when(l1.isNotNull() & l0.isNotNull(), F.greatest(h1, h0) - F.least(l1, l0))), F.lit(100.0))
        rows.append(issue(F.when(o <= OVERLAP[0], "LD010").when(o < OVERLAP[1], "LD011").when(o < OVERLAP[2], "LD012"), c, F.when(o <= OVERLAP[0], "critical").when(o < OVERLAP[1], "high").otherwise("medium"), o))
        above = F.when(r > CORRELATION[1], "critical").when(r > CORRELATION[2], "high").otherwise("medium")
        if re.search(TEMPORAL_NAME, c):
            rows.append(issue(F.when(r > CORRELATION[2], "LD022"), c, F.when(r > CORRELATION[1], "high").otherwise("medium"), r))
        if re.search(DOMAIN_NAME, c):
            rows.append(issue(F.lit("LD053"), c, above, r))
        if re.search(CROSS_ENTITY_NAME, c):
            rows.append(issue(F.lit("LD060"), c, F.when(r > CORRELATION[2], "high").otherwise("medium"), r))
        if c not in by_name:
            rows.append(issue(F.when(r > 0.99, "LD052"), c, "critical", r))
    if feature_time in df.columns:
        at = _time(df, feature_time)
        if label_time in df.columns:
            n = agg(F.count(F.when(at > _time(df, label_time), 1)))
            rows.append(issue(F.when(n > 0, "LD040"), feature_time, "critical", n))
        for c in (c for c in features if kinds[c] in ("date", "timestamp", "timestamp_ntz")):
            n = agg(F.count(F.when(_time(df, c) > at, 1)))
            share = 100.0 * n / F.col("total")
            rows.append(issue(F.when(n > 0, "LD041"), c, F.when(share > 5, "critical").otherwise("high"), share))
        n, low, high = agg(F.count(at)), agg(F.unix_micros(F.min(at))), agg(F.unix_micros(F.max(at)))
        rows.append(issue(F.when((n > 1) & (high - low < 60_000_000), "LD050"), feature_time, F.when(high == low, "high").otherwise("medium"), (high - low) / 1e6))
    out = _issues(df.agg(*aggs), rows or [issue(F.lit(None).cast("string"), "", "", F.lit(None))])
    if not numeric:
        return out
    auc, temporal = F.col("auc"), F.col("feature").rlike(TEMPORAL_NAME)
    found = F.when(temporal, F.when(auc > AUC[0], "LD031")).when(auc > AUC[0], "LD030").when(auc > AUC[1], "LD031")
    alone = feature_aucs(df, numeric, target).select(found.alias("check_id"), "feature", F.when(found == "LD030", "critical").otherwise("high").alias("severity"), auc.alias("value"))
    return out.unionByName(alone.where("check_id is not null"))


def split_overlap(train: DataFrame, test: DataFrame, time: str) -> DataFrame:
    """Issue LD061 if training rows are as late as the first test row: how many, and their percentage."""
    first = test.agg(F.min(_time(test, time)).alias("_first"))
    d = train.where(F.col(time).isNotNull()).join(F.broadcast(first))  # one row
    late = F.count(F.when(_time(train, time) >= F.col("_first"), 1))
    return d.agg(late.alias("rows"), F.try_divide(100.0 * late, F.count("*").cast("double")).alias("percent")).where("rows > 0").select(F.lit("LD061").alias("check_id"), F.lit(time).alias("feature"), F.lit("critical").alias("severity"), "rows", "percent")

"""Column transforms with fitted parameters: scaling, powers, date parts, encodings, interactions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import quantiles
from ..time import days_between

PERIODS = {"month": 12, "day_of_week": 7, "day_of_year": 365, "quarter": 4, "hour": 24, "minute": 60}
#: Names in cyclical order.
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Pairs that stand for yes and no.
BINARY = {"yes": 1, "no": 0, "y": 1, "n": 0, "true": 1, "false": 0, "t": 1, "f": 0, "active": 1, "inactive": 0, "1": 1, "0": 0}


@dataclass(frozen=True)
class Scaler:
    """(x - shift) / scale per column; a scale of 0 gives 0."""

    shift: dict[str, float]
    scale: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.when(F.col(c).isNotNull(), F.lit(0.0)) if not s else (F.col(c).cast("double") - self.shift[c]) / s) for c, s in self.scale.items()})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * s + self.shift[c] for c, s in self.scale.items()})


def fit_scaler(df: DataFrame, columns: Sequence[str], method: str = "standard") -> Scaler:
    """standard (population deviation), minmax, robust (median and quartile range) or maxabs."""
    if method == "robust":
        q = {c: v or [0.0, 0.0, 0.0] for c, v in quantiles(df, columns, [0.25, 0.5, 0.75]).items()}
        return Scaler({c: v[1] for c, v in q.items()}, {c: v[2] - v[0] for c, v in q.items()})
    made = {"standard": lambda c: (F.avg(c), F.stddev_pop(c)), "minmax": lambda c: (F.min(c), F.max(c) - F.min(c)), "maxabs": lambda c: (F.lit(0.0), F.max(F.abs(c)))}
    if method not in made:
        raise ValueError(f"method {method} is none of robust and {sorted(made)}")
    row = df.agg(*[F.struct(*[x.cast("double").alias(n) for n, x in zip("ab", made[method](F.col(c)), strict=True)]).alias(c) for c in columns]).first()
    return Scaler({c: row[c].a or 0.0 for c in columns}, {c: row[c].b or 0.0 for c in columns})


def power(df: DataFrame, column: str, method: str, inverse: bool = False) -> DataFrame:
    """log, log1p or sqrt; values outside the domain fail the query."""
    c = F.col(column).cast("double")
    domain = {"log": c > 0, "log1p": c > -1, "sqrt": c >= 0}[method]
    if inverse:
        return df.withColumn(column, {"log": F.exp(c), "log1p": F.expm1(c), "sqrt": c * c}[method])
    made = {"log": F.log(c), "log1p": F.log1p(c), "sqrt": F.sqrt(c)}[method]
    return df.withColumn(column, F.when(c.isNull() | domain, made).otherwise(F.raise_error(F.lit(f"{column} is outside the domain of {method}")).cast("double")))


def box_cox(x: Column, lam: float) -> Column:
    return F.log(x) if lam == 0 else (F.pow(x, F.lit(lam)) - 1) / lam


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if lam == 0 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if lam == 2 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def date_parts(t: Column) -> dict[str, Column]:
    """Fourteen parts; Monday is day 0."""
    t = t.cast("timestamp")
    d = F.to_date(t)
    quarter = F.to_date(F.date_trunc("quarter", t))
    out = {
        "year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "day_of_week": F.weekday(t), "day_of_year": F.dayofyear(t), "week_of_year": F.weekofyear(t), "quarter": F.quarter(t),
        "hour": F.hour(t), "minute": F.minute(t), "is_weekend": (F.weekday(t) >= 5), "is_month_start": F.dayofmonth(t) == 1, "is_month_end": d == F.last_day(d),
        "is_quarter_start": d == quarter, "is_quarter_end": F.date_add(d, 1) == F.to_date(F.add_months(quarter, 3)),
    }
    return {n: c.cast("int") for n, c in out.items()}


def cyclical(value: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * value / period
    return F.sin(angle), F.cos(angle)


def days_since(df: DataFrame, column: str, reference: Column) -> DataFrame:
    return df.withColumn(f"days_since_{column}", days_between(reference, F.col(column).cast("timestamp")))


# Encodings


@dataclass(frozen=True)
class Encoder:
    """A fitted encoding of one column: the values it knows, and for some kinds a number for each."""

    column: str
    kind: str
    values: list[str]
    numbers: dict[str, float] = field(default_factory=dict)
    default: float | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        c = F.col(self.column)
        if self.kind == "one_hot":
            return df.withColumns({f"{self.column}_{v}": F.coalesce(c == v, F.lit(False)).cast("int") for v in self.values}).drop(self.column)
        if not self.numbers:
            return df.withColumn(self.column, F.lit(None).cast("double"))
        table = F.create_map(*[F.lit(x) for kv in self.numbers.items() for x in kv])
        found = table[c]
        if self.kind in ("label", "ordinal"):
            unknown = F.raise_error(F.concat(F.lit(f"{self.column} has no such value: "), c)).cast("double")
            return df.withColumn(self.column, F.when(c.isNull(), F.lit(None)).when(found.isNull(), unknown).otherwise(found).cast("int"))
        return df.withColumn(self.column, F.when(c.isNotNull(), F.coalesce(found, F.lit(self.default))))


def fit_encoder(df: DataFrame, column: str, kind: str, target: str | None = None, order: Sequence[str] = (), least: int = 1, drop_first: bool = False, smoothing: float = 10.0, max_values: int = 10_000) -> Encoder:
    """one_hot, label, ordinal (order given), frequency or target (smoothed mean). A column of more than max_values
    values fails: encode it with `encode_by_join`."""
    if kind == "ordinal":
        return Encoder(column, kind, list(order), {v: i for i, v in enumerate(order)})
    aggs = [F.count("*").alias("n")] + ([F.sum(target).cast("double").alias("s"), F.count(target).alias("nt")] if target else [])
    rows = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(*aggs).limit(max_values + 1).collect()
    if len(rows) > max_values:
        raise ValueError(f"column {column} has more than {max_values} values")
    rows = sorted(rows, key=lambda r: r.v)
    if kind == "one_hot":
        return Encoder(column, kind, [r.v for r in rows if r.n >= least][1 if drop_first else 0 :])
    if kind == "label":
        return Encoder(column, kind, [r.v for r in rows], {r.v: i for i, r in enumerate(rows)})
    total = sum(r.n for r in rows)
    if kind == "frequency":
        return Encoder(column, kind, [r.v for r in rows], {r.v: r.n / total for r in rows}, 0.0)
    if kind == "target":
        n = sum(r.nt for r in rows)
        mean = sum(r.s or 0.0 for r in rows) / n
        return Encoder(column, kind, [r.v for r in rows], {r.v: ((r.s or 0.0) + smoothing * mean) / (r.nt + smoothing) for r in rows}, mean)
    raise ValueError(f"kind {kind} is not known")


def encode_by_join(df: DataFrame, column: str, kind: str, target: str | None = None, smoothing: float = 10.0) -> DataFrame:
    """frequency or target encoding as a join, for columns of any number of values."""
    each = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"), *([F.sum(target).cast("double").alias("_s"), F.count(target).alias("_c")] if target else []))
    if kind == "frequency":
        table = each.join(F.broadcast(each.agg(F.sum("_n").alias("_t")))).select(column, (F.col("_n") / F.col("_t")).alias(f"{column}_{kind}"))  # one row
    else:
        mean = each.agg((F.sum("_s") / F.sum("_c")).alias("_m"))
        table = each.join(F.broadcast(mean)).select(column, ((F.col("_s") + smoothing * F.col("_m")) / (F.col("_c") + smoothing)).alias(f"{column}_{kind}"))  # one row
    return df.join(table, column, "left")


def cyclical_names(df: DataFrame, column: str) -> DataFrame:
    """Sine and cosine of names of days or months, or of numbers from 1."""
    low = F.lower(F.trim(F.col(column).cast("string")))
    day, month = (F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])[low] for names in (DAYS, MONTHS))
    at, period = F.coalesce(day, month), F.when(month.isNotNull(), 12).otherwise(7)
    angle = F.lit(2 * math.pi) * at / period
    return df.withColumns({f"{column}_sin": F.sin(angle), f"{column}_cos": F.cos(angle)})


def binary(df: DataFrame, column: str) -> DataFrame:
    """1 and 0 for known pairs of names; of other two values the larger is 1. More than two fail."""
    values = sorted(str(r[0]) for r in df.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).distinct().limit(3).collect())
    if len(values) > 2:
        raise ValueError(f"column {column} has more than two values")
    known = {v: BINARY[v.strip().lower()] for v in values if v.strip().lower() in BINARY}
    if len(known) < len(values):
        known = {v: i for i, v in enumerate(values)}
    made = F.lit(None).cast("int")
    for v, n in known.items():
        made = F.when(F.col(column).cast("string") == v, n).otherwise(made)
    return df.withColumn(column, made)


def consistent(c: Column, case: str = "lower") -> Column:
    """Trimmed, with single spaces, in one case."""
    c = F.regexp_replace(F.trim(c), r"\s+", " ")
    return {"lower": F.lower, "upper": F.upper, "title": F.initcap, "none": lambda x: x}[case](c)


# Interactions


def ratio(a: Column, b: Column) -> Column:
    """Null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def interactions(df: DataFrame, specs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(kind, a, b) with kind ratio, product, sum or difference, named a_kind_b."""
    made = {"ratio": ratio, "product": lambda a, b: a * b, "sum": lambda a, b: a + b, "difference": lambda a, b: a - b}
    return df.withColumns({f"{a}_{k}_{b}": made[k](F.col(a), F.col(b)) for k, a, b in specs})


def useless_columns(df: DataFrame, identifiers: Sequence[str] = (), missing: float = 0.95) -> list[str]:
    """Identifiers, columns missing in more than that share of rows, and constant ones; one aggregation."""
    row = df.agg(F.count("*").alias("_n"), *[F.struct(F.count(c).alias("n"), F.min(c).cast("string").alias("a"), F.max(c).cast("string").alias("b")).alias(c) for c in df.columns]).first()
    n = row["_n"]
    return [c for c in df.columns if c in identifiers or (n and 1 - row[c].n / n > missing) or row[c].a == row[c].b]

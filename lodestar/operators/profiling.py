"""Column profiles and quality checks: one wide aggregation for a table's numbers, one counted table for each text column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import quantile_row
from ..functions.stats import kurtosis, skewness

#: Tokens that stand for an unknown category.
UNKNOWN_TOKENS = ("unknown", "n/a", "na", "none", "null", "missing", "undefined", "?", "-")
#: Tokens of binary columns.
TRUE_TOKENS, FALSE_TOKENS = ("1", "1.0", "true", "yes", "y", "t"), ("0", "0.0", "false", "no", "n", "f")
#: Patterns of personal data.
PII = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
}
#: Formats of dates and times that are tried.
TIME_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "MM-dd-yyyy", "dd.MM.yyyy", "yyyyMMdd", "yyyy-MM-dd'T'HH:mm:ss", "MMM d, yyyy")


def _long(row: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each column from a row of structs."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])).alias("r")).select("r.column", "r.s.*")


def universal(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, nulls, distinct values and their shares in percent."""
    columns = list(columns or df.columns)
    n = F.count("*")
    row = df.agg(*[
        F.struct(n.alias("rows"), (n - F.count(c)).alias("nulls"), F.count_distinct(c).alias("distinct"), F.try_divide((n - F.count(c)) * 100.0, n.cast("double")).alias("null_pct"), F.try_divide(F.count_distinct(c) * 100.0, F.count(c).cast("double")).alias("distinct_pct")).alias(c)
        for c in columns
    ])
    return _long(row, columns)


def numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Moments, exact quartiles, zeros, negatives, infinities, and outliers by quartile fences and by three deviations.
    Quartiles come from ranks by ranges; the rows of the first passes are broadcast to the last."""
    first = df.agg(*[
        F.struct(
            F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
            skewness(F.col(c)).alias("skewness"), kurtosis(F.col(c)).alias("kurtosis"),
            F.count(F.when(F.col(c) == F.floor(F.col(c).cast("double")), 1)).alias("whole"), F.count(F.when(F.col(c) == 0, 1)).alias("zeros"), F.count(F.when(F.col(c) < 0, 1)).alias("negatives"), F.count(F.when(F.abs(F.col(c).cast("double")) == float("inf"), 1)).alias("infinite"),
        ).alias(f"_{c}")
        for c in columns
    ])
    quartiles = quantile_row(df, columns, [0.25, 0.5, 0.75]).select(*[F.col(c).alias(f"_q_{c}") for c in columns])
    both = df.select(*columns).join(F.broadcast(first.join(F.broadcast(quartiles))))  # one row each

    def outside(c: str) -> list[Column]:
        q, x = F.col(f"_q_{c}"), F.col(c)
        low, high = q[0] - 1.5 * (q[2] - q[0]), q[2] + 1.5 * (q[2] - q[0])
        z = F.abs(x - F.col(f"_{c}.mean")) > 3 * F.col(f"_{c}.std")
        return [F.count(F.when((x < low) | (x > high), 1)).alias("iqr_outliers"), F.count(F.when(z, 1)).alias("z_outliers")]

    row = both.agg(*[F.struct(F.first(f"_{c}").alias("p"), F.first(f"_q_{c}").alias("q"), *outside(c)).alias(c) for c in columns])
    d = _long(row, columns)
    return d.select("column", "p.n", "p.mean", "p.std", "p.min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "p.max", "p.skewness", "p.kurtosis", "p.zeros", "p.whole", "p.negatives", "p.infinite", "iqr_outliers", "z_outliers")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal bins from the least to the largest value, the last one closed."""
    x = F.col(column).cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    d = df.where(x.isNotNull()).join(F.broadcast(ends))  # one row
    at = F.least(F.floor(F.coalesce(F.try_divide(x - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * bins), F.lit(bins - 1))
    return d.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k commonest values, of equally common ones the smaller: a report of that many rows."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def categorical(df: DataFrame, column: str, rare: float = 0.01) -> DataFrame:
    """Cardinality, entropy in bits, share of the commonest, rare categories and their rows in percent, unknown tokens,
    values that differ in case only, and values with surrounding white space."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    c = counts.join(F.broadcast(total)).withColumn("p", F.col("n") / F.col("t"))  # one row
    cases = counts.groupBy(F.lower("v").alias("l")).agg(F.count("*").alias("k")).agg(F.count(F.when(F.col("k") > 1, 1)).alias("case_variants"))
    out = c.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("cardinality"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), F.max("p").alias("top_share"), F.count(F.when(F.col("p") < rare, 1)).alias("rare_categories"),
        F.coalesce(F.sum(F.when(F.col("p") < rare, F.col("p"))), F.lit(0.0)).alias("_rare"), F.count(F.when(F.lower(F.trim("v")).isin(*UNKNOWN_TOKENS), 1)).alias("unknown_tokens"), F.count(F.when(F.col("v") != F.trim("v"), 1)).alias("padded_values"),
    )
    return out.withColumn("rare_pct", F.col("_rare") * 100).drop("_rare").join(F.broadcast(cases))  # one row


def text(df: DataFrame, column: str) -> DataFrame:
    """Lengths, words, empty texts and rows with personal data, over all rows and whole texts."""
    c = F.col(column)
    length = F.length(c)
    return df.agg(
        F.count(c).alias("n"), F.avg(length).alias("mean_length"), F.min(length).alias("min_length"), F.max(length).alias("max_length"), F.avg(F.size(F.split(c, " "))).alias("mean_words"),
        F.count_distinct(F.xxhash64(c)).alias("distinct"), F.count(F.when(F.trim(c) == "", 1)).alias("empty"), *[F.count(F.when(c.rlike(p), 1)).alias(f"with_{n}") for n, p in PII.items()],
    )


def binary(df: DataFrame, column: str) -> DataFrame:
    """Values, their number of kinds, the share of true ones in percent and those that are no known token."""
    low = F.lower(F.trim(F.col(column).cast("string")))
    true, false = low.isin(*TRUE_TOKENS), low.isin(*FALSE_TOKENS)
    return df.agg(F.count(column).alias("n"), F.count_distinct(column).alias("distinct"), F.try_divide(F.count(F.when(true, 1)) * 100.0, F.count(F.when(true | false, 1)).cast("double")).alias("true_pct"), F.count(F.when(~(true | false), 1)).alias("unexpected"))


def date_texts(df: DataFrame, column: str) -> DataFrame:
    """Of texts that should be times: those that parse by the commonest format in percent, those that none parses, and the
    number of kinds of zone offsets."""
    c = F.col(column)
    parses = [F.expr(f"try_to_timestamp(`{column}`, \"{f}\")").isNotNull() for f in TIME_FORMATS]
    zone = F.when(c.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & c.contains(":"), F.regexp_extract(c, r"(Z|[+-]\d{2}:?\d{2})$", 1)).when(c.isNotNull(), "")
    any_ = parses[0]
    for p in parses[1:]:
        any_ = any_ | p
    best = F.greatest(*[F.count(F.when(p, 1)) for p in parses])
    return df.agg(F.count(c).alias("n"), F.try_divide(best * 100.0, F.count(c).cast("double")).alias("best_format_pct"), F.count(F.when(c.isNotNull() & ~(any_ | F.expr(f"try_cast(`{column}` as timestamp)").isNotNull()), 1)).alias("invalid"), F.count_distinct(zone).alias("zones"))


def identifier(df: DataFrame, column: str) -> DataFrame:
    """Repeated values, lengths, and the share of values with the commonest shape (letters and digits by runs)."""
    c = F.col(column).cast("string")
    shape = F.regexp_replace(F.regexp_replace("v", "[A-Za-z]+", "a"), "[0-9]+", "0")
    each = df.groupBy(c.alias("v")).agg(F.count("*").alias("n"))
    n = F.when(F.col("v").isNotNull(), F.col("n"))
    shapes = each.where("v is not null").groupBy(shape.alias("shape")).agg(F.sum("n").alias("k")).agg(F.try_divide(F.max("k") * 100.0, F.sum("k").cast("double")).alias("format_pct"))
    return each.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n"), F.count("v").alias("distinct"), F.count(F.when(n > 1, 1)).alias("duplicated_values"), F.min(F.length("v")).alias("min_length"), F.max(F.length("v")).alias("max_length"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls")).join(F.broadcast(shapes))  # one row


def target(df: DataFrame, column: str, expected: Sequence[str] | None = None) -> DataFrame:
    whole = df.groupBy(F.col(column).cast("string").alias("class")).agg(F.count("*").alias("n"))
    each = whole.where("class is not null")
    odd = F.count(F.when(~F.col("class").isin(*expected), 1)) if expected else F.lit(0)
    nulls = whole.agg(F.coalesce(F.sum(F.when(F.col("class").isNull(), F.col("n"))), F.lit(0)).alias("nulls"))
    return each.agg(odd.alias("unexpected"), F.count("*").alias("classes"), F.min(F.struct("n", "class"))["class"].alias("minority"), (F.min("n") * 100.0 / F.sum("n")).alias("minority_pct"), F.try_divide(F.max("n").cast("double"), F.min("n").cast("double")).alias("imbalance_ratio")).join(F.broadcast(nulls))  # one row


def datetimes(df: DataFrame, column: str, as_of: Column) -> DataFrame:
    t = F.col(column).cast("timestamp")
    return df.agg(
        F.count(t).alias("n"), F.date_format(F.min(t), "yyyy-MM-dd HH:mm:ss").alias("first"), F.date_format(F.max(t), "yyyy-MM-dd HH:mm:ss").alias("last"), F.count(F.when(t > as_of, 1)).alias("future"),
        F.count(F.when(F.to_date(t).isin("1970-01-01", "1900-01-01", "9999-12-31"), 1)).alias("placeholders"), F.avg((F.weekday(t) >= 5).cast("double")).alias("weekend_share"), ((F.unix_micros(F.max(t)) - F.unix_micros(F.min(t))) / (365.25 * 86_400_000_000)).alias("range_years"),
    )


def format_rates(df: DataFrame, column: str) -> DataFrame:
    """Per date format the share of texts that it parses."""
    rate = lambda f: F.avg(F.expr(f"try_to_timestamp(`{column}`, \"{f}\")").isNotNull().cast("double"))
    row = df.where(F.col(column).isNotNull()).agg(*[rate(f).alias(f"f{i}") for i, f in enumerate(TIME_FORMATS)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("format"), F.col(f"f{i}").alias("rate")) for i, f in enumerate(TIME_FORMATS)])).alias("r")).select("r.*")


def semantic_types(df: DataFrame) -> dict[str, str]:
    """A type for each column from one aggregation: identifier, target, binary, datetime, numeric_continuous or _discrete,
    categorical_cyclical, categorical_nominal, text, unknown."""
    kinds = dict(df.dtypes)
    row = df.agg(F.count("*").alias("_n"), *[F.struct(F.count(c).alias("n"), F.count_distinct(c).alias("d"), (F.avg(F.expr(f"try_cast(`{c}` as timestamp)").isNotNull().cast("int")) if kinds[c] == "string" else F.lit(0.0)).alias("t")).alias(c) for c in df.columns]).first()
    out = {}
    for c, kind in kinds.items():
        n, d, low = row[c].n, row[c].d, c.lower()
        if not n:
            out[c] = "unknown"
        elif (low.endswith(("_id", "id", "key")) or low in ("uuid", "guid")) and d == n:
            out[c] = "identifier"
        elif low in ("target", "label", "churn", "churned", "retained", "outcome") and d <= 10:
            out[c] = "target"
        elif d == 2:
            out[c] = "binary"
        elif kind.startswith(("timestamp", "date")) or row[c].t and row[c].t > 0.8:
            out[c] = "datetime"
        elif kind in ("int", "bigint", "smallint", "tinyint", "double", "float") or kind.startswith("decimal"):
            out[c] = "numeric_discrete" if d <= 20 else "numeric_continuous"
        elif low in ("day", "weekday", "month", "day_of_week", "favday"):
            out[c] = "categorical_cyclical"
        else:
            out[c] = "categorical_nominal" if d <= 100 else "text"
    return out


def granularity(df: DataFrame, entity: str) -> DataFrame:
    """Rows for each entity; over 1.5 of them on average it is an event table."""
    out = df.agg(F.count("*").alias("rows"), F.count_distinct(entity).alias("entities"))
    mean = F.try_divide(F.col("rows").cast("double"), F.col("entities").cast("double"))
    return out.withColumns({"rows_per_entity": mean, "granularity": F.when(mean > 1.5, "event").otherwise("entity")})


# Quality checks


@dataclass(frozen=True)
class Check:
    """A check of a profile row, which fails where the condition on its columns holds. severity may be a case expression."""

    id: str
    kind: str
    severity: str
    failed: str


#: Check ids, severities and thresholds, as SQL over the profiles above.
CHECKS = (
    Check("FQ001", "universal", "case when null_pct > 95 then 'critical' when null_pct > 70 then 'high' when null_pct > 20 then 'medium' else 'critical' end", "null_pct > 70"),
    Check("FQ003", "universal", "critical", "distinct = 1"),
    Check("NC001", "numeric", "high", "100.0 * iqr_outliers / n > 5"), Check("NC002", "numeric", "medium", "100.0 * iqr_outliers / n > 1"), Check("NC003", "numeric", "medium", "abs(skewness) > 2"),
    Check("NC004", "numeric", "medium", "100.0 * zeros / n > 50"), Check("NC005", "numeric", "high", "negatives > 0"), Check("NC006", "numeric", "critical", "infinite > 0"), Check("NC007", "numeric", "high", "std = 0"),
    Check("NUM002", "numeric", "medium", "abs(skewness) > 1"), Check("NUM003", "numeric", "medium", "100.0 * iqr_outliers / n > 5"), Check("NUM004", "numeric", "low", "100.0 * zeros / n > 50"),
    Check("FQ005", "numeric", "high", "100.0 * iqr_outliers / n > 50"), Check("FQ011", "numeric", "critical", "iqr_outliers = n"),
    Check("CN001", "categorical", "high", "cardinality > 100"), Check("CN002", "categorical", "medium", "cardinality > 50"), Check("CN003", "categorical", "medium", "rare_categories > 10"), Check("CN004", "categorical", "high", "rare_pct > 20"),
    Check("CN005", "categorical", "low", "case_variants > 0"), Check("CN006", "categorical", "low", "padded_values > 0"), Check("CN007", "categorical", "high", "cardinality = 1"), Check("CAT003", "categorical", "medium", "rare_pct > 20"), Check("CAT004", "categorical", "low", "unknown_tokens > 0"),
    Check("FQ009", "categorical", "medium", "cardinality > 1000"), Check("CAT001", "categorical", "medium", "cardinality > 0.95 * n"),
    Check("NC008", "numeric", "low", "n > 10 and whole = n"), Check("NUM001", "universal_numeric", "low", "distinct < 10"),
    Check("BN001", "binary", "critical", "distinct <> 2"), Check("BN002", "binary", "medium", "true_pct < 1 or true_pct > 99"), Check("BN003", "binary", "high", "distinct = 1"), Check("BN004", "binary", "high", "unexpected > 0"),
    Check("DT003", "date_texts", "medium", "best_format_pct < 95"), Check("DT004", "date_texts", "medium", "zones > 1"), Check("DT005", "date_texts", "critical", "invalid > 0"),
    Check("DT006", "datetime", "medium", "range_years > 50"), Check("FQ012", "datetime", "high", "range_years > 100"), Check("ID002", "identifier", "medium", "format_pct < 95"),
    Check("TG001", "target", "critical", "nulls > 0"), Check("TG004", "target", "high", "unexpected > 0"), Check("TX004", "text", "medium", "distinct > 0.95 * n"),
    Check("CN008", "similar", "medium", "pairs > 0"), Check("FQ008", "meaning", "medium", "type = 'unknown'"), Check("LEAK001", "meaning", "critical", "type = 'identifier' and feature"),
    Check("ID001", "identifier", "critical", "duplicated_values > 0"), Check("ID003", "identifier", "high", "nulls > 0"),
    Check("TG002", "target", "high", "minority_pct < 1"), Check("TG003", "target", "medium", "minority_pct < 10"), Check("TG005", "target", "critical", "classes = 1"), Check("CAT002", "target", "high", "imbalance_ratio > 5"),
    Check("DT001", "datetime", "high", "future > 0"), Check("DT002", "datetime", "medium", "100.0 * placeholders / n > 0.05"),
    Check("TX001", "text", "critical", "with_email + with_phone + with_ssn + with_credit_card > 0"), Check("TX002", "text", "high", "100.0 * empty / n > 50"), Check("TX003", "text", "medium", "mean_length < 10"),
)


def run_checks(profile: DataFrame, kind: str, column: str | None = None) -> DataFrame:
    """(column, check_id, severity, passed) for the profile rows; a condition on null passes."""
    checks = [c for c in CHECKS if c.kind == kind]
    name = F.col("column") if column is None else F.lit(column)
    rows = F.array(*[F.struct(F.lit(c.id).alias("check_id"), (F.expr(c.severity) if c.severity.startswith("case ") else F.lit(c.severity)).alias("severity"), (~F.coalesce(F.expr(c.failed), F.lit(False))).alias("passed")) for c in checks])
    return profile.select(name.alias("column"), F.explode(rows).alias("c")).select("column", "c.*")


def similar_values(df: DataFrame, column: str, k: int = 100, least: float = 0.8) -> DataFrame:
    """Possible typing errors among the k commonest values: pairs with a normalised edit similarity in (least, 1)."""
    top = top_values(df, column, k)
    a, b = top.select(F.col("value").alias("a")), top.select(F.col("value").alias("b"))
    size = F.greatest(F.length("a"), F.length("b"))
    s = 1 - F.levenshtein("a", "b") / size
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", s.alias("similarity")).where((F.col("similarity") > least) & (F.col("similarity") < 1))  # k values


#: The profiles that fit a semantic type.
KINDS = {
    "identifier": ("universal", "identifier"), "target": ("universal", "target"), "binary": ("universal", "binary"), "numeric_continuous": ("universal", "universal_numeric", "numeric"), "numeric_discrete": ("universal", "universal_numeric", "numeric"),
    "categorical_nominal": ("universal", "categorical", "similar"), "categorical_ordinal": ("universal", "categorical"), "categorical_cyclical": ("universal", "categorical"), "datetime": ("universal", "datetime"), "text": ("universal", "text"), "unknown": ("universal",),
}


def explore(df: DataFrame, as_of: Column, types: dict[str, str] | None = None, features: Sequence[str] = ()) -> DataFrame:
    """All checks that fit each column's semantic type: (column, check_id, severity, passed)."""
    types = types or semantic_types(df)
    by = {k: [c for c, t in types.items() if k in KINDS.get(t, ())] for k in ("universal", "universal_numeric", "numeric")}
    kinds = dict(df.dtypes)
    out = [run_checks(universal(df, by["universal"]), "universal")]
    if by["numeric"]:
        out += [run_checks(numeric(df, by["numeric"]), "numeric"), run_checks(universal(df, by["universal_numeric"]), "universal_numeric")]
    single = {"identifier": identifier, "target": target, "binary": binary, "categorical": categorical, "text": text}
    for c, t in types.items():
        for kind in KINDS.get(t, ()):
            if kind in single:
                out.append(run_checks(single[kind](df, c), kind, c))
            elif kind == "datetime" and kinds[c] == "string":
                out.append(run_checks(date_texts(df, c), "date_texts", c))
            elif kind == "datetime":
                out.append(run_checks(datetimes(df, c, as_of), kind, c))
            elif kind == "similar":
                out.append(run_checks(similar_values(df, c).agg(F.count("*").alias("pairs")), kind, c))
    meaning = df.sparkSession.createDataFrame([(c, t, c in features) for c, t in types.items()], "column string, type string, feature boolean")
    out.append(run_checks(meaning, "meaning"))
    whole = out[0]
    for d in out[1:]:
        whole = whole.unionByName(d)
    return whole


# What distributions suggest

#: Skewness that is high and moderate, percentages of zeros and outliers, kurtosis of heavy tails.
SKEWED, BENT, ZEROS, OUTLIERS, HEAVY = 2.0, 1.0, 30.0, 5.0, 3.0


def distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column what its numbers look like, and the transformation that suits, with its priority: zeros beside a skewed
    rest, negative values, outliers, and skewness decide, in that order."""
    d = numeric(df, columns).where("n > 0")
    zero, out = 100.0 * F.col("zeros") / F.col("n"), 100.0 * F.col("iqr_outliers") / F.col("n")
    skew, bent = F.abs("skewness") > SKEWED, (F.abs("skewness") > BENT) & (F.abs("skewness") <= SKEWED)
    d = d.withColumns({"zero_pct": zero, "outlier_pct": out, "highly_skewed": F.coalesce(skew, F.lit(False)), "zero_inflated": zero > ZEROS, "heavy_tails": F.coalesce(F.col("kurtosis") > HEAVY, F.lit(False))})
    rules = [
        (F.col("zero_inflated") & skew, "zero_inflation_handling", "high"), (F.col("zero_inflated"), "zero_inflation_handling", "medium"), ((F.col("negatives") > 0) & skew, "yeo_johnson", "high"),
        (skew & (out > OUTLIERS), "cap_then_log", "high"), (skew & (F.col("min") > 0), "log_transform", "high"), (skew, "yeo_johnson", "high"),
        (bent & (F.col("min") >= 0), "sqrt_transform", "medium"), (bent, "yeo_johnson", "medium"), (out > OUTLIERS, "cap_outliers", "medium"),
    ]
    transform, priority = F.lit("none"), F.lit("low")
    for when, name, urgency in reversed(rules):
        transform, priority = F.when(when, name).otherwise(transform), F.when(when, urgency).otherwise(priority)
    return d.select("column", "n", "mean", "std", "skewness", "kurtosis", "zero_pct", "outlier_pct", "highly_skewed", "zero_inflated", "heavy_tails", transform.alias("transform"), priority.alias("priority"))


#: Categories of a column that are few and some, share of a rare one, ratio of unequal ones, entropy (of the
#: largest possible) that is low, percentage of the three commonest that is high.
FEW, SOME, RARE, UNEQUAL, NARROW, CONCENTRATED = 5, 20, 0.01, 10.0, 0.5, 90.0


def category_distribution(df: DataFrame, column: str, cyclical: bool = False, ordinal: bool = False) -> DataFrame:
    """One row: categories, how unequal and concentrated they are, and the encoding that suits, with its priority."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    top3 = counts.orderBy(F.desc("n")).limit(3).agg(F.sum("n").alias("top3"))  # a sum of three counts
    p = F.col("n") / F.col("total")
    d = counts.join(F.broadcast(total)).agg(F.count("*").alias("categories"), F.try_divide(F.max("n").cast("double"), F.min("n").cast("double")).alias("imbalance_ratio"), (-F.sum(p * F.log2(p + 1e-10))).alias("entropy"), (100 * F.max(p)).alias("top1_pct"), F.count(F.when(p < RARE, 1)).alias("rare"), F.max("total").alias("total"))  # one row
    most = F.when(F.col("categories") > 1, F.log2(F.col("categories").cast("double"))).otherwise(1.0)
    d = d.join(F.broadcast(top3)).withColumns({"normalized_entropy": F.col("entropy") / most, "top3_pct": 100.0 * F.col("top3") / F.col("total")})  # one row
    k, rare = F.col("categories"), F.col("rare") > 0
    rules = [(F.lit(cyclical), "cyclical", "medium"), (F.lit(ordinal), "ordinal", "medium"), (k == 2, "binary", "low"), (k <= FEW, "one_hot", "low"), ((k <= SOME) & rare, "target", "medium"), (k <= SOME, "one_hot", "low")]
    encoding, priority = F.lit("target"), F.lit("high")
    for when, name, urgency in reversed(rules):
        encoding, priority = F.when(when, name).otherwise(encoding), F.when(when, urgency).otherwise(priority)
    flags = {"imbalanced": F.col("imbalance_ratio") > UNEQUAL, "low_diversity": F.col("normalized_entropy") < NARROW, "concentrated": F.col("top3_pct") > CONCENTRATED}
    return d.select(F.lit(column).alias("column"), "categories", "imbalance_ratio", "entropy", "normalized_entropy", "top1_pct", "top3_pct", "rare", *[c.alias(n) for n, c in flags.items()], encoding.alias("encoding"), priority.alias("priority"))


def health(checks: DataFrame, null_pct: float) -> DataFrame:
    """100, less half the null percentage (30 at most), 15 for each failed critical check and 5 for each failed medium one;
    0 at least."""
    failed = lambda s: F.count(F.when(~F.col("passed") & (F.col("severity") == s), 1))
    score = 100.0 - min(30.0, 0.5 * null_pct) - 15 * failed("critical") - 5 * failed("medium")
    return checks.agg(F.greatest(F.lit(0.0), score).alias("score"), failed("critical").alias("critical"), failed("high").alias("high"), failed("medium").alias("medium"))

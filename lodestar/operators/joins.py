"""Point-in-time and as-of joins, merges along keys, set comparisons of keys, discovery of join keys."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..time import as_time


def asof(left: DataFrame, right: DataFrame, on: Sequence[str], time: str, right_time: str, values: Sequence[str], direction: str = "backward") -> DataFrame:
    """Each row of left with the values of right's row that is nearest in time: at or before it (backward), at or after
    it (forward), or either (nearest, the earlier of equally near ones). One shuffle of the union of both sides; no row
    is multiplied. Null where there is none."""
    sides = {"backward": ("b",), "forward": ("f",), "nearest": ("b", "f")}[direction]
    payload = F.struct(F.col(right_time).cast("timestamp").alias("_rt"), *values)
    l = left.select("*", F.col(time).cast("timestamp").alias("_t"), F.lit(1).alias("_left"), F.lit(None).alias("_p"))
    r = right.select(*on, F.col(right_time).cast("timestamp").alias("_t"), F.lit(0).alias("_left"), payload.alias("_p"))
    both = l.drop("_p").unionByName(r, allowMissingColumns=True)
    back = Window.partitionBy(*on).orderBy("_t", "_left").rowsBetween(Window.unboundedPreceding, 0)
    fore = Window.partitionBy(*on).orderBy(F.desc("_t"), "_left").rowsBetween(Window.unboundedPreceding, 0)
    for s in sides:
        both = both.withColumn(f"_{s}", F.last("_p", ignorenulls=True).over(back if s == "b" else fore))
    found = F.col(f"_{sides[0]}")
    if direction == "nearest":
        near = lambda s: F.abs(F.unix_micros("_t") - F.unix_micros(F.col(f"_{s}._rt")))
        found = F.when(F.col("_f").isNull() | (near("b") <= near("f")), F.col("_b")).otherwise(F.col("_f"))
    out = both.where("_left = 1").withColumn("_found", found)
    return out.select(*left.columns, *[F.col(f"_found.{v}").alias(v) for v in values], F.col("_found._rt").alias(f"matched_{right_time}"))


def point_in_time(base: DataFrame, features: DataFrame, entity: str, base_time: str, feature_time: str, values: Sequence[str]) -> DataFrame:
    """One row for each row of base: the values known at its time, never later ones."""
    return asof(base, features, [entity], base_time, feature_time, values)


def point_in_time_by_entity(base: DataFrame, features: DataFrame, entity: str, base_time: str, feature_time: str, values: Sequence[str]) -> DataFrame:
    """One row for each entity with a match: of each column the last value that is not null among features from no later
    than the entity's last base time."""
    cut = base.groupBy(entity).agg(F.max(F.col(base_time).cast("timestamp")).alias("_cut"))
    t = F.col(feature_time).cast("timestamp")
    held = features.join(cut, entity).where(t <= F.col("_cut"))
    return held.groupBy(entity).agg(F.max(t).alias(feature_time), *[F.max_by(v, F.when(F.col(v).isNotNull(), t)).alias(v) for v in values])


def with_first_target(events: DataFrame, entity: str, target: str, time: str) -> DataFrame:
    """events whose target is that of their entity's first event that has one (of events at that time the smallest)."""
    at = F.struct(F.col(time).cast("timestamp").alias("t"), F.col(target).alias("y"))
    first = events.groupBy(F.col(entity).alias("_entity")).agg(F.min(F.when(F.col(target).isNotNull(), at))["y"].alias("_target"))
    both = events.join(first, F.col(entity).eqNullSafe(F.col("_entity")), "left")
    return both.select(*[F.col("_target").alias(target) if c == target else F.col(c) for c in events.columns])


def future_rows(df: DataFrame, feature_time: str, columns: Sequence[str]) -> DataFrame:
    """Per time column, rows in which it is later than the feature time."""
    t = F.col(feature_time).cast("timestamp")
    row = df.agg(*[F.count(F.when(F.col(c).cast("timestamp") > t, 1)).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("violations")) for c in columns])).alias("r")).select("r.*")


def training_labels(labels: DataFrame, entity: str, target: str, label_time: str, as_of: str | datetime) -> DataFrame:
    return labels.where(F.col(label_time).cast("timestamp") <= as_time(as_of)).select(entity, target, label_time)


def merge_sources(base: DataFrame, sources: Sequence[tuple[DataFrame, dict[str, str], str]]) -> DataFrame:
    """base joined with each (source, {base column: source column}, how); equal non-key names get the suffix _n."""
    for n, (s, keys, how) in enumerate(sources, 1):
        renamed = s.select(*[F.col(c).alias(f"_k{n}_{c}" if c in keys.values() else f"{c}_{n}" if c in base.columns else c) for c in s.columns])
        on = [base[k] == renamed[f"_k{n}_{v}"] for k, v in keys.items()]
        base = base.join(renamed, on, how).drop(*[f"_k{n}_{v}" for v in keys.values()])
    return base


def key_overlap(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Distinct keys of either side and of both, their harmonic overlap (times 1.2, 1 at most, for equal names), and the
    cardinality of the relation. Keys are counted on either side before they meet."""
    a = left.where(F.col(left_key).isNotNull()).groupBy(F.col(left_key).alias("k")).agg(F.count("*").alias("a"))
    b = right.where(F.col(right_key).isNotNull()).groupBy(F.col(right_key).alias("k")).agg(F.count("*").alias("b"))
    s = a.join(b, "k", "full_outer").agg(
        F.count("a").alias("left_keys"), F.count("b").alias("right_keys"), F.count(F.col("a") + F.col("b")).alias("shared_keys"),
        F.coalesce(F.max("a"), F.lit(0)).alias("_ma"), F.coalesce(F.max("b"), F.lit(0)).alias("_mb"),
    )
    boost = 1.2 if left_key == right_key else 1.0
    score = F.least(F.lit(1.0), boost * F.coalesce(F.try_divide(2.0 * F.col("shared_keys"), (F.col("left_keys") + F.col("right_keys")).cast("double")), F.lit(0.0)))
    side = lambda c: F.when(F.col(c) <= 1, "1").otherwise("N")
    return s.select("left_keys", "right_keys", "shared_keys", score.alias("score"), F.concat(side("_ma"), F.lit(":"), side("_mb")).alias("cardinality"))


#: What names of identifiers hold.
ID_NAMES = ("_id", "id", "_key", "key", "_code", "code")


def join_candidates(left: Sequence[str], right: Sequence[str], left_name: str | None = None, right_name: str | None = None) -> list[tuple[str, str]]:
    """Pairs of columns that may join two tables: equal names of identifiers, `id` with `<table>_id`, and names that end in
    `_id` of which one holds the other."""
    ids = lambda names: [n for n in names if any(p in n.lower() for p in ID_NAMES)]
    out = {(c, c) for c in left if c in right and (c in ids(left) or c in ids(right))}
    if left_name and "id" in left and f"{left_name.lower()}_id" in right:
        out.add(("id", f"{left_name.lower()}_id"))
    if right_name and "id" in right and f"{right_name.lower()}_id" in left:
        out.add((f"{right_name.lower()}_id", "id"))
    out |= {(a, b) for a in ids(left) for b in ids(right) if a != b and a.endswith("_id") and b.endswith("_id") and (a[:-3] in b[:-3] or b[:-3] in a[:-3])}
    return sorted(out)


def relationship(left: DataFrame, right: DataFrame, left_name: str | None = None, right_name: str | None = None, pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """The candidate pair with the largest overlap of values (of equal ones the first by name): its columns, overlap,
    coverage of either side, cardinality, and the join that suits; no row if none reaches .01."""
    out = None
    for a, b in pairs or join_candidates(left.columns, right.columns, left_name, right_name):
        one = key_overlap(left, a, right, b).select(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), "*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return left.sparkSession.createDataFrame([], "left_column string, right_column string, score double, left_coverage double, right_coverage double, cardinality string, join string")
    covered = lambda side: F.try_divide(F.col("shared_keys").cast("double"), F.col(f"{side}_keys").cast("double"))
    out = out.where("score >= 0.01").orderBy(F.desc("score"), "left_column", "right_column").limit(1)  # of a few candidates
    return out.select("left_column", "right_column", "score", covered("left").alias("left_coverage"), covered("right").alias("right_coverage"), "cardinality", F.when(F.col("cardinality") == "1:N", "left").otherwise("inner").alias("join"))


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key, "left_anti").select(key).distinct()


def common_rows(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key, "left_semi")


def compare_on_key(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Per column, of rows with keys on both sides: how many differ by more than the tolerance or in being null, and the
    largest difference. One join."""
    both = left.select(key, *[F.col(c).alias(f"a_{c}") for c in columns]).join(right.select(key, *[F.col(c).alias(f"b_{c}") for c in columns]), key)
    diff = {c: F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in columns}
    off = {c: (F.col(f"a_{c}").isNull() != F.col(f"b_{c}").isNull()) | F.coalesce(d > tolerance, F.lit(False)) for c, d in diff.items()}
    row = both.agg(*[F.struct(F.count("*").alias("rows"), F.count(F.when(off[c], 1)).alias("differ"), F.coalesce(F.max(diff[c]), F.lit(0.0)).alias("largest")).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])).alias("r")).select("r.column", "r.s.*")

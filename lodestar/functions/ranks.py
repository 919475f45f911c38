"""Running totals and exact quantiles over all rows, by ranges: no task reads all values, and none holds them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

#: Of a sketch's ranks one in so many may be wrong; values around quantiles that are counted and ranked, at most.
ACCURACY, INSIDE = 10_000, 4_000_000
#: Groups whose sizes are broadcast, at most.
GROUPS = 100_000


def running(df: DataFrame, order: str, columns: Sequence[str], how: str = "sum") -> DataFrame:
    """df with c_running for each column: sums (or maxima) up to each row in the order of a column of distinct values.
    Rows are dealt by ranges of that order and written with their range's number, so that what is read twice is cut
    at the same bounds; results within a range are put together with the totals of the ranges before it."""
    made, join = {"sum": (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0))), "max": (F.max, F.greatest)}[how]
    ranged = written(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranged")
    within = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    each = ranged.withColumns({f"{c}_running": made(c).over(within) for c in columns})
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_part").agg(*[made(c).alias(f"_{c}") for c in columns])
    parts = parts.select("_part", *[made(f"_{c}").over(before).alias(f"_{c}") for c in columns])
    return each.join(F.broadcast(parts), "_part").select(*df.columns, *[join(F.col(f"{c}_running"), F.col(f"_{c}")).alias(f"{c}_running") for c in columns])  # a row for each range


def ranked(df: DataFrame, by: str, order: Sequence[str | Column]) -> DataFrame:
    """df with _rank (from 1, in the order within each value of by) and _size (rows of that value). Ranks are running counts
    by ranges, so that no task holds a group."""
    at = df.withColumns({"_at": F.struct(F.col(by).alias("by"), *order), "_one": F.lit(1)})
    r = running(at, "_at", ["_one"])
    sizes = written(r.groupBy(F.col(by).alias("_by")).agg(F.min("_one_running").alias("_first"), F.count("*").alias("_size")), "sizes")
    sizes = F.broadcast(sizes) if sizes.limit(GROUPS + 1).count() <= GROUPS else sizes
    both = r.join(sizes, F.col(by).eqNullSafe(F.col("_by"))).withColumn("_rank", F.col("_one_running") - F.col("_first") + 1)
    return both.select(*df.columns, "_rank", "_size")


def along(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """df with _n (the row's number in the order), and the nearest values before and after it, its own included, with their
    numbers: _b, _nb, _a, _na. Within ranges by windows, over their bounds by a row for each range."""
    ranged = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    by = Window.partitionBy("_part").orderBy(*order)
    d = ranged.withColumn("_i", F.row_number().over(by))
    seen = F.when(F.col(column).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(column).alias("v")))
    back, fore = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    d = written(d.withColumns({"_before": F.last(seen, True).over(back), "_after": F.first(seen, True).over(fore)}), "ranged")
    parts = d.groupBy("_part").agg(F.count("*").alias("rows"), F.max("_i").alias("_m"), F.max(F.struct("_i", "_before"))["_before"].alias("l"), F.min(F.struct("_i", "_after"))["_after"].alias("f"))
    o = Window.orderBy("_part")  # a row for each range
    parts = parts.withColumn("_offset", F.coalesce(F.sum("rows").over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = {c: F.when(F.col(c).isNotNull(), F.struct((F.col(f"{c}.i") + F.col("_offset")).alias("i"), F.col(f"{c}.v").alias("v"))) for c in ("l", "f")}
    parts = parts.withColumns(placed).select("_part", "_offset", F.last("l", True).over(o.rowsBetween(Window.unboundedPreceding, -1)).alias("_l"), F.first("f", True).over(o.rowsBetween(1, Window.unboundedFollowing)).alias("_f"))
    d = d.join(F.broadcast(parts), "_part")
    return d.select(
        *df.columns, (F.col("_i") + F.col("_offset")).alias("_n"),
        F.coalesce("_before.v", "_l.v").alias("_b"), F.coalesce(F.col("_before.i") + F.col("_offset"), "_l.i").alias("_nb"),
        F.coalesce("_after.v", "_f.v").alias("_a"), F.coalesce(F.col("_after.i") + F.col("_offset"), "_f.i").alias("_na"),
    )


def quantiles_by(df: DataFrame, key: str, value: str, probabilities: Sequence[float]) -> DataFrame:
    """(key, values): exact quantiles of each key's values, interpolated linearly. Equal values are counted first; then
    ranks are running counts, so one key may hold all rows."""
    x = F.col(value).cast("double")
    counts = df.select(F.col(key).alias("key"), x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x")).groupBy("key", "x").agg(F.count("*").alias("n"))
    ranked = running(counts.select(F.struct("key", "x").alias("at"), "n"), "at", ["n"]).select("at.key", "at.x", "n", F.col("n_running").alias("upto"))
    size = ranked.groupBy("key").agg(F.min(F.col("upto") - F.col("n")).alias("start"), F.sum("n").alias("total"))
    size = size.withColumnRenamed("key", "_key")
    d = ranked.join(size, F.col("key").eqNullSafe(F.col("_key")))
    low, high = F.col("upto") - F.col("n") - F.col("start"), F.col("upto") - F.col("start")
    aggs = []
    for i, p in enumerate(probabilities):
        r = F.lit(float(p)) * (F.col("total") - 1)
        for name, at in (("f", F.floor(r)), ("c", F.ceil(r))):
            aggs.append(F.max(F.when((low <= at) & (at < high), F.col("x"))).alias(f"{name}{i}"))
    out = d.groupBy("key").agg(F.first("total").alias("total"), *aggs)
    values = []
    for i, p in enumerate(probabilities):
        r = F.lit(float(p)) * (F.col("total") - 1)
        values.append(F.col(f"f{i}") * (1 - (r - F.floor(r))) + F.col(f"c{i}") * (r - F.floor(r)))
    return out.select("key", F.array(*values).alias("values"))


def quantile_row(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """One row with an array of the quantiles of each column (null for a column without values). Exact: a sketch brackets
    each quantile, what lies below its bracket is counted, and the few values inside are ranked; where that would be many,
    all values are."""
    found = _selected(df, columns, probabilities)
    if found is not None:
        return found
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("x")) for c in columns])).alias("r")).select("r.*")
    q = quantiles_by(long, "key", "x", probabilities)
    return q.agg(*[F.max(F.when(F.col("key") == c, F.col("values"))).alias(c) for c in columns])


def _selected(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame | None:
    x = [f"_{i}" for i in range(len(columns))]
    d = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(n) for c, n in zip(columns, x, strict=True)])
    margin = 2 / ACCURACY
    ends = [min(1.0, max(0.0, e)) for p in probabilities for e in (p - margin, p + margin)]
    sketch = d.agg(*[F.struct(F.count(n).alias("n"), F.percentile_approx(n, ends, ACCURACY).alias("q")).alias(n) for n in x]).first()
    cells = [(n, j, *sketch[n].q[2 * j : 2 * j + 2], p * (sketch[n]["n"] - 1)) for n in x if sketch[n]["n"] for j, p in enumerate(probabilities)]
    if not cells:
        return d.select(*[F.lit(None).cast("array<double>").alias(c) for c in columns]).agg(*[F.max(c).alias(c) for c in columns])
    count = d.agg(*[F.struct(F.count(F.when(F.col(n) < low, 1)).alias("below"), F.count(F.when(F.col(n).between(low, high), 1)).alias("inside")).alias(f"c{k}") for k, (n, _, low, high, _) in enumerate(cells)]).first()
    held = all(count[f"c{k}"].below <= math.floor(r) and math.ceil(r) < count[f"c{k}"].below + count[f"c{k}"].inside for k, (*_, r) in enumerate(cells))
    # A bracket of one value, however often it stands, is the quantile.
    open_ = [k for k, (_, _, low, high, _) in enumerate(cells) if low < high]
    if not held or sum(count[f"c{k}"].inside for k in open_) > INSIDE:
        return None
    one = {(n, j): F.lit(low) if low == high else F.max(F.when(F.col("k") == k, F.col("v"))) for k, (n, j, low, high, _) in enumerate(cells)}
    row = [(F.array(*[one[n, j] for j in range(len(probabilities))]) if sketch[n]["n"] else F.lit(None).cast("array<double>")).alias(c) for c, n in zip(columns, x, strict=True)]
    if not open_:
        return df.sparkSession.range(1).select(*row)
    inside = F.array(*[F.when(F.col(n).between(low, high), F.struct(F.lit(k).alias("k"), F.col(n).alias("x"))) for k, (n, _, low, high, _) in enumerate(cells) if k in open_])
    values = d.select(F.explode(inside).alias("r")).where("r is not null").groupBy("r.k", "r.x").agg(F.count("*").alias("n"))
    of = lambda made: F.element_at(F.array(*made), F.col("k") + 1)
    below, rank = of([F.lit(count[f"c{k}"].below) for k in range(len(cells))]), of([F.lit(float(r)) for *_, r in cells])
    upto = F.sum("n").over(Window.partitionBy("k").orderBy("x")) + below
    at = lambda r: F.max(F.when((F.col("upto") - F.col("n") <= r) & (r < F.col("upto")), F.col("x")))
    each = values.withColumns({"upto": upto, "rank": rank}).groupBy("k", "rank").agg(at(F.floor("rank")).alias("f"), at(F.ceil("rank")).alias("c"))
    part = F.col("rank") - F.floor("rank")
    each = each.select("k", F.when(part == 0, F.col("f")).otherwise(F.col("f") * (1 - part) + F.col("c") * part).alias("v"))
    return each.agg(*row)


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float] | None]:
    row = quantile_row(df, columns, probabilities).first()
    return {c: row[c] for c in columns}


def with_quantiles(groups: DataFrame, df: DataFrame, group: str, names: dict[str, tuple[str, float]]) -> DataFrame:
    """groups, a row for each value of group, with exact quantiles of df: {name: (column, probability)}."""
    for column in dict.fromkeys(c for c, _ in names.values()):
        mine = {n: p for n, (c, p) in names.items() if c == column}
        q = quantiles_by(df, group, column, list(mine.values()))
        q = q.select(F.col("key").alias("_group"), *[F.col("values")[i].alias(n) for i, n in enumerate(mine)])
        groups = groups.join(q, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")
    return groups

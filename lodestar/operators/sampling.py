"""Imputation by neighbours, and resampling of imbalanced classes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Complete rows that one task compares with a block of incomplete ones, about.
REFERENCE = 5000
#: Rows of a class that one task makes synthetic rows from, and incomplete rows that one task compares, about.
BLOCK = 2000


def _hash(key: str):
    return F.xxhash64(F.col(key).cast("string"))


def knn_impute(df: DataFrame, key: str, columns: Sequence[str], k: int = 5, reference: int = REFERENCE) -> DataFrame:
    """Missing values as means of the k nearest complete rows, by the columns that are there, scaled by their deviations.
    Neighbours and deviations come from all complete rows: each block of `reference` of them is compared with each block
    of incomplete rows, and the k nearest of the blocks are merged. Of equally near rows those with the smallest hashes
    of their keys count. A row without any value gets means."""
    w, v = [f"_w{i}" for i in range(len(columns))], [f"_v{i}" for i in range(len(columns))]
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    typed = df.withColumns(value)
    complete = typed.dropna(subset=list(columns)).select(F.col(key).cast("string").alias("_k"), _hash(key).alias("_h"), *[F.col(c).alias(x) for c, x in zip(columns, v, strict=True)])
    stats = complete.agg(F.count("*").alias("n"), *[F.avg(x).alias(f"m{x}") for x in v], *[F.stddev_pop(x).alias(f"s{x}") for x in v]).first()
    if not stats["n"]:
        return df
    sd = np.array([stats[f"s{x}"] or 1.0 for x in v])
    has = [F.col(c).isNotNull().cast("int") for c in columns]
    partly = sum(has[1:], has[0])
    missing = typed.where((partly > 0) & (partly < len(columns))).select(*[F.col(c).alias(x) for c, x in zip(columns, w, strict=True)]).distinct()
    rows, refs = -(-missing.count() // BLOCK) or 1, -(-stats["n"] // reference)

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["_h", "_k"], kind="stable")
        x, r = left[w].to_numpy(dtype=float), right[v].to_numpy(dtype=float)
        out = []
        for i in range(len(x) if len(r) else 0):
            known = ~np.isnan(x[i])
            d = (((r[:, known] - x[i, known]) / sd[known]) ** 2).sum(axis=1)
            near = np.argsort(d, kind="stable")[:k]
            out.append(pd.concat([pd.DataFrame(np.repeat(x[i : i + 1], len(near), axis=0), columns=w), right.iloc[near].drop(columns=["_i", "_j"]).reset_index(drop=True).assign(_d=d[near])], axis=1))
        return pd.concat(out)[[*w, "_d", "_h", "_k", *v]] if out else pd.DataFrame(columns=[*w, "_d", "_h", "_k", *v])

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = missing.withColumn("_i", F.pmod(F.xxhash64(*w), F.lit(rows)).cast("int")).withColumn("_j", every(refs))
    right = complete.withColumn("_j", F.pmod(F.xxhash64("_k", *v), F.lit(refs)).cast("int")).withColumn("_i", every(rows))
    schema = ", ".join([*[f"{x} double" for x in w], "_d double, _h bigint, _k string", *[f"{x} double" for x in v]])
    found = left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInPandas(nearest, schema)
    # NaN is how pandas gives back a value that is missing.
    found = found.withColumns({x: F.when(~F.isnan(x), F.col(x)) for x in w})
    best = found.groupBy(*w).agg(F.slice(F.array_sort(F.collect_list(F.struct("_d", "_h", "_k", *v))), 1, k).alias("_near"))
    same = F.lit(True)
    for c, x in zip(columns, w, strict=True):
        same = same & typed[c].eqNullSafe(best[x])
    mean = {c: F.expr(f"aggregate(_near, 0d, (a, e) -> a + e.{x}) / size(_near)") for c, x in zip(columns, v, strict=True)}
    filled = typed.join(best, same, "left")
    return filled.select(*[F.coalesce(F.col(c), mean[c], F.lit(stats[f"m{v[list(columns).index(c)]}"])).alias(c) if c in mean else F.col(c) for c in df.columns])


def undersample(df: DataFrame, key: str, target: str, seed: int = 42) -> DataFrame:
    """Every class cut to about the size of the rarest: rows by the hash of their keys."""
    each = df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("_class")).agg(F.count("*").alias("_n"))
    each = each.join(F.broadcast(each.agg(F.min("_n").alias("_least"))))  # one row
    u = F.pmod(F.crc32(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), F.lit(1_000_003)) / 1_000_003.0
    return df.join(each, F.col(target) == F.col("_class")).where(u < F.col("_least") / F.col("_n")).select(*df.columns)


def smote(df: DataFrame, key: str, columns: Sequence[str], target: str, minority, copies: int = 1, k: int = 5, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """df's columns and target with `copies` synthetic rows for each row of the minority: points between it and one of its k
    nearest rows of that class, by the columns over their deviations in the class. Blocks of about `block` rows are compared
    with each other by matrix products, and each row's nearest of all blocks merged. Keys are to be distinct."""
    v, w = [f"_v{i}" for i in range(len(columns))], [f"_w{i}" for i in range(len(columns))]
    few = df.where(F.col(target) == minority).dropna(subset=list(columns)).select(F.col(key).cast("string").alias("_k"), *[F.col(c).cast("double").alias(x) for c, x in zip(columns, v, strict=True)])
    stats = few.agg(F.count("*").alias("n"), *[F.stddev_pop(x).alias(x) for x in v]).first()
    sd = np.array([stats[x] or 1.0 for x in v])
    blocks = -(-stats["n"] // block) or 1

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["_k", "_d", "_near", *v, *w])
        r = right.sort_values("_near", kind="stable")
        x, y = left[v].to_numpy(dtype=float), r[w].to_numpy(dtype=float)
        a, b = x / sd, y / sd
        d = np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T, 0)
        d[left["_k"].to_numpy()[:, None] == r["_near"].to_numpy()[None]] = np.inf
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        rows, at = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
        ok = np.isfinite(d[rows, at])
        rows, at = rows[ok], at[ok]
        out = {"_k": left["_k"].to_numpy()[rows], "_d": d[rows, at], "_near": r["_near"].to_numpy()[at]}
        return pd.DataFrame(out | {n: x[rows, i] for i, n in enumerate(v)} | {n: y[at, i] for i, n in enumerate(w)})

    place = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = few.withColumn("_i", place("_k")).withColumn("_j", every)
    # Columns of its own: both sides come from the same rows.
    right = few.select(F.col("_k").alias("_near"), *[F.col(a).alias(b) for a, b in zip(v, w, strict=True)]).withColumn("_j", place("_near")).withColumn("_i", every)
    schema = ", ".join(["_k string, _d double, _near string", *[f"{x} double" for x in (*v, *w)]])
    found = left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInPandas(nearest, schema)
    best = found.groupBy("_k", *v).agg(F.slice(F.array_sort(F.collect_list(F.struct("_d", "_near", *w))), 1, k).alias("_best"))
    draw = lambda n, c: F.pmod(F.xxhash64("_k", c, F.lit(seed + n)), F.lit(1 << 30))
    made = best.withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn("_one", F.get("_best", (draw(0, "_c") % F.size("_best")).cast("int")))
    step = draw(1, "_c") / float(1 << 30)
    made = made.select(*[(F.col(x) + step * (F.col(f"_one.{y}") - F.col(x))).alias(c) for c, x, y in zip(columns, v, w, strict=True)], F.lit(minority).cast(df.schema[target].dataType).alias(target))
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns], target).unionByName(made)

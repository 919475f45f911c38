"""What runs by ranges or blocks, against plain Python, with bounds set to a few rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar import scratch
from lodestar.functions import ranks
from lodestar.operators import cleaning, gates, joins, modeling, profiling, sampling, temporal
from lodestar.streaming import events as stream


@pytest.fixture(scope="module")
def holes(spark):
    rng = random.Random(5)
    rows = [(i, None if rng.random() < 0.6 else float(rng.randint(0, 99))) for i in range(400)]
    return rows, spark.createDataFrame(rows, "n int, x double").repartition(7)


@pytest.mark.parametrize("method", ["ffill", "bfill", "linear"])
def test_fill_along_without_a_partition(holes, method):
    rows, df = holes
    got = [r.x for r in cleaning.fill_along(df, "x", ["n"], method=method).orderBy("n").collect()]
    one = [r.x for r in cleaning.fill_along(df.withColumn("g", F.lit(1)), "x", ["n"], ["g"], method).orderBy("n").collect()]
    assert got == one
    seen = [(n, x) for n, x in rows if x is not None]
    for n, x in enumerate(got):
        before, after = [p for p in seen if p[0] <= n], [p for p in seen if p[0] >= n]
        if method == "ffill":
            assert x == (before[-1][1] if before else None)
        if method == "bfill":
            assert x == (after[0][1] if after else None)
    assert len(got) == len(rows)


@pytest.mark.parametrize("inside", [ranks.INSIDE, 0])
def test_quantiles_by_selection_and_by_ranks(spark, monkeypatch, inside):
    monkeypatch.setattr(ranks, "INSIDE", inside)
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=5000).tolist(), rng.integers(0, 3, 5000).astype(float).tolist()
    df = spark.createDataFrame([(a, b, None) for a, b in zip(x, y, strict=True)] + [(float("nan"), None, None)], "x double, y double, z double")
    p = [0.0, 0.01, 0.25, 0.5, 0.731, 0.99, 1.0]
    row = ranks.quantile_row(df, ["x", "y", "z"], p).first()
    assert np.allclose(row.x, np.quantile(x, p)) and np.allclose(row.y, np.quantile(y, p)) and row.z is None
    assert ranks.quantile_row(df.limit(0), ["x"], p).first().x is None
    assert ranks.quantile_row(spark.createDataFrame([(7.0,)], "x double"), ["x"], p).first().x == [7.0] * 7


@pytest.mark.parametrize("groups", [ranks.GROUPS, 0])
def test_ranked(spark, monkeypatch, groups):
    monkeypatch.setattr(ranks, "GROUPS", groups)
    df = spark.range(300).withColumn("g", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    rows = ranks.ranked(df, "g", [F.col("id").alias("i")]).collect()
    assert len(rows) == 300 and all(r._size == 100 and r._rank == r.id // 3 + 1 for r in rows)


def test_smote_in_blocks_equals_one_block(spark):
    rng = np.random.default_rng(8)
    rows = [(i, float(a), float(b), int(i < 90)) for i, (a, b) in enumerate(rng.normal(size=(150, 2)) * [1, 50])]
    df = spark.createDataFrame(rows, "k int, x double, y double, t int")
    made = lambda block: sorted((round(r.x, 9), round(r.y, 9)) for r in sampling.smote(df, "k", ["x", "y"], "t", 1, copies=2, k=3, block=block).where("t = 1").collect())
    whole = made(1000)
    assert whole == made(7) and len(whole) == 90 * 3
    x = np.array([r[1:3] for r in rows[:90]])
    z = x / x.std(axis=0)
    near = np.argsort(((z[:, None] - z[None]) ** 2).sum(axis=2) + np.diag([np.inf] * 90), axis=1)[:, :3]
    real = {(round(a, 9), round(b, 9)) for a, b in x.tolist()}
    ends = [(x[i], x[j]) for i in range(90) for j in near[i]]
    for p in (np.array(p) for p in whole if p not in real):
        assert any(abs((b - a)[0] * (p - a)[1] - (b - a)[1] * (p - a)[0]) < 1e-6 and 0 <= np.dot(p - a, b - a) <= np.dot(b - a, b - a) + 1e-9 for a, b in ends)


def test_folds_over_time_and_classes(spark):
    d = spark.range(60).select("id", (F.col("id") % 2).alias("y"), (F.col("id") * 1.0).alias("x"))
    time = {r.fold: r.ids for r in modeling.cv_folds(d, "id", 4, "time", "x").groupBy("fold").agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()}
    assert time == {f: list(range(12 * f, 12 * f + 12)) for f in range(5)}
    even = modeling.cv_folds(d, "id", 5, "stratified", "y").groupBy("y", "fold").count().collect()
    assert len(even) == 10 and {r["count"] for r in even} == {6}
    with pytest.raises(ValueError):
        modeling.cv_folds(d, "id", 5, "other")


def test_cross_validation_and_search(spark):
    d = spark.range(120).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 3 + F.rand(4)).alias("x"))
    cv = modeling.cross_validate(d, "id", ["x"], "y", k=2, strategy="stratified", repeats=2)
    rows = cv.collect()
    assert sorted(r.fold for r in rows) == [0, 1, 2, 3] and all(r.roc_auc > 0.9 for r in rows)
    assert modeling.stability(cv).first().stable
    found = modeling.search(d, "id", ["x"], "y", {"regParam": [0.0, 100.0], "elasticNetParam": [1.0]}, k=2, metric="average_precision")
    assert found[0][0]["regParam"] == 0.0 and len(found) == 2


def test_gates_without_numbers_or_rows(spark):
    d = spark.createDataFrame([("a", 1), ("b", 0)], "c string, y int")
    assert gates.detect_leakage(d, "y").count() == 0 and gates.leakage(d.limit(0), "y").count() == 0
    assert gates.leakage(d, "y", features=["c"]).count() == 0
    found = gates.data_quality(d.limit(0), ["none"], "nothing")
    assert sorted((r.check_id, r.subject) for r in found.collect()) == [("DQ010", "none"), ("DQ020", "nothing")]


def test_join_candidates():
    assert joins.join_candidates(["id", "name"], ["customer_id", "name", "code"], "customer") == [("id", "customer_id")]
    assert joins.join_candidates(["order_id", "x"], ["order_id", "old_order_id"]) == [("order_id", "old_order_id"), ("order_id", "order_id")]


def test_seasonality_needs_two_periods(spark):
    d = spark.range(40).select("id", (F.col("id") % 7).cast("double").alias("x"))
    assert [r.period for r in temporal.acf_seasonality(d, "id", "x").collect()] == [7, 14]
    assert temporal.acf_seasonality(d.where("id < 13"), "id", "x").count() == 0


def test_distribution_of_nothing_and_of_one_value(spark):
    d = spark.createDataFrame([(1.0, None), (1.0, None)], "x double, y double")
    row = profiling.distribution(d, ["x", "y"]).collect()
    assert [(r.column, r["transform"]) for r in row] == [("x", "none")]
    assert profiling.category_distribution(d, "y").first().categories == 0


def test_schema_errors_of_odd_events(spark):
    d = spark.createDataFrame([(1, "a", None), (2, "a", '{"p": 1}'), (3, "b", "{}"), (4, None, "{}")], "i int, event_type string, props string")
    got = {r.i: r.errors for r in stream.schema_errors(d, {"a": ["p", "q"]}).collect()}
    assert got == {1: ["missing p", "missing q"], 2: ["missing q"], 3: ["no schema"], 4: ["no schema"]}


def test_what_is_put_into_the_shared_folder_goes(spark):
    with scratch.cleaned(spark):
        path = scratch.written(spark.range(3), "gone").inputFiles()[0].rsplit("/", 1)[0]
        fs, p = scratch.hadoop_path(spark, path)
        assert fs.exists(p)
    assert not fs.exists(p)

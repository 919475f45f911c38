import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import interpret, modeling, monitoring, profiling, reduce, sampling, seasonality, segments, selection, timestamps
from lodestar.plans.spec import Plan, Step
from lodestar.sources import features, tables
from lodestar.streaming import processor


def test_plan_fits_once_and_travels_as_json(spark):
    train = spark.createDataFrame([(1, "A ", 1.0, "x"), (2, "b", None, "y"), (3, "a", 3.0, "x")], "k int, c string, v double, g string")
    plan = Plan([Step("bronze", "consistent", {"columns": ["c"]}), Step("bronze", "impute", {"strategies": {"v": "mean"}}), Step("silver", "interact", {"specs": [["product", "v", "k"]]}), Step("gold", "encode", {"column": "g", "kind": "one_hot"}), Step("gold", "scale", {"columns": ["v"]})])
    first = plan.run(train).orderBy("k").collect()
    assert [r.c for r in first] == ["a", "b", "a"] and first[1].v == 0.0 and first[0].g_x == 1
    again = Plan.from_json(plan.to_json()).run(spark.createDataFrame([(9, "z", None, "q")], "k int, c string, v double, g string")).first()
    assert (again.v, again.g_x, again.g_y) == (0.0, 0, 0)
    with pytest.raises(ValueError):
        Step("bronze", "fly")
    with pytest.raises(ValueError):
        Plan([Step("gold", "drop", {"columns": []}), Step("bronze", "drop", {"columns": []})])


def test_feature_store_is_point_in_time(spark):
    store = features.FeatureStore(spark, "lodestar_test")
    d = spark.createDataFrame([("a", "2024-01-01", 1.0), ("a", "2024-03-01", 3.0)], "e string, event_timestamp string, x double").withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp"))
    try:
        store.write(d, "f", ["e"], "event_timestamp", "overwrite")
        store.write(d.where("x = 3").withColumn("x", F.lit(4.0)), "f", ["e"], "event_timestamp")
        assert store.tables() == ["f"] and store.read("f").count() == 2
        spine = spark.createDataFrame([("a", "2024-02-01"), ("a", "2024-04-01"), ("b", "2024-04-01")], "e string, t string").withColumn("t", F.col("t").cast("timestamp"))
        assert [r.x for r in store.historical(spine, "e", "t", ["f:x"]).orderBy("e", "t").collect()] == [1.0, 4.0, None]
        assert store.latest(spine.select("e").distinct(), "e", "f", ["x"]).where("e = 'a'").first().x == 4.0
    finally:
        spark.sql("drop database if exists lodestar_test cascade")


def test_baseline_drift(spark):
    a = spark.range(1000).select((F.col("id") % 100).cast("double").alias("x"))
    b = a.select((F.col("x") + 60).alias("x"))
    base = monitoring.fit_baseline(a, "x")
    same, other = (monitoring.drift(d, [base]).first() for d in (a, b))
    assert same.psi == 0 and same.severity == "none"
    assert other.severity == "critical" and other.ks > 0.5 and other.mean_shift > 1
    assert monitoring.drift(a.limit(0), [base]).first().mean_shift is None


def test_driver_side_rules():
    assert monitoring.champion({"roc_auc": 0.8, "recall": 0.5}, {"roc_auc": 0.83, "recall": 0.3}, guards={"recall": 0.1}) == "keep"
    assert monitoring.champion({"roc_auc": 0.8}, {"roc_auc": 0.83}) == "promote"
    assert ("MV001", "critical") in monitoring.model_validity({"train_auc": 0.99, "test_auc": 0.96})
    assert monitoring.budget([("a", 10, 100), ("b", 10, 50), ("c", 5, 40)], 15) == ["a", "c"]
    assert modeling.retraining_reasons(0.2, 0.1, 100, 0.0) == ["performance", "age"]
    assert selection.availability_actions({"a": 0.99, "b": 0.5, "c": 0.1})["c"] == ["remove", "indicator", "filter_window"]
    assert timestamps.scenario([("last_login", "activity")]) == "derived" and not timestamps.consistent_times({"a": "1", "b": "2"})


def test_pca_reconstructs_variance(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2)) @ rng.normal(size=(2, 6)) + 3
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k int, v array<double>")
    mean, parts = reduce.fit_pca(d, "v")
    assert len(parts) == 2 and np.allclose(mean, x.mean(axis=0))
    got = np.array([[r.v_pc0, r.v_pc1] for r in reduce.project(d, "v", mean, parts, "v").orderBy("k").collect()])
    assert np.allclose(got @ parts + mean, x)


def test_knn_impute_takes_all_complete_rows(spark):
    rows = [(i, float(i), float(2 * i), "a") for i in range(12_000)] + [(12_000, 7777.2, None, "b"), (12_001, None, float("nan"), "c"), (12_002, None, 31.0, "d")]
    d = spark.createDataFrame(rows, "k long, x double, y double, z string")
    out = sampling.knn_impute(d, "k", ["x", "y"], k=2)
    by = {r.k: r for r in out.where("k >= 12000 or k = 5").collect()}
    assert out.columns == d.columns and out.count() == len(rows) and by[5].y == 10.0
    assert by[12_000].y == 2 * 7777.5 and by[12_000].z == "b"
    assert abs(by[12_001].x - 5999.5) < 1e-6 and abs(by[12_001].y - 11999.0) < 1e-6
    assert by[12_002].x == 15.5


def test_knn_impute_and_smote(spark):
    rows = [(i, float(i % 2) * 10 + i / 1000, float(i % 2) * 10) for i in range(200)]
    d = spark.createDataFrame([*rows, (900, 10.0, None), (901, None, None)], "k int, x double, y double")
    out = {r.k: r for r in sampling.knn_impute(d, "k", ["x", "y"]).collect()}
    assert out[900].y == 10.0 and out[901].y == pytest.approx(5.0) and out[3].y == 10.0
    t = d.dropna().withColumn("t", (F.col("k") < 20).cast("int"))
    s = sampling.smote(t, "k", ["x", "y"], "t", 1, copies=3)
    assert s.where("t = 1").count() == 80 and s.where("x < 0 or x > 11").count() == 0
    u = sampling.undersample(t, "k", "t")
    assert u.where("t = 1").count() == 20 and 5 < u.where("t = 0").count() < 45


def test_selection_of_twins(spark):
    d = spark.range(100).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"), F.lit(1.0).alias("c"), F.rand(1).alias("r"))
    got = selection.select(d, ["a", "b", "c", "r"])
    assert got["kept"] == ["b", "r"] and got["correlated"] == ["a"] and got["low_variance"] == ["c"]
    assert selection.effective_features(d, ["a", "b", "r"]) == 2


def test_explore_runs_every_kind(spark):
    rows = [(f"id{i}", i % 2, "yes" if i % 3 else "no", f"2024-01-{i % 28 + 1:02d}", float(i), f"long text number {i} with mail a{i}@b.com", "same") for i in range(120)]
    d = spark.createDataFrame(rows, "user_id string, target int, flag string, day string, x double, note string, one string").withColumn("day", F.to_timestamp("day"))
    checks = profiling.explore(d, F.lit("2024-01-20").cast("timestamp"), features=["user_id"])
    failed = {(r["column"], r.check_id) for r in checks.where("not passed").collect()}
    assert {("note", "TX001"), ("day", "DT001"), ("user_id", "LEAK001"), ("one", "FQ003"), ("one", "CN007"), ("note", "TX004")} <= failed
    assert ("target", "TG001") not in failed
    assert len({c.id for c in profiling.CHECKS}) >= 50
    score = profiling.health(checks, 0.0).first()
    assert 0 <= score.score <= 100 and score.critical >= 3


def test_interpretation_of_a_linear_score(spark):
    d = spark.createDataFrame([(1, 1.0, 5.0), (2, 9.0, 5.0)], "k int, a double, b double")
    score = lambda x: x.withColumn("score", F.col("a") / 10)
    assert [r.mean_score for r in interpret.partial_dependence(d, "a", [0, 5], score).orderBy("grid").collect()] == [0.0, 0.5]
    c = interpret.counterfactual(d, "k", {"b": [1], "a": [8, 3]}, score).orderBy("k").collect()
    assert [(r.k, r["column"], r["value"]) for r in c] == [(1, "b", 1.0), (2, "a", 3.0)]


def test_spark_models_and_clusters(spark):
    d = spark.range(400).select("id", (F.col("id") % 2).cast("double").alias("y"), ((F.col("id") % 2) * 4 + F.rand(3)).alias("x"), F.rand(4).alias("z"))
    for kind in ("logistic", "forest", "boosted"):
        p = modeling.train(d, ["x", "z"], "y", kind).transform(d)
        assert p.where("prediction = y").count() > 390
    assert segments.clusters(d, ["x"], 2).groupBy("cluster").count().count() == 2


def test_state_and_triggers_on_streams(spark, tmp_path):
    d = spark.createDataFrame([("a", "f", 1.0, f"2024-01-01 0{h}:00:00") for h in range(6)] + [("b", "f", 2.0, "2024-01-01 00:00:00")], "key string, feature string, value double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in (d.where("ts < '2024-01-01 03:00:00'"), d.where("ts >= '2024-01-01 03:00:00'")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = []
    q = processor.maintain_state(source, f"{tmp_path}/state", f"{tmp_path}/c", lambda s: seen.append({(r.key, r.total, r.events) for r in s.collect()}))
    q.processAllAvailable()
    q.stop()
    assert seen[-1] == {("a", 6.0, 6), ("b", 2.0, 1)} and len(seen) == 2
    fired = processor.trigger_stream(source, "key", "ts", 7200, 2)
    q = fired.writeStream.outputMode("append").format("memory").queryName("fired").option("checkpointLocation", f"{tmp_path}/t").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.key, r.n) for r in spark.sql("select key, count(*) as n from fired group by key").collect()} == {("a", 2), ("b", 1)}


def test_seasonal_reports_of_empty_tables(spark):
    d = spark.createDataFrame([], "e string, t timestamp, v double, y int")
    assert seasonality.weekly(d, "t").first().cv is None
    assert seasonality.peak_months(d, "t").count() == 0
    assert seasonality.eta_squared(d, "v", "e").first().eta_squared is None
    assert tables.duplicate_columns(["a", "B", "b"]) == ["b"]
    assert timestamps.discover(spark.createDataFrame([], "x double")).count() == 0


def test_cross_validation_and_arms(spark):
    d = spark.range(300).select("id", (F.col("id") % 2).cast("double").alias("y"), ((F.col("id") % 2) * 3 + F.rand(3)).alias("x"))
    rows = modeling.cross_validate(d, "id", ["x"], "y", k=3).collect()
    assert len(rows) == 3 and all(r.roc_auc == 1.0 for r in rows)
    assert modeling.compare({"a": {"roc_auc": 0.7}, "b": {"roc_auc": 0.9}}) == [("b", 0.9), ("a", 0.7)]
    assert modeling.overfitting(0.95, 0.80, [0.7, 0.9, 0.8]) == ["severe_gap", "unstable"]
    assert modeling.with_noise(d, ["x"], 0.0).where("x is null").count() == 0
    arms = {(r.y, r.arm): r.n for r in modeling.assign_arms(d, "id", "y").groupBy("y", "arm").agg(F.count("*").alias("n")).collect()}
    assert set(arms.values()) == {75}


def test_load_results_metadata_and_pruning(spark, tmp_path):
    from lodestar.sources import snapshots

    df, bad = tables.try_load(spark, tables.SourceConfig("s", f"{tmp_path}/nothing"))
    assert df is None and bad.error
    d = spark.createDataFrame([(1, "2024-01-01", "2024-02-01", True)], "k int, feature_timestamp string, label_timestamp string, label_available_flag boolean")
    tables.save_with_metadata(d, f"{tmp_path}/m", {"reference_date": "2024-03-01"})
    back, ok = tables.try_load(spark, tables.SourceConfig("m", f"{tmp_path}/m"))
    assert ok.rows == 1 and tables.metadata_of(back)["reference_date"] == "2024-03-01"
    store = snapshots.Snapshots(spark, f"{tmp_path}/s")
    assert snapshots.snapshot_or(store, "a", d)[1] is False
    d = d.withColumn("feature_timestamp", F.col("feature_timestamp").cast("timestamp"))
    for _ in range(3):
        store.create(d, "a", "2024-12-31")
    assert snapshots.prune(store, "a", 1) == [1, 2] and store.versions("a") == [3] and snapshots.snapshot_or(store, "a", d)[1]

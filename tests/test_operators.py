"""Operators on small literal tables: nulls, ties, edges, empty inputs."""

import pytest
from pyspark.sql import functions as F

from lodestar.functions import ranks, stats
from lodestar.operators import cleaning, joins, modeling, profiling, segments, temporal, transforms, validation, windows
from lodestar.sources import snapshots, tables
from lodestar.streaming import events as stream
from lodestar.time import days_between, inside, window_micros


def one(df):
    return df.first()


def test_days_are_floored_elapsed_time(spark):
    d = spark.sql("select timestamp '2024-01-01 23:59:00' as a, timestamp '2024-01-02 00:01:00' as b")
    assert one(d.select(days_between(F.col("b"), F.col("a")).alias("x"))).x == 0
    assert one(d.select(days_between(F.col("a"), F.col("b")).alias("x"))).x == -1
    with pytest.raises(ValueError):
        window_micros("7x")


def events(spark):
    rows = [("a", f"2024-03-{d:02d} 12:00:00", float(d), k) for d, k in ((1, "x"), (5, "y"), (30, "x"))] + [("b", "2024-01-01 00:00:00", None, None), ("b", "2024-04-09 00:00:00", 7.0, "z")]
    return spark.createDataFrame(rows, "id string, ts string, v double, k string").withColumn("ts", F.col("ts").cast("timestamp"))


def test_window_defaults_and_bounds(spark):
    plan = windows.WindowPlan(["7d", "all_time"], {"v": ["sum", "mean", "count"], "k": ["mode", "sum"]})
    rows = {r.id: r for r in windows.aggregate(events(spark), "id", "ts", plan, "2024-04-01").collect()}
    assert (rows["b"].v_sum_7d, rows["b"].v_mean_7d, rows["b"].event_count_7d) == (0.0, None, 0)
    assert rows["a"].event_count_7d == 1 and rows["a"].v_sum_all_time == 36.0 and rows["a"].k_mode_all_time == "x"
    assert rows["b"].event_count_all_time == 1 and rows["a"].k_sum_7d == 0.0
    late = {r.id: r for r in windows.aggregate(events(spark), "id", "ts", plan, "2024-04-01", upper_bound=False).collect()}
    assert late["b"].event_count_7d == 1
    assert windows.aggregate(events(spark).limit(0), "id", "ts", plan).count() == 0
    with pytest.raises(ValueError):
        windows.WindowPlan(["1d"], {"v": ["nope"]})


def test_asof_directions_and_ties(spark):
    left = spark.createDataFrame([("a", "2024-03-01"), ("a", "2024-06-01"), ("b", "2024-02-01"), ("c", None)], "k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    right = spark.createDataFrame([("a", "2024-01-01", 1), ("a", "2024-03-01", 2), ("a", "2024-07-01", 3), ("b", "2024-04-01", 4)], "k string, rt string, x int").withColumn("rt", F.col("rt").cast("timestamp"))
    got = lambda d: [r.x for r in joins.asof(left, right, ["k"], "t", "rt", ["x"], d).orderBy("k", "t").collect()]
    assert got("backward") == [2, 2, None, None]
    assert got("forward")[:3] == [2, 3, 4]
    assert got("nearest")[:3] == [2, 3, 4]


def test_point_in_time_by_entity_takes_last_known_of_each_column(spark):
    base = spark.createDataFrame([("a", "2024-06-01"), ("b", "2024-01-01")], "e string, t string")
    feats = spark.createDataFrame([("a", "2024-01-01", 1, 10), ("a", "2024-02-01", None, 20), ("a", "2024-07-01", 9, 90), ("b", "2024-05-01", 5, 5)], "e string, ft string, x int, y int")
    rows = joins.point_in_time_by_entity(base, feats, "e", "t", "ft", ["x", "y"]).collect()
    assert [(r.e, r.x, r.y) for r in rows] == [("a", 1, 20)]


def test_fill_outliers_and_duplicates(spark):
    d = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0), (4, 1000.0), (5, None)], "n int, x double")
    assert cleaning.fit_fill(d, {"x": "median"}) == {"x": 3.0}
    assert [r.x for r in cleaning.fill_along(d, "x", ["n"], method="linear").orderBy("n").collect()] == [1.0, 2.0, 3.0, 1000.0, 1000.0]
    with pytest.raises(ValueError):
        cleaning.fit_fill(d.where("x is null"), {"x": "mean"})
    capped = cleaning.treat_outliers(d, {"x": (0.0, 10.0)}, "cap").orderBy("n").collect()
    assert [r.x for r in capped] == [1.0, None, 3.0, 10.0, None]
    assert cleaning.treat_outliers(d, {"x": (0.0, 10.0)}, "drop").count() == 4
    twice = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 1)], "k string, o int, v int")
    assert [(r.k, r.v) for r in cleaning.keep_last(twice, ["k"], ["o"]).orderBy("k").collect()] == [("a", 2), ("b", 1)]
    assert cleaning.duplicate_keys(twice, ["k"]).first().conflicting_columns == 2


def test_encoders_and_unknown_values(spark):
    d = spark.createDataFrame([("x", 1.0), ("x", 0.0), ("y", 1.0), (None, 1.0)], "c string, y double")
    new = spark.createDataFrame([("z",), (None,), ("y",)], "c string")
    target = transforms.fit_encoder(d, "c", "target", "y", smoothing=1.0)
    got = [r.c for r in target.transform(new).collect()]
    assert got[0] == pytest.approx(2 / 3) and got[1] is None and got[2] == pytest.approx((1 + 2 / 3) / 2)
    hot = transforms.fit_encoder(d, "c", "one_hot").transform(new).collect()
    assert [(r.c_x, r.c_y) for r in hot] == [(0, 0), (0, 0), (0, 1)]
    with pytest.raises(Exception, match="no such value"):
        transforms.fit_encoder(d, "c", "label").transform(new).collect()
    with pytest.raises(Exception, match="domain"):
        transforms.power(spark.createDataFrame([(-1.0,)], "x double"), "x", "log").collect()
    assert [r.c for r in transforms.binary(spark.createDataFrame([("Yes",), ("no",), (None,)], "c string"), "c").collect()] == [1, 0, None]


def test_scaler_round_trip_and_constant(spark):
    d = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, None)], "x double, c double")
    s = transforms.fit_scaler(d, ["x", "c"], "standard")
    out = s.transform(d).collect()
    assert [r.x for r in out] == [-1.0, 1.0, None] and [r.c for r in out] == [0.0, 0.0, None]
    assert [r.x for r in s.inverse(s.transform(d)).collect()] == [1.0, 3.0, None]


def test_bins_and_running_sums(spark):
    d = spark.createDataFrame([(float(i),) for i in range(0, 11)], "x double")
    assert [r.b for r in d.select(stats.cut(F.col("x"), [0, 5, 10], ["low", "high"]).alias("b")).collect()] == ["low"] * 6 + ["high"] * 5
    assert [r.b for r in d.select(stats.bin_of(F.col("x"), [0, 5, 10]).alias("b")).collect()] == [0] * 5 + [1] * 6
    many = spark.range(5000).select("id", F.lit(1).alias("n"))
    bad = ranks.running(many.repartition(7), "id", ["n"]).where("n_running <> id + 1").count()
    assert bad == 0
    assert stats.ks_p_value(0.5, 100, 100) < 1e-6 and stats.sample_size(0.1, 0.1) > 10_000


def test_quantiles_are_exact_and_interpolated(spark):
    d = spark.createDataFrame([("a", float(x)) for x in (5, 1, 1, 1, 9)] + [("b", 2.0), ("b", None), (None, 7.0)], "k string, x double")
    got = {r.key: r["values"] for r in ranks.quantiles_by(d.repartition(3), "k", "x", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    assert got["a"] == pytest.approx([1.0, 1.0, 1.0, 7.4, 9.0]) and got["b"] == [2.0] * 5 and got[None] == [7.0] * 5
    big = spark.range(10_001).select((F.col("id") * 7919 % 10_001).cast("double").alias("x"), F.lit(None).cast("double").alias("none"))
    assert ranks.quantiles(big.repartition(9), ["x", "none"], [0.25, 0.5]) == {"x": [2500.0, 5000.0], "none": None}


def test_psi_of_equal_samples_is_zero(spark):
    d = spark.createDataFrame([(float(i % 10), str(i % 3)) for i in range(300)], "x double, c string")
    assert one(stats.psi_numeric(d, d, "x", [0.0, 5.0, 10.0])).psi == 0
    assert one(stats.psi_categorical(d, d, "c")).psi == 0
    assert one(stats.ks(d, d, "x")).ks == 0


def test_profiles_of_nulls_and_checks(spark):
    d = spark.createDataFrame([(None, "Unknown"), (None, "unknown "), (None, "ok")], "x double, c string")
    p = profiling.universal(d)
    failed = {r.check_id for r in profiling.run_checks(p, "universal").where("not passed").collect()}
    assert failed == {"FQ001"}
    c = {r.check_id for r in profiling.run_checks(profiling.categorical(d, "c"), "categorical", "c").where("not passed").collect()}
    assert {"CN006", "CAT004"} <= c
    assert profiling.semantic_types(d)["x"] == "unknown"
    assert one(profiling.numeric(d, ["x"])).mean is None


def test_temporal_features_of_single_events(spark):
    d = spark.createDataFrame([("a", "2024-01-01", 1.0)], "e string, t string, v double")
    r = one(temporal.regularity(d, "e", "t"))
    assert r.event_frequency is None and r.regularity_score is None
    assert one(temporal.lifecycle(d, "e", "t", "v")).v_beginning is None
    assert one(temporal.momentum(d, "e", "t", "v", "2025-01-01")).momentum == 1.0


def test_segments_at_their_cuts(spark):
    d = spark.createDataFrame([(0.75,), (0.5,), (0.25,), (0.1,), (None,)], "p double")
    assert [r.s for r in d.select(segments.risk_segment(F.col("p")).alias("s")).collect()] == ["Critical", "High", "Medium", "Low", None]
    assert [r.s for r in d.select(segments.risk_segment(F.col("p"), "realtime").alias("s")).collect()][:2] == ["High", "High"]
    days = spark.createDataFrame([(7,), (8,), (181,)], "d int")
    assert [r.s for r in days.select(segments.recency_bucket(F.col("d")).alias("s")).collect()] == ["0-7d", "8-30d", "180d+"]


def test_splits_are_disjoint_and_stable(spark):
    d = spark.range(1000).withColumn("g", F.col("id") % 3)
    s = modeling.stratified_split(d, "id", "g")
    assert {r.g: r.n for r in s.where("split = 'test'").groupBy("g").agg(F.count("*").alias("n")).collect()} == {0: 67, 1: 67, 2: 67}
    assert s.exceptAll(modeling.stratified_split(d.repartition(5), "id", "g")).count() == 0
    assert {r.fold for r in modeling.folds(d, "id").select("fold").distinct().collect()} == {0, 1, 2, 3, 4}


def test_ranking_with_ties_and_one_class(spark):
    d = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, p double")
    assert one(modeling.ranking(d, "y", "p")).roc_auc == 0.875
    assert one(modeling.ranking(d.where("y = 1"), "y", "p")).roc_auc is None


def test_upsert_and_append(spark):
    a = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, o int")
    b = spark.createDataFrame([(2, None, 9), (3, "c", 3)], "k int, v string, o int")
    assert sorted(map(tuple, tables.upsert(a, b, ["k"]).collect())) == [(1, "a", 1), (2, None, 9), (3, "c", 3)]
    assert sorted(map(tuple, tables.upsert(a, b, ["k"], ["o"]).collect())) == [(1, "a", 1), (2, "b", 9), (3, "c", 3)]
    assert sorted(map(tuple, tables.append_keep_last(a, b, ["k"], "o").collect())) == [(1, "a", 1), (2, None, 9), (3, "c", 3)]


def test_sources_and_contexts(spark, tmp_path):
    d = spark.createDataFrame([(1, "x;y"), (2, None)], "a int, b string")
    for kind in ("parquet", "json", "orc"):
        d.write.format(kind).save(f"{tmp_path}/{kind}")
        assert tables.load(spark, tables.SourceConfig("s", f"{tmp_path}/{kind}", kind)).count() == 2
    d.write.option("header", True).option("sep", ";").csv(f"{tmp_path}/csv")
    read = tables.load(spark, tables.SourceConfig("s", f"{tmp_path}/csv", "csv", {"sep": ";"}, sample=1))
    assert read.count() == 1 and dict(read.dtypes)["a"] == "int"
    with pytest.raises(ValueError):
        tables.load(spark, tables.SourceConfig("s", "x", "nope"))
    with pytest.raises(tables.AccessDenied):
        tables.guarded("training", "raw")
    tables.guarded("admin", "label")


def test_snapshots_are_versioned_and_checked(spark, tmp_path):
    d = spark.createDataFrame([(1, "2024-01-01", "2024-02-01", True), (2, "2024-03-01", "2024-04-01", True), (3, "2024-01-01", "2024-02-01", False)], "k int, feature_timestamp string, label_timestamp string, label_available_flag boolean")
    d = d.withColumns({c: F.col(c).cast("timestamp") for c in ("feature_timestamp", "label_timestamp")})
    s = snapshots.Snapshots(spark, str(tmp_path))
    assert s.create(d, "train", "2024-02-15").rows == 1 and s.create(d, "train", "2024-12-31").version == 2
    assert s.load("train").count() == 2 and s.compare("train", 1, 2)["rows"] == 1
    spark.createDataFrame([(9,)], "k int").write.mode("append").parquet(f"{tmp_path}/train/v2/data")
    with pytest.raises(ValueError):
        s.load("train", 2)


def test_sessions_split_after_the_gap_only(spark):
    d = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:30:00"), ("a", "2024-01-01 01:00:01")], "k string, t string")
    assert [(r.session, r.events, r.seconds) for r in stream.sessions(d, "k", "t", "30m").orderBy("session").collect()] == [(0, 2, 1800.0), (1, 1, 0.0)]


def test_trigger_cooldown_and_cap(spark):
    times = ["2024-01-01 00:00:00", "2024-01-01 00:30:00", "2024-01-01 01:00:00", "2024-01-01 05:00:00", "2024-01-01 09:00:00", "2024-01-02 00:00:00"]
    d = spark.createDataFrame([("a", t, 1) for t in times] + [("b", times[0], 0)], "k string, t string, v int")
    fired = stream.threshold_trigger(d, "k", "t", F.col("v") > 0, "1h", 3).count()
    assert fired == 4


def test_early_warning_is_clipped(spark):
    d = spark.range(1)
    r = one(stream.early_warning(d, {n: F.lit(1.0) for n in stream.SIGNALS}))
    assert r.score == 1.0 and r.level == "critical" and r.primary_signal == "activity_drop"


def test_stream_twins(spark, sf, tmp_path):
    batch = tables.table(spark, sf, "events")
    batch.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    out = stream.tumbling_stream(source, "ts", "1 hour", [F.count("*").alias("n")], "10 minutes")
    q = out.writeStream.outputMode("complete").format("memory").queryName("hourly").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from hourly").first()[0] == batch.count()
    s = stream.sessions_stream(source, "user_id", "ts", "12 hours", "1 day", [F.count("*").alias("n")])
    q = s.writeStream.outputMode("append").format("memory").queryName("sessions").option("checkpointLocation", f"{tmp_path}/s").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) from sessions").first()[0] > 0


def test_validation_on_empty_tables(spark):
    d = spark.createDataFrame([], "e string, t timestamp, x double, y int")
    assert validation.leakage(d, ["x"], "y").first().correlation is None
    assert one(validation.feature_auc(d, "x", "y")).auc is None
    assert validation.gap_islands(d, "t").count() == 0
    assert validation.temporal_quality(d, "e", "t", F.lit("2024-01-01").cast("timestamp")).count() == 2
    assert one(d.select(inside(F.col("t"), F.lit("2024-01-01").cast("timestamp"), "7d").alias("i")).agg(F.count("*").alias("n"))).n == 0

"""Splits, evaluation, scoring, calibration, fairness and campaign arithmetic as DataFrame plans."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import ranked, running
from ..time import as_time
from .segments import risk_segment


def _hash(key: str, seed: int) -> Column:
    """A number from 0 up to 1 for each key, the same on every run."""
    return F.pmod(F.crc32(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), F.lit(1_000_003)) / 1_000_003.0


def stratified_split(df: DataFrame, key: str, stratum: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """split = test for that share of each stratum, by rank of the key's hash."""
    d = ranked(df, stratum, [_hash(key, seed).alias("h"), F.col(key).alias("k")])
    return d.withColumn("split", F.when(F.col("_rank") <= F.round(F.col("_size") * test), "test").otherwise("train")).drop("_rank", "_size")


def hash_split(df: DataFrame, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """By the hash of a key or group alone: no shuffle, and a group is never torn apart."""
    return df.withColumn("split", F.when(_hash(key, seed) < test, "test").otherwise("train"))


def temporal_split(df: DataFrame, time: str, cutoff: str | datetime) -> DataFrame:
    """train up to the cutoff, score after it, unresolvable without a time."""
    t = F.col(time).cast("timestamp")
    return df.withColumn("split", F.when(t.isNull(), "unresolvable").when(t <= as_time(cutoff), "train").otherwise("score"))


def folds(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", F.least(F.floor(_hash(key, seed) * k), F.lit(k - 1)).cast("int"))


def cv_folds(df: DataFrame, key: str, k: int = 5, kind: str = "stratified", by: str | None = None, seed: int = 42) -> DataFrame:
    """df with fold, from 0. stratified: each class of `by` dealt evenly, by rank of the key's hash; group: values of `by`
    stay together; time: in the order of `by`, with k test parts of equal size at the end, numbered from 1, each to be
    tested on what comes before it (fold 0 is never tested)."""
    if kind == "group":
        return folds(df, by or key, k, seed)
    if kind == "stratified":
        d = ranked(df, by or key, [_hash(key, seed).alias("h"), F.col(key).alias("k")])
        return d.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_size")
    if kind != "time":
        raise ValueError(f"folds {kind} are none of stratified, group, time")
    d = ranked(df.withColumn("_all", F.lit(1)), "_all", [F.col(by or key).alias("t"), F.col(key).alias("k")])
    size = F.floor(F.col("_size") / (k + 1))
    return d.withColumn("fold", F.greatest(F.lit(0), k - F.floor((F.col("_size") - F.col("_rank")) / size)).cast("int")).drop("_rank", "_size", "_all")


def class_weights(df: DataFrame, target: str) -> DataFrame:
    each = df.groupBy(target).agg(F.count("*").alias("n"))
    return each.join(F.broadcast(each.agg(F.sum("n").alias("_n"), F.count("*").alias("_k")))).select(target, (F.col("_n") / (F.col("_k") * F.col("n"))).alias("weight"))  # one row


def confusion(df: DataFrame, y: str, p: str, threshold: float = 0.5) -> DataFrame:
    """Counts and rates at a threshold, Brier score and log loss."""
    one, said = F.col(y) == 1, F.col(p) >= threshold
    count = lambda c: F.count(F.when(c, 1)).cast("double")
    q = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(p)))
    d = df.agg(count(one & said).alias("tp"), count(~one & said).alias("fp"), count(one & ~said).alias("fn"), count(~one & ~said).alias("tn"), F.avg(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("brier"), F.avg(-F.when(one, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    precision, recall, rest = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    return d.withColumns({"accuracy": (tp + tn) / (tp + fp + fn + tn), "precision": precision, "recall": recall, "f1": F.try_divide(2 * tp, 2 * tp + fp + fn), "balanced_accuracy": (recall + rest) / 2})


def ranking(df: DataFrame, y: str, p: str) -> DataFrame:
    """ROC-AUC (ties count half) and average precision from running counts over distinct scores."""
    each = df.groupBy((-F.col(p).cast("double")).alias("s")).agg(F.sum((F.col(y) == 1).cast("bigint")).alias("p"), F.sum((F.col(y) == 0).cast("bigint")).alias("q"))
    r = running(each, "s", ["p", "q"])
    total = F.sum("p"), F.sum("q")
    won = F.sum(F.col("q") * (F.col("p_running") - F.col("p") / 2))
    precision = F.col("p_running") / (F.col("p_running") + F.col("q_running"))
    return r.agg(F.try_divide(won, (total[0] * total[1]).cast("double")).alias("roc_auc"), F.try_divide(F.sum(F.col("p") * precision), total[0].cast("double")).alias("average_precision"))


def lift(df: DataFrame, y: str, p: str, key: str, percents: Sequence[int] = (10, 20)) -> DataFrame:
    """Per share of the highest scores: rate there over the rate of all, and share of all ones found. Ties by key. The rank
    comes from running counts by ranges."""
    d = df.select(F.col(y).cast("int").alias("y"), F.struct((-F.col(p).cast("double")).alias("s"), F.col(key).alias("k")).alias("o"), F.lit(1).alias("one"))
    r = running(d, "o", ["one"])
    total = d.agg(F.count("*").alias("n"), F.sum("y").alias("ones"))
    both = r.join(F.broadcast(total))  # one row
    row = both.agg(F.first("n").alias("n"), F.first("ones").alias("ones"), *[F.struct(F.count(F.when(c, 1)).alias("rows"), F.coalesce(F.sum(F.when(c, F.col("y"))), F.lit(0)).alias("hits")).alias(f"k{k}") for k in percents for c in [F.col("one_running") <= F.floor(F.col("n") * k / 100)]])
    out = row.select("n", "ones", F.explode(F.array(*[F.struct(F.lit(k).alias("percent"), F.col(f"k{k}").alias("s")) for k in percents])).alias("r"))
    return out.select("r.percent", F.try_divide(F.col("r.s.hits") / F.col("r.s.rows"), F.col("ones") / F.col("n")).alias("lift"), (F.col("r.s.hits") / F.col("ones")).alias("gain"))


def thresholds(df: DataFrame, y: str, p: str, false_positive: float = 1.0, false_negative: float = 5.0) -> DataFrame:
    """Cost, F1, F2, precision and recall at thresholds .01 to .99, from counts of score cells (100 rows), not from rows."""
    cell = F.least(F.floor(F.col(p) * 100 + 1e-9), F.lit(99)).cast("int")
    cells = df.groupBy(cell.alias("cell")).agg(F.sum((F.col(y) == 1).cast("bigint")).alias("a"), F.sum((F.col(y) == 0).cast("bigint")).alias("b"))
    grid = df.sparkSession.range(1, 100).select(F.col("id").cast("int").alias("t"))
    d = grid.join(F.broadcast(cells), F.lit(True)).groupBy("t").agg(  # 99 thresholds, 100 cells
        *[F.sum(F.when(c, F.col(x)).otherwise(0)).cast("double").alias(n) for n, x, c in (("tp", "a", F.col("cell") >= F.col("t")), ("fp", "b", F.col("cell") >= F.col("t")), ("fn", "a", F.col("cell") < F.col("t")))]
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return d.select((F.col("t") / 100).alias("threshold"), (fp * false_positive + fn * false_negative).alias("cost"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"), F.try_divide(5 * tp, 5 * tp + fp + 4 * fn).alias("f2"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"))


def calibration(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(F.col(y).cast("double")).alias("observed"))


def calibration_error(bins: DataFrame) -> DataFrame:
    gap = F.abs(F.col("predicted") - F.col("observed"))
    return bins.agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def fairness(df: DataFrame, y: str, p: str, group: str, threshold: float = 0.5) -> DataFrame:
    """Per group: share selected, true and false positive rates, and the share over the highest group's."""
    said, one = F.col(p) >= threshold, F.col(y) == 1
    rate = lambda c, of: F.try_divide(F.count(F.when(c & of, 1)).cast("double"), F.count(F.when(of, 1)).cast("double"))
    each = df.groupBy(group).agg(F.count("*").alias("n"), rate(said, F.lit(True)).alias("selected"), rate(said, one).alias("tpr"), rate(said, ~one).alias("fpr"))
    return each.join(F.broadcast(each.agg(F.max("selected").alias("_m")))).withColumn("disparate_impact", F.try_divide("selected", "_m")).drop("_m")  # one row


def segment_performance(df: DataFrame, y: str, p: str, segment: str, threshold: float = 0.5) -> DataFrame:
    said, one = F.col(p) >= threshold, F.col(y) == 1
    n = lambda c: F.count(F.when(c, 1)).cast("double")
    return df.groupBy(segment).agg(F.count("*").alias("n"), (n(said == one) / F.count("*")).alias("accuracy"), F.try_divide(n(said & one), n(said)).alias("precision"), F.try_divide(n(said & one), n(one)).alias("recall"))


def errors(df: DataFrame, y: str, p: str, threshold: float = 0.5) -> DataFrame:
    """Wrong rows by kind and by how sure the score was."""
    said, one = F.col(p) >= threshold, F.col(y) == 1
    kind = F.when(said & ~one, "false_positive").when(~said & one, "false_negative")
    sure = F.abs(F.col(p) - threshold)
    band = F.when(sure >= 0.3, "high").when(sure >= 0.15, "medium").otherwise("low")
    return df.select(kind.alias("kind"), band.alias("confidence")).where("kind is not null").groupBy("kind", "confidence").agg(F.count("*").alias("n"))


def batch_scores(df: DataFrame, entity: str, probability: Column, threshold: float = 0.5, kind: str = "batch") -> DataFrame:
    p = probability.cast("double")
    return df.select(F.col(entity), p.alias("churn_probability"), risk_segment(p, kind).alias("risk_segment"), (p >= threshold).cast("int").alias("predicted_churn"))


def campaign_list(scores: DataFrame, entity: str, n: int) -> DataFrame:
    """The n entities of the highest risk: a report of that many rows."""
    return scores.orderBy(F.desc("churn_probability"), entity).limit(n)


def roi(scores: DataFrame, interventions: DataFrame, customer_value: float) -> DataFrame:
    """Per risk segment and intervention (name, cost, success_rate): rows, cost, saved value and return on cost. Segments are
    counted before they meet the interventions."""
    each = scores.groupBy("risk_segment").agg(F.count("*").alias("n"), F.avg("churn_probability").alias("risk"))
    d = each.join(F.broadcast(interventions), F.lit(True))  # a few segments, a list of interventions
    cost, saved = F.col("n") * F.col("cost"), F.col("n") * F.col("risk") * F.col("success_rate") * customer_value
    return d.select("risk_segment", "name", "n", cost.alias("total_cost"), saved.alias("saved_value"), F.try_divide(saved - cost, cost.cast("double")).alias("roi"))


def best_intervention(roi_: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("risk_segment").orderBy(F.desc("roi"), "name"))
    return roi_.withColumn("_r", rank).where("_r = 1").drop("_r")


def retraining_reasons(performance_drop: float, psi: float, age_days: int, volume_change: float) -> list[str]:
    rules = {"performance": performance_drop > 0.15, "drift": psi > 0.20, "age": age_days > 90, "volume": volume_change > 0.5}
    return [n for n, hit in rules.items() if hit]


def train(df: DataFrame, features: Sequence[str], target: str, kind: str = "logistic", weight: str | None = None, **options):
    """A fitted Spark ML pipeline: logistic, forest or boosted. options: the classifier's parameters."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    made = {"logistic": LogisticRegression, "forest": RandomForestClassifier, "boosted": GBTClassifier}[kind]
    options = {"labelCol": target, "featuresCol": "_features"} | ({"weightCol": weight} if weight else {}) | options
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip"), made(**options)]).fit(df)


def cross_validate(df: DataFrame, key: str, features: Sequence[str], target: str, kind: str = "logistic", k: int = 5, seed: int = 42, strategy: str = "hash", by: str | None = None, repeats: int = 1, **options) -> DataFrame:
    """(fold, roc_auc, average_precision) of models that were trained on the other folds. strategy: hash, or one of
    cv_folds; over time, on earlier folds only. repeats: with other seeds, folds numbered on."""
    from pyspark.ml.functions import vector_to_array

    out = None
    for n in range(repeats):
        d = folds(df, key, k, seed + n) if strategy == "hash" else cv_folds(df, key, k, strategy, target if strategy == "stratified" else by, seed + n)
        for i in range(1, k + 1) if strategy == "time" else range(k):
            rest = F.col("fold") < i if strategy == "time" else F.col("fold") != i
            scored = train(d.where(rest), features, target, kind, **options).transform(d.where(F.col("fold") == i))
            r = ranking(scored.select(target, vector_to_array("probability")[1].alias("_p")), target, "_p").select(F.lit(n * k + i).alias("fold"), "roc_auc", "average_precision")
            out = r if out is None else out.unionByName(r)
    return out


def stability(cv: DataFrame, metric: str = "average_precision", most: float = 0.10) -> DataFrame:
    """Mean and population deviation of a metric over folds, and whether the deviation is at most `most`."""
    return cv.agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std")).withColumn("stable", F.col("std") <= most)


def search(df: DataFrame, key: str, features: Sequence[str], target: str, grid: dict[str, Sequence], kind: str = "logistic", metric: str = "average_precision", tries: int | None = None, seed: int = 42, **cv) -> list[tuple[dict, float]]:
    """Parameters of a grid, or `tries` drawn from it, with their mean metric over folds, best first."""
    import itertools
    import random

    every = [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]
    chosen = every if tries is None or tries >= len(every) else random.Random(seed).sample(every, tries)
    found = [(options, cross_validate(df, key, features, target, kind, seed=seed, **cv, **options).agg(F.avg(metric)).first()[0]) for options in chosen]
    return sorted(found, key=lambda x: (x[1] is None, -(x[1] or 0.0), str(x[0])))


def compare(models: dict[str, dict[str, float]], metric: str = "roc_auc") -> list[tuple[str, float]]:
    """Models by a metric, best first, ties by name."""
    return sorted(((n, m[metric]) for n, m in models.items()), key=lambda x: (-x[1], x[0]))


def assign_arms(df: DataFrame, key: str, stratum: str, arms: Sequence[str] = ("control", "treatment"), seed: int = 42) -> DataFrame:
    """Arms of an experiment, of equal size within each stratum, by rank of the key's hash."""
    d = ranked(df, stratum, [_hash(key, seed).alias("h"), F.col(key).alias("k")])
    return d.withColumn("arm", F.element_at(F.array(*map(F.lit, arms)), ((F.col("_rank") - 1) % len(arms) + 1).cast("int"))).drop("_rank", "_size")


def with_noise(df: DataFrame, columns: Sequence[str], share: float, seed: int = 42) -> DataFrame:
    """Columns with Gaussian noise of that share of their deviation, to see how far scores move."""
    sd = df.agg(*[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    d = df.join(F.broadcast(sd))  # one row
    return d.withColumns({c: F.col(c) + F.randn(seed + i) * F.col(f"_s_{c}") * share for i, c in enumerate(columns)}).drop(*[f"_s_{c}" for c in columns])


def overfitting(train_metric: float, test_metric: float, cv: Sequence[float] = ()) -> list[str]:
    """What the gap between training and test, and the spread over folds, say."""
    gap = train_metric - test_metric
    out = ["severe_gap"] if gap > 0.10 else ["gap"] if gap > 0.05 else []
    if len(cv) > 1:
        mean = sum(cv) / len(cv)
        sd = (sum((x - mean) ** 2 for x in cv) / (len(cv) - 1)) ** 0.5
        out += ["unstable"] if sd > 0.05 else []
    return out

"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's features are its distinct words, their first four and five letters and their shapes (runs of upper case, lower
case, digits and each symbol), hashed into DIMENSIONS buckets, and a few marks of its form (how much of it is upper case,
digits, symbols, repeated words, long words), each in one of 32 steps. Fitting keeps the features that stand in DF
documents at least and whose share among the lower grades differs from that among the higher ones by Z standard
deviations. One weight vector serves all grades; ordered thresholds t_1 < t_2 < ... cut the same axis: P(grade >= j) =
sigmoid(w x - t_j). The expected grade is the sum of these, and the last of them, the probability of the best grade, is
what selection uses.

Grades of the tables here: 0 toxic, 1 not toxic but of low quality, 2 neither. Fitting takes at most SAMPLE labelled
documents, those with the smallest hashes of their keys, as long as these have FEATURES hashed features in all; gathers
these on the driver (whole texts), and runs full-batch gradient steps. Every whole text is scored.

Rows: null and empty texts have form marks only and are scored; labels with a null key or null grades are not learned
from; of labels that repeat a key the lowest grade counts; without labels every text has expected grade null and is
kept; with a single grade that grade is expected of all; texts of any length are read whole; rows that repeat are scored
equally; an empty table gives an empty one; other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import about, extended, table, written

DIMENSIONS = 1 << 18
#: Labelled documents that are learned from, at most.
SAMPLE = 6000
#: Features of them that the driver gathers, at most: 120 MB.
FEATURES = 30_000_000
STEPS, RATE, RIDGE = 1000, 0.1, 1e-3
DF, Z = 2, 4.0
#: Documents with at least this probability of the best grade are kept.
KEEP = 0.5
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
FORM = 256
_RUNS = ((re.compile(r"[^\W\d_]+"), lambda m: "A" if m[0].isupper() else "a" if m[0].islower() else "Aa"), (re.compile(r"\d+"), "0"), (re.compile(r"(.)\1+"), r"\1"))


def _bucket(name: str) -> int:
    return xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass")) % (DIMENSIONS - FORM)


class _Buckets(dict):
    """Token -> the buckets of its word, its beginnings and its shape."""

    def __missing__(self, token: str) -> tuple[int, ...]:
        word, shape = token.strip(EDGES).lower(), token
        for pattern, by in _RUNS:
            shape = pattern.sub(by, shape)
        names = [f"w{word}", *(f"b{word[:n]}" for n in (4, 5) if len(word) > n), f"s{shape}"]
        made = tuple(map(_bucket, names))
        if len(self) >= 400_000:
            self.clear()
        if len(token) <= 48:
            self[token] = made
        return made


_buckets = _Buckets()


def features(text: str | None) -> np.ndarray:
    """Distinct buckets of a text, each of value 1. The last FORM are its form's."""
    text = text or ""
    tokens = text.split()
    kinds = set(tokens)
    n, n_tokens = max(len(text), 1), max(len(tokens), 1)
    raw = text.encode("utf-8", "surrogatepass")
    upper, digits = (len(raw) - len(raw.translate(None, which)) for which in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"))
    symbols = len(raw) - len(raw.translate(None, EDGES.encode()))
    twice = sum(map(str.__eq__, tokens, tokens[1:]))
    form = (upper / n, digits / n, symbols / n, 1 - len(kinds) / n_tokens, min(1.0, (n - n_tokens) / n_tokens / 16), min(1.0, n_tokens / 4096), twice / n_tokens, min(1.0, raw.count(b"\n") / n_tokens))
    marks = [DIMENSIONS - FORM + 32 * i + min(31, int(32 * max(0.0, v) ** 0.5)) for i, v in enumerate(form)]
    found = set(marks).union(*map(_buckets.__getitem__, kinds))
    return np.fromiter(found, np.int64, len(found))


def telling(rows: list[np.ndarray], y: np.ndarray, df: int = DF, z: float = Z) -> np.ndarray:
    """Whether each feature tells some lower grades from the higher ones. The form's marks are kept if they occur."""
    n = len(rows)
    at, owner = np.concatenate(rows), np.repeat(np.arange(n), [len(r) for r in rows])
    total = np.bincount(at, minlength=DIMENSIONS)
    out = np.zeros(DIMENSIONS, bool)
    for j in range(1, int(y.max()) + 1):
        low = y < j
        share = low.mean()
        seen = np.bincount(at[low[owner]], minlength=DIMENSIONS)
        spread = np.sqrt(np.maximum(total * share * (1 - share) * (1 - total / n), 1e-9))
        out |= (np.abs(seen - total * share) >= z * spread) & (total >= df)
    out[-FORM:] = total[-FORM:] > 0
    return out


class CumulativeLink:
    def __init__(self, weights: np.ndarray, cuts: np.ndarray, least: int):
        self.weights, self.cuts, self.least = weights, cuts, least

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= least + j) for j = 1, 2, ..."""
        return _sigmoid(score[:, None] - self.cuts[None, :])

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and the probability of the best grade."""
        score = np.array([self.weights[features(t)].sum() for t in texts])
        tails = self.tails(score)
        best = tails[:, -1] if len(self.cuts) else np.ones(len(texts))
        return self.least + tails.sum(axis=1), best


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def likelihood(score: np.ndarray, cuts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The weighted negative log-likelihood of grades y (from 0), and its slopes by each row's score and by the cuts."""
    n, m = len(y), len(cuts)
    upper = np.concatenate([np.ones((n, 1)), _sigmoid(score[:, None] - cuts), np.zeros((n, 1))], axis=1)
    p = np.maximum(upper[np.arange(n), y] - upper[np.arange(n), y + 1], 1e-12)
    slope = upper * (1 - upper)  # of each tail; 0 at both ends
    ds = -weight * (slope[np.arange(n), y] - slope[np.arange(n), y + 1]) / p
    dc = np.zeros(m)
    np.add.at(dc, y[y > 0] - 1, (weight * slope[np.arange(n), y] / p)[y > 0])
    np.add.at(dc, y[y < m], (-weight * slope[np.arange(n), y + 1] / p)[y < m])
    return float(-(weight * np.log(p)).sum()), ds, dc


def fit_arrays(rows: list[np.ndarray], grades: np.ndarray, steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> CumulativeLink:
    """Maximum likelihood with a ridge, by Adagrad steps on all rows. Thresholds are kept
    in order after each step. Every row has the form's marks, so none is empty."""
    least, best = int(grades.min()), int(grades.max())
    y, m, n = grades - least, best - least, len(rows)
    if not m:
        return CumulativeLink(np.zeros(DIMENSIONS), np.zeros(0), least)
    chosen = telling(rows, y)
    rows = [r[chosen[r]] for r in rows]
    at, start = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]])
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    used, at = np.unique(at, return_inverse=True)
    w = np.zeros(len(used))
    share = np.array([(y >= j).mean() for j in range(1, m + 1)]).clip(1e-3, 1 - 1e-3)
    cuts = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(m))
    gw, gc = np.full(len(used), 1e-8), np.full(m, 1e-8)
    weight = np.array([1 / max(1, (y == g).sum()) ** 0.5 for g in range(m + 1)])[y]  # a grade weighs as the root of its rows
    weight *= n / weight.sum()
    for _ in range(steps):
        _, ds, dc = likelihood(np.add.reduceat(w[at], start), cuts, y, weight)
        dw = np.bincount(at, weights=ds[owner], minlength=len(used)) / n + ridge * w
        dc /= n
        gw += dw**2
        gc += dc**2
        w -= rate * dw / np.sqrt(gw)
        cuts = np.maximum.accumulate(cuts - rate * dc / np.sqrt(gc))
    weights = np.zeros(DIMENSIONS)
    weights[used] = w
    return CumulativeLink(weights, cuts, least)


def fit(docs: DataFrame, grades: DataFrame, key: str = "doc_id", text: str = "text", grade: str = "grade", sample: int = SAMPLE, most: int = FEATURES) -> CumulativeLink | None:
    """grades: key and grade (integer). most: features that are gathered; the documents that would pass it, by the hash of
    the key, are left out, but for the first one."""
    rated = grades.select(F.col(key).alias("key"), F.col(grade).cast("int").alias("grade")).dropna().groupBy("key").agg(F.min("grade").alias("grade"))
    # Cut to about twice the sample first, so that the last ranking sees no more, whatever the input.
    chosen = rated.where(about(2 * sample, rated.count(), "key")).orderBy(F.xxhash64("key"), "key").limit(sample)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key").groupBy("key", "grade").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t).tolist() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(map(len, found)), pa.int32()), pa.array(found, pa.list_(pa.int32()))], names=["place", "grade", "size", "features"])

    made = written(texts.select(F.xxhash64("key").alias("place"), "grade", "text").mapInArrow(run, "place bigint, grade int, size int, features array<int>"), "features")
    sizes = sorted(map(tuple, made.select("place", "size").collect()))  # of `sample` documents
    total, last = 0, None
    for place, size in sizes:
        total += size
        if total > most and last is not None:
            break
        last = place
    if last is None:
        return None
    t = made.where(F.col("place") <= last).orderBy("place", "grade").select("grade", "features").toArrow()
    lists = t.column("features").combine_chunks()
    at = lists.flatten().to_numpy().astype(np.int64)
    rows = np.split(at, np.cumsum(lists.value_lengths().to_numpy())[:-1])
    return fit_arrays(rows, t.column("grade").to_numpy())


def score(docs: DataFrame, model: CumulativeLink | None, text: str = "text", least: float = KEEP) -> DataFrame:
    """docs with expected_grade, p_best and keep; columns of these names are replaced."""
    docs = docs.drop("expected_grade", "p_best", "keep")
    if model is None:
        return docs.withColumns({"expected_grade": F.lit(None).cast("double"), "p_best": F.lit(None).cast("double"), "keep": F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.cuts, model.least))  # DIMENSIONS weights: 1 MB
    at = docs.columns.index(text)
    schema = extended(docs.schema, "expected_grade double, p_best double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = CumulativeLink(*shared.value)
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                b = whole.slice(a, 256)
                expected, best = mine.predict(b.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(expected, pa.float64()), pa.array(best, pa.float64())], names=[*b.schema.names, "expected_grade", "p_best"])

    return docs.mapInArrow(run, schema).withColumn("keep", F.col("p_best") >= least)


def grades_of(labels: DataFrame) -> DataFrame:
    """0 toxic, 1 low quality, 2 neither."""
    grade = F.when(F.col("toxic") == 1, 0).when((F.col("toxic") == 0) & (F.col("quality") == 0), 1).when((F.col("toxic") == 0) & (F.col("quality") == 1), 2)
    return labels.select("doc_id", grade.alias("grade"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, grades_of(table(spark, sf_dir, "labels")))).drop("text")

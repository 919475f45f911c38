"""Embeddings to principal components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_pca(df: DataFrame, vector: str, share: float = 0.95, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and components (rows) of the vectors, as many as reach that share of the variance, or just `most` if that is
    fewer. Signs are such that each component's largest entry is positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    rows = df.where(F.col(vector).isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    mean = np.asarray(rows.select(Summarizer.mean(rows.v)).first()[0].toArray())
    model = PCA(k=min(most or len(mean), len(mean)), inputCol="v", outputCol="p").fit(rows)
    parts, explained = model.pc.toArray().T, np.asarray(model.explainedVariance.toArray())
    k = min(len(parts), int(np.searchsorted(np.cumsum(explained), share - 1e-12) + 1))
    signs = np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(axis=1)])
    return mean, (parts * signs[:, None])[:k]


def project(df: DataFrame, vector: str, mean: np.ndarray, components: np.ndarray, prefix: str) -> DataFrame:
    """Columns prefix_pc0, prefix_pc1, ...: built-in array functions over literal components."""
    x = F.zip_with(F.col(vector).cast("array<double>"), F.array(*map(F.lit, mean.tolist())), lambda a, m: a - m)
    df = df.withColumn("_x", x)
    dot = lambda c: F.aggregate(F.zip_with("_x", F.array(*map(F.lit, c.tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return df.withColumns({f"{prefix}_pc{i}": dot(c) for i, c in enumerate(components)}).drop("_x")

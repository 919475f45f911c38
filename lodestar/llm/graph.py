"""Connected components of links between 64-bit keys: links are contracted to forests task by task, and forests that don't
fit in one task are merged by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_join, written

#: Links of 16 bytes that are contracted at once; so many at most need no rounds.
CHUNK = 1 << 20
#: The rounds double the reach of a label; a chain of 2^40 keys would need about as many.
MAX_ROUNDS = 60


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key that these links tie to a smaller one, and the smallest that it reaches over them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        u, v = label[i], label[j]
        open_ = u != v
        if not open_.any():
            break
        i, j, u, v = i[open_], j[open_], u[open_], v[open_]
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while (label[label] != label).any():
            label = label[label]
    tied = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[tied], nodes[label[tied]]


def _contract(links: DataFrame, chunk: int) -> DataFrame:
    """(u, v): links that connect the same, each from a key to the smallest one that its chunk's links reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def done() -> Iterator[pa.RecordBatch]:
            u, v = contracted(*(np.concatenate(x) for x in zip(*held, strict=True)))
            for at in range(0, len(u), 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(u[at : at + 65_536]), pa.array(v[at : at + 65_536])], names=["u", "v"])

        for b in batches:
            for at in range(0, b.num_rows, chunk):
                part = b.slice(at, chunk)
                held.append((part.column(0).to_numpy(), part.column(1).to_numpy()))
                n += part.num_rows
                if n >= chunk:
                    yield from done()
                    held, n = [], 0
        if held:
            yield from done()

    return links.mapInArrow(run, "u bigint, v bigint")


def components(links: DataFrame, chunk: int = CHUNK, hot_rows: int | None = None) -> DataFrame:
    """links: columns a, b (long). Returns (node, root): the smallest key that each linked key reaches. Keys without links
    are absent. Each round's links are written to the shared folder; the driver sees counts only. A node with many
    neighbours is dealt over several tasks."""
    pairs = written(links.where("a <> b").select("a", "b").distinct(), "links")
    if pairs.limit(chunk + 1).count() <= chunk:
        return _roots(written(_contract(pairs.coalesce(1), chunk + 1), "links"))
    pairs = written(_contract(pairs, chunk).distinct(), "links")
    for _ in range(MAX_ROUNDS):
        # large-star: the larger neighbours of a node, and nothing else, are tied to its smallest neighbour
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
        large = written(keyed_join(both, least, ["u"], 0, hot_rows=hot_rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # small-star: a node and its smaller neighbours are tied to the smallest of these
        low = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        tied = keyed_join(large, low, ["u"], 0, hot_rows=hot_rows).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(_contract(tied.unionByName(low.select("u", F.col("m").alias("v"))), chunk).distinct(), "links")
        same = _digest(after) == _digest(pairs)
        pairs = after
        if same:
            return _roots(pairs)
    raise RuntimeError("components did not settle")


def _roots(pairs: DataFrame) -> DataFrame:
    roots = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _digest(pairs: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(pairs.agg(F.count("*"), F.bit_xor(h), F.sum(h % 1_000_003)).first())

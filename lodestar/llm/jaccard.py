"""Pairs of texts whose sets of word shingles are similar, by banded minhashes with exact verification.

A set's BANDS x ROWS minhashes are folded band by band; sets that agree on a band are candidates, and each candidate
pair's Jaccard similarity is computed from the sets themselves. A pair of similarity s agrees on no band with a
probability of (1 - s^ROWS)^BANDS: 5e-8 at 0.8, less above. Nothing that is linked falls short of `least`. Sets of up to
SMALL shingles are hashed by as many functions; larger ones are dealt into as many bins by one, of which each gives its
smallest; sets between the two sizes, that may be similar to either kind, have both.

Candidates of a band's value are compared with one of them, its hub; what that leaves in different components is compared
with other hubs, until few pairs are left (or HUBS rounds are over). The rest is compared block by block inside tasks,
which give the links of a forest. So a large group of near copies gives a few stars and a forest, and never its pairs.

Rows: a text without words has no set and is in no pair; a text of fewer than `size` words is one shingle; texts of any
length count whole, in blocks.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .common import keyed_join, short, written

BANDS, ROWS = 32, 4
#: Shingles up to which every function hashes all of them.
SMALL = 512
#: Rounds of hubs, and sets of a block.
HUBS, BLOCK = 3, 512
#: Rows of 16 bytes, of bands or texts, up to which a list is broadcast.
LIST_ROWS = 1_000_000
#: Pairs beyond which a set's comparisons are dealt over several tasks.
HOT_PAIRS = 2000


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles. Words are as in simhash.fingerprint."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(len(h), size), np.uint64)
    for i in range(min(len(h), size)):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(42)
    return r.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def _folded(least: np.ndarray, kind: int) -> np.ndarray:
    out = np.arange(BANDS, dtype=np.uint64) + np.uint64(BANDS * kind)
    for column in least.reshape(BANDS, ROWS).T:
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out


def bands(hashes: np.ndarray, least: float = 0.8) -> np.ndarray:
    """The values of a set's bands, one or two for each band. hashes: sorted."""
    out = []
    if len(hashes) <= math.ceil(SMALL / least):
        times, plus = _functions()
        x = hashes[:, None] * times + plus
        out.append(_folded((x ^ (x >> np.uint64(32))).min(axis=0), 0))
    if len(hashes) > SMALL:
        bins = np.arange(BANDS * ROWS, dtype=np.uint64)
        bound = bins * np.uint64((1 << 64) // (BANDS * ROWS))
        start = np.searchsorted(hashes, bound)
        end = np.append(start[1:], len(hashes))
        out.append(_folded(np.where(start < end, hashes[np.minimum(start, len(hashes) - 1)], bins), 1))
    return np.concatenate(out)


def columns(texts: list[str | None], size: int, least: float) -> tuple[list[pa.Array], list[str]]:
    """id (a hash of the set; null without words) and bands of each text."""
    ids: list[int | None] = []
    values: list[np.ndarray | None] = []
    for t in texts:
        h = shingles(t, size)
        ids.append(int(np.uint64(xxhash.xxh64_intdigest(h.tobytes())).view(np.int64)) if len(h) else None)
        values.append(bands(h, least).view(np.int64) if len(h) else None)
    return [pa.array(ids, pa.int64()), pa.array(values, pa.list_(pa.int64()))], ["id", "bands"]


def _sets(texts: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, hashes): the sets themselves. ids: id, and key and print of a text that has it."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                values = pa.array([shingles(t, size).view(np.int64) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0), values], names=["id", "hashes"])

    few = short(ids, LIST_ROWS)
    ids = ids.withColumnsRenamed({"key": "_key", "print": "_print"})
    found = texts.join(F.broadcast(ids) if few else ids, (F.col("print") == F.col("_print")) & F.col("key").eqNullSafe(F.col("_key"))).select("id", "text")
    # Rows may repeat key and text: any one of them gives the set.
    return written(found.mapInArrow(run, "id bigint, hashes array<bigint>").dropDuplicates(["id"]), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, x, y) of ids whose sets are as similar as `least`."""
    for side, name in (("a", "_x"), ("b", "_y")):
        n = pairs.groupBy(side).agg(F.count("*").alias("_n"))
        own = written(n.join(sets.select(F.col("id").alias(side), F.col("hashes").alias(name)), side), "sides")
        pairs = keyed_join(pairs, own, [side], 0, n="_n", hot_rows=HOT_PAIRS)
    shared = F.size(F.array_intersect("_x", "_y"))
    return pairs.where(shared >= F.lit(least) * (F.size("_x") + F.size("_y") - shared)).drop("_x", "_y")


def links(texts: DataFrame, rows: DataFrame, groups: DataFrame, size: int, least: float) -> DataFrame:
    """texts: key, print, text. rows: key, print, fp, id, bands. groups: node and root, of fingerprints that are linked
    already. Edges (a, b) of roots that connect what the pairs of texts with a similarity of `least` or more connect
    beyond that."""
    one = F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "print"))
    kinds = rows.where("id is not null").groupBy("id", "fp").agg(one.alias("one"), F.first("bands").alias("bands"))
    kinds = kinds.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kinds = written(kinds, "kinds")
    first = written(kinds.groupBy("id").agg(F.min("root").alias("root"), F.max("root").alias("last"), F.min("one").alias("one"), F.first("bands").alias("bands")), "ids")
    apart = first.where("root <> last").select("id", F.col("root").alias("b"))
    edges = written(kinds.select("id", F.col("root").alias("a")).join(apart, "id").where("a <> b").select("a", "b").distinct(), "edges")

    posted = first.select("id", "root", F.explode("bands").alias("band"))
    open_ = posted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high")
    posted = written(keyed_join(posted, written(open_.select("band", "n"), "open"), ["band"], LIST_ROWS), "candidates")
    wanted = posted.select("id").distinct().join(first, "id").select("id", F.col("one.key").alias("key"), F.col("one.print").alias("print"))
    sets = _sets(texts, written(wanted, "wanted"), size)

    for turn in range(HUBS + 1):
        now = graph.components(edges).select(F.col("node").alias("root"), F.col("root").alias("to"))
        posted = posted.join(now, "root", "left").select("band", "id", F.coalesce("to", "root").alias("root"))
        each = posted.groupBy("band", "root").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id")).alias("least"))
        open_ = each.groupBy("band").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"), F.min(F.struct("least.h", "least.id", "root")).alias("hub")).where("kinds > 1")
        open_ = written(open_.select("band", "n", F.col("n").alias("size"), ((F.col("n") * F.col("n") - F.col("own")) / 2).alias("pairs"), F.col("hub.id").alias("hub"), F.col("hub.root").alias("hub_root")), "open")
        count = open_.agg(F.sum("pairs").alias("pairs"), F.sum("n").alias("n")).first()
        if not count.n:
            return edges
        posted = written(keyed_join(posted, open_, ["band"], LIST_ROWS), "candidates")
        if turn == HUBS or count.pairs <= 2 * count.n:
            return edges.unionByName(_blocks(posted, sets, least))
        star = posted.where("root <> hub_root")
        pairs = star.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"), F.least("root", "hub_root").alias("x"), F.greatest("root", "hub_root").alias("y"))
        more = _verified(written(pairs.dropDuplicates(["a", "b"]), "pairs"), sets, least).select(F.col("x").alias("a"), F.col("y").alias("b"))
        edges = written(edges.unionByName(more).distinct(), "edges")
        posted = posted.select("band", "id", "root")
    return edges


def _blocks(posted: DataFrame, sets: DataFrame, least: float, block: int | None = None) -> DataFrame:
    """Edges (a, b) of roots that connect what similar sets within a band connect. posted: band, id, root, size (of the band).
    A band is cut into blocks of about `block` sets; a task compares two of them, or one with itself."""
    k = F.greatest(F.ceil(F.col("size") / (block or BLOCK)).cast("int"), F.lit(1))
    own = posted.withColumn("k", k).withColumn("p", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    every = own.select("band", "id", "root", "p", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("q"))
    every = every.select("band", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "p", "id", "root")
    n = written(every.groupBy("id").agg(F.count("*").alias("n")).join(sets, "id"), "sides")
    held = keyed_join(every, n, ["id"], 0, hot_rows=HOT_PAIRS).repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")

    def run(batches):
        out: list[tuple[int, int]] = []
        rows: list[tuple] = []
        at = None

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

        for b in batches:
            sides = b.column(6)
            for row, place in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)):
                if place != at:
                    out += forest(rows, least)
                    rows, at = [], place
                rows.append((b.column(3)[row].as_py(), b.column(5)[row].as_py(), sides[row].values.to_numpy().view(np.uint64)))
            if out:
                yield batch()
                out = []
        out += forest(rows, least)
        if out:
            yield batch()

    return held.select("band", "i", "j", "p", "id", "root", "hashes").mapInArrow(run, "a bigint, b bigint")


def forest(rows: list[tuple[int, int, np.ndarray]], least: float) -> list[tuple[int, int]]:
    """Links of roots that connect what similar sets of different roots connect. rows: block, root, set; sets of two blocks
    are compared across them only, which with one block means each with all."""
    if len({r for _, r, _ in rows}) < 2:
        return []
    blocks = {p for p, _, _ in rows}
    label = {r: r for _, r, _ in rows}

    def find(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    out = []
    for p in sorted(blocks)[:1]:
        mine = [(r, h) for q, r, h in rows if q == p]
        others = [(r, h) for q, r, h in rows if q != p] if len(blocks) > 1 else mine
        sizes = np.array([len(h) for _, h in others])
        flat, start = np.concatenate([h for _, h in others]), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        for r, h in mine:
            if all(find(o) == find(r) for o in {o for o, _ in others}):
                continue
            shared = np.add.reduceat(h[np.minimum(np.searchsorted(h, flat), len(h) - 1)] == flat, start)
            for i in np.flatnonzero(shared >= least * (len(h) + sizes - shared)).tolist():
                a, b = find(r), find(others[i][0])
                if a != b:
                    label[max(a, b)] = min(a, b)
                    out.append((max(a, b), min(a, b)))
    return out

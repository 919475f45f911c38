"""Near-duplicates by SimHash, found with a byte-position inverted index and count filtering.

A fingerprint's 64 bits are eight bytes at eight positions. Two fingerprints within 3 bits share at least 5 of them, and
so all four bytes of at least one quad out of a family of quads that covers every five positions. The inverted index
posts each distinct fingerprint under its bytes at each quad; fingerprints on one posting list are compared in blocks:
their shared positional bytes are tallied, pairs with fewer than 5 pass no further, the rest are verified bit by bit.
Each list gives the edges of a forest that links what is linked in it, not its pairs. A posting list longer than
LIST_ROWS is posted again under a fifth byte and, where it is still longer, under its other 24 bits with every three of
them blanked: fingerprints within 3 bits meet under some blank, and each such group gives a star. No list, however
long, is dropped or gathered in one task.

Rows: a text without words (null, empty, white space) has fingerprint zero and is linked like any other; texts of any
length count whole, in blocks; rows that repeat a doc_id get the same component; a null doc_id takes part, and is the
component's id only where no member has one; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph, jaccard
from .common import keyed_join, table, written

#: Longest posting list that one task compares in memory (512 KB of fingerprints, about a second).
LIST_ROWS = 32_768
#: Rows of some 30 bytes up to which posting lists' sizes, and fingerprints' components, are broadcast: 10 MB.
POST_ROWS = 300_000
#: Fingerprints of a list that are compared with the list at once.
BLOCK = 512
#: Shingles whose bits are tallied at once.
CHUNK = 65_536
BITS, BYTES = 64, 8


def quads() -> list[tuple[int, ...]]:
    """The 14 quads of positions whose numbers XOR to zero: every five positions of eight hold one of them."""
    return [q for q in combinations(range(BYTES), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]


def fingerprint(text: str | None, size: int = 3) -> int:
    """Bit b is 1 if it is set in over half of the shingles' XXH64 (seed 42). A-Z are lower-cased; words are runs
    without ASCII white space; a text of fewer than `size` words, but not none, is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[size - 1 :] or ends[-1:]
    counts, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for c in range(0, len(last), CHUNK):
        spans = zip(starts[c : c + CHUNK], last[c : c + CHUNK], strict=False)
        h = np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, min(CHUNK, len(last) - c))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(last), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, words: int | None = None, least: float = 0.8) -> DataFrame:
    """(key, fp, print): the fingerprint of each row as a long with the same bits, and a hash of its text. words: also id
    and bands, of the set of its shingles of so many words (see jaccard)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts = b.column(1).to_pylist()
                fps = np.fromiter((fingerprint(t, size) for t in texts), np.uint64, b.num_rows)
                more = jaccard.columns(texts, words, least) if words else ([], [])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), b.column(2), *more[0]], names=["key", "fp", "print", *more[1]])

    df = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("print"))
    return df.mapInArrow(run, f"key {kind}, fp bigint, print bigint" + (", id bigint, bands array<bigint>" if words else ""))


def _bytes_at(positions: tuple[int, ...]) -> Column:
    mask = sum(0xFF << 8 * p for p in positions)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _postings(fps: DataFrame, families: list[tuple[int, ...]]) -> DataFrame:
    """fp under its bytes at each family of positions: columns slot (the positions), post (the bytes), fp."""
    lists = F.explode(F.array(*[F.struct(F.lit(sum(1 << p for p in q)).alias("slot"), _bytes_at(q).alias("post")) for q in families]))
    return fps.select("fp", lists.alias("p")).select("p.slot", "p.post", "fp")


def _forest(fps: np.ndarray, distance: int, shared: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that link the fingerprints of one posting list as all their near pairs would: for each block of rows the
    near pairs are folded into labels, and each row is tied to its label once."""
    n = len(fps)
    label = np.arange(n)
    for a in range(0, n, BLOCK):
        x = fps[a : a + BLOCK, None] ^ fps[None, a:]
        tally = (x.view(np.uint8).reshape(*x.shape, BYTES) == 0).sum(axis=2, dtype=np.uint8)
        i, j = np.nonzero(tally >= shared)
        near = np.bitwise_count(x[i, j]) <= distance
        i, j = i[near] + a, j[near] + a
        off = i < j
        i, j = i[off], j[off]
        while len(i):
            u, v = label[i], label[j]
            open_ = u != v
            if not open_.any():
                break
            i, j, u, v = i[open_], j[open_], u[open_], v[open_]
            np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
            while (label[label] != label).any():
                label = label[label]
    tied = np.flatnonzero(label != np.arange(n))
    return [(fps[tied], fps[label[tied]])] if len(tied) else []


def _compare(lists: DataFrame, distance: int, shared: int) -> DataFrame:
    """Edges within posting lists of LIST_ROWS at most. A task reads its lists one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray]] = []
        held: list[np.ndarray] = []
        at = None

        def done() -> None:
            if held and len(fps := np.unique(np.concatenate(held))) > 1:
                out.extend(_forest(fps.view(np.uint64), distance, shared))

        for b in batches:
            if not b.num_rows:
                continue
            slot, post, fp = (b.column(i).to_numpy() for i in range(3))
            new = np.flatnonzero((np.diff(slot) != 0) | (np.diff(post) != 0)) + 1
            for s, e in zip([0, *new.tolist()], [*new.tolist(), len(fp)], strict=True):
                if at != (key := (slot[s], post[s])):
                    done()
                    held, at = [], key
                held.append(fp[s:e])
            if out:
                a, c = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
                out = []
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], names=["a", "b"])
        done()
        for a, c in out:
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64))], names=["a", "b"])

    return lists.repartition("slot", "post").sortWithinPartitions("slot", "post").mapInArrow(run, "a bigint, b bigint")


def _blanked(lists: DataFrame, distance: int) -> DataFrame:
    """Edges within lists that share five bytes and are too long to compare: a star for each blank of three bits."""
    rows = []
    for five in combinations(range(BYTES), 5):
        bits = [8 * p + i for p in range(BYTES) if p not in five for i in range(8)]
        rows += [(sum(1 << p for p in five), ~sum(1 << b for b in blank)) for blank in combinations(bits, distance)]
    masks = lists.sparkSession.createDataFrame([(slot, m if m >= -(1 << 63) else m + (1 << 64)) for slot, m in rows], "slot int, mask bigint")
    # 56 x 2024 masks, whatever the input
    under = written(lists.join(F.broadcast(masks), "slot").select("slot", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("rest"), "fp"), "blanked")
    star = under.groupBy("slot", "mask", "rest").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    return keyed_join(under, written(star, "stars"), ["slot", "mask", "rest"], POST_ROWS).where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def _with_sizes(posted: DataFrame, sizes: DataFrame) -> DataFrame:
    """posted with the length of each list in n."""
    return keyed_join(posted, written(sizes.withColumn("rows", F.col("n")), "sizes"), ["slot", "post"], POST_ROWS, n="rows")


def links(fps: DataFrame, distance: int = 3, list_rows: int = LIST_ROWS) -> DataFrame:
    """fps: distinct fingerprints (fp). Edges (a, b) that connect exactly what pairs within `distance` bits connect.
    distance: at most 3, for which the family of quads is complete."""
    if not 0 <= distance <= 3:
        raise ValueError("the index guarantees distances up to 3")
    shared = BYTES - distance
    posted = _postings(fps, quads())
    sizes = posted.groupBy("slot", "post").agg(F.count("*").alias("n")).where("n > 1")
    shared_lists = written(_with_sizes(posted, sizes), "postings")
    edges = _compare(shared_lists.where(F.col("n") <= list_rows).drop("n"), distance, shared)
    if not shared_lists.where(F.col("n") > list_rows).limit(1).count():
        return edges
    # A long list again, under each fifth byte.
    fifth = F.explode(F.array(*[F.lit(p) for p in range(BYTES)]))
    long_ = shared_lists.where(F.col("n") > list_rows).select("slot", "post", "fp", fifth.alias("p")).where(F.expr("slot & shiftleft(1, p)") == 0)
    byte = F.expr("shiftleft(cast(255 as bigint), 8 * p)")
    again = long_.select((F.expr("slot | shiftleft(1, p)")).alias("slot"), F.col("post").bitwiseOR(F.col("fp").bitwiseAND(byte)).alias("post"), "fp").distinct()
    sizes = again.groupBy("slot", "post").agg(F.count("*").alias("n")).where("n > 1")
    again = written(_with_sizes(again, sizes), "postings")
    edges = edges.unionByName(_compare(again.where(F.col("n") <= list_rows).drop("n"), distance, shared))
    return edges.unionByName(_blanked(again.where(F.col("n") > list_rows).drop("n"), distance))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, distance: int = 3, list_rows: int = LIST_ROWS, words: int = 5, least: float | None = None) -> DataFrame:
    """(key, fp, print, component, root): each row's fingerprint, a hash of its text, the smallest key that it reaches
    over links, and the smallest fingerprint that it reaches, which tells components apart whose keys are all null.
    least: also links texts whose shingles of `words` words have a Jaccard similarity of `least` or more."""
    rows = written(fingerprints(df, key, text, size, None if least is None else words, least or 0.8), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("key").alias("first"), F.count("*").alias("n")), "distinct")
    groups = graph.components(links(distinct.select("fp"), distance, list_rows))
    if least is not None:
        texts = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("print"), F.col(text).alias("text"))
        more = jaccard.links(texts, rows, groups, words, least)
        groups = graph.components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    rooted = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("first").alias("component"))
    rooted = written(rooted.join(first, "root").select("fp", "component", "root", "n"), "rooted")
    return keyed_join(rows.select("key", "fp", "print"), rooted, ["fp"], POST_ROWS).select("key", "fp", "print", "component", "root")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))

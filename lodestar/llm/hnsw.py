"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph per shard, stored as flat
neighbour arrays, with the shards' results merged.

Equal vectors are one node that holds the smallest of their ids, one more than can be asked for: copies, however many,
neither crowd a graph nor a task. Nodes are dealt over shards by a hash. To turn inner products into angles, vectors
are divided by the shard's largest norm M and get one more component, sqrt(1 - |x|^2 / M^2); queries get a 0 there, so
the order by angle is that by inner product.

A node's level is geometric, from a hash. Layers are built from the top; a layer's nodes are inserted in blocks, those
of the layer above first. Since a shard is bounded, a block's candidates among the nodes before it are found exactly, by
matrix products; of these each node is tied to up to M (twice that in layer 0) that are nearer to it than to each other
(the usual pruning), and back. A search goes down greedily and keeps EF nodes in layer 0, many queries in step. There it
starts from the shard's LONGEST vectors as well and, where links don't lead from every node to every other one, from seeds
in all parts. Scores are inner products of the original vectors in double precision.

The query set is all rows whose id is a multiple of `every`. Queries are packed in blocks of QUERY_BYTES, each of which is
broadcast in turn and searched in every shard, so no vector is shuffled to a shard. All rows are indexed. A shard holds
SHARD_BYTES of vectors and links at most, whatever their length.

Rows: vectors that are null, empty, zero, or hold a null, NaN or infinite component take no part, nor do rows without an
id; vectors of different lengths are never compared; rows that repeat id and vector count once; with fewer candidates
than k all are returned; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

K, EVERY = 20, 20
#: Links of a node, candidates for them, nodes that a search keeps.
M, CANDIDATES, EF = 16, 64, 128
#: Shards at least (a few per core), and nodes and bytes of a shard, about, beyond which there are more shards.
SHARDS, SHARD_ROWS, SHARD_BYTES = 12, 32_768, 64 << 20
#: Bytes of the queries that are broadcast at once, and of a packed row of them.
QUERY_BYTES, PACK_BYTES = 128 << 20, 4 << 20
#: Longest vectors of a shard at which every search of the lowest layer starts too.
LONGEST = 32
#: Nodes inserted, and queries searched, at once.
BLOCK = 256


def augmented(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1)
    scale = norm.max() or 1.0
    rest = np.sqrt(np.clip(1 - (norm / scale) ** 2, 0, None))
    return np.concatenate([x / scale, rest[:, None]], axis=1)


def levels(n: int, m: int = M) -> np.ndarray:
    """A level for each node number: geometric with ratio 1 / m."""
    h = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    u = ((h >> np.uint64(11)).astype(np.float64) + 1) / 2**53
    return np.floor(-np.log(u) / math.log(m)).astype(np.int64)


def _prune(a: np.ndarray, own: np.ndarray, cand: np.ndarray, m: int) -> np.ndarray:
    """Rows of cand (-1: none) in falling nearness to own's nodes; up to m kept of each row: those nearer to the node
    than to any that is kept, then the nearest of the others. -1 fills up."""
    rows, width = cand.shape
    near = np.einsum("rd,rcd->rc", a[own], a[cand])
    near[cand < 0] = -np.inf
    order = np.argsort(-near, axis=1, kind="stable")
    cand, near = np.take_along_axis(cand, order, 1), np.take_along_axis(near, order, 1)
    v = a[cand]
    between = np.matmul(v, v.transpose(0, 2, 1))
    keep, count, blocked = np.zeros((rows, width), bool), np.zeros(rows, int), np.zeros((rows, width), bool)
    for c in range(width):
        now = (cand[:, c] >= 0) & ~blocked[:, c] & (count < m)
        keep[:, c] = now
        count += now
        blocked |= now[:, None] & (between[:, c, :] > near)
    rank = np.where(keep, 0, np.where(cand >= 0, 1, 2))
    best = np.argsort(rank, axis=1, kind="stable")[:, :m]
    out = np.take_along_axis(np.where(cand >= 0, cand, -1), best, 1)
    if out.shape[1] < m:
        out = np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)
    return out.astype(np.int32)


def _link(a: np.ndarray, order: np.ndarray, m: int) -> np.ndarray:
    """Neighbours (len(a), m) of the nodes in order, which are inserted in blocks."""
    links = np.full((len(a), m), -1, np.int32)
    start = 0
    while start < len(order):
        end = min(len(order), start + max(1, min(start, BLOCK)))
        mine, before = order[start:end], order[:end]
        near = a[mine] @ a[before].T
        near[np.arange(end - start), np.arange(start, end)] = -np.inf
        width = min(CANDIDATES, end - 1)
        if width:
            top = np.argpartition(-near, width - 1, axis=1)[:, :width]
            found = before[top]
            found = np.where(np.isneginf(np.take_along_axis(near, top, 1)), -1, found)
            links[mine] = _prune(a, mine, found, m)
            # and back
            to = links[mine].ravel()
            by = np.repeat(mine, m)[to >= 0]
            to = to[to >= 0]
            s = np.lexsort((-np.einsum("rd,rd->r", a[to], a[by]), to))
            to, by = to[s], by[s]
            first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            rank = np.arange(len(to)) - np.repeat(first, np.diff(np.r_[first, len(to)]))
            some, row = np.unique(to, return_inverse=True)
            more = np.full((len(some), CANDIDATES), -1, np.int32)
            ok = rank < CANDIDATES
            more[row[ok], rank[ok]] = by[ok]
            for c in range(0, len(some), BLOCK):
                part = slice(c, c + BLOCK)
                old = links[some[part]]
                new = np.where((more[part, :, None] == old[:, None, :]).any(axis=2), -1, more[part])
                links[some[part]] = _prune(a, some[part], np.concatenate([old, new], axis=1), m)
        start = end
    return links


class Graph:
    """A shard: vectors, the ids of each, and flat neighbour arrays by layer."""

    def __init__(self, x: np.ndarray, ids: list[list[int]], m: int = M):
        self.x, self.ids = x, ids
        self.least = np.array([i[0] for i in ids], np.int64)
        # Links are told apart in doubles: short vectors beside a long one differ in the last component by very little.
        a = augmented(x.astype(np.float64))
        self.a = a.astype(np.float32)
        level = levels(len(x), m)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # from the top: nodes, their neighbours
        order = np.zeros(0, np.int64)
        for at in range(int(level.max()), -1, -1):
            order = np.concatenate([order, np.flatnonzero(level == at)])
            links = _link(a, order, m if at else 2 * m)
            self.layers.append((order[:1], links))
        # Inner products are largest with long vectors, to which a walk from short ones may not lead.
        longest = np.argsort(-np.linalg.norm(x, axis=1), kind="stable")[:LONGEST]
        self.seeds = np.union1d(longest, self._seeds(order[0], links))

    @staticmethod
    def _seeds(first: int, links: np.ndarray) -> np.ndarray:
        """Where a search of the lowest layer is to start besides, if links don't lead from every node to every other one
        (clusters that are far apart): nodes from which together all are reached, and their neighbours."""
        n = len(links)
        by, to = np.repeat(np.arange(n), links.shape[1])[links.ravel() >= 0], links.ravel()[links.ravel() >= 0]

        def spread(seen: np.ndarray, node: int, by: np.ndarray, to: np.ndarray) -> np.ndarray:
            seen[node], count = True, -1
            while count != (count := int(seen.sum())):
                seen[to[seen[by]]] = True
            return seen

        seen, starts = spread(np.zeros(n, bool), first, by, to), [first]
        while not seen.all():
            starts.append(int(seen.argmin()))
            seen = spread(seen, starts[-1], by, to)
        if len(starts) == 1 and spread(np.zeros(n, bool), first, to, by).all():
            return np.zeros(0, np.int64)
        return np.unique(np.concatenate([starts, links[starts][links[starts] >= 0]])).astype(np.int64)

    def search(self, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Node numbers (-1: none) and inner products of the k nearest found of each query, nearest first, of equally
        near ones that with the smaller id."""
        q = q.astype(np.float64)
        unit = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        unit = np.concatenate([unit, np.zeros((len(q), 1))], axis=1).astype(np.float32)
        entry = np.full((len(q), 1), self.layers[0][0][0], np.int64)
        for i, (_, links) in enumerate(self.layers):
            last = i == len(self.layers) - 1
            if last:
                entry = np.concatenate([entry, np.where(self.seeds == entry, -1, self.seeds)], axis=1)
            entry = self._walk(unit, entry, links, max(ef, k, entry.shape[1]) if last else 1)
        score = np.einsum("rd,rcd->rc", q, self.x[entry].astype(np.float64))
        score[entry < 0] = -np.inf
        order = np.lexsort((self.least[entry], -score), axis=1)[:, :k]
        return np.take_along_axis(entry, order, 1), np.take_along_axis(score, order, 1)

    def _walk(self, q: np.ndarray, entry: np.ndarray, links: np.ndarray, ef: int, wide: int = 4) -> np.ndarray:
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), len(self.a) + 1), bool)  # the last column takes the fillers
        best = np.full((len(q), ef), -1, np.int64)
        near = np.full((len(q), ef), -np.inf, np.float32)
        best[:, : entry.shape[1]] = entry
        near[:, : entry.shape[1]] = np.where(entry < 0, -np.inf, np.einsum("rd,rcd->rc", q, self.a[entry]))
        seen[rows, entry] = True
        seen[:, -1] = False
        done = best < 0
        wide = min(wide, ef)
        while True:
            waiting = np.where(done, -np.inf, near)
            active = np.flatnonzero((~done).any(axis=1))
            if not len(active):
                return best
            pick = np.argpartition(-waiting[active], wide - 1, axis=1)[:, :wide]
            r = active[:, None]
            node = np.where(done[r, pick], -1, best[r, pick])
            done[r, pick] = True
            next_ = np.where(node[:, :, None] >= 0, links[node], -1).reshape(len(active), -1)
            next_ = np.sort(next_, axis=1)
            next_[:, 1:][next_[:, 1:] == next_[:, :-1]] = -1
            next_[seen[r, next_]] = -1
            seen[r, next_] = True
            seen[:, -1] = False
            s = np.einsum("rd,rcd->rc", q[active], self.a[next_])
            s[next_ < 0] = -np.inf
            all_, all_near = np.concatenate([best[active], next_], axis=1), np.concatenate([near[active], s], axis=1)
            all_done = np.concatenate([done[active], next_ < 0], axis=1)
            top = np.argpartition(-all_near, ef - 1, axis=1)[:, :ef]
            best[active], near[active], done[active] = (np.take_along_axis(y, top, 1) for y in (all_, all_near, all_done))


def _valid(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Distinct (id, v, dim) of rows that take part."""
    v = F.col("v")
    df = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.col("id").isNotNull() & v.isNotNull()).where(F.coalesce(whole, F.lit(False))).dropDuplicates(["id", "v"]).withColumn("dim", F.size("v"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def build(rows: DataFrame, shards: int, keep: int) -> DataFrame:
    """A row (dim, shard, graph) for each shard."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    nodes = rows.withColumn("rank", rank).where(F.col("rank") <= keep).groupBy("v", "dim").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))

    def make(t: pa.Table) -> pa.Table:
        g = Graph(_matrix(t.column("v")), t.column("ids").to_pylist())
        return pa.table({"dim": t.column("dim").slice(0, 1), "shard": t.column("shard").slice(0, 1), "graph": pa.array([pickle.dumps(g)], pa.binary())})

    # A task builds a shard or two, however little there is.
    return nodes.repartition(2 * shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(make, "dim int, shard int, graph binary")


def _packed(queries: DataFrame) -> DataFrame:
    """(dim, n, ids, vectors): queries of one length in blocks of about PACK_BYTES, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                own = b.filter(pa.array(dims == dim))
                step = max(1, PACK_BYTES // (8 * dim))
                for at in range(0, own.num_rows, step):
                    part = own.slice(at, step)
                    ids, v = part.column(0).to_numpy(), np.ascontiguousarray(_matrix(part.column(1)))
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], names=["dim", "n", "ids", "vectors"])

    return queries.mapInArrow(run, "dim int, n int, ids binary, vectors binary")


def neighbours(
    df: DataFrame, k: int = K, every: int = EVERY, key: str = "vec_id", vector: str = "embedding", ef: int = EF, shards: int = SHARDS, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES, query_bytes: int = QUERY_BYTES
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose key is a multiple of `every`."""
    spark = df.sparkSession
    rows = written(_valid(df, key, vector), "vectors")
    # doubles, floats and links of a node
    of = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(12 * F.col("dim") + 4 + 16 * M), F.lit(0)).alias("bytes")).first()
    shards = max(shards, math.ceil(of.n / shard_rows), math.ceil(of.bytes / shard_bytes))
    graphs = written(build(rows, shards, k + 1), "graphs")
    packed = written(_packed(rows.where(F.pmod("id", F.lit(every)) == 0).select("id", "v", "dim")), "queries")
    found = _searched(spark, graphs, packed, k, ef, query_bytes)
    rank = F.row_number().over(Window.partitionBy("query_id", "print").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(spark: SparkSession, graphs: DataFrame, packed: DataFrame, k: int, ef: int, query_bytes: int) -> DataFrame:
    """The nearest found of each query in each shard. The driver holds one block of queries, of query_bytes or a row of
    packed, at a time."""
    out, block, size = [], [], 0

    def flush() -> None:
        nonlocal block, size
        shared = spark.sparkContext.broadcast(block)  # query_bytes
        block, size = [], 0

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for dim, data in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                    mine = [p for p in shared.value if p[0] == dim]
                    if not mine:
                        continue
                    graph = pickle.loads(data.as_py())  # noqa: S301  written by build
                    for _, ids, vectors in mine:
                        ids, q = np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, dim)
                        for at in range(0, len(ids), BLOCK):
                            yield _found(graph, ids[at : at + BLOCK], q[at : at + BLOCK], k, ef)

        found = graphs.select("dim", "shard", "graph").mapInArrow(search, "query_id bigint, print bigint, vec_id bigint, score double")
        out.append(written(found, "found"))
        shared.destroy()

    for r in packed.toLocalIterator():
        if block and size + len(r.vectors) > query_bytes:
            flush()
        block.append((r.dim, bytes(r.ids), bytes(r.vectors)))
        size += len(r.vectors)
    flush()
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    return whole


def _found(graph: Graph, ids: np.ndarray, q: np.ndarray, k: int, ef: int) -> pa.RecordBatch:
    """Up to k rows of each query, its own id left out. print tells vectors apart that share an id."""
    nodes, scores = graph.search(q, k + 1, ef)
    out: list[tuple[int, int, int, float]] = []
    for i, query in enumerate(ids.tolist()):
        mark = xxhash.xxh64_intdigest(q[i].tobytes()) >> 1
        rows = [(-s, v, s) for node, s in zip(nodes[i].tolist(), scores[i].tolist(), strict=True) if node >= 0 for v in graph.ids[node] if v != query]
        out += [(query, mark, v, s) for _, v, s in sorted(rows)[:k]]
    columns = list(zip(*out, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "print", "vec_id", "score"])


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))

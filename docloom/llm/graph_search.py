"""Nearest neighbours by largest inner product, through robust-pruned directed graphs.

Index. Equal vectors are one node. Nodes are dealt by hash into shards of bounded
size, every node into one. Within a shard the inner product becomes a distance by
one further coordinate, which brings all nodes to the same length. Nodes enter the
graph in batches: a greedy search from the node nearest the middle proposes
neighbours, and relaxed distance pruning keeps a candidate only if no neighbour
kept before is nearer to it by the factor `alpha`; edges back are pruned likewise.
A second pass offers every node what a search over the whole graph finds.

Search. Every query is sent to every shard, where a beam search follows the edges;
each shard gives its nearest, scored in double precision on the original vectors,
and the nearest of all shards are the result. Queries stream through a shard's
task, many at once, so memory depends on the shard's size alone.

Bounds. A shard holds about `most_nodes` nodes at most (shards are even, as nodes
differ and are dealt by hash), in graphs of no more than so many. Of the ids that share a vector only
the k + 1 smallest can be among k nearest, since ties go to the smaller id; they
are found per input partition before any shuffle.

Defined results: vectors that are null, empty, zero or hold a null or non-finite
component are neither indexed nor queries; vectors of different lengths don't
compare; rows with a null id take no part; a repeated id with the same vector is
one candidate, with another vector a candidate of its own, and the same holds for
queries; a query has fewer than k rows only if fewer candidates exist. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, shuffle_parts, stored

#: Edges a node, beams for building and searching, relaxation; nodes that enter at once; the first ones, which compare with each other.
DEGREE, BUILD_BEAM, BEAM, ALPHA, BATCH, SEED = 32, 64, 128, 1.2, 512, 256
#: Nodes of a shard at most and, while there are so few that shuffle partitions would be left, at least; bytes of what a search notes at once.
MOST_NODES, LEAST_NODES, NOTED_BYTES = 16_384, 512, 32 << 20


class Graph:
    """A shard's graph: `edges` has a row of nodes for each node, filled from the left and then with -1; from `entries` all nodes are reached."""

    def __init__(self, vectors: np.ndarray, edges: np.ndarray, entries: np.ndarray):
        self.vectors, self.edges, self.entries = vectors, edges, entries
        self.norms = (vectors * vectors).sum(1)

    def enter_everywhere(self) -> None:
        """Nodes that no path reaches become entries too."""
        met, entries = np.zeros(len(self.vectors), bool), list(self.entries)
        front = self.entries
        while len(front) or not met.all():
            if not len(front):
                front = np.flatnonzero(~met)[:1]
                entries.append(int(front[0]))
            met[front] = True
            to = self.edges[front]
            front = np.unique(to[to >= 0])
            front = front[~met[front]]
        self.entries = np.array(entries, np.int32)

    def search(self, queries: np.ndarray, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, squared distances) of the `beam` nearest that a greedy search meets, by distance; -1 and infinity where there are fewer.

        Queries walk together: at each step each expands its `wide` nearest nodes that it hasn't expanded.
        """
        n, q = len(self.vectors), len(queries)
        if q > 1 and q * n * 4 > NOTED_BYTES:
            half = q // 2
            return tuple(np.concatenate(x) for x in zip(self.search(queries[:half], beam, wide), self.search(queries[half:], beam, wide), strict=True))
        width = min(beam, n)
        nodes, gaps, done = np.full((q, width), -1, np.int32), np.full((q, width), np.inf, np.float32), np.ones((q, width), bool)
        own = (queries * queries).sum(1)
        seen = np.zeros((q, n), np.int32)  # by what a node was met first
        for start in self.entries:
            gap = self.norms[start] - 2 * queries @ self.vectors[start] + own
            last = gaps.argmax(1)
            better = np.flatnonzero(gap < gaps[np.arange(q), last])
            nodes[better, last[better]], gaps[better, last[better]], done[better, last[better]] = start, gap[better], False
        seen[:, self.entries] = 1
        stamp, active = 1, np.arange(q)
        while len(active):
            open_gaps = np.where(done[active], np.inf, gaps[active])
            take = min(wide, width)
            best = np.argpartition(open_gaps, take - 1, axis=1)[:, :take] if take < width else np.broadcast_to(np.arange(width), (len(active), width))
            usable = np.isfinite(np.take_along_axis(open_gaps, best, 1))
            going = usable.any(1)
            active, best, usable = active[going], best[going], usable[going]
            if not len(active):
                break
            from_nodes = np.where(usable, np.take_along_axis(nodes[active], best, 1), -1)
            done[active[:, None], best] = True
            near = np.where((from_nodes >= 0)[:, :, None], self.edges[from_nodes], -1).reshape(len(active), -1)
            fresh = (near >= 0) & (seen[active[:, None], near] == 0)
            rows, places = np.nonzero(fresh)
            who, to = active[rows], near[rows, places]
            ticket = np.arange(stamp + 1, stamp + 1 + len(to), dtype=np.int32)
            seen[who, to] = ticket  # of those that meet a node in the same step the last one stays
            first = seen[who, to] == ticket
            stamp += len(to)
            rows, places, who, to = rows[first], places[first], who[first], to[first]
            found = np.full(near.shape, np.inf, np.float32)
            found[rows, places] = self.norms[to] - 2 * np.einsum("ij,ij->i", queries[who], self.vectors[to]) + own[who]
            all_gaps = np.concatenate([gaps[active], found], 1)
            all_nodes = np.concatenate([nodes[active], near], 1)
            all_done = np.concatenate([done[active], np.zeros(near.shape, bool)], 1)
            keep = np.argpartition(all_gaps, width - 1, axis=1)[:, :width]
            gaps[active], nodes[active], done[active] = (np.take_along_axis(x, keep, 1) for x in (all_gaps, all_nodes, all_done))
            done[active] |= ~np.isfinite(gaps[active])
        order = np.argsort(gaps, axis=1, kind="stable")
        gaps, nodes = np.take_along_axis(gaps, order, 1), np.take_along_axis(nodes, order, 1)
        return np.where(np.isfinite(gaps), nodes, -1), gaps


def prune(vectors: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point the neighbours kept of its candidates (-1: none): the nearest, without those that a kept one is nearer to by alpha."""
    out = np.full((len(points), degree), -1, np.int32)
    chunk = max(1, (8 << 20) // (candidates.shape[1] ** 2 + 1))
    for start in range(0, len(points), chunk):
        p, c = points[start : start + chunk], np.sort(candidates[start : start + chunk], axis=1)
        alive = (c >= 0) & (c != p[:, None])
        alive[:, 1:] &= c[:, 1:] != c[:, :-1]
        x = vectors[c]
        norms = (x * x).sum(2)
        own = norms + (vectors[p] ** 2).sum(1)[:, None] - 2 * np.einsum("ij,ikj->ik", vectors[p], x)
        between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
        rows = np.arange(len(p))
        for k in range(degree):
            left = np.where(alive, own, np.inf)
            pick = left.argmin(1)
            some = alive[rows, pick]
            if not some.any():
                break
            out[start : start + chunk, k] = np.where(some, c[rows, pick], -1)
            alive &= ~((alpha * alpha * between[rows, pick] <= own) & some[:, None])
            alive[rows, pick] = False
    return out


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> Graph:
    """A graph over the rows of `vectors`, which differ from each other."""
    n = len(vectors)
    middle = vectors.mean(0)
    entry = int(((vectors - middle) ** 2).sum(1).argmin())
    graph = Graph(vectors, np.full((n, degree), -1, np.int32), np.array([entry], np.int32))
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([[entry], order[order != entry]]).astype(np.int32)
    first = order[:SEED]
    norms = (vectors[first] ** 2).sum(1)
    distances = norms[:, None] + norms[None] - 2 * vectors[first] @ vectors[first].T
    nearest = first[np.argsort(distances, axis=1)[:, : 2 * beam]]
    _link(graph, first, prune(vectors, first, nearest, degree, alpha), degree, alpha)
    for again in (False, True):
        at = 0 if again else len(first)
        while at < n:
            batch = order[at : at + (BATCH if again else min(BATCH, at))]
            at += len(batch)
            met, _ = graph.search(vectors[batch], beam)
            candidates = np.concatenate([met, graph.edges[batch]], 1)
            _link(graph, batch, prune(vectors, batch, candidates, degree, alpha), degree, alpha)
    graph.enter_everywhere()
    return graph


def _link(graph: Graph, points: np.ndarray, neighbours: np.ndarray, degree: int, alpha: float) -> None:
    """Set the points' edges, and offer the edges back: where they don't fit, a node's edges are pruned anew."""
    graph.edges[points] = neighbours
    rows, places = np.nonzero(neighbours >= 0)
    to, back = neighbours[rows, places], points[rows]
    there = (graph.edges[to] == back[:, None]).any(1)
    to, back = to[~there], back[~there]
    order = np.argsort(to, kind="stable")
    to, back = to[order], back[order]
    nodes, start, count = np.unique(to, return_index=True, return_counts=True)
    has = (graph.edges[nodes] >= 0).sum(1)
    fits = has + count <= degree
    for many in (False, True):
        of = np.nonzero(fits != many)[0]
        if not many:  # edges are filled from the left
            which = np.repeat(of, count[of])
            offset = np.arange(len(which)) - np.repeat(np.cumsum(count[of]) - count[of], count[of])
            graph.edges[nodes[which], has[which] + offset] = back[start[which] + offset]
            continue
        of = of[np.argsort(count[of], kind="stable")]
        for group in np.array_split(of, max(1, len(of) // 256)):
            if len(group):
                candidates = np.full((len(group), degree + count[group].max()), -1, np.int32)
                candidates[:, :degree] = graph.edges[nodes[group]]
                for row, k in enumerate(group):
                    candidates[row, degree : degree + count[k]] = back[start[k] : start[k] + count[k]]
                graph.edges[nodes[group]] = prune(graph.vectors, nodes[group], candidates, degree, alpha)


def level(vectors: np.ndarray) -> np.ndarray:
    """Vectors brought to length 1 by one more coordinate, after division by the greatest length: nearest means largest inner product."""
    x = vectors.astype(np.float64) / np.abs(vectors).max()
    squares = (x * x).sum(1)
    x, squares = x / np.sqrt(squares.max()), squares / squares.max()
    rest = np.where(squares > 1 - 1e-6, 0.0, 1 - squares)
    return np.concatenate([x, np.sqrt(rest)[:, None]], 1).astype(np.float32)


def directions(queries: np.ndarray) -> np.ndarray:
    x = queries.astype(np.float64) / np.abs(queries).max(1, keepdims=True)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    return np.concatenate([x, np.zeros((len(x), 1))], 1).astype(np.float32)


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    kind = "float" if df.schema[vector_col].dataType.elementType.simpleString() == "float" else "double"
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("vec"))
    return rows.where(F.col("id").isNotNull() & usable(F.col("vec")))


def _matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of the lists."""
    at = column.offsets.to_numpy()
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(at)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[(at[rows] - at[0])[:, None] + np.arange(size)]


def _graphs(most_nodes: int, degree: int, beam: int, alpha: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["shard", "nodes", "vectors", "edges", "entries", "ids"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]  # a partition is a shard
        if not batches:
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        ids = table["ids"].combine_chunks()
        for rows, matrix in _matrices(table["vec"].combine_chunks()):
            for start in range(0, len(rows), most_nodes):
                some = rows[start : start + most_nodes]
                part = np.ascontiguousarray(matrix[start : start + most_nodes])
                graph = build(level(part), degree, beam, alpha)
                of = ids.take(pa.array(some))
                listed = pa.ListArray.from_arrays(pa.array([0, len(of)], pa.int32()), of)
                yield pa.RecordBatch.from_arrays(
                    [table["shard"].slice(0, 1).combine_chunks(), pa.array([len(some)], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (part, graph.edges, graph.entries)], listed], names
                )

    return stream


def _searched(k: int, degree: int, beam: int, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, graphs = None, []
        for batch in batches:
            shards, nodes = batch.column("shard").to_pylist(), batch.column("nodes")
            where = np.flatnonzero(np.asarray(nodes.is_valid()))
            for row in where:  # a shard's graphs come before its queries
                if shards[row] != shard:
                    shard, graphs = shards[row], []
                n = nodes[row].as_py()
                vectors, edges, entries = (np.frombuffer(batch.column(c)[row].as_buffer(), t) for c, t in (("vectors", kind), ("edges", np.int32), ("entries", np.int32)))
                vectors = vectors.reshape(n, -1)
                graphs.append((Graph(level(vectors), edges.reshape(n, degree), entries), vectors, batch.column("ids")[row].values))
            asked = np.flatnonzero(~np.asarray(nodes.is_valid()))
            if not len(asked):
                continue
            queries = batch.take(pa.array(asked))
            for rows, matrix in _matrices(queries.column("vec")):
                number = queries.column("query").take(pa.array(rows)).to_numpy()
                for graph, vectors, ids in graphs:
                    if vectors.shape[1] == matrix.shape[1]:
                        yield from _nearest(graph, vectors, ids, number, matrix, k, beam)

    return stream


def _nearest(graph: Graph, vectors: np.ndarray, ids: pa.ListArray, number: np.ndarray, queries: np.ndarray, k: int, beam: int, at_once: int = 512) -> Iterator[pa.RecordBatch]:
    smallest = ids.flatten().take(pa.array(ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()))
    order = np.empty(len(vectors), np.int64)
    order[np.asarray(pa.compute.sort_indices(smallest))] = np.arange(len(vectors))
    for start in range(0, len(queries), at_once):
        q = queries[start : start + at_once].astype(np.float64)
        found, _ = graph.search(directions(q), beam)
        scores = np.where(found >= 0, (vectors[found].astype(np.float64) * q[:, None, :]).sum(2), -np.inf)
        best = np.lexsort((order[found], -scores), axis=1)[:, :k]
        found, scores = np.take_along_axis(found, best, 1), np.take_along_axis(scores, best, 1)
        rows, places = np.nonzero(found >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(number[start + rows]), pa.array(scores[rows, places]), ids.take(pa.array(found[rows, places]))], ["query", "score", "ids"])


class Index:
    """Graphs over all rows of a table of vectors. `keep` bounds the k of searches."""

    def __init__(self, table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: int = 20, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, most_nodes: int = MOST_NODES):
        spark = table.sparkSession
        bound_batches(spark)
        self.keep, self.degree = keep, degree
        rows = _vectors(table, id_col, vector_col).groupBy("vec", "id").agg(F.count(F.lit(1)).alias("copies"))
        rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("vec").orderBy("id"))).where(F.col("nth") <= keep + 1)
        nodes = rows.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
        nodes = stored(nodes, "graph-nodes")
        n = nodes.count()
        self.shards = max(1, min(shuffle_parts(spark), n // LEAST_NODES), -(-n // most_nodes))
        nodes = nodes.withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(self.shards)).cast("int"))
        self._id, self._vec = nodes.schema["ids"].dataType.elementType.simpleString(), nodes.schema["vec"].dataType.elementType.simpleString()
        graphs = nodes.repartitionById(self.shards, F.col("shard")).mapInArrow(_graphs(most_nodes, degree, beam, alpha), f"shard int, nodes int, vectors binary, edges binary, entries binary, ids array<array<{self._id}>>")
        self.graphs = stored(graphs, "graphs")

    def search(self, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, beam: int = BEAM) -> DataFrame:
        """query_id, rank (from 1), vec_id and score (inner product) of the k nearest found for each row of queries; rows with its own id don't count."""
        if k > self.keep:
            raise ValueError(f"the index keeps {self.keep} ids of a vector, so k can't be {k}")
        rows = _vectors(queries, id_col, vector_col).select(F.col("id").alias("query_id"), F.col("vec").cast(f"array<{self._vec}>").alias("vec")).distinct()
        different = stored(rows.groupBy("vec").agg(F.count(F.lit(1)).alias("n")).withColumn("query", F.monotonically_increasing_id()), "graph-queries")
        asked = different.select(F.explode(F.sequence(F.lit(0), F.lit(self.shards - 1))).alias("shard"), "query", "vec")
        both = self.graphs.unionByName(asked, allowMissingColumns=True)
        both = both.repartitionById(self.shards, F.col("shard")).sortWithinPartitions("shard", F.col("nodes").isNull())
        kind = np.float32 if self._vec == "float" else np.float64
        found = both.mapInArrow(_searched(k + 1, self.degree, max(beam, k + 1), kind), f"query long, score double, ids array<{self._id}>")
        first = W.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0])
        found = found.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
        found = found.groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
        pairs = rows.join(different.select(F.col("vec").alias("v"), "query"), F.col("vec") == F.col("v")).select("query_id", "query")
        pairs = pairs.join(found, "query").select("query_id", "query", F.explode("found").alias("x")).select("query_id", "query", "x.score", F.explode("x.ids").alias("vec_id"))
        pairs = pairs.where(F.col("vec_id") != F.col("query_id"))
        rank = F.row_number().over(W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
        return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

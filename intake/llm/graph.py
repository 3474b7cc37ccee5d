"""Approximate nearest neighbours by largest inner product: a robust-pruned directed graph for each shard, and beam searches of every shard.

Equal vectors are one node with its ids. Nodes are dealt to shards by a hash; a task builds the graph of one shard: points are added in batches,
a greedy search of the graph so far proposes neighbours, a relaxed distance rule keeps diverse ones, and edges back are pruned alike.
Inner products become distances by one more coordinate, which brings every vector of a shard to one length. Nodes that the entry doesn't lead to become
entries too, so a shard of no more nodes than the beam is searched whole. Queries are searched in blocks, many of them in step (numpy); scores are in double precision.

The index is written to the shared folder once. A search reads a shard for each block of queries; its cost grows with queries times shards, and a shard holds up to
``SHARD_ROWS`` nodes so that shards stay few.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an id; an empty table gives an empty result.
Vectors of unlike length are never near. Repeated rows count once; of an id with several vectors, as query or as candidate, the best score counts. Ties go to the lesser id.
Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intake.llm.common import cut, list_array

#: Shards at least, nodes of a shard about at most, queries searched in one task.
SHARDS, SHARD_ROWS, QUERY_BLOCK = 8, 1 << 18, 1 << 17
#: Edges of a node, how much nearer a kept neighbour may make another one superfluous, width of the beams, nodes expanded in a step.
DEGREE, RELAXED, BUILD_BEAM, BEAM, EXPAND = 32, 1.2, 96, 160, 4
#: Bytes of visited marks held at once.
MARKS = 1 << 25


def _search(x: np.ndarray, norms: np.ndarray, edges: np.ndarray, entries: np.ndarray, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes on the beam of each query, nearest first, and their squared distances less the query's own norm. ``edges`` and ``norms`` have a last row for no node."""
    none, block = len(edges) - 1, max(1, MARKS // len(edges))
    ids, dist = np.full((len(queries), width), none, np.int32), np.full((len(queries), width), np.inf, np.float32)
    for start in range(0, len(queries), block):
        q = queries[start : start + block]
        ids[start : start + block], dist[start : start + block] = _in_step(x, norms, edges, entries, q, width, none)
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def _in_step(x, norms, edges, entries, q, width, none):
    rows = len(q)
    seen = np.zeros((rows, none + 1), bool)
    seen[:, none] = True
    seen[:, entries] = True
    ids, dist, fresh = np.full((rows, width), none, np.int32), np.full((rows, width), np.inf, np.float32), np.zeros((rows, width), bool)
    for part in range(0, len(entries), width):
        some = entries[part : part + width]
        d = norms[some][None, :] - 2 * (q @ x[some].T)
        ids, dist, fresh = _merge(ids, dist, fresh, np.broadcast_to(some.astype(np.int32), d.shape), d, width)
    act = np.arange(rows)
    while True:
        near = np.where(fresh[act], dist[act], np.inf)
        pick = np.argpartition(near, min(EXPAND, width) - 1, axis=1)[:, :EXPAND]
        open_ = np.isfinite(np.take_along_axis(near, pick, 1))
        going = open_.any(axis=1)
        act, pick, open_ = act[going], pick[going], open_[going]
        if not len(act):
            return ids, dist
        fresh[act[:, None], pick] &= ~open_
        nodes = np.where(open_, ids[act[:, None], pick], none)
        new = np.sort(edges[nodes].reshape(len(act), -1), axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = none
        new[seen[act[:, None], new]] = none
        seen[act[:, None], new] = True
        held = new != none
        new = np.take_along_axis(new, np.argsort(~held, axis=1, kind="stable"), 1)[:, : max(1, held.sum(axis=1).max())]
        d = norms[new] - 2 * np.matmul(x[new], q[act][:, :, None])[:, :, 0]
        ids[act], dist[act], fresh[act] = _merge(ids[act], dist[act], fresh[act], new, d, width)


def _merge(ids, dist, fresh, new, d, width):
    """The best of a beam and new nodes."""
    ids, dist = np.concatenate([ids, new], axis=1), np.concatenate([dist, d], axis=1)
    fresh = np.concatenate([fresh, np.isfinite(d)], axis=1)
    best = np.argpartition(dist, width - 1, axis=1)[:, :width]
    return tuple(np.take_along_axis(v, best, 1) for v in (ids, dist, fresh))


def _prune(x: np.ndarray, norms: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """Up to ``DEGREE`` diverse neighbours of each row's candidates, the nearest first: one goes if a kept one is ``RELAXED`` times nearer to it than the node is."""
    none, rows = len(norms) - 1, np.arange(len(ids))
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    v, n = x[ids], norms[ids]
    gap = n[:, :, None] + n[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    alive, kept = np.isfinite(dist), np.full((len(ids), DEGREE), none, np.int32)
    for k in range(DEGREE):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        kept[some, k] = ids[rows, first][some]
        alive &= RELAXED * RELAXED * gap[rows, first] > dist
        alive[rows, first] = False
    return kept


def _distances(x: np.ndarray, norms: np.ndarray, of: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of nodes from each row's candidates; those that are no node, the node itself or repeated are infinitely far."""
    d = norms[of][:, None] + norms[ids] - 2 * np.matmul(x[ids], x[of][:, :, None])[:, :, 0]
    order = np.argsort(ids, axis=1, kind="stable")
    inner = np.take_along_axis(ids, order, 1)
    again = np.zeros_like(inner, bool)
    np.put_along_axis(again, order, np.concatenate([np.zeros((len(ids), 1), bool), inner[:, 1:] == inner[:, :-1]], axis=1), 1)
    return np.where(again | (ids == len(norms) - 1) | (ids == of[:, None]), np.inf, np.maximum(d, 0)).astype(np.float32)


def _lengthened(vectors: np.ndarray) -> np.ndarray:
    """Vectors brought to one length of 1 by one more coordinate: the nearest are then those of the largest inner product. The last row is no node."""
    norms = np.linalg.norm(vectors.astype(np.float64), axis=1)
    scaled = vectors / (norms.max() or 1)
    more = np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(axis=1, keepdims=True)))
    return np.concatenate([np.concatenate([scaled, more], axis=1), np.zeros((1, vectors.shape[1] + 1))]).astype(np.float32)


def build_graph(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (rows padded with the number of nodes) and entries of a graph over distinct vectors."""
    count = len(vectors)
    x = _lengthened(vectors)
    norms = np.append((x[:-1] * x[:-1]).sum(axis=1), np.inf).astype(np.float32)
    edges = np.full((count + 1, DEGREE), count, np.int32)
    order = np.random.default_rng(7).permutation(count)
    middle = int(np.argmin(norms[:-1] - 2 * (x[:-1] @ x[:-1].mean(axis=0))))
    order = np.concatenate([[middle], order[order != middle]])
    first = order[: 2 * DEGREE]
    _link(x, norms, edges, first, np.broadcast_to(first.astype(np.int32), (len(first), len(first))))
    done = len(first)
    while done < count:
        batch = order[done : done + max(DEGREE, min(2048, done // 4))]
        found, _ = _search(x, norms, edges, np.array([middle]), x[batch], BUILD_BEAM)
        _link(x, norms, edges, batch, found)
        done += len(batch)
    return edges[:-1], _entries(edges, middle)


def _link(x, norms, edges, nodes, found) -> None:
    """Gives nodes their pruned neighbours among those found, and those an edge back."""
    none = len(edges) - 1
    for start in range(0, len(nodes), 256):
        some, ids = nodes[start : start + 256], found[start : start + 256]
        edges[some] = _prune(x, norms, ids, _distances(x, norms, some, ids))
    own = edges[nodes]
    back, to = own[own != none], np.repeat(nodes, (own != none).sum(axis=1)).astype(np.int32)
    order = np.lexsort((norms[back] + norms[to] - 2 * np.einsum("ij,ij->i", x[back], x[to]), back))
    back, to = back[order], to[order]
    starts = np.flatnonzero(np.append(True, back[1:] != back[:-1])) if len(back) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(back)))
    for start in range(0, len(starts), 256):
        s, n = starts[start : start + 256], sizes[start : start + 256]
        more = np.full((len(s), n.max()), none, np.int32)
        inside = np.arange(n.max())[None, :] < n[:, None]
        more[inside] = to[np.repeat(s, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))]
        for part in range(0, more.shape[1], 2 * DEGREE):  # many edges back to one node are pruned in turn
            ids = np.concatenate([edges[back[s]], more[:, part : part + 2 * DEGREE]], axis=1)
            d = _distances(x, norms, back[s], ids)
            full = np.isfinite(d).sum(axis=1) > DEGREE
            fits = np.take_along_axis(np.where(np.isfinite(d), ids, none), np.argsort(d, axis=1, kind="stable")[:, :DEGREE], 1)
            if full.any():
                fits[full] = _prune(x, norms, ids[full], d[full])
            edges[back[s]] = fits


def _entries(edges: np.ndarray, middle: int) -> np.ndarray:
    """The middle node, and one more for each part of the graph that it doesn't lead to."""
    count, entries = len(edges) - 1, [middle]
    reached = np.zeros(count + 1, bool)
    reached[count], at, rest = True, np.array([middle]), 0
    while True:
        while len(at):
            reached[at] = True
            at = np.unique(edges[at])
            at = at[~reached[at]]
        while rest < count and reached[rest]:
            rest += 1
        if rest == count:
            return np.array(entries)
        entries.append(rest)
        at = np.array([rest])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _plain(column: pa.ChunkedArray) -> pa.ListArray:
    """A list column whose type says nothing of nulls."""
    lists = column.combine_chunks()
    return pa.ListArray.from_arrays(lists.offsets, lists.values)


INDEX = "dim int, shard int, ids array<long>, vector array<double>, edges array<int>, entry boolean"


def _build(part: pa.Table) -> pa.Table:
    vectors = _matrix(part.column("vector"))
    edges, entries = build_graph(vectors)
    entry = np.zeros(len(edges), bool)
    entry[entries] = True
    node = np.arange(len(edges), dtype=np.int32)
    made = {"dim": part.column("dim"), "shard": part.column("shard"), "ids": _plain(part.column("ids")), "vector": _plain(part.column("vector")), "edges": list_array(edges.ravel(), np.full(len(edges), DEGREE), pa.int32()), "entry": pa.array(entry)}
    return pa.table(made | {"node": pa.array(node)})


def usable(vec_id: Column, vector: Column) -> Column:
    """Whether a row takes part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec_id.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors_of(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The rows that take part, as vec_id, dim, vector (double)."""
    v = F.col(vector).cast("array<double>")
    return table.where(usable(F.col(vec_id), v)).select(F.col(vec_id).cast("long").alias("vec_id"), F.size(vector).alias("dim"), v.alias("vector"))


def index(vectors: DataFrame, k: int = 20) -> DataFrame:
    """The graph of every shard, a row for each distinct vector. Of a vector's ids, the ``k`` + 1 least can be among the ``k`` nearest of a query."""
    least = Window.partitionBy("dim", "vector").orderBy("vec_id")
    ids = vectors.distinct().withColumn("_r", F.row_number().over(least)).where(F.col("_r") <= k + 1)
    nodes = cut(ids.groupBy("dim", "vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    sizes = nodes.groupBy("dim").agg(F.greatest(F.lit(SHARDS), F.ceil(F.count("*") / SHARD_ROWS)).cast("int").alias("shards"))
    dealt = nodes.join(F.broadcast(sizes), "dim").select("dim", F.pmod(F.xxhash64("vector"), F.col("shards")).cast("int").alias("shard"), "ids", "vector")
    return cut(dealt.groupBy("dim", "shard").applyInArrow(_build, f"{INDEX}, node int"))


FOUND = "query_id long, vec_id long, score double"


def _searcher(k: int, beam: int):
    def run(shard: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not shard.num_rows or not queries.num_rows:
            return empty
        shard = shard.sort_by("node")
        vectors, edges = _matrix(shard.column("vector")), _matrix(shard.column("edges"))
        entries = np.flatnonzero(shard.column("entry").to_numpy(zero_copy_only=False))
        x = _lengthened(vectors)
        norms = np.append((x[:-1] * x[:-1]).sum(axis=1), np.inf).astype(np.float32)
        edges = np.concatenate([edges, np.full((1, edges.shape[1]), len(edges), edges.dtype)])
        lists = shard.column("ids").combine_chunks()
        offsets, ids = lists.offsets.to_numpy(), lists.values.to_numpy()
        query_ids, q = queries.column("query_id").to_numpy(), _matrix(queries.column("query"))
        parts = []
        for start in range(0, len(q), 1024):
            some, own = q[start : start + 1024], query_ids[start : start + 1024]
            unit = some / np.linalg.norm(some, axis=1, keepdims=True)
            found, _ = _search(x, norms, edges, entries, np.concatenate([unit, np.zeros((len(some), 1))], axis=1).astype(np.float32), max(beam, k + 1))
            row, at = np.nonzero(found < len(vectors))
            node = found[row, at]
            score = np.einsum("ij,ij->i", some[row], vectors[node])
            n = offsets[node + 1] - offsets[node]
            row, score, vec = np.repeat(row, n), np.repeat(score, n), ids[np.repeat(offsets[node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            other = vec != own[row]
            row, score, vec = row[other], score[other], vec[other]
            order = np.lexsort((vec, -score, row))
            row, score, vec = row[order], score[order], vec[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            parts.append((own[row[place < k]], vec[place < k], score[place < k]))
        return pa.table({name: pa.array(np.concatenate([p[i] for p in parts])) for i, name in enumerate(empty.column_names)})

    return run


def search(shards: DataFrame, queries: DataFrame, k: int = 20, beam: int = BEAM) -> DataFrame:
    """The ``k`` nearest other vectors found for each query (vec_id, dim, vector): query_id, rank, vec_id, score."""
    queries = cut(queries.select(F.col("vec_id").alias("query_id"), "dim", F.col("vector").alias("query")).distinct())
    blocks = -(-queries.count() // QUERY_BLOCK) or 1
    all_shards = shards.select(F.col("dim").alias("of"), F.col("shard").alias("to")).distinct()
    asked = queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).join(all_shards, F.col("dim") == F.col("of")).select("of", "to", "part", "query_id", "query")
    held = shards.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = held.groupBy("dim", "shard", "block").cogroup(asked.groupBy("of", "to", "part")).applyInArrow(_searcher(k, beam), FOUND)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

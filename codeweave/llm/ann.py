"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard (Vamana, Subramanya et al. 2019).

Rows are dealt to shards by a hash of vec_id: at least MIN_SHARDS, each of about SHARD_ROWS rows, so a graph fits in
one task. In a shard, equal vectors become one node with the least K + 1 of their ids, more of which can't be asked for.
The graph is grown in batches of doubling size: greedy searches from the medoid propose neighbours, pruning keeps one
only if no nearer kept neighbour is ALPHA times closer to it, and reverse edges are pruned alike. Each graph is sent once
for BLOCK_QUERIES queries, which stream past it in Arrow batches and are searched with a beam; the best K over all
shards are ranked.

Graphs join directions: they are built on vectors of length 1. Beams follow their edges ranked by inner product, from the medoid and
the STARTS longest vectors, so a long vector is found from any of its direction's neighbours. Both work in single precision, beams on
vectors divided by the shard's largest component, so none is too large for it. What they find is scored on the original
vectors, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, materialise

K, EVERY = 20, 20
DEGREE, BEAM, ALPHA = 32, 64, 1.2
SEARCH_BEAM, STARTS = 192, 16
MIN_SHARDS, SHARD_ROWS, BLOCK_QUERIES = 12, 20_000, 100_000
TOGETHER = 512
#: Different vector lengths whose counts may be broadcast.
MAX_LENGTHS = 100_000


def beam_search(points: np.ndarray, graph: np.ndarray, start: int | np.ndarray, queries: np.ndarray, beam: int, inner: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, squared distances) of the `beam` nearest that a greedy search of each query finds, nearest first; -1 where fewer.

    graph: neighbours of each node, -1 for none; start: the node or nodes to begin with. inner: nearest by inner product, its
    negative double stands for the distance. All queries step together: each expands its nearest node not yet expanded.
    """
    q, n = len(queries), len(points)
    start = np.atleast_1d(start)[:beam]
    norms = np.zeros(n, dtype=points.dtype) if inner else np.einsum("ij,ij->i", points, points)
    own = np.zeros(q, dtype=points.dtype) if inner else np.einsum("ij,ij->i", queries, queries)
    nodes = np.full((q, beam), -1, dtype=np.int64)
    dist = np.full((q, beam), np.inf, dtype=np.float32)
    open_ = np.zeros((q, beam), dtype=bool)
    nodes[:, : len(start)], open_[:, : len(start)] = start, True
    dist[:, : len(start)] = norms[start] - 2 * queries @ points[start].T + own[:, None]
    seen = np.zeros((q, n), dtype=bool)
    seen[:, start] = True
    live = np.arange(q)
    while len(live):
        front = np.where(open_[live], dist[live], np.inf)
        best = front.argmin(axis=1)
        more = np.isfinite(front[np.arange(len(live)), best])
        live, best = live[more], best[more]
        if not len(live):
            break
        open_[live, best] = False
        near = graph[nodes[live, best]]
        fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        safe = np.maximum(near, 0)
        rows = np.broadcast_to(live[:, None], near.shape)
        seen[rows[fresh], near[fresh]] = True
        d = norms[safe] - 2 * np.einsum("qd,qrd->qr", queries[live], points[safe]) + own[live][:, None]
        d = np.where(fresh, d, np.inf).astype(np.float32)
        all_d = np.concatenate([dist[live], d], axis=1)
        all_n = np.concatenate([nodes[live], np.where(fresh, near, -1)], axis=1)
        all_o = np.concatenate([open_[live], fresh], axis=1)
        order = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        dist[live], nodes[live] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_n, order, 1)
        open_[live] = np.take_along_axis(all_o, order, 1)
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(dist, order, 1)


def robust_prune(points: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node of `of`, up to `degree` of its candidates (-1 for none), nearest first, dropping those that a kept one covers."""
    if len(of) > TOGETHER:
        return np.concatenate([robust_prune(points, of[at : at + TOGETHER], candidates[at : at + TOGETHER], degree, alpha) for at in range(0, len(of), TOGETHER)])
    norms = np.einsum("ij,ij->i", points, points)
    safe = np.maximum(candidates, 0)
    d = norms[safe] - 2 * np.einsum("qd,qcd->qc", points[of], points[safe]) + norms[of][:, None]
    d = np.where((candidates < 0) | (candidates == of[:, None]), np.inf, np.maximum(d, 0))
    order = np.argsort(d, axis=1, kind="stable")
    candidates, d = np.take_along_axis(candidates, order, 1), np.take_along_axis(d, order, 1)
    again = np.zeros_like(d, dtype=bool)
    again[:, 1:] = (candidates[:, 1:] == candidates[:, :-1])
    d[again] = np.inf
    vectors = points[np.maximum(candidates, 0)]
    out = np.full((len(of), degree), -1, dtype=np.int64)
    alive, rows = np.isfinite(d), np.arange(len(of))
    for k in range(degree):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        out[some, k] = candidates[rows[some], first[some]]
        chosen = vectors[rows, first]
        between = np.einsum("qcd,qcd->qc", vectors, vectors) - 2 * np.einsum("qcd,qd->qc", vectors, chosen) + np.einsum("qd,qd->q", chosen, chosen)[:, None]
        alive &= alpha * alpha * between > d
        alive[rows, first] = False
        alive[~some] = False
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """(graph, start): nodes join in batches of doubling size, searched for in the graph of those before."""
    n = len(points)
    graph = np.full((n, degree), -1, dtype=np.int64)
    start = int(np.argmin(np.einsum("ij,ij->i", points - points.mean(axis=0), points - points.mean(axis=0)))) if n else 0
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([[start], order[order != start]]) if n else order
    done = 1
    while done < n:
        batch = order[done : done + min(done, TOGETHER)]
        found, _ = beam_search(points, graph, start, points[batch], beam)
        graph[batch] = robust_prune(points, batch, found, degree, alpha)
        # reverse edges: each neighbour is offered its new friends, and pruned if it has too many
        source, target = np.repeat(batch, degree), graph[batch].reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        touched, first, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, count)
        owner = np.repeat(np.arange(len(touched)), count)
        # of many new friends, so many at a time; what a pass keeps meets the next ones
        for at in range(0, int(count.max(initial=0)), 4 * degree):
            now = np.flatnonzero(count > at)
            offered = np.full((len(touched), min(4 * degree, int(count.max()) - at)), -1, dtype=np.int64)
            fits = (place >= at) & (place < at + offered.shape[1])
            offered[owner[fits], place[fits] - at] = source[fits]
            graph[touched[now]] = robust_prune(points, touched[now], np.concatenate([graph[touched[now]], offered[now]], axis=1), degree, alpha)
        done += len(batch)
    return graph, start


def _shard_rows(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """One row: the shard's distinct vectors, their ids, and the graph, as bytes."""
    rows = rows.sort_values("vec_id", ignore_index=True)
    unique, inverse = np.unique(np.stack(rows["embedding"].to_numpy()).astype(np.float64), axis=0, return_inverse=True)
    inverse = inverse.reshape(-1)
    by = np.argsort(inverse, kind="stable")
    place = np.arange(len(by)) - np.searchsorted(inverse[by], inverse[by])
    by, place = by[place <= k], place[place <= k]
    scaled = (unique / np.abs(unique).max()).astype(np.float32)
    unit = unique / np.abs(unique).max(axis=1, keepdims=True)
    norms = np.sqrt(np.einsum("ij,ij->i", unit, unit))
    graph, start = build_graph((unit / norms[:, None]).astype(np.float32))
    longest = np.argsort(-norms * (np.abs(unique).max(axis=1) / np.abs(unique).max()), kind="stable")[:STARTS]
    starts = np.append(start, longest[longest != start])
    ids = rows["vec_id"].to_numpy()[by]
    return pd.DataFrame({
        "dim": [unique.shape[1]], "shard": [int(rows["shard"].iloc[0])], "starts": [starts.astype(np.int64).tobytes()], "vectors": [unique.tobytes()], "points": [scaled.tobytes()],
        "graph": [graph.astype(np.int32).tobytes()], "ids": [ids.astype(np.int64).tobytes()], "owner": [inverse[by].astype(np.int64).tobytes()],
    })


class _Shard:
    """A shard's graph as it comes out of its row."""

    def __init__(self, row: dict):
        dim = row["dim"]
        self.key, self.starts = (dim, row["shard"]), np.frombuffer(row["starts"], dtype=np.int64)
        self.vectors = np.frombuffer(row["vectors"], dtype=np.float64).reshape(-1, dim)
        self.points = np.frombuffer(row["points"], dtype=np.float32).reshape(-1, dim)
        self.graph = np.frombuffer(row["graph"], dtype=np.int32).reshape(len(self.points), -1).astype(np.int64)
        self.ids, owner = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["owner"], dtype=np.int64)
        self.first = np.searchsorted(owner, np.arange(len(self.points) + 1))

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vec_id, score) of the k best for each query, whose own ids take no part."""
        # a query's direction alone orders inner products
        q = (queries / np.abs(queries).max(axis=1, keepdims=True)).astype(np.float32)
        nodes, _ = beam_search(self.points, self.graph, self.starts, q, beam, inner=True)
        who, at = np.nonzero(nodes >= 0)
        node = nodes[who, at]
        score = np.einsum("ij,ij->i", queries[who], self.vectors[node])
        size = self.first[node + 1] - self.first[node]
        ids = self.ids[np.repeat(self.first[node] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        who, score = np.repeat(who, size), np.repeat(score, size)
        other = ids != own[who]
        who, ids, score = who[other], ids[other], score[other]
        by = np.lexsort((ids, -score, who))
        who, ids, score = who[by], ids[by], score[by]
        top = np.arange(len(who)) - np.searchsorted(who, who) < k
        return own[who[top]], ids[top], score[top]


def _search_batches(k: int, beam: int):
    """Rows of a shard's graph, then of queries for it, to the k best of the shard for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            is_graph = batch.column("is_query").to_numpy() == 0
            keys = np.stack([batch.column("dim").to_numpy(), batch.column("shard").to_numpy()], axis=1)
            cuts = np.flatnonzero(is_graph | np.append(True, (keys[1:] != keys[:-1]).any(axis=1)) if len(batch) else [])
            for a, b in zip(cuts, np.append(cuts[1:], len(batch)), strict=True):
                if is_graph[a]:
                    shard, a = _Shard(batch.slice(a, 1).to_pylist()[0]), a + 1
                if a == b or shard is None or shard.key != tuple(keys[a]):
                    continue  # a shard without rows
                for at in range(a, b, TOGETHER):
                    part = batch.slice(at, min(TOGETHER, b - at))
                    vectors = part.column("embedding").flatten().to_numpy().reshape(len(part), -1)
                    found = shard.search(part.column("vec_id").to_numpy(), vectors, k, beam)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    return run


GRAPH = "dim int, shard int, starts binary, vectors binary, points binary, graph binary, ids binary, owner binary"


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, beam: int = SEARCH_BEAM, min_shards: int = MIN_SHARDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found for each row whose vec_id is divisible by `every`, its own row apart.

    Vectors that are null, zero, empty, or hold null or non-finite components take no part, nor do rows with a null vec_id.
    A vector meets vectors of its own length only. Repeated rows of a vec_id count once, with the first vector in
    order. Ties go to the smaller vec_id. A table of fewer rows gives all candidates; an empty one none. Other columns
    are ignored.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.filter("vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0)")
    one = materialise(v.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding")), "ann-rows")
    sizes = one.groupBy("dim").agg(F.greatest(F.lit(min_shards), F.ceil(F.count("*") / shard_rows)).cast("int").alias("shards"), F.ceil(F.count("*") / (every * BLOCK_QUERIES)).cast("int").alias("blocks"))
    sizes = materialise(sizes, "ann-sizes")
    one = one.join(bounded_broadcast(sizes, MAX_LENGTHS), "dim")
    rows = one.select("dim", F.pmod(F.xxhash64("vec_id"), "shards").cast("int").alias("shard"), "vec_id", "embedding")
    graphs = materialise(rows.groupBy("dim", "shard").applyInPandas(lambda r: _shard_rows(r, k), GRAPH), "ann-graphs")
    sent = graphs.join(bounded_broadcast(sizes.select("dim", "blocks"), MAX_LENGTHS), "dim").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks")
    asked = one.filter(F.col("vec_id") % every == 0).select("dim", F.explode(F.expr("sequence(0, shards - 1)")).alias("shard"), F.pmod(F.xxhash64("vec_id", F.lit(7)), "blocks").cast("int").alias("block"), "vec_id", "embedding")
    both = sent.withColumn("is_query", F.lit(0)).unionByName(asked.withColumn("is_query", F.lit(1)), allowMissingColumns=True)
    lined = both.repartition("dim", "shard", "block").sortWithinPartitions("dim", "shard", "block", "is_query")
    found = lined.mapInArrow(_search_batches(k, beam), "query_id long, vec_id long, score double")
    ranked = found.selectExpr("query_id", "cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank", "vec_id", "score")
    return ranked.filter(F.col("rank") <= k)

"""Approximate nearest neighbours by inner product over robust-pruned directed graphs.

Distinct vectors of one length are dealt to shards by norm, in bands of ratio ``band``, and within a
band by hash; a shard has about ``shard_rows`` vectors and ``shard_bytes`` bytes at most, and a graph of
its own over the vectors' directions. Norms in a shard being close, a query's largest inner products are
among its nearest directions, whatever the norms of the table. Nodes are inserted in batches: a greedy
beam search from the shard's middle proposes neighbours; robust pruning keeps, nearest first, those that
no kept one is closer to by the factor ``alpha``; links back are added and pruned alike. A query searches
every shard's graph with a beam; the shards' finds, scored in double precision on the original vectors,
are merged.

Equal vectors are one node with its k + 1 least ids, which is all that a result can hold of them, so
a very common vector is neither a hub nor a large group. A shard's graph is read once and the blocks of
queries stream past it.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; a
query is answered among the vectors of its own length, as others have no inner product with it; ids
must not be null; rows that repeat an id and vector count once; ties go to the smaller id; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, cut, parts

DEGREE = 24
SLACK = 64
BATCH = 1024
EXPAND = 4


def directions(x: np.ndarray) -> np.ndarray:
    """Vectors brought to norm one, as float32; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return np.ascontiguousarray(x / np.sqrt((x * x).sum(axis=1, keepdims=True)), np.float32)


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances (up to a constant per query) of the ``beam`` nearest found, nearest first; -1 where fewer."""
    b, n = len(q), len(x)
    ids = np.full((b, beam), -1, np.int64)
    dist = np.full((b, beam), np.inf, np.float32)
    done = np.ones((b, beam), bool)
    seen = np.zeros((b, n), bool)
    ids[:, 0], done[:, 0], seen[:, entry] = entry, False, True
    dist[:, 0] = -2 * (q @ x[entry]) + 1
    live = np.arange(b)
    while len(live):
        own_done = done[live]
        turn = np.cumsum(~own_done, axis=1)
        take = ~own_done & (turn <= EXPAND)
        row, col = np.nonzero(take)
        done[live[row], col] = True
        hops = np.full((len(live), EXPAND), -1, np.int64)
        hops[row, turn[row, col] - 1] = ids[live[row], col]
        near = np.where(hops[:, :, None] >= 0, graph[hops], -1).reshape(len(live), -1)
        near.sort(axis=1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        fresh &= ~seen[live[:, None], near]
        row, col = np.nonzero(fresh)
        seen[live[row], near[row, col]] = True
        d = np.full(near.shape, np.inf, np.float32)
        flat = near[row, col]
        d[row, col] = 1 - 2 * np.einsum("ij,ij->i", x[flat], q[live[row]])
        all_ids, all_d = np.hstack([ids[live], near]), np.hstack([dist[live], d])
        all_done = np.hstack([done[live], ~fresh])
        best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(all_d, best, 1), axis=1, kind="stable"), 1)
        dist[live] = np.take_along_axis(all_d, best, 1)
        ids[live] = np.where(np.isfinite(dist[live]), np.take_along_axis(all_ids, best, 1), -1)
        done[live] = np.take_along_axis(all_done, best, 1) | ~np.isfinite(dist[live])
        live = live[~done[live].all(axis=1)]
    return ids, dist


def robust_prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, alpha: float) -> np.ndarray:
    """For each node its up to ``DEGREE`` diverse neighbours among the candidates (-1: none)."""
    out = np.full((len(nodes), SLACK), -1, np.int64)
    cand = np.sort(cand, axis=1)
    bad = (cand < 0) | (cand == nodes[:, None])
    bad[:, 1:] |= cand[:, 1:] == cand[:, :-1]
    xc = x[cand]
    to_node = 2 - 2 * np.einsum("ijk,ik->ij", xc, x[nodes])
    to_node[bad] = np.inf
    order = np.argsort(to_node, axis=1, kind="stable")
    cand, to_node = np.take_along_axis(cand, order, 1), np.take_along_axis(to_node, order, 1)
    xc = np.take_along_axis(xc, order[:, :, None], 1)
    between = 2 - 2 * np.matmul(xc, xc.transpose(0, 2, 1))
    alive, rows = np.isfinite(to_node), np.arange(len(nodes))
    for k in range(DEGREE):
        pick = alive.argmax(axis=1)
        got = alive[rows, pick]
        if not got.any():
            break
        out[got, k] = cand[got, pick[got]]
        alive &= ~(got[:, None] & (alpha * alpha * between[rows, pick] <= to_node))
        alive[rows, pick] = False
    return out


def _link_back(x: np.ndarray, graph: np.ndarray, nodes: np.ndarray, alpha: float) -> None:
    src = np.repeat(nodes, SLACK)
    dst = graph[nodes].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    keep = ~(graph[dst] == src[:, None]).any(axis=1)
    src, dst = src[keep], dst[keep]
    if not len(src):
        return
    near = -np.einsum("ij,ij->i", x[src], x[dst])
    order = np.lexsort((near, dst))
    src, dst = src[order], dst[order]
    to, start, count = np.unique(dst, return_index=True, return_counts=True)
    place = np.arange(len(dst)) - np.repeat(start, count)
    more = np.full((len(to), SLACK), -1, np.int64)
    ok = place < SLACK
    more[np.repeat(np.arange(len(to)), count)[ok], place[ok]] = src[ok]
    both = np.hstack([graph[to], more])
    full = (both >= 0).sum(axis=1) > SLACK
    packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :SLACK]
    graph[to[~full]] = packed[~full]
    for i in range(0, int(full.sum()), BATCH):
        some = np.flatnonzero(full)[i : i + BATCH]
        graph[to[some]] = robust_prune(x, to[some], both[some], alpha)


def build_graph(x: np.ndarray, beam: int = 64, alpha: float = 1.2, seed: int = 1) -> tuple[np.ndarray, int]:
    """(neighbours n x SLACK with -1 for none, entry) over directions, from random links."""
    rng, n = np.random.default_rng(seed), len(x)
    graph = np.full((n, SLACK), -1, np.int64)
    if n > 1:
        graph[:, : min(DEGREE, 2 * n) // 2] = rng.integers(0, n, (n, min(DEGREE, 2 * n) // 2))
    entry = int(np.argmax(x @ x.mean(axis=0)))
    if n <= 2:
        graph[:, :] = -1
        graph[:, 0] = np.arange(n)[::-1]
        return graph, entry
    order = rng.permutation(n)
    for i in range(0, n, BATCH):
        nodes = order[i : i + BATCH]
        found, _ = beam_search(x, graph, entry, x[nodes], beam)
        graph[nodes] = robust_prune(x, nodes, np.hstack([found, graph[nodes]]), alpha)
        _link_back(x, graph, nodes, alpha)
    return graph, entry


SHARD = "shard string, kind int, block int, n int, entry int, vectors binary, links binary, ids binary, id_counts binary"


def _index(beam: int, alpha: float):
    def index(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("least")
        x = np.array(f["embedding"].tolist(), np.float64)
        graph, entry = build_graph(directions(x), beam, alpha)
        lengths = np.array([len(i) for i in f["ids"]], "<i4")
        return pd.DataFrame({
            "shard": f["shard"].iloc[:1].to_numpy(), "kind": [0], "block": [0], "n": [len(x)], "entry": [entry], "vectors": [x.tobytes()], "links": [graph.astype("<i4").tobytes()],
            "ids": [np.concatenate([np.asarray(i, np.int64) for i in f["ids"]]).tobytes()], "id_counts": [lengths.tobytes()],
        })

    return index


def _block(f: pd.DataFrame) -> pd.DataFrame:
    """A block of queries as one row."""
    return pd.DataFrame({"dim": f["dim"].iloc[:1].to_numpy(), "block": f["block"].iloc[:1].to_numpy(), "n": [len(f)], "vectors": [np.array(f["embedding"].tolist(), np.float64).tobytes()], "ids": [f["query_id"].to_numpy(np.int64).tobytes()]})


class _Shard:
    def __init__(self, n: int, entry: int, vectors: bytes, links: bytes, ids: bytes, counts: bytes):
        self.n, self.entry = n, entry
        self.x = np.frombuffer(vectors, np.float64).reshape(n, -1)
        self.low = directions(self.x)
        self.graph = np.frombuffer(links, "<i4").reshape(n, SLACK).astype(np.int64)
        self.ids, self.counts = np.frombuffer(ids, np.int64), np.frombuffer(counts, "<i4").astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)[:-1]])

    def nearest(self, own: np.ndarray, queries: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query ids, ids found, scores): up to k of each query."""
        if self.n <= beam:
            found = np.tile(np.arange(self.n), (len(own), 1))
        else:
            found, _ = beam_search(self.low, self.graph, self.entry, directions(queries), beam)
        q, c = np.nonzero(found >= 0)
        node = found[q, c]
        score = (self.x[node] * queries[q]).sum(axis=1)
        times = self.counts[node]
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        vec, q, score = self.ids[np.repeat(self.first[node], times) + step], np.repeat(q, times), np.repeat(score, times)
        other = vec != own[q]
        vec, q, score = vec[other], q[other], score[other]
        order = np.lexsort((vec, -score, q))
        vec, q, score = vec[order], q[order], score[order]
        start = np.searchsorted(q, q)  # where each row's query begins
        top = np.arange(len(q)) - start < k
        return own[q[top]], vec[top], score[top]


def _search(k: int, beam: int):
    def search(record_batches):
        shard = None
        for f in record_batches:
            for i in range(f.num_rows):
                at = lambda c: f.column(c)[i].as_py()  # noqa: B023, E731
                if at("kind") == 0:
                    shard = _Shard(at("n"), at("entry"), at("vectors"), at("links"), at("ids"), at("id_counts"))
                    continue
                own, queries = np.frombuffer(at("ids"), np.int64), np.frombuffer(at("vectors"), np.float64).reshape(at("n"), -1)
                for j in range(0, len(own), 256):
                    got = shard.nearest(own[j : j + 256], queries[j : j + 256], k, beam)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], ["query_id", "vec_id", "score"])

    return search


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, beam: int = 256, build_beam: int = 64, alpha: float = 1.2, band: float = 1.2, shard_rows: int = 16384, shard_bytes: int = 1 << 28, block: int = 1024
) -> DataFrame:
    """The ``k`` nearest of ``vectors`` (vec_id, embedding) found for each of ``queries`` (vec_id, embedding): query_id, rank, vec_id, score."""
    spark = vectors.sparkSession

    def valid(df: DataFrame) -> DataFrame:
        e = F.col("embedding").cast("array<double>")
        fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(e, lambda v: v != 0)
        return df.select(F.col("vec_id").cast("long"), e.alias("embedding")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))

    # a rank within equal vectors is cut off before the shuffle, so a common vector's rows don't travel
    w = Window.partitionBy("embedding").orderBy("vec_id")
    nodes = valid(vectors).withColumn("r", F.dense_rank().over(w)).where(F.col("r") <= k + 1)
    nodes = nodes.groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    top = F.aggregate("embedding", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v)))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + (v / F.col("top")) * (v / F.col("top")))
    nodes = nodes.withColumn("top", top).withColumn("norm", F.log("top") + F.log(square) / 2)
    nodes = cut(nodes.select("embedding", "ids", F.size("embedding").alias("dim"), F.floor(F.col("norm") / math.log(band)).cast("int").alias("band")), "nodes")
    most = F.greatest(F.lit(1), F.least(F.lit(shard_rows), F.floor(F.lit(shard_bytes) / (8 * F.col("dim") + 4 * SLACK))))
    shards = nodes.groupBy("dim", "band").agg(F.count("*").alias("n")).select("dim", "band", F.ceil(F.col("n") / most).cast("long").alias("of"))
    nodes = nodes.join(shards, ["dim", "band"]).select("embedding", "ids", F.element_at("ids", 1).alias("least"), F.concat_ws(":", "dim", "band", F.pmod(F.xxhash64("embedding"), F.col("of"))).alias("shard"))
    index = cut(nodes.groupBy("shard").applyInPandas(_index(build_beam, alpha), SHARD), "graphs")

    q = cut(valid(queries).distinct().select(F.col("vec_id").alias("query_id"), "embedding", F.size("embedding").alias("dim")), "queries")
    blocks = max(1, -(-q.count() // block))
    q = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).groupBy("dim", "block").applyInPandas(_block, "dim int, block int, n int, vectors binary, ids binary")
    # a small table of its own, so that the planner knows its size; otherwise a skewed join splits the blocks of a length
    places = cut(index.select("shard", F.split("shard", ":")[0].cast("int").alias("dim")), "places")
    asked = cut(q, "blocks").join(places, "dim").select("shard", F.lit(1).alias("kind"), "block", "n", "vectors", "ids")
    batches(spark, 8)  # rows are blocks and shards
    stream = index.unionByName(asked, allowMissingColumns=True).repartition(parts(spark), "shard").sortWithinPartitions("shard", "kind", "block")
    found = cut(stream.mapInArrow(_search(k, beam), "query_id long, vec_id long, score double"), "found")
    batches(spark)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

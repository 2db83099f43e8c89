"""Approximate nearest neighbours by cosine, in robust-pruned directed graphs.

Vectors are dealt to shards; each shard gets a graph of its own. A vector is inserted by a greedy
search from the entry point, whose path and result propose its neighbours; robust pruning keeps of
these the nearest, and others only where they are not ALPHA times nearer to a neighbour that is
kept, so that edges are diverse. Queries go through every shard by beam search; what the beams
hold is scored exactly, and shards are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keytide.llm import vectors as V
from keytide.session import materialize

DEGREE, ALPHA = 32, 1.2
#: Candidates that a search holds: in building, and in answering a query.
BUILD_BEAM, BEAM = 48, 128
#: Nodes whose neighbours are looked at in one step of a search, and vectors handled at once.
EXPAND, AT_ONCE = 4, 512
QUERY_EVERY, K = 50, 5


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, as single floats."""
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> np.ndarray:
    """The ``beam`` nodes found nearest to each query, nearest first; -1 fills up.

    ``x`` are unit vectors, ``graph`` the neighbours of each node (-1: none). All queries take
    a step together: each looks at the neighbours of its EXPAND nearest nodes not yet seen to.
    """
    n = len(queries)
    ids = np.full((n, beam), -1)
    near = np.full((n, beam), -np.inf, np.float32)
    done = np.ones((n, beam), bool)
    ids[:, 0], near[:, 0], done[:, 0] = entry, queries @ x[entry], False
    active = np.arange(n)
    while len(active):
        a_ids, a_near, a_done = ids[active], near[active], done[active]
        rank = np.argsort(a_done, axis=1, kind="stable")[:, :EXPAND]
        rows = np.arange(len(active))[:, None]
        picked = np.where(a_done[rows, rank], -1, a_ids[rows, rank])
        a_done[rows, rank] = True
        new = np.where(picked[:, :, None] >= 0, graph[picked], -1).reshape(len(active), -1)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[(new[:, :, None] == a_ids[:, None, :]).any(axis=2)] = -1
        score = np.einsum("brd,bd->br", x[new], queries[active])
        score[new < 0] = -np.inf
        all_ids = np.concatenate([a_ids, new], axis=1)
        all_near = np.concatenate([a_near, score], axis=1)
        all_done = np.concatenate([a_done, new < 0], axis=1)
        order = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        ids[active], near[active], done[active] = all_ids[rows, order], all_near[rows, order], all_done[rows, order]
        active = active[~done[active].all(axis=1)]
    ids[np.isneginf(near)] = -1
    return ids


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` neighbours for each node among its candidates (-1: none)."""
    some = x[candidates]
    near = np.einsum("bcd,bd->bc", some, x[nodes])
    usable = (candidates >= 0) & (candidates != nodes[:, None])
    # squared distances of unit vectors
    apart, between = 2 - 2 * near, 2 - 2 * (some @ some.transpose(0, 2, 1))
    out, rows = np.full((len(nodes), degree), -1), np.arange(len(nodes))
    for r in range(degree):
        open_ = np.where(usable, apart, np.inf)
        pick = open_.argmin(axis=1)
        ok = usable[rows, pick]
        if not ok.any():
            break
        out[ok, r] = candidates[rows, pick][ok]
        usable &= alpha * alpha * between[rows, pick] > apart
        usable[rows, pick] = False
    return out


def build(x: np.ndarray, seed: int = 0, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BUILD_BEAM) -> tuple[np.ndarray, int]:
    """Neighbours of each of the unit vectors, and the entry point, the one nearest to the mean.

    Vectors are inserted in batches that at most double the graph; a second pass inserts all of
    them once more into the whole graph.
    """
    n = len(x)
    graph = np.full((n, degree), -1)
    entry = int((x @ x.mean(axis=0)).argmax())
    order = np.random.default_rng(seed).permutation(n)
    order = np.r_[entry, order[order != entry]]
    for relaxed, whole in ((1.0, False), (alpha, True)):
        at = 1
        while at < n:
            size = min(AT_ONCE, n - at, n if whole else at)
            _insert(x, graph, entry, order[at : at + size], degree, relaxed, beam)
            at += size
    return graph, entry


def _insert(x, graph, entry, nodes, degree, alpha, beam) -> None:
    found = beam_search(x, graph, entry, x[nodes], beam)
    graph[nodes] = robust_prune(x, nodes, np.concatenate([found, graph[nodes]], axis=1), degree, alpha)
    # edges back; a target that gets too many is pruned
    source = np.repeat(nodes, degree)
    target = graph[nodes].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    distinct, start, count = np.unique(target, return_index=True, return_counts=True)
    for lo in range(0, len(distinct), AT_ONCE):
        some = slice(lo, lo + AT_ONCE)
        # a target with very many new edges takes them in rounds, so none is left out
        for skip in range(0, int(count[some].max(initial=0)), degree):
            todo = np.flatnonzero(count[some] > skip) + lo
            t = distinct[todo]
            at = start[todo, None] + skip + np.arange(degree)
            inside = at < (start + count)[todo, None]
            new = np.where(inside, source[np.minimum(at, len(source) - 1)], -1)
            new[(new[:, :, None] == graph[t][:, None, :]).any(axis=2)] = -1
            both = np.concatenate([graph[t], new], axis=1)
            full = (both >= 0).sum(axis=1) > degree
            packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)[:, :degree]
            graph[t] = packed
            if full.any():
                graph[t[full]] = robust_prune(x, t[full], both[full], degree, alpha)


def usable(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, x)`` of vectors that have a direction."""
    return V.usable(embeddings).where(F.exists("x", lambda v: v != 0))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """``(x, ids)``: each different vector with the ``k + 1`` smallest ids that have it; of more
    equal candidates none can be among the ``k`` nearest."""
    rank = F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))
    some = rows.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    return some.groupBy("x").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def index(vectors: DataFrame, n_shards: int) -> DataFrame:
    """``(shard, x, ids, node, entry, neighbours)``: the graphs of all shards."""

    def run(table: pa.Table) -> pa.Table:
        x = V.matrix(table["x"])
        shard = table["shard"][0].as_py()
        graph, entry = build(unit(x), seed=shard)
        return pa.table(
            {
                "shard": table["shard"], "x": table["x"], "ids": table["ids"],
                "node": pa.array(np.arange(len(x), dtype=np.int32)),
                "entry": pa.array(np.full(len(x), entry, np.int32)),
                "neighbours": pa.array([g[g >= 0] for g in graph], pa.list_(pa.int32())),
            }
        )

    schema = "shard int, x array<double>, ids array<long>, node int, entry int, neighbours array<int>"
    dealt = V.sharded(vectors, n_shards, "x")
    return dealt.repartition(4 * n_shards, "shard").groupBy("shard").applyInArrow(run, schema)


def search_shard(shard: pa.Table, block: pa.Table, k: int, beam: int) -> Iterator[tuple]:
    """``(query id, ids, scores)`` of a block of queries in one shard, scored in double precision."""
    order = np.argsort(shard["node"].to_numpy())
    q = V.matrix(block["x"])
    x = V.matrix(shard["x"], q.shape[1])[order]
    q = V.matrix(block["x"], x.shape[1])
    ids = [shard["ids"][int(i)].as_py() for i in order]
    graph = np.full((len(x), DEGREE), -1)
    for node, i in enumerate(order.tolist()):
        own = shard["neighbours"][i].as_py()
        graph[node, : len(own)] = own
    entry = shard["entry"][0].as_py()
    small, lengths = unit(x), np.sqrt((x * x).sum(axis=1))
    for at in range(0, len(q), AT_ONCE):
        some = q[at : at + AT_ONCE]
        found = beam_search(small, graph, entry, unit(some), beam)
        for own, query, nodes in zip(block["vec_id"][at : at + AT_ONCE].to_pylist(), some, found):
            nodes = nodes[nodes >= 0]
            score = (x[nodes] * query).sum(axis=1) / (lengths[nodes] * np.sqrt((query * query).sum()))
            of = np.repeat(np.arange(len(nodes)), [len(ids[n]) for n in nodes])
            who = np.array([i for n in nodes for i in ids[n]], np.int64)
            score = score[of] if len(of) else score[:0]
            keep = who != own
            who, score = who[keep], score[keep]
            got = V.top(score, who, k)
            yield own, who[got], score[got]


def search(
    embeddings: DataFrame, every: int = QUERY_EVERY, k: int = K, beam: int = BEAM,
    shard_rows: int = V.SHARD_ROWS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each vector whose id ``every`` divides, the ``k``
    others found nearest by cosine, ties to smaller ids.

    Vectors that are NULL, zero or hold NULL or non-finite components take no part; components
    that a shorter vector lacks count as 0. Of rows that repeat an id one takes part. Equal
    vectors are one node of the graph.
    """
    rows = materialize(usable(embeddings), "ann")
    queries = rows.where(F.col("vec_id") % every == 0)
    distinct = materialize(distinct_vectors(rows, k), "ann-distinct")
    n_shards = V.shards(distinct.count(), shard_rows)
    graphs = materialize(index(distinct, n_shards), "ann-index")

    def run(shard: pa.Table, block: pa.Table) -> pa.Table:
        found = list(search_shard(shard, block, k, beam)) if shard.num_rows and block.num_rows else []
        own = np.concatenate([np.full(len(i), q) for q, i, _ in found] or [[]]).astype(np.int64)
        ids = np.concatenate([i for _, i, _ in found] or [[]]).astype(np.int64)
        score = np.concatenate([s for _, _, s in found] or [[]]).astype(np.float64)
        return pa.table({"query_id": own, "vec_id": ids, "score": score})

    found = V.search_blocks(graphs, queries, n_shards, queries.count(), run, "double")
    return V.best(found, k)

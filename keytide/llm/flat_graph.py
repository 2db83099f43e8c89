"""Near duplicates among vectors, from a flat robust-pruned graph over overlapping clusters.

Different vectors are nodes. Each goes to the clusters of its nearest centroids, so clusters
overlap; every cluster (cut into pieces where it is large) gets a robust-pruned graph, and a node's
neighbours in all its graphs are put together: one flat graph. Every node then searches in all its
clusters: greedily from the medoid to the nearest nodes, and from those within the range on to
all their neighbours, as long as new ones lie within it. What is found is verified in double precision.

A task of the search holds two pieces of one cluster at most, so dense groups are many tasks of
bounded size. Found pairs stay in the task: a pair counts in the first of the clusters that its two
nodes share, and what leaves the task is, for each node, its number of links and one other node of
the same component. So rows grow with the nodes, however many pairs a dense group has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.functions.joins import dimension_join
from keytide.llm import vectors as V
from keytide.llm.ann import AT_ONCE, beam_search, build, unit
from keytide.llm.components import connected_components
from keytide.session import materialize

THRESHOLD = 0.9
#: Clusters of a node; nodes that a cluster is meant to have, and that a piece has at most.
OVERLAP, CLUSTER_ROWS, PIECE_ROWS = 3, 1_536, 4_096
#: Centroids are fitted on a sample of so many vectors each, and there are at most so many.
SAMPLE_EACH, MAX_CENTROIDS, ROUNDS = 8, 16_384, 4
BUILD_BEAM, BEAM, DEGREE, ALPHA = 32, 32, 32, 1.2
#: Single precision may be off by less than this; the search keeps what verification has to see.
SLACK = 1e-4
#: Equal vectors are looked up by broadcast only for so many of them.
BROADCAST_NODES = 20_000


def comparable(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, x)``: all rows; ``x`` is NULL where a vector can't link with anything."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists(x, lambda v: v != 0)
    fit = F.coalesce(~bad & some, F.lit(False)) & F.col("vec_id").isNotNull()
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fit, x).alias("x"))


def fit_centroids(sample: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """``k`` unit vectors: a few rounds of spherical k-means from random members."""
    centres = sample[np.random.default_rng(seed).permutation(len(sample))[:k]]
    for _ in range(ROUNDS):
        nearest = np.concatenate(
            [(sample[at : at + AT_ONCE] @ centres.T).argmax(axis=1) for at in range(0, len(sample), AT_ONCE)]
        )
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        # an empty cluster keeps its centroid
        centres = np.where(length > 0, sums / np.maximum(length, 1e-30), centres)
    return centres.astype(np.float32)


def assign(nodes: DataFrame, n: int, cluster_rows: int, overlap: int, seed: int = 0) -> DataFrame:
    """``nodes`` with ``clusters``, the ids of those with the nearest centroids, ascending.

    Only centroids are fitted on a sample, bounded by MAX_CENTROIDS and SAMPLE_EACH; all nodes
    are assigned.
    """
    k = min(max(1, -(-n * overlap // cluster_rows)), MAX_CENTROIDS)
    if n <= cluster_rows:
        return nodes.withColumn("clusters", F.array(F.lit(0)))
    wanted = k * SAMPLE_EACH
    by_hash = F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1_000_000)) < max(1, int(1e6 * min(1.0, wanted / n)))
    rows = nodes.where(by_hash).select("x").limit(2 * wanted).toArrow()
    centres = fit_centroids(unit(V.matrix(rows["x"])), k, seed)
    own = nodes.sparkSession.sparkContext.broadcast(centres)
    few = min(overlap, len(centres))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            centres = own.value
            x = unit(V.matrix(pa.chunked_array([batch.column("x")]), centres.shape[1]))[:, : centres.shape[1]]
            near = np.concatenate(
                [
                    np.argpartition(-(x[at : at + AT_ONCE] @ centres.T), few - 1, axis=1)[:, :few]
                    for at in range(0, len(x), AT_ONCE)
                ]
            )
            near = np.sort(near, axis=1).astype(np.int32)
            offsets = np.arange(len(near) + 1, dtype=np.int32) * few
            clusters = pa.ListArray.from_arrays(pa.array(offsets), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, clusters], names=[*batch.schema.names, "clusters"])

    names = nodes.select("node", "m", "x")
    return names.mapInArrow(run, "node long, m long, x array<double>, clusters array<int>")


def members(assigned: DataFrame, piece_rows: int) -> DataFrame:
    """A row for each node and cluster: ``(cluster, pieces, piece, node, m, x, clusters)``."""
    rows = assigned.withColumn("cluster", F.explode("clusters"))
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("cluster", F.ceil(F.col("n") / F.lit(piece_rows)).cast("int").alias("pieces"))
    dealt = rows.join(F.broadcast(sizes), "cluster")  # one row for each centroid
    piece = F.pmod(F.xxhash64("node", F.lit(11)), F.col("pieces")).cast("int")
    return dealt.select("cluster", "pieces", piece.alias("piece"), "node", "m", "x", "clusters")


def flat_graph(rows: DataFrame) -> DataFrame:
    """``(node, neighbours)``: the union of a node's neighbours in the graphs of all its pieces."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node = table["node"].to_numpy()
        graph, _ = build(unit(V.matrix(table["x"])), seed=0, degree=DEGREE, alpha=ALPHA, beam=BUILD_BEAM)
        kept = graph >= 0
        offsets = np.r_[0, np.cumsum(kept.sum(axis=1))].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(node[graph[kept]]))
        return pa.table({"node": node, "neighbours": lists})

    keys = ("cluster", "piece")
    graphs = rows.select(*keys, "node", "x").groupBy(*keys).applyInArrow(run, "node long, neighbours array<long>")
    return graphs.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))


class Piece:
    """Nodes of a piece with the part of the flat graph that lies within it."""

    def __init__(self, table: pa.Table, width: int):
        table = table.sort_by("node")
        self.node, self.m = table["node"].to_numpy(), table["m"].to_numpy()
        self.x = V.matrix(table["x"], width)
        self.small, self.length = unit(self.x), np.sqrt((self.x * self.x).sum(axis=1))
        clusters = table["clusters"].combine_chunks()
        self.clusters = np.asarray(clusters.flatten()).reshape(len(self.node), -1)
        lists = table["neighbours"].combine_chunks()
        row = np.repeat(np.arange(len(self.node)), np.diff(lists.offsets.to_numpy()))
        to = np.asarray(lists.flatten())
        at = np.minimum(np.searchsorted(self.node, to), len(self.node) - 1)
        here = self.node[at] == to
        row, at = row[here], at[here]
        count = np.bincount(row, minlength=len(self.node))
        place = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
        self.graph = np.full((len(self.node), max(1, count.max(initial=0))), -1)
        self.graph[row, place] = at
        self.entry = int((self.small @ self.small.mean(axis=0)).argmax())  # the medoid


def range_search(piece: Piece, queries: np.ndarray, own: np.ndarray | None, least: float, beam: int) -> np.ndarray:
    """Which nodes of the piece are within the range of each query (at cosine ``least`` or above).

    ``queries`` are unit vectors; ``own`` their nodes where they belong to the piece.
    """
    n, size = len(queries), len(piece.node)
    within, seen = np.zeros((n, size), bool), np.zeros((n, size), bool)
    found = beam_search(piece.small, piece.graph, piece.entry, queries, min(beam, size))
    at, to = np.nonzero(found >= 0)[0], found[found >= 0]
    if own is not None:
        at, to = np.r_[at, np.arange(n)], np.r_[to, own]
    while len(at):
        new = np.zeros((n, size), bool)
        new[at, to] = True
        new &= ~seen
        seen |= new
        at, to = np.nonzero(new)
        close = np.concatenate(
            [
                np.einsum("ij,ij->i", queries[at[lo : lo + (1 << 18)]], piece.small[to[lo : lo + (1 << 18)]])
                for lo in range(0, len(at), 1 << 18)
            ]
            or [np.zeros(0)]
        ) >= least
        at, to = at[close], to[close]
        within[at, to] = True
        reached = np.zeros((n, size), bool)
        for lo in range(0, len(at), 1 << 16):
            some = piece.graph[to[lo : lo + (1 << 16)]]
            edge = some >= 0
            reached[np.broadcast_to(at[lo : lo + (1 << 16), None], some.shape)[edge], some[edge]] = True
        reached &= ~seen
        at, to = np.nonzero(reached)
    return within


def linked(a: Piece, b: Piece, cluster: int, threshold: float, beam: int) -> np.ndarray:
    """Which nodes of ``a`` and ``b`` (the same piece, or another of the cluster) link, as far as
    that pair is this cluster's to count: it has no smaller one in common."""
    hits = np.zeros((len(a.node), len(b.node)), bool)
    least = threshold - SLACK
    for lo in range(0, len(a.node), AT_ONCE):
        some = slice(lo, lo + AT_ONCE)
        own = np.arange(len(a.node))[some] if a is b else None
        hits[some] |= range_search(b, a.small[some], own, least, beam)
    if a is b:
        hits |= hits.T
        np.fill_diagonal(hits, False)
    else:
        for lo in range(0, len(b.node), AT_ONCE):
            some = slice(lo, lo + AT_ONCE)
            hits[:, some] |= range_search(a, b.small[some], None, least, beam).T
    for lo in range(0, len(a.node), AT_ONCE):
        i, j = np.nonzero(hits[lo : lo + AT_ONCE])
        for start in range(0, len(i), 1 << 16):
            p, q = i[start : start + (1 << 16)] + lo, j[start : start + (1 << 16)]
            exact = (a.x[p] * b.x[q]).sum(axis=1) / (a.length[p] * b.length[q])
            both = (a.clusters[p][:, :, None] == b.clusters[q][:, None, :]).any(axis=2)
            mine = ~(both & (a.clusters[p] < cluster)).any(axis=1)
            hits[p, q] = (exact >= threshold) & mine
    return hits


def local_roots(n: int, hits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes ``0..n-1`` the smallest node of their component; ``hits`` links ``a`` with ``b``."""
    root = np.arange(n)
    rows, columns = np.flatnonzero(hits.any(axis=1)), np.flatnonzero(hits.any(axis=0))
    while len(rows):
        before = root.copy()
        for lo in range(0, len(rows), AT_ONCE):
            r = rows[lo : lo + AT_ONCE]
            least = np.where(hits[r], root[b][None, :], n).min(axis=1)
            np.minimum.at(root, root[a[r]], least)
            root[a[r]] = np.minimum(root[a[r]], least)
        for lo in range(0, len(columns), AT_ONCE):
            c = columns[lo : lo + AT_ONCE]
            least = np.where(hits[:, c], root[a][:, None], n).min(axis=0)
            np.minimum.at(root, root[b[c]], least)
            root[b[c]] = np.minimum(root[b[c]], least)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    return root


def search(rows: DataFrame, graph: DataFrame, threshold: float, beam: int) -> DataFrame:
    """``(node, n, other)``: for each node and task with a link of it, the vectors linked and a
    node of the same component, itself where it is the smallest of the task."""
    paired = (
        rows.join(graph, "node")
        .withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .select(
            "cluster", F.least("piece", "partner").alias("low"), F.greatest("piece", "partner").alias("high"),
            "piece", "node", "m", "x", "clusters", "neighbours",
        )
    )

    def run(table: pa.Table) -> pa.Table:
        cluster, low, high = (table[c][0].as_py() for c in ("cluster", "low", "high"))
        side = table["piece"].to_numpy()
        width = int(np.diff(table["x"].combine_chunks().offsets.to_numpy()).max())
        empty = pa.table({c: pa.array([], pa.int64()) for c in ("node", "n", "other")})
        if low != high and len(np.unique(side)) < 2:
            return empty
        a = Piece(table.filter(pa.array(side == low)), width)
        b = a if low == high else Piece(table.filter(pa.array(side == high)), width)
        hits = linked(a, b, cluster, threshold, beam)
        if not hits.any():
            return empty
        node = a.node if a is b else np.r_[a.node, b.node]
        at_a = np.arange(len(a.node))
        at_b = at_a if a is b else np.arange(len(b.node)) + len(a.node)
        n = np.zeros(len(node), np.int64)
        for lo in range(0, len(a.node), AT_ONCE):
            n[at_a[lo : lo + AT_ONCE]] += hits[lo : lo + AT_ONCE] @ b.m
            if a is not b:
                n[at_b] += a.m[lo : lo + AT_ONCE] @ hits[lo : lo + AT_ONCE]
        root = local_roots(len(node), hits, at_a, at_b)
        some = n > 0
        return pa.table({"node": node[some], "n": n[some], "other": node[root][some]})

    keys = ("cluster", "low", "high")
    return paired.groupBy(*keys).applyInArrow(run, "node long, n long, other long")


def near_duplicates(
    embeddings: DataFrame, threshold: float = THRESHOLD, overlap: int = OVERLAP,
    cluster_rows: int = CLUSTER_ROWS, piece_rows: int = PIECE_ROWS, beam: int = BEAM,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``: a row for each row of ``embeddings``.

    Links are pairs of rows with a cosine of at least ``threshold``; every pair counted is verified,
    few may be missed (``recall`` measures them). Equal vectors are one node and always link. Vectors
    that are NULL, zero or hold NULL or non-finite components, and rows without an id, link with
    nothing; a row without an id has no component and is kept. Rows that repeat an id are rows of
    their own. Components that a shorter vector lacks count as 0. Other columns are not read.
    """
    rows = materialize(comparable(embeddings), "flat-rows")
    usable = rows.where("x is not null")
    nodes = usable.groupBy("x").agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("least"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "flat-nodes")
    assigned = materialize(assign(nodes, nodes.count(), cluster_rows, overlap), "flat-assigned")
    placed = materialize(members(assigned, piece_rows), "flat-members")
    graph = materialize(flat_graph(placed), "flat-graph")
    found = materialize(search(placed, graph, threshold, beam), "flat-found")

    roots = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b")), "flat")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    labels = (
        nodes.join(counts, "node", "left").join(roots, "node", "left")
        .select("x", "m", "least", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "node").alias("root"))
    )
    labels = materialize(labels, "flat-labels")
    least = labels.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = labels.join(least, "root").select("x", (F.col("n") + F.col("m") - 1).alias("n_links"), "component_id")
    linked_rows = dimension_join(usable, labels, ["x"], BROADCAST_NODES).drop("x")
    alone = rows.where("x is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    return linked_rows.unionByName(alone).withColumn("kept", kept)


def recall(embeddings: DataFrame, result: DataFrame, every: int = 20, threshold: float = THRESHOLD) -> DataFrame:
    """The audit: ``(found, true)`` links of the rows whose id ``every`` divides, the true ones by
    comparing those with all rows, in blocks."""
    rows = materialize(comparable(embeddings).where("x is not null"), "flat-audit")
    asked = rows.where(F.col("vec_id") % every == 0)
    n_queries, n_rows = asked.count(), rows.count()
    # new columns: a table can't be grouped with itself by the same ones
    both = rows.select(*[F.col(c).alias(c) for c in rows.columns])
    dealt = V.sharded(both, V.shards(n_rows, V.SHARD_ROWS))

    def run(shard: pa.Table, block: pa.Table) -> pa.Table:
        if not shard.num_rows or not block.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        q = V.matrix(block["x"])
        x = V.matrix(shard["x"], q.shape[1])
        q = V.matrix(block["x"], x.shape[1])
        q, x = (v / np.sqrt((v * v).sum(axis=1, keepdims=True)) for v in (q, x))
        true = (q @ x.T >= threshold).sum(axis=1)
        ids = block["vec_id"].to_numpy()
        return pa.table({"query_id": ids, "vec_id": ids, "score": true})

    pairs = V.search_blocks(dealt, asked, V.shards(n_rows, V.SHARD_ROWS), n_queries, run, "long")
    none = F.lit(0).cast("long")
    true = pairs.agg(none.alias("found"), (F.sum("score") - n_queries).alias("true"))
    got = result.where(F.col("vec_id") % every == 0).agg(F.sum("n_links").alias("found"), none.alias("true"))
    return got.unionByName(true).agg(F.sum("found").alias("found"), F.sum("true").alias("true"))

"""Near duplicates among vectors against comparing all pairs."""

import numpy as np
import pytest

from keytide.llm import flat_graph
from tests.llm.fixtures import rows_of
from tests.llm.test_vectors import INF, NAN, table

COLUMNS = ("vec_id", "n_links", "component_id", "kept")


def groups(n=700, dims=24, seed=1):
    """Single vectors, groups of near copies, chains, and one vector many times."""
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, dims))
    x[100:160] = x[100] + 0.2 * rnd.normal(size=(60, dims))
    x[200:300] = x[200] + 0.35 * rnd.normal(size=(100, dims))
    for i in range(301, 320):
        x[i] = x[i - 1] + 0.4 * rnd.normal(size=dims)
    x[400:450] = x[400]
    return x.astype(np.float32)


def brute(rows, threshold=0.9):
    usable = [
        (i, np.array(v + [0.0] * (24 - len(v)), float))
        for i, v, _ in rows
        if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)
    ]
    x = np.array([v for _, v in usable])
    length = np.sqrt((x * x).sum(axis=1))
    link = np.array([(x * row).sum(axis=1) / (length * own) >= threshold for row, own in zip(x, length)])
    np.fill_diagonal(link, False)
    ids = np.array([i for i, _ in usable])
    root = ids.copy()
    while True:
        new = np.minimum(root, np.where(link, root[None, :], 1 << 40).min(axis=1))
        if (new == root).all():
            break
        root = new
    out = [(int(i), int(n), int(r), bool(i == r)) for i, n, r in zip(ids, link.sum(axis=1), root)]
    taken = len(out)
    bad = [i for i, v, _ in rows]
    for i in ids:
        bad.remove(int(i))
    out += [(i, 0, i, True) for i in bad]
    assert taken + len(bad) == len(rows)
    return sorted(out, key=lambda r: tuple((c is not None, c) for c in r))


def awkward():
    x = groups()
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    bad = [None, [], [0.0] * 24, [1.0, None] * 12, [NAN] * 24, [INF] + [0.0] * 23]
    rows += [(1000 + i, v, 1) for i, v in enumerate(bad)]
    # shorter, scaled, a repeated id with the same and with another vector, no id
    rows += [(1100, [1.0, 2.0], 1), (1101, [2.0, 4.0], 1), (1102, [3.0 * c for c in rows[7][1]], 1)]
    return rows + [rows[5], (8, rows[9][1], 2), (None, rows[3][1], 2)]


@pytest.mark.parametrize("cluster_rows,piece_rows", [(10_000, 4096), (10_000, 150), (300, 4096), (300, 80)])
def test_against_all_pairs(spark, cluster_rows, piece_rows):
    rows = awkward()
    df = table(spark, rows).selectExpr("*", "'n' AS node", "1 AS m")
    result = flat_graph.near_duplicates(df, cluster_rows=cluster_rows, piece_rows=piece_rows).persist()
    got, want = rows_of(result, *COLUMNS), brute(rows)
    assert [r[0] for r in got] == [r[0] for r in want]
    if cluster_rows == 10_000:
        assert got == want
    else:
        assert all(g[1] <= w[1] for g, w in zip(got, want))
        assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)
    audit = flat_graph.recall(df, result, every=10).first()
    assert audit.true == sum(r[1] for r in want if r[0] is not None and r[0] % 10 == 0)
    assert audit.found == sum(r[1] for r in got if r[0] is not None and r[0] % 10 == 0)


def test_empty_single_and_copies_only(spark):
    assert flat_graph.near_duplicates(table(spark, [(1, [1.0], 0)]).limit(0)).count() == 0
    assert rows_of(flat_graph.near_duplicates(table(spark, [(4, [1.0, 0.0], 0)])), *COLUMNS) == [(4, 0, 4, True)]
    same = [(i, [1.0, 2.0], 0) for i in range(3, 40)]
    assert rows_of(flat_graph.near_duplicates(table(spark, same)), *COLUMNS) == [(i, 36, 3, i == 3) for i in range(3, 40)]


def test_shards_share_nodes_and_their_neighbours(spark):
    """The flat graph has edges of all a node's clusters, so more than any of its graphs."""
    from pyspark.sql import functions as F

    x = groups()
    nodes = spark.createDataFrame([(i, 1, [float(c) for c in v]) for i, v in enumerate(x)], "node long, m long, x array<double>")
    placed = flat_graph.members(flat_graph.assign(nodes, len(x), 200, 3), 4096)
    assert placed.count() == 3 * len(x)
    graph = flat_graph.flat_graph(placed)
    widest = graph.agg(F.max(F.size("neighbours"))).first()[0]
    assert flat_graph.DEGREE < widest <= 3 * flat_graph.DEGREE

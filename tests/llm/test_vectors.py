import numpy as np
import pytest

from keytide.llm import ann, maxscore
from tests.llm.fixtures import rows_of

INF, NAN = float("inf"), float("nan")


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.selectExpr("*", "1 AS shard", "2 AS block", "'x' AS x", "0 AS ids")


def awkward(n=600, seed=0):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, 8)).astype(np.float32)
    x[50:250] = x[50]  # one vector many times
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(n)]
    bad = [None, [], [0.0] * 8, [1.0, None] * 4, [NAN] * 8, [INF] + [0.0] * 7, [1.0, 2.0]]
    return rows + [(1000 + 50 * i, v, 1) for i, v in enumerate(bad)] + [rows[3], (None, rows[0][1], 0)]


def vectors_of(rows):
    out = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v):
            out[i] = np.array(v + [0.0] * (8 - len(v)))
    return out


def brute(vectors, every, k, score):
    want = []
    for q in (i for i in vectors if i % every == 0):
        others = sorted(((-score(vectors[q], x), i) for i, x in vectors.items() if i != q))[:k]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(others, 1)]
    return sorted(want)


@pytest.mark.parametrize("shard_rows", [90, 8192])
def test_maxscore_against_brute_force(spark, shard_rows, monkeypatch):
    monkeypatch.setattr(maxscore, "STEP", 37)
    rows = awkward()
    vectors = {i: np.floor(1024 * x).astype(np.int64) for i, x in vectors_of(rows).items()}
    got = rows_of(maxscore.search(table(spark, rows), shard_rows=shard_rows))
    assert got == brute(vectors, 100, 10, lambda a, b: int(a @ b))


def test_maxscore_skips_what_cannot_win():
    rnd = np.random.default_rng(2)
    x = np.floor(1024 * rnd.normal(size=(5000, 16)) * np.r_[8, 4, np.full(14, 0.05)]).astype(np.int64)
    postings = maxscore.Postings(np.arange(5000), x)
    ids, scores = postings.search(x[7], 7, 10)
    exact = x @ x[7]
    exact[7] = -(1 << 60)
    assert ids.tolist() == np.lexsort((np.arange(5000), -exact))[:10].tolist()
    assert scores.tolist() == exact[ids].tolist()


def test_empty_and_single(spark):
    for search in (maxscore.search, ann.search):
        assert search(table(spark, [])).count() == 0
        assert search(table(spark, [(0, [1.0, 2.0], 0)])).count() == 0


def cosine(a, b):
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


@pytest.mark.parametrize("shard_rows", [150, 8192])
def test_graph_search_recall(spark, shard_rows):
    rows = awkward()
    vectors = {i: x for i, x in vectors_of(rows).items() if x.any()}
    got = ann.search(table(spark, rows), shard_rows=shard_rows).collect()
    want = brute(vectors, 50, 5, cosine)
    assert len(got) == len(want)
    reached = {(r.query_id, r.rank): r.score for r in got}
    hits = [reached[(q, rank)] >= s - 1e-12 for q, rank, _, s in want]
    assert np.mean(hits) >= 0.9
    for r in got:
        assert r.query_id != r.vec_id
        assert r.score == pytest.approx(cosine(vectors[r.query_id], vectors[r.vec_id]), abs=1e-12)


def test_recall_on_the_given_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    vectors = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    got = {(r.query_id, r.vec_id) for r in ann.search(df, shard_rows=200).collect()}
    want = {(q, i) for q, _, i, _ in brute(vectors, 50, 5, cosine)}
    assert len(got & want) >= 0.9 * len(want)


def test_pruned_edges_are_diverse_and_bounded():
    rnd = np.random.default_rng(3)
    x = ann.unit(rnd.normal(size=(400, 8)))
    graph, entry = ann.build(x, degree=12)
    assert graph.shape == (400, 12) and ((graph >= 0).sum(axis=1) > 0).all()
    assert not (graph == np.arange(400)[:, None]).any()
    found = ann.beam_search(x, graph, entry, x, 32)
    assert np.mean([i in f for i, f in enumerate(found)]) > 0.98

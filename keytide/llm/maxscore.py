"""Exact top-k by inner product over integer vectors, with MaxScore.

A component is a term: it has two postings lists, of the vectors where it is positive and of
those where it is negative. Of a query's terms, those lists whose products are positive have a
score bound each. Once k results are known, the lists with small bounds, whose sum stays below
the k-th score, are non-essential: a vector found in them alone can't be a result. Vectors in
essential lists are accumulated; the other lists are probed in order of their bounds, and last
those that lower a score, for as long as a vector is competitive.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytide.llm import vectors as V
from keytide.session import materialize

SCALE = 1024
#: Quantized components are smaller than this, so that sums stay within 64 bits.
LARGEST = 1 << 28
TOO_LARGE = "a component times 1024 is beyond 2^28: exact scores may not fit 64 bits"
QUERY_EVERY, K = 100, 10
#: Vectors looked at between two updates of the k-th score.
STEP = 1_024


def quantized(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, x array<bigint>)``: floor(1024 x) of each component, in double precision.

    A component beyond LARGEST is an error: a score with it might not fit 64 bits.
    """

    def checked(v: Column) -> Column:
        fits = F.abs(v) < LARGEST / SCALE
        return F.when(fits, F.floor(v * SCALE)).otherwise(F.raise_error(TOO_LARGE).cast("long"))

    return V.usable(embeddings).select("vec_id", F.transform("x", checked).alias("x"))


class Postings:
    """A shard's lists, dense by vector, in order of ids; bounds of each list."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(ids)
        self.ids = ids[order]
        x = np.ascontiguousarray(x[order].T.astype(np.int64))
        self.up, self.down = np.maximum(x, 0), np.minimum(x, 0)
        self.most_up = self.up.max(axis=1, initial=0)
        self.most_down = self.down.min(axis=1, initial=0)

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best but the query's own."""
        query = query[: len(self.up)]
        dims = np.flatnonzero(query)
        bound = np.where(query > 0, query * self.most_up[: len(query)], query * self.most_down[: len(query)])
        raising = dims[np.argsort(-bound[dims], kind="stable")]
        raising = raising[bound[raising] > 0]
        rest = np.r_[np.cumsum(bound[raising][::-1])[::-1], 0]
        lowers = np.where(query > 0, query * self.most_down[: len(query)], query * self.most_up[: len(query)])
        lowering = dims[np.argsort(lowers[dims], kind="stable")]
        lowering = lowering[lowers[lowering] < 0]
        ids, scores, least = np.empty(0, np.int64), np.empty(0, np.int64), None
        for at in range(0, len(self.ids), STEP):
            here = slice(at, at + STEP)
            alive = np.arange(at, min(at + STEP, len(self.ids)))
            alive = alive[self.ids[here] != own]
            essential = len(raising) if least is None else int(np.argmax(rest < least)) if (rest < least).any() else len(raising)
            sums = np.zeros(len(alive), np.int64)
            for j, d in enumerate(raising):
                if j == essential:
                    # in no essential list, or too low with all that may come
                    keep = (sums > 0) & (sums + rest[j] >= least)
                    alive, sums = alive[keep], sums[keep]
                lists = self.up if query[d] > 0 else self.down
                sums += query[d] * lists[d][alive]
                if j >= essential:
                    keep = sums + rest[j + 1] >= least
                    alive, sums = alive[keep], sums[keep]
            for d in lowering:
                if least is not None:
                    keep = sums >= least
                    alive, sums = alive[keep], sums[keep]
                    if not len(alive):
                        break
                lists = self.down if query[d] > 0 else self.up
                sums = sums + query[d] * lists[d][alive]
            ids, scores = np.r_[ids, self.ids[alive]], np.r_[scores, sums]
            got = V.top(scores, ids, k)
            ids, scores = ids[got], scores[got]
            least = int(scores[-1]) if len(scores) == k else None
        return ids, scores


def search(
    embeddings: DataFrame, every: int = QUERY_EVERY, k: int = K, shard_rows: int = V.SHARD_ROWS
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each vector whose id ``every`` divides, the ``k``
    others of highest inner product, ties to smaller ids.

    Vectors that are NULL or hold NULL or non-finite components take no part; components that a
    shorter vector lacks count as 0. Of rows that repeat an id one takes part.
    """
    rows = materialize(quantized(embeddings), "maxscore")
    queries = rows.where(F.col("vec_id") % every == 0)
    n, n_queries = rows.count(), queries.count()
    n_shards = V.shards(n, shard_rows)

    def run(shard: pa.Table, block: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if shard.num_rows and block.num_rows:
            x, q = V.matrix(shard["x"]), V.matrix(block["x"])
            postings = Postings(shard["vec_id"].to_numpy(), x)
            for own, query in zip(block["vec_id"].to_pylist(), q.astype(np.int64)):
                ids, scores = postings.search(query, own, k)
                found.append((np.full(len(ids), own), ids, scores))
        parts = [np.concatenate(c).astype(np.int64) for c in zip(*found)] or [np.empty(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), parts)))

    found = V.search_blocks(V.sharded(rows, n_shards), queries, n_shards, n_queries, run, "long")
    return V.best(found, k)

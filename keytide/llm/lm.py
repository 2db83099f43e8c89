"""Stupid-backoff scores of documents under a bigram model of all other documents.

Documents become token ids of a public subword vocabulary. They are dealt to blocks; a block
explodes into its different n-grams, one row each with its count. Those rows, partitioned by
n-gram, are summed to the counts of the corpus and joined back to the blocks they came from,
where the scores of each document's n-grams are summed. Counts leave the scored document out,
else its own n-grams would all be known.

``S(w | u) = c(u w) / c(u)`` where the pair is known, else ``BACKOFF * c(w) / N``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.llm.packing import ChunkEncoder
from keytide.llm.textio import id_text, map_batches
from keytide.session import materialize

BACKOFF = 0.4
#: Tokens of a block; a task holds one block.
BLOCK_TOKENS = 1_500_000
_BITS = 17


def tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``(doc_id, ids binary)``: little-endian unsigned 16-bit ids of whole texts."""

    def make():
        encoder = ChunkEncoder.of(tokenizer)
        if encoder.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")

        def apply(batch):
            ids = [np.frombuffer(encoder.encode(t.as_py()), "<u4").astype("<u2").tobytes() for t in batch.column("text")]
            return {"doc_id": batch.column("doc_id"), "ids": ids}

        apply.finish = encoder.forget
        return apply

    return map_batches(id_text(docs), "doc_id long, ids binary", make)


def _flat(ids: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a block as numbers from 1, and the document that each belongs to."""
    parts = [np.frombuffer(x.as_py(), "<u2") for x in ids]
    of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    return (np.concatenate(parts) if parts else np.empty(0)).astype(np.int64) + 1, of


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values of a sorted array and how often they come."""
    start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)
    return x[start], np.diff(np.r_[start, len(x)])


def _pairs(tok: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = of[1:] == of[:-1]
    return ((tok[:-1] << _BITS) | tok[1:])[inside], of[1:][inside]


def count_block(table: pa.Table) -> pa.Table:
    """``(gram, block, n)`` of a block: words have one number, pairs two."""
    tok, of = _flat(table["ids"])
    grams, n = zip(_runs(np.sort(tok)), _runs(np.sort(_pairs(tok, of)[0])))
    gram, n = np.concatenate(grams), np.concatenate(n)
    block = np.full(len(gram), table["block"][0].as_py(), np.int32)
    return pa.table({"gram": gram, "block": block, "n": n})


class BlockCounts:
    """Counts in the corpus of the n-grams of a block. Those that no other block has are not in
    ``shared``; their count is the block's own."""

    def __init__(self, own: np.ndarray, shared: pa.Table) -> None:
        self.grams, self.n = _runs(np.sort(own))
        gram, total = shared["gram"].to_numpy(), shared["total"].to_numpy()
        at = np.searchsorted(self.grams, gram)
        at = np.minimum(at, max(0, len(self.grams) - 1))
        hit = self.grams[at] == gram if len(self.grams) else np.zeros(len(gram), bool)
        self.n[at[hit]] = total[hit]

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        return self.n[np.searchsorted(self.grams, grams)]


def score_block(docs: pa.Table, shared: pa.Table, all_tokens: int, backoff: float) -> pa.Table:
    tok, of = _flat(docs["ids"])
    n_docs = docs.num_rows
    lengths = np.bincount(of, minlength=n_docs)
    pairs, pair_of = _pairs(tok, of)
    if n_docs >= 1 << (63 - 2 * _BITS):
        raise ValueError("too many documents in a block")
    words_total, pairs_total = BlockCounts(tok, shared), BlockCounts(pairs, shared)
    # different words of each document, their counts in it and in the others
    mine, word_n = _runs(np.sort((of << _BITS) | tok))
    word, word_of = mine & ((1 << _BITS) - 1), mine >> _BITS
    word_rest = words_total(word) - word_n
    unigram = np.log(np.maximum(word_rest, 1)) - np.log(np.maximum(all_tokens - lengths[word_of], 1))
    # all tokens by their unigram score; pairs then change what they know better or back off from
    total = np.bincount(word_of, weights=word_n * unigram, minlength=n_docs).astype(np.float64)
    # a pair's number and its document's in one
    both, pair_n = _runs(np.sort((pair_of << 2 * _BITS) | pairs))
    pair, pair_of = both & ((1 << 2 * _BITS) - 1), both >> 2 * _BITS
    at = np.searchsorted(mine, (pair_of << _BITS) | (pair & ((1 << _BITS) - 1)))
    context = np.searchsorted(mine, both >> _BITS)
    rest = pairs_total(pair) - pair_n
    known = np.log(np.maximum(rest, 1)) - np.log(np.maximum(word_rest[context], 1)) - unigram[at]
    total += np.bincount(pair_of, weights=pair_n * np.where(rest > 0, known, math.log(backoff)), minlength=n_docs)
    total = total.astype(np.float64)
    mean = total / np.maximum(lengths, 1)
    return pa.table(
        {
            "doc_id": docs["doc_id"], "n_tokens": lengths.astype(np.int64),
            "log_score": pa.array(total, mask=lengths == 0),
            "mean_log_score": pa.array(mean, mask=lengths == 0),
        }
    )


def scores(
    docs: DataFrame, tokenizer: str, backoff: float = BACKOFF, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """``(doc_id, n_tokens, log_score, mean_log_score)``, natural logarithms, a row for each row.

    A token that no other document has counts as one that was seen once. Texts without tokens,
    NULL ones too, have NULL scores. Copies of a document count as other documents. Of the
    columns only ``doc_id`` and ``text`` are read.
    """
    # dealt by number of the row, so that rows that repeat are no hot block
    coded = materialize(
        tokens(docs, tokenizer).withColumn("deal", F.xxhash64(F.monotonically_increasing_id())), "lm-tokens"
    )
    n = int(coded.agg(F.sum(F.octet_length("ids").cast("long"))).first()[0] or 0) // 2
    n_blocks = max(1, math.ceil(n / block_tokens))
    blocked = coded.select("doc_id", "ids", F.pmod("deal", F.lit(n_blocks)).cast("int").alias("block"))
    blocked = blocked.repartition(2 * n_blocks, "block").groupBy("block")
    exploded = blocked.applyInArrow(count_block, "gram long, block int, n long")
    exploded = materialize(exploded, "lm-grams")
    corpus = (
        exploded.groupBy("gram")
        .agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("blocks"))
        .where("blocks > 1")
    )
    shared = exploded.join(corpus, "gram").select("block", "gram", "total")
    shared = shared.repartition(2 * n_blocks, "block").groupBy("block")

    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        return score_block(docs, shared, n, backoff)

    schema = "doc_id long, n_tokens long, log_score double, mean_log_score double"
    return blocked.cogroup(shared).applyInArrow(run, schema)

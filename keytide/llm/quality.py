"""Text quality from weak labels.

Overlapping heuristics vote high, low or nothing on every document. Their accuracies are not
known; expectation-maximisation estimates them, with the share of good documents, from how
often which votes come together, so no label is needed. The posterior of each pattern of
votes then labels a bounded sample, on which a linear scorer over hashed word shapes is
trained; it scores every document.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.llm.textio import Memory, filter_texts, id_text, map_batches
from keytide.session import materialize

#: The scorer is trained on at most so many documents, those with the smallest hashed ids.
TRAIN_ROWS = 20_000
BUCKETS = 1 << 14
STEPS, RATE, RIDGE = 40, 0.5, 1e-4
#: Documents below this score are rejected.
KEEP_FROM = 0.5

#: Where EM starts, a vote against weighs as so many votes for: heuristics fire seldom on good text.
LOW_WEIGHT = 4.0

#: What is assumed of each heuristic: it votes against good texts at most so often.
MAX_FALSE = 0.002

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_SPACE = b"\t\n\x0b\x0c\r "
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())

#: Letters of scripts written without spaces between words: Thai, Lao, Burmese, Khmer, kana, Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")

#: (name, low, high): a vote against where the first holds, a vote for where the second does.
#: Most can only tell what is bad: the absence of a fault says little.
LABELLERS = (
    ("marks", lambda v: v > 0.15, None),
    ("capitals", lambda v: v > 0.40, None),
    ("digits", lambda v: v > 0.20, None),
    ("word_length", lambda v: v < 2.0 or v > 14.0, lambda v: 3.0 <= v <= 9.0),
    ("lone_marks", lambda v: v > 0.15, None),
    ("marked_words", lambda v: v > 0.55, None),
    ("sentences", lambda v: v > 0.5, lambda v: 0.02 <= v <= 0.4),
    ("stutter", lambda v: v > 0.30, None),
    ("top_word", lambda v: v > 0.30, None),
)


def _count(raw: bytes, kind: bytes) -> int:
    return len(raw) - len(raw.translate(None, kind))


def signals(text: str) -> list[float] | None:
    """The number that each labeller looks at; None for a text without words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return None
    chars = len(raw) - _count(raw, _SPACE)
    capitals, letters = _count(raw, _UPPER), chars - _count(raw, _MARKS + _DIGITS)
    ends = [w[-1] for w in words]
    marks = set(_MARKS)
    marked = sum(map(marks.__contains__, ends))
    stops = ends.count(46) + ends.count(33) + ends.count(63)
    lone = sum(1 for w in words if len(w) <= 3 and not w.translate(None, _MARKS))
    return [
        _count(raw, _MARKS) / chars,
        capitals / max(1, letters),
        _count(raw, _DIGITS) / chars,
        word_length(text, raw, len(words)),
        lone / len(words),
        marked / len(words),
        stops / len(words),
        sum(map(eq, words, words[1:])) / len(words),
        (Counter(words).most_common(1)[0][1] - 1) / len(words),
    ]


def word_length(text: str, raw: bytes, n_words: int) -> float:
    """Characters of a word; NaN, so that no vote comes of it, where the script has no spaces.

    Only a text of many bytes a character can be in such a script.
    """
    chars = len(text) - _count(raw, _SPACE)
    if len(raw) > 1.5 * len(text) and len(_UNSPACED.findall(text)) > 0.3 * chars:
        return math.nan
    return chars / n_words


def votes(values: list[float] | None) -> int:
    """All votes as one number in base 3: 0 low, 1 none, 2 high. No words, no vote but low ones."""
    pattern = 0
    for i, (_, low, high) in enumerate(LABELLERS):
        if values is None:
            vote = 0
        else:
            vote = 0 if low(values[i]) else 2 if high and high(values[i]) else 1
        pattern = pattern * 3 + vote
    return pattern


def vote_patterns(docs: DataFrame) -> DataFrame:
    """``(doc_id, pattern)`` of every document."""

    def make():
        def apply(batch):
            texts = batch.column("text")
            return {
                "doc_id": batch.column("doc_id"),
                "pattern": [votes(signals(t.as_py())) for t in texts],
            }

        return apply

    return map_batches(id_text(docs), "doc_id long, pattern int", make)


def estimate(patterns: np.ndarray, counts: np.ndarray, steps: int = 200) -> np.ndarray:
    """Posterior of a good document for each pattern of votes.

    Two classes, votes independent within a class, starting from the votes themselves; the
    confusion of each labeller has three outcomes, so abstaining may tell something too.
    ``patterns`` are at most ``3 ** len(LABELLERS)`` numbers.
    """
    m = len(LABELLERS)
    v = (patterns[:, None] // 3 ** np.arange(m - 1, -1, -1)) % 3
    good = 1 / (1 + np.exp(-(1 + (v == 2).sum(axis=1) - LOW_WEIGHT * (v == 0).sum(axis=1))))
    one_hot = (v[:, :, None] == np.arange(3)).astype(float)
    for _ in range(steps):
        logs = []
        for side, most in ((good, MAX_FALSE), (1 - good, 1.0)):
            w = counts * side
            table = (np.einsum("n,nmk->mk", w, one_hot) + 1.0) / (w.sum() + 3.0)
            table[:, 0] = np.minimum(table[:, 0], most)
            share = (w.sum() + 1.0) / (counts.sum() + 2.0)
            logs.append(np.log(share) + np.einsum("nmk,mk->n", one_hot, np.log(table)))
        new = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -50, 50)))
        if np.abs(new - good).max(initial=0.0) < 1e-9:
            break
        good = new
    return good


_RUN = re.compile(r"(.)\1+")


_SHAPES = Memory()


def shape_bucket(word: str) -> int:
    """Bucket of a word's shape: letters to A or a, digits to 0, marks as they are, runs as one."""
    if len(word) > 64:
        return _bucket("long")
    shape = "".join(
        "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word
    )
    return _bucket(_RUN.sub(r"\1", shape))


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: shares of word shapes, how often words and lines repeat the one before, a constant."""
    words = text.split()
    _SHAPES.fill(set(words), lambda new: map(shape_bucket, new))
    counts = Counter(map(_SHAPES.__getitem__, words))
    idx, val = list(counts), [n / len(words) for n in counts.values()]
    lines = [x for x in text.split("\n") if x.strip()]
    for name, parts in (("words", words), ("lines", lines)):
        varied = int(10 * sum(map(eq, parts, parts[1:])) / len(parts)) if parts else -1
        idx.append(_bucket(f"\t{name} {varied}"))
        val.append(0.3)
    idx.append(_bucket("\tconstant"))
    val.append(1.0)
    return np.array(idx, np.int32), np.array(val, np.float32)


def train(docs: DataFrame, posterior: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights of the hashed scorer, by gradient steps over a written table of sparse rows.

    ``posterior`` has ``(doc_id, good)``. A step sends out the weights and brings back one
    sum for each bucket.
    """
    spark = docs.sparkSession
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    sample = (
        posterior.where("doc_id is not null").groupBy("doc_id").agg(F.avg("good").alias("good"))
        .orderBy(*order).limit(rows).withColumnRenamed("doc_id", "picked")
    )
    # bounded by ``rows``
    picked = id_text(docs).join(F.broadcast(sample), F.col("doc_id") == F.col("picked"))

    def make():
        def apply(batch):
            got = [features(t.as_py()) for t in batch.column("text")]
            return {"idx": [i for i, _ in got], "val": [v for _, v in got], "good": batch.column("good")}

        return apply

    table = materialize(
        map_batches(picked.select("text", "good"), "idx array<int>, val array<float>, good double", make),
        "quality-train",
    )
    weights, seen = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    total = table.count()
    for _ in range(STEPS if total else 0):
        sent = spark.sparkContext.broadcast(weights)
        got = (
            map_batches(table, "bucket int, slope double", lambda sent=sent: lambda b: _slopes(b, sent.value))
            .groupBy("bucket").agg(F.sum("slope").alias("slope")).toArrow()
        )
        slope = RIDGE * weights
        slope[got["bucket"].to_numpy()] += got["slope"].to_numpy() / total
        seen += slope**2
        weights = weights - RATE * slope / np.sqrt(seen)
        sent.unpersist()
    return weights


def _slopes(batch, weights: np.ndarray) -> dict:
    idx, val = batch.column("idx"), batch.column("val").flatten().to_numpy()
    sizes = np.diff(idx.offsets.to_numpy())
    row, at = np.repeat(np.arange(len(sizes)), sizes), idx.flatten().to_numpy()
    z = np.bincount(row, weights=weights[at] * val, minlength=len(sizes))
    error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - batch.column("good").to_numpy()
    sums = np.bincount(at, weights=error[row] * val, minlength=BUCKETS)
    used = np.unique(at)
    return {"bucket": used.astype(np.int32), "slope": sums[used]}


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``(doc_id, score)`` of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        def apply(batch):
            texts = batch.column("text").to_pylist()
            return {"doc_id": batch.column("doc_id"), "score": [text_score(t, sent.value) for t in texts]}

        return apply

    return map_batches(id_text(docs), "doc_id long, score double", make)


def text_score(text: str, weights: np.ndarray) -> float:
    idx, val = features(text)
    return float(1 / (1 + np.exp(-np.clip(weights[idx] @ val, -40, 40))))


def reject_low(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents, with all their columns, whose score is high enough."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, rows))
    return filter_texts(
        docs, lambda: lambda texts: [text_score(t, sent.value) >= KEEP_FROM for t in texts]
    )


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Votes on all documents, accuracies by EM, and the scorer trained on the posteriors."""
    spark = docs.sparkSession
    patterns = materialize(vote_patterns(docs), "quality-votes")
    counted = patterns.groupBy("pattern").count().orderBy("pattern").toArrow()
    codes, counts = (c.to_numpy() for c in counted.columns)
    good = estimate(codes, counts.astype(float)) if len(codes) else np.empty(0)
    table = spark.createDataFrame(
        list(zip(codes.tolist(), good.tolist())), "pattern int, good double"
    )
    # at most 3 ** len(LABELLERS) rows
    posterior = patterns.join(F.broadcast(table), "pattern").select("doc_id", "good")
    return train(docs, posterior, rows)


def quality(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``(doc_id, score, predicted)``: chance of good text, and 1 where it is kept.

    NULL and wordless texts count as empty ones, which every labeller votes against.
    Repeated rows are kept; of the columns only ``doc_id`` and ``text`` are read.
    """
    scored = score(docs, fit(docs, rows))
    return scored.withColumn("predicted", (F.col("score") >= KEEP_FROM).cast("int"))

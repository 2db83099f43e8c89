"""Packing token sequences of documents into sequences of fixed capacity.

Only the histogram of lengths reaches the driver, at most ``capacity`` numbers. On it the
configuration linear program (how often to use which multiset of lengths, so that every length
is covered as often as it occurs, with as few sequences as can be) is solved by multiplicative
weights: each length has a weight, a knapsack dynamic program prices configurations, lengths
that have been covered less than their share gain weight, and a closing round covers the rest.
Amounts are rounded to whole sequences; what that leaves is packed best-fit. The resulting plan has a size that depends on
the capacity alone, and every document finds its place from its rank among its length.
"""

from __future__ import annotations

import re
import string
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keytide.llm.textio import Memory, id_text, map_batches
from keytide.session import materialize

CAPACITY = 4096
END_ID = 1
#: Rounds of multiplicative weights, and how fast weights follow what is covered.
ROUNDS, RATE = 16, 0.5
#: Configurations worth less than this share of the best are not used in a round but the closing
#: one. Lengths that lose less than TIE of it fill up alike; a configuration that lost more than
#: SLACK because lengths were used up is priced again.
GOOD, TIE, SLACK = 0.98, 1e-4, 2e-3
#: Characters of chunks that a task remembers; those longer than LONGEST are encoded each time.
REMEMBERED_CHARS, LONGEST = 24 << 20, 64

#: Python's str.split also parts words at these, the tokenizer does not.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


class ChunkEncoder:
    """Ids of whole texts by a tokenizer that drops white space, so that chunks between white
    space can be encoded once and remembered.

    The tokenizer takes letters as one word and the marks after them as another. Chunks of that
    form, Latin-1 letters alone or before ASCII marks, are put together from words that its model
    merges once; its normalizer and patterns would take most of the time. Others take the whole
    way through it.
    """

    _of_path: dict[str, ChunkEncoder] = {}

    def __init__(self, path: str) -> None:
        import os
        import sys

        from tokenizers import Tokenizer

        # a task has one core: threads of the tokenizer would only wait for each other
        os.environ["TOKENIZERS_PARALLELISM"] = "false"

        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are taken as little-endian 32-bit numbers")

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        #: What the model gets for the letters beyond ASCII.
        shown = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.letters = {c: shown(chr(c))[0][0] for c in range(128, 256) if chr(c).isalpha()}
        self.known = Memory(REMEMBERED_CHARS)

    @classmethod
    def of(cls, path: str) -> ChunkEncoder:
        """One for each worker process."""
        if path not in cls._of_path:
            cls._of_path[path] = cls(path)
        return cls._of_path[path]

    def forget(self) -> None:
        """For the end of a task: the worker goes on to other stages."""
        self.known = Memory(REMEMBERED_CHARS)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        odd = any(c in text for c in _SEPARATORS)
        chunks = [c for c in _SPACE.split(text) if c] if odd else plain(text).split()
        ids = list(map(self.known.get, chunks))
        if new := [k for k, known in enumerate(ids) if known is None]:
            made = self._new({chunks[k] for k in new})
            for k in new:
                ids[k] = made[chunks[k]]
        return b"".join(ids)

    def _new(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks that are not known; from now on they are, but for the long ones."""
        long = [c for c in chunks if len(c) > LONGEST]
        chunks = chunks.difference(long)
        self.known.fill(chunks, self._make)
        return {c: self.known[c] for c in chunks} | dict(zip(long, self._make(long)))

    def _make(self, chunks: list[str]) -> list[bytes]:
        made: list[bytes] = []
        merged: dict[str, bytes] = {}
        whole = []
        for k, chunk in enumerate(chunks):
            word = chunk.rstrip(string.punctuation)
            marks = chunk[len(word) :]
            if word.isalpha() and (word.isascii() or max(word) <= "\xff") and "<|" not in marks:
                ids = self._word(word.lower(), merged)
                made.append(ids + self._word(marks, merged) if marks else ids)
            else:
                whole.append(k)
                made.append(b"")
        encoded = self.tokenizer.encode_batch_fast([chunks[k] for k in whole], add_special_tokens=False)
        for k, e in zip(whole, encoded):
            made[k] = array("I", e.ids).tobytes()
        return made

    def _word(self, word: str, merged: dict[str, bytes]) -> bytes:
        """Ids of lower-case letters or of marks, which may be known as a chunk."""
        ids = self.known.get(word) or self.known.before.get(word) or merged.get(word)
        if ids is None:
            shown = word if word.isascii() else word.translate(self.letters)
            ids = merged[word] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return ids


def plain(text: str) -> str:
    """The text in lower case where that is sure to be what the tokenizer makes of it: Latin-1
    is composed already and has no letters whose case depends on what is around them."""
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, part, rank)``: documents cut at ``capacity``.

    ``rank`` counts pieces of the same length within the task ``part`` that made them.
    """
    end = np.array([end_id], "<u4").tobytes()

    def make():
        encoder = ChunkEncoder.of(tokenizer)
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)

        def apply(batch):
            rows = []
            for i, text in enumerate(batch.column("text")):
                ids = encoder.encode(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    some = ids[at : at + 4 * capacity]
                    n = len(some) // 4
                    rows.append((i, piece, at // 4, n, zlib.crc32(some), part, seen[n]))
                    seen[n] += 1
            of, piece, start, length, crc, parts, rank = zip(*rows)
            return {
                "doc_id": batch.column("doc_id").take(_int64(of)), "piece": piece, "start": start,
                "length": length, "ids_crc32": crc, "part": parts, "rank": rank,
            }

        apply.finish = encoder.forget
        return apply

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
    return map_batches(id_text(docs), schema, make)


def _int64(values):
    import pyarrow as pa

    return pa.array(values, pa.int64())


@dataclass(frozen=True)
class Plan:
    """Slots in order of (length, first rank): ``count`` ranks from ``rank`` on, ``each`` of
    them in a sequence, the first sequence being ``sequence``, at ``offset`` in it."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these lengths and ranks."""
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        begins = np.searchsorted(self.length, [length, length + 1])
        for n in np.unique(length):
            rows = np.flatnonzero(length == n)
            lo, hi = begins[0][rows[0]], begins[1][rows[0]]
            at = lo + np.searchsorted(self.rank[lo:hi], rank[rows], side="right") - 1
            since = rank[rows] - self.rank[at]
            sequence[rows] = self.sequence[at] + since // self.each[at]
            offset[rows] = self.offset[at] + since % self.each[at] * n
        return sequence, offset


def knapsack(lengths: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best weight for every capacity, lengths used as often as fits, and the last length taken
    (0: none)."""
    best, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    worth = np.full(capacity + 1, -np.inf)
    worth[lengths] = weights
    for c in range(1, capacity + 1):
        values = best[c - 1 :: -1] + worth[1 : c + 1]
        j = int(values.argmax())
        if values[j] > best[c - 1]:
            best[c], taken[c] = values[j], j + 1
        else:
            best[c] = best[c - 1]
    return best, taken


class Pricing:
    """Configurations of nearly the best weight, from the lengths that still lack cover.

    Where several lengths do equally well the choice is drawn in proportion to what each
    lacks, so that configurations of one round don't all use up the same few lengths.
    """

    def __init__(self, lengths: np.ndarray, weights: np.ndarray, capacity: int, draws) -> None:
        self.lengths, self.weights, self.capacity, self.draws = lengths, weights, capacity, draws
        self.price(np.ones(len(lengths), bool))

    def price(self, usable: np.ndarray) -> None:
        self.open = np.flatnonzero(usable)
        self.sizes, self.worth = self.lengths[self.open], self.weights[self.open]
        self.best, _ = knapsack(self.sizes, self.worth, self.capacity)

    def fill(self, first: int, left: np.ndarray) -> np.ndarray | None:
        """Places in ``lengths`` of a configuration with ``first``; None where the lengths that
        are left no longer reach the prices."""
        lack = left[self.open]
        config, room = [first], self.capacity - int(self.lengths[first])
        equal, slack = (x * self.best[self.capacity] + 1e-9 for x in (TIE, SLACK))
        while self.best[room] > 0:
            room = int(np.searchsorted(self.best, self.best[room]))
            k = int(np.searchsorted(self.sizes, room, side="right"))
            loss = self.best[room] - self.best[room - self.sizes[:k]] - self.worth[:k]
            loss[lack[:k] <= 0] = np.inf
            near = np.flatnonzero(loss <= min(equal, slack))
            if not len(near):
                near = loss.argmin(keepdims=True)
                if loss[near[0]] > slack:
                    return None
            chance = np.cumsum(lack[near])
            j = near[min(int(np.searchsorted(chance, self.draws.random() * chance[-1], side="right")), len(near) - 1)]
            config.append(int(self.open[j]))
            slack -= max(0.0, float(loss[j]))
            room -= int(self.sizes[j])
        return np.array(config)


def configurations(
    lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS
) -> dict[tuple[int, ...], float]:
    """A fractional solution of the configuration program: configuration to amount.

    In a round, a dynamic program prices configurations by the weights; those near the best take
    up what every length still lacks of this round's share. When the lengths that fill up others
    are used up, the rest are priced again. The closing round takes whatever is left, so that
    every length is covered.
    """
    weights = lengths / capacity
    left, amounts = counts.astype(float), {}
    draws = np.random.default_rng(len(lengths))
    for t in range(1, rounds + 2):
        closing = t > rounds
        pricing = Pricing(lengths, weights, capacity, draws)
        pricing.price(left > 0)
        share = counts * (min(t, rounds) / rounds)
        for j in np.argsort(-lengths, kind="stable"):
            while left[j] > 0 and (lack := share[j] - (counts[j] - left[j])) > 1e-9 * counts[j]:
                value = pricing.weights[j] + pricing.best[capacity - lengths[j]]
                if not closing and value < GOOD * pricing.best[capacity]:
                    break
                config = pricing.fill(int(j), left)
                if config is None:
                    pricing.price(left > 0)
                    continue
                used, times = np.unique(config, return_counts=True)
                # no length is covered beyond its number
                amount = min(lack / times[used == j][0], (left[used] / times).min())
                key = tuple(sorted(lengths[config].tolist(), reverse=True))
                amounts[key] = amounts.get(key, 0.0) + amount
                left[used] -= amount * times
                left[used[left[used] <= 1e-9 * counts[used]]] = 0.0
        weights = weights * np.exp(RATE * (share - (counts - left)) / counts)
        weights /= knapsack_scale(weights, lengths, capacity)
    return amounts


def knapsack_scale(weights: np.ndarray, lengths: np.ndarray, capacity: int) -> float:
    """Keeps weights near the share of capacity that they stand for."""
    return float((weights * capacity / lengths).mean()) or 1.0


def rounded(
    solved: dict[tuple[int, ...], float], counts: dict[int, int], capacity: int = CAPACITY
) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Whole numbers of configurations, and how many pieces of each length are left over.

    Amounts are rounded down; then full configurations that lost half or more get one more,
    those that lost most first, while their pieces last.
    """
    left, times = dict(counts), {}
    needs = {config: {n: config.count(n) for n in config} for config in solved}

    def take(config: tuple[int, ...], most: int) -> None:
        got = min(most, *(left[n] // m for n, m in needs[config].items()))
        times[config] = times.get(config, 0) + got
        for n, m in needs[config].items():
            left[n] -= m * got

    for config, amount in sorted(solved.items(), key=lambda x: -x[1]):
        take(config, int(amount + 1e-9))
    for config, amount in sorted(solved.items(), key=lambda x: times[x[0]] - x[1]):
        if sum(config) == capacity and amount - times[config] >= 0.5:
            take(config, 1)
    return [(config, n) for config, n in times.items() if n], left


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> dict[tuple[int, ...], int]:
    """Best-fit decreasing; equal pieces and equal sequences are handled together."""
    by_room: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    open_ = np.zeros(capacity + 1, bool)

    def put(room: int, config: tuple[int, ...], times: int) -> None:
        if times:
            by_room[room][config] = by_room[room].get(config, 0) + times
            open_[room] = True

    for n, todo in zip(lengths[::-1].tolist(), counts[::-1].tolist()):
        todo = int(todo)
        while todo:
            fits = np.flatnonzero(open_[n:])
            room = n + int(fits[0]) if len(fits) else capacity
            config, there = by_room[room].popitem() if len(fits) else ((), todo)
            open_[room] = bool(by_room[room])
            # a sequence that has taken one is the fullest that takes the next
            each = room // n
            full = min(there, todo // each)
            todo -= full * each
            put(room - n * each, config + (n,) * each, full)
            if full < there:
                put(room - n * todo, config + (n,) * todo, 1 if todo else 0)
                put(room, config, there - full - (1 if todo else 0) if len(fits) else 0)
                todo = 0
    out: dict[tuple[int, ...], int] = {}
    for configs in by_room:
        for config, times in configs.items():
            out[config] = out.get(config, 0) + times
    return out


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Solve, round down, pack the rest, and lay the slots out by rank."""
    order = np.argsort(lengths)
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    left = dict(zip(lengths.tolist(), counts.tolist()))
    solved = configurations(lengths, counts, capacity) if len(lengths) else {}
    chosen, left = rounded(solved, left, capacity)
    rest = np.array([left[n] for n in lengths.tolist()], np.int64)
    chosen += best_fit(lengths, rest, capacity).items()
    slots, used, sequence = [], dict.fromkeys(left, 0), 0
    for config, times in chosen:
        offset = 0
        for n in sorted(set(config), reverse=True):
            m = config.count(n)
            slots.append((n, used[n], sequence, m, offset))
            used[n] += m * times
            offset += m * n
        sequence += times
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 5).T
    return Plan(*table, sequences=sequence)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, a row for each piece.

    Every document ends with ``end_id``, so NULL and empty texts are one piece of length 1.
    Repeated rows are packed as often as they come. Of the columns only ``doc_id`` and ``text``
    are read.
    """
    cut = materialize(pieces(docs, tokenizer, capacity, end_id), "pieces")
    by_part = materialize(
        cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts"
    )
    histogram = by_part.groupBy("length").agg(F.sum("n").alias("n")).toArrow()
    made = plan(*(c.to_numpy() for c in histogram.columns), capacity)
    # ranks go on from task to task
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    ranked = cut.join(by_part.select("part", "length", before.alias("before")), ["part", "length"])
    sent = docs.sparkSession.sparkContext.broadcast(made)

    def make():
        def apply(batch):
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = sent.value.places(length, rank)
            return {c: batch.column(c) for c in batch.schema.names} | {
                "sequence_id": sequence, "offset": offset,
            }

        return apply

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = ranked.select(*columns, (F.col("rank") + F.col("before")).alias("rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return map_batches(ranked, schema, make)

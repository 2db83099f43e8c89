"""Repeated passages by a sparse suffix array over words.

1. Of every document only the suffixes at *minimiser* positions are retained: of all runs of
   ANCHOR_WORDS words inside a window of MIN_WORDS words the one with the smallest hash. The
   choice depends on the window's words alone, so wherever a passage of MIN_WORDS words
   occurs again, the same suffix of it is retained.
2. Retained suffixes are sorted by their first words; those that agree with no other go.
   Stretches of windows around a suffix that are equal as a whole are reduced to the first.
3. The others are extended, to the left and to the right of the anchor, into all windows of
   MIN_WORDS words that hold it. These are sorted by content and compared with their
   neighbours: a window that equals an earlier one is a repeat.

The result is exact: a word is in a repeated passage if a window of MIN_WORDS words around it
occurs earlier, in order of document, text hash and position.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.llm.textio import Memory, map_batches
from keytide.session import materialize

MIN_WORDS = 50
ANCHOR_WORDS = 12
_M = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_M), -1, 1 << 64))
_POSITION = np.uint64((1 << 24) - 1)


def keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, row, text)``: rows are told apart by ``row``, a hash of the text.

    Rows of one id with the same text are one document; NULL texts are empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text")
    )


class Words:
    """Hashes of the words of a text, and of any stretch of them."""

    def __init__(self, text: str, known: Memory) -> None:
        from xxhash import xxh64_intdigest

        words = text.split()
        known.fill(set(words), lambda new: [xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in new])
        self.n = len(words)
        self.h = np.fromiter(map(known.__getitem__, words), np.uint64, self.n)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.r_[np.uint64(1), np.full(self.n, _M)])
            self.back = np.cumprod(np.r_[np.uint64(1), np.full(self.n, _INVERSE)])
            self.sums = np.r_[np.uint64(0), np.cumsum(self.h * powers[:-1])]

    def stretch(self, start: np.ndarray, length) -> np.ndarray:
        """Hash of ``length`` words from ``start``, wherever they stand."""
        with np.errstate(over="ignore"):
            raw = (self.sums[start + length] - self.sums[start]) * self.back[start]
            raw = (raw ^ (raw >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.asarray(length).astype(np.uint64)
            return raw ^ (raw >> np.uint64(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchored_runs(words: Words, min_words: int = MIN_WORDS, anchor_words: int = ANCHOR_WORDS):
    """Anchor hash, first and last window start, and hash of all words, of each run of windows
    that retain the same suffix."""
    windows = words.n - min_words + 1
    if windows <= 0:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(np.uint64)
    grams = words.stretch(np.arange(words.n - anchor_words + 1), anchor_words)
    ranked = (grams & ~_POSITION) | (np.arange(len(grams)).astype(np.uint64) & _POSITION)
    least = _sliding_min(ranked, min_words - anchor_words + 1)
    starts = np.arange(windows)
    anchor = starts + ((least.astype(np.int64) - starts) & int(_POSITION))
    lo = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    hi = np.r_[lo[1:] - 1, windows - 1]
    return grams[anchor[lo]], lo, hi, words.stretch(lo, hi - lo + min_words)


def retained(docs: DataFrame) -> DataFrame:
    """``(anchor, run, doc_id, row, lo, hi)``, a row for each retained suffix."""

    def make():
        known = Memory()

        def apply(batch):
            got = [anchored_runs(Words(t.as_py(), known)) for t in batch.column("text")]
            of = np.repeat(np.arange(len(got)), [len(g[1]) for g in got])
            anchor, lo, hi, run = (np.concatenate([g[i] for g in got]) for i in range(4))
            return {
                "anchor": anchor.view(np.int64), "run": run.view(np.int64),
                "doc_id": batch.column("doc_id").take(pa.array(of)),
                "row": batch.column("row").take(pa.array(of)),
                "lo": lo.astype(np.int32), "hi": hi.astype(np.int32),
            }

        return apply

    schema = "anchor long, run long, doc_id long, row long, lo int, hi int"
    return map_batches(keyed(docs), schema, make)


def extended(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """``(content, doc_id, row, pos)``: every window of the runs in ``firsts``."""
    runs = firsts.groupBy(F.col("doc_id").alias("of_id"), F.col("row").alias("of_row")).agg(
        F.collect_list(F.struct("lo", "hi")).alias("runs")
    )
    texts = keyed(docs)
    same = texts["doc_id"].eqNullSafe(runs["of_id"]) & (texts["row"] == runs["of_row"])

    def make():
        known = Memory()

        def apply(batch):
            content, of, pos = [], [], []
            for i, (text, spans) in enumerate(zip(batch.column("text"), batch.column("runs"))):
                at = np.unique(np.concatenate([np.arange(s["lo"], s["hi"] + 1) for s in spans.as_py()]))
                content.append(Words(text.as_py(), known).stretch(at, MIN_WORDS).view(np.int64))
                of.append(np.full(len(at), i))
                pos.append(at.astype(np.int32))
            take = pa.array(np.concatenate(of))
            return {
                "content": np.concatenate(content), "doc_id": batch.column("doc_id").take(take),
                "row": batch.column("row").take(take), "pos": np.concatenate(pos),
            }

        return apply

    joined = texts.join(runs, same).select("doc_id", "row", "text", "runs")
    return map_batches(joined, "content long, doc_id long, row long, pos int", make)


_COMPARED = "part int, doc_id long, row long, pos int, first_doc_id long, opens boolean, content long"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each window with the one before it in sorted order.

    Yields the repeats, all windows of the partition's first content (``opens``: whether they
    are repeats is known only with the partition before), and a last row with ``-1 - part`` for
    the content that the partition ends with and its first window.
    """
    part = TaskContext.get().partitionId()
    schema = pa.schema(
        [("part", pa.int32()), ("doc_id", pa.int64()), ("row", pa.int64()), ("pos", pa.int32()),
         ("first_doc_id", pa.int64()), ("opens", pa.bool_()), ("content", pa.int64())]
    )

    def out(doc, row, pos, first, opens, content, part=part):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(doc), part, np.int32)), _nulls(doc), pa.array(row),
             pa.array(pos.astype(np.int32)), _nulls(first), pa.array(opens), pa.array(content)], schema=schema
        )

    head = None
    for batch in batches:
        if not batch.num_rows:
            continue
        content, row, pos = (batch.column(c).to_numpy() for c in ("content", "row", "pos"))
        doc = batch.column("doc_id").fill_null(_NO_ID).to_numpy()
        if head is None:
            head, last, first = content[0], None, None
        # the last content goes on in front of this batch, with its first window
        joined = last is not None and content[0] == last
        new = np.r_[not joined, content[1:] != content[:-1]]
        start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        of = np.stack([doc, row, pos.astype(np.int64)])
        firsts = of[:, start]
        if joined:
            firsts[:, : np.argmax(new) if new.any() else len(new)] = np.array(first)[:, None]
        # a document that is there twice does not repeat itself
        repeat = (firsts != of).any(axis=0)
        keep = np.flatnonzero((content == head) | repeat)
        last, first = content[-1], firsts[:, -1].tolist()
        yield out(doc[keep], row[keep], pos[keep], firsts[0][keep], content[keep] == head, content[keep])
    if head is not None:
        doc, row, pos = (np.array([x]) for x in first)
        yield out(doc, row, pos, doc, np.array([head == last]), np.array([last]), -1 - part)


_NO_ID = -(1 << 63)


def _nulls(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, mask=ids == _NO_ID)


def repeated_windows(windows: DataFrame) -> DataFrame:
    """``(doc_id, row, pos, first_doc_id)`` of all windows whose content occurs earlier.

    Sorted over all partitions, so that a content in a third of all documents is no hot group;
    what spans partitions is settled with one row of each partition.
    """
    spark = windows.sparkSession
    order = ("content", "doc_id", "row", "pos")
    ordered = windows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = materialize(ordered.select(*order).mapInArrow(_compare, _COMPARED), "suffix-neighbours")
    # two rows of each partition: its first and its last content, each with its first window
    ends = found.where("part < 0").orderBy(F.col("part").desc()).collect()
    heads = {
        r.part: r
        for r in found.where("part >= 0 and opens").groupBy("part", "content")
        .agg(F.min(F.struct("doc_id", "row", "pos")).alias("m")).select("part", "content", "m.*").collect()
    }
    carried, before = [], None
    for end in ends:
        head = heads[-1 - end.part]
        if before is not None and before.content == head.content:
            head = before
        carried.append((-1 - end.part, head.doc_id, head.row, head.pos))
        before = head if end.opens else end
    table = spark.createDataFrame(carried, "open_part int, of_id long, of_row long, of_pos int")
    inside = found.where("part >= 0 and not opens").select("doc_id", "row", "pos", "first_doc_id")
    own = F.struct("doc_id", "row", "pos").eqNullSafe(
        F.struct(F.col("of_id").alias("doc_id"), F.col("of_row").alias("row"), F.col("of_pos").alias("pos"))
    )
    opened = (
        found.where("part >= 0 and opens")
        .join(F.broadcast(table), F.col("part") == F.col("open_part"))
        .where(~own)
        .select("doc_id", "row", "pos", F.col("of_id").alias("first_doc_id"))
    )
    return inside.union(opened)


def repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, row, start, words, first_doc_id)``: the repeated passages of each document.

    ``start`` and ``words`` count words; overlapping repeats are one passage. The first
    occurrence of a passage is none. Texts of fewer than MIN_WORDS words have none. Columns
    other than ``doc_id`` and ``text`` are not read.
    """
    runs = materialize(retained(docs), "suffixes")
    first = F.min(F.struct("doc_id", "row", "lo", "hi")).alias("first")
    groups = materialize(
        runs.groupBy("anchor", "run").agg(F.count(F.lit(1)).alias("n"), first), "suffix-runs"
    )
    # suffixes whose first words no other has are no longer looked at
    shared = groups.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    extend = groups.join(shared, "anchor", "left_semi").select("first.*")
    windows = materialize(extended(docs, extend), "suffix-windows")
    single = repeated_windows(windows).select(
        "doc_id", "row", F.col("pos").alias("lo"), F.col("pos").alias("hi"), "first_doc_id"
    )
    copies = groups.where("n > 1").select("anchor", "run", "first")
    whole = (
        runs.join(copies, ["anchor", "run"])
        .where(~F.struct("doc_id", "row", "lo", "hi").eqNullSafe(F.col("first")))
        .select("doc_id", "row", "lo", "hi", F.col("first.doc_id").alias("first_doc_id"))
    )
    found = single.union(whole).groupBy("doc_id", "row").agg(
        F.collect_set(F.struct("lo", "hi", "first_doc_id")).alias("found")
    )

    def make():
        def apply(batch):
            out, of = [], []
            for i, spans in enumerate(batch.column("found")):
                merged = merge([(s["lo"], s["hi"] + MIN_WORDS, s["first_doc_id"]) for s in spans.as_py()])
                out += merged
                of += [i] * len(merged)
            take = pa.array(of, pa.int64())
            return {
                "doc_id": batch.column("doc_id").take(take), "row": batch.column("row").take(take),
                "start": [s for s, _, _ in out], "words": [e - s for s, e, _ in out],
                "first_doc_id": [f for _, _, f in out],
            }

        return apply

    return map_batches(found, "doc_id long, row long, start long, words long, first_doc_id long", make)


def merge(spans: list[tuple[int, int, int | None]]) -> list[tuple[int, int, int | None]]:
    """Union of half-open spans in order, each with the smallest id of its parts."""
    out: list[tuple[int, int, int | None]] = []
    for lo, hi, first in sorted(spans, key=lambda s: s[:2]):
        if out and lo <= out[-1][1]:
            a, b, f = out[-1]
            known = [x for x in (f, first) if x is not None]
            out[-1] = (a, max(b, hi), min(known, default=None))
        else:
            out.append((lo, hi, first))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of ``spans`` (half-open, in order) and the space after them."""
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    kept, at = [], 0
    for lo, hi in spans:
        kept.append(text[at : words[lo][0]])
        at = words[hi][0] if hi < len(words) else words[hi - 1][1]
    return "".join([*kept, text[at:]])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """All documents, without the passages that occur earlier; ``n_chars`` follows the text.

    A document all of whose words are repeated stays, with what white space is left.
    """
    columns = docs.columns
    spans = repeats(docs).groupBy(F.col("doc_id").alias("of_id"), F.col("row").alias("of_row")).agg(
        F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("words")).alias("end")))).alias("spans")
    )
    # columns of the documents stay inside ``doc``, whatever their names
    whole = docs.select(
        F.struct(*[docs[c] for c in columns]).alias("doc"),
        docs["doc_id"].cast("long").alias("id"),
        F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("hash"),
    )
    same = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("hash") == F.col("of_row"))
    joined = whole.join(spans, same, "left").select("doc", "spans")

    def make():
        def apply(batch):
            doc = batch.column("doc")
            texts = [
                cut(t.as_py(), [(s["start"], s["end"]) for s in spans.as_py()])
                for t, spans in zip(doc.field("text"), batch.column("spans"))
            ]
            out = {c: doc.field(c) for c in columns} | {"text": texts}
            if "n_chars" in columns:
                out["n_chars"] = [len(t) for t in texts]
            return out

        return apply

    # only documents with repeats go through Python
    dirty = map_batches(joined.where("spans is not null"), docs.schema, make)
    return joined.where("spans is null").select("doc.*").union(dirty)

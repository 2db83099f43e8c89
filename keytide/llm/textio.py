"""Small helpers shared by the operators: typed inputs and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def id_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` as long and ``text`` as string, NULL text as empty; other columns go."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


#: Bytes of text that a function of one batch gets at once, and characters that a memory of words holds.
SLICE_BYTES, REMEMBERED_CHARS, ENTRY = 2 << 20, 4 << 20, 32


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most SLICE_BYTES of ``text``, or one row; without that column as it is."""
    if "text" not in batch.schema.names or batch.num_rows < 2:
        yield batch
        return
    sizes = pc.binary_length(batch.column("text").cast(pa.binary())).fill_null(0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    at = done = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, done + SLICE_BYTES, side="right")))
        yield batch.slice(at, to - at)
        at, done = to, int(ends[to - 1])


def give_back() -> None:
    """Workers live on from stage to stage: what Arrow freed goes back to the system."""
    pa.default_memory_pool().release_unused()


class Memory(dict):
    """What is known of words, bounded in bytes, so that what a worker keeps from task to task stays
    small. When half of the bound is full it starts anew, and takes over from what was known
    before the words that come again: frequent ones are never lost to a flood of rare ones."""

    def __init__(self, most: int = REMEMBERED_CHARS) -> None:
        super().__init__()
        self.most, self.chars = most, 0
        self.before: dict = {}

    def fill(self, words: Collection[str], make: Callable[[list[str]], Iterable]) -> None:
        """See that all ``words`` are known; ``make`` gives the values of new ones, in their order.

        An entry counts as its characters and a fixed part.
        """
        new = [w for w in words if w not in self]
        if not new:
            return
        if 2 * (self.chars + sum(map(len, new)) + ENTRY * len(new)) > self.most and self:
            self.before = dict(self)
            self.clear()
            self.chars, new = 0, list(words)
        before = self.before
        self.update((w, before[w]) for w in new if w in before)
        unseen = [w for w in new if w not in before]
        self.update(zip(unseen, make(unseen)) if unseen else ())
        self.chars += sum(map(len, new)) + ENTRY * len(new)


def map_batches(
    df: DataFrame, schema: str | StructType, make: Callable[[], Callable[[pa.RecordBatch], dict]]
) -> DataFrame:
    """``mapInArrow`` for functions of one batch; ``make`` builds the task's function once.

    A function returns a dict of columns (lists, numpy or Arrow arrays). If it has a ``finish``, that
    is called at the end of the task.
    """
    struct = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(struct)
        apply = make()
        for batch in batches:
            for some in slices(batch) if batch.num_rows else ():
                out = apply(some)
                yield pa.RecordBatch.from_arrays(
                    [as_array(out[f.name], f.type) for f in arrow], schema=arrow
                )
            give_back()
        if finish := getattr(apply, "finish", None):
            finish()

    return df.mapInArrow(run, struct)


def filter_texts(
    docs: DataFrame, make: Callable[[], Callable[[list[str]], list[bool]]]
) -> DataFrame:
    """The rows, with all their columns, whose ``text`` (NULL: empty) the function keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            for some in slices(batch) if batch.num_rows else ():
                texts = [t or "" for t in some.column("text").to_pylist()]
                yield some.filter(pa.array(keep(texts), pa.bool_()))
            give_back()

    return docs.mapInArrow(run, docs.schema)


def as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)

"""How the sources of a language differ in their words, exactly, from bitmaps of term ids.

A language's terms are dealt to blocks of at most 256, each term a bit of its block. A group
(language and source) has, in every block, one bitmap for each number of occurrences: the terms
that it uses so often; the terms it doesn't use are the complement. For two groups, the bits that
two bitmaps share say how many terms are used ``c`` times by one and ``d`` times by the other, and
all these terms differ by the same amount, so terms are never compared one by one.

Terms of like frequency share a block, so that rare terms, the most by far, have few bitmaps. On
Spark: words are counted in the tasks that read them, added up by (group, term), so no group or
word meets in one task uncounted. A task of the comparison holds one block for two sets of groups.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from keytide.functions.joins import dimension_join
from keytide.session import materialize

MIN_DOCUMENTS, SMOOTHING, UNIT, TOP_TERMS = 30, 5, 1_000_000_000, 50
#: Terms of a block (64 to a word of a bitmap) and groups of a set; blocks are filled to the half
#: on average, so that hardly one is overfull and has to be cut.
BLOCK_TERMS, SET_GROUPS = 256, 64
WORDS = BLOCK_TERMS // 64
#: Bytes of a text that are parted at once, and different words that a task holds before it sends them on.
PIECE, HELD = 1 << 20, 200_000
GROUP = ("lang", "source")

_LETTERS = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B))
#: A-Z to a-z, every other ASCII character but letters to a blank; the rest stays.
_TABLE = bytes(
    c if c >= 0x80 else (ord(chr(c).lower()) if c in _LETTERS else 0x20) for c in range(256)
)


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and (text[end] >= 0x80 or text[end] in _LETTERS):
            end += 1
        yield text[at:end].translate(_TABLE).split()
        at = end


def count_terms(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, count, docs)``: occurrences and documents, added up in each task."""
    schema = StructType.fromDDL("lang string, source string, term string, count long, docs long")
    texts = docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*GROUP, "text")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, tuple[Counter, Counter]] = {}

        def flush() -> pa.RecordBatch:
            columns: list[list] = [[], [], [], [], []]
            for (lang, source), (often, where) in counts.items():
                for column, values in zip(
                    columns,
                    ([lang] * len(often), [source] * len(often), often, often.values(), map(where.get, often)),
                ):
                    column.extend(values)
            counts.clear()
            columns[2] = pa.array(columns[2], pa.binary()).cast(pa.string())
            arrays = [pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(columns, arrow)]
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        arrow = to_arrow_schema(schema)
        held = 0
        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for lang, source, text in zip(langs, sources, batch.column("text").cast(pa.binary())):
                often, where = counts.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(often), set()
                for words in words_of(text.as_py()):
                    often.update(words)
                    own.update(words)
                where.update(own)
                held += len(often) - before
                if held > HELD:
                    yield flush()
                    held = 0
        if counts:
            yield flush()

    counted = texts.mapInArrow(run, schema)
    return counted.groupBy(*GROUP, "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(UNIT (count + SMOOTHING) / (total + SMOOTHING terms))``, exact at any size."""
    wide = lambda c: c.cast("decimal(20,0)")
    above = wide(count + SMOOTHING) * F.lit(UNIT).cast("decimal(10,0)")
    below = wide(total + terms * SMOOTHING)
    return F.call_function("div", above, below).cast("long") + 1


def in_blocks(kept: DataFrame) -> DataFrame:
    """``kept (lang, term, total)`` with its ``block`` (dense from 0 in each language) and ``bit``.

    A block has terms whose totals have the same number of binary digits. It takes a share of them
    by hash, and is cut where it has more than its bits.
    """
    kept = materialize(kept.withColumn("level", F.length(F.bin("total"))), "divergence-kept")
    levels = kept.groupBy("lang", "level").agg(F.count(F.lit(1)).alias("n"))
    levels = levels.withColumn("cuts", F.ceil(F.col("n") / (BLOCK_TERMS // 2)).cast("long")).drop("n")
    dealt = dimension_join(kept, levels, ["lang", "level"])
    bucket = ["lang", "level", "bucket"]
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("cuts")))
    rank = F.row_number().over(Window.partitionBy(*bucket).orderBy("term")) - 1
    dealt = dealt.withColumns({"rank": rank}).withColumns(
        {"cut": F.floor(F.col("rank") / BLOCK_TERMS).cast("int"), "bit": (F.col("rank") % BLOCK_TERMS).cast("int")}
    )
    sizes = dealt.groupBy(*bucket, "cut").agg(F.count(F.lit(1)).alias("size"))
    block = F.row_number().over(Window.partitionBy("lang").orderBy("level", "bucket", "cut")) - 1
    sizes = materialize(sizes.withColumn("block", block), "divergence-blocks")
    return dealt.join(sizes, [*bucket, "cut"]).select("lang", "term", "total", "block", "bit", "size")


def bitmaps(cells: DataFrame) -> DataFrame:
    """``(lang, source, block, count, bits)`` of ``cells (lang, source, count, block, bit)``."""
    word = lambda w: F.bit_or(
        F.when(F.floor(F.col("bit") / 64) == w, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit") % 64)).otherwise(0)
    )
    return (
        cells.groupBy(*GROUP, "block", "count").agg(*[word(w).alias(f"w{w}") for w in range(WORDS)])
        .select(*GROUP, "block", "count", F.array(*[f"w{w}" for w in range(WORDS)]).alias("bits"))
    )


def compare_block(rows: pa.Table, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(group, others, sums)``: over the terms of a block, differences of a group of the left set
    and those of the right set (later ones, where both are one set).

    ``rows``: number of the group (``at``), its ``share`` for a bitmap, ``bits`` and ``side``. A row
    without bits has the share of terms that the group doesn't use.
    """
    at, side = rows["at"].to_numpy(), rows["side"].to_numpy()
    p = rows["share"].to_numpy()
    bits = rows["bits"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, WORDS).copy()
    order = np.lexsort((rows["count"].to_numpy(), at, side))
    at, side, p, bits = at[order], side[order], p[order], bits[order]
    # counts are at least 0, so the first row of a group is that of its unused terms
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (side[1:] != side[:-1])])
    full = np.array([(1 << max(0, min(64, size - 64 * w))) - 1 for w in range(WORDS)], np.uint64)
    bits[first] = full & ~np.bitwise_or.reduceat(bits, first)
    ends = np.r_[first[1:], len(at)]
    right = np.flatnonzero(side[first] == 1) if (side == 1).any() else np.arange(len(first))
    for k in np.flatnonzero(side[first] == 0):
        others = right if (side == 1).any() else right[right > k]
        if not len(others):
            continue
        lo, own = first[others[0]], slice(first[k], ends[k])
        sums = np.zeros(len(others), np.int64)
        # one level at a time, so that memory stays at the size of the block
        for level, value in zip(bits[own], p[own]):
            shared = np.bitwise_count(bits[lo:] & level).sum(axis=1, dtype=np.int64)
            sums += np.add.reduceat(shared * np.abs(p[lo:] - value), first[others] - lo)
        yield at[first[k]], at[first[others]], sums


def pair_sums(maps: DataFrame) -> DataFrame:
    """``(lang, a, b, value)`` with ``a < b``, numbers of groups, summed over all blocks.

    ``maps``: a row for each bitmap, and one of count 0 for each group and block, with ``sets``, the
    number of sets of groups in the language. Sets are paired with each other, so a task holds
    one block of at most two sets.
    """
    own = F.floor(F.col("at") / SET_GROUPS).cast("int")
    partner = F.explode(F.sequence(F.lit(0), F.col("sets") - 1))
    paired = maps.withColumn("own", own).withColumn("other", partner)
    paired = paired.select(
        "lang", "block", "size", "at", "count", "share", "bits",
        F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
    )

    def run(table: pa.Table) -> pa.Table:
        lang = table["lang"][0].as_py()
        found = list(compare_block(table, table["size"][0].as_py()))
        a = [np.full(len(o), g, np.int64) for g, o, _ in found]
        b, value = [o for _, o, _ in found], [s for _, _, s in found]
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        n = sum(map(len, b))
        columns = {"lang": pa.array([lang] * n, pa.string()), "a": join(a), "b": join(b), "value": join(value)}
        return pa.table(columns)

    keys = ("lang", "block", "low", "high")
    found = paired.groupBy(*keys).applyInArrow(run, "lang string, a long, b long, value long")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for each group of a language and a source.

    Part ``pair``: every other source of the language, by the sum of the differences over all kept
    terms. Part ``term``: the 50 terms whose share most exceeds the language's. A language keeps
    terms that at least 30 of its documents use. NULL texts, languages and sources are
    empty strings; every row is a document, whatever its id. A group without terms is a group; a
    language that keeps no terms has differences of 0. An empty table has no rows.
    """
    found = materialize(count_terms(docs), "divergence-counts")
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP]
    groups = docs.select(*named).distinct()
    kept = (
        found.groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= MIN_DOCUMENTS).drop("docs")
    )
    kept = materialize(in_blocks(kept), "divergence-terms")
    cells = materialize(found.drop("docs").join(kept, ["lang", "term"]), "divergence-cells")
    langs = kept.groupBy("lang").agg(
        F.sum("total").alias("lang_total"), F.count(F.lit(1)).alias("terms"), F.max("block").alias("last")
    )
    totals = cells.groupBy(*GROUP).agg(F.sum("count").alias("group_total"))
    by_name = Window.partitionBy("lang").orderBy("source")
    groups = groups.join(totals, list(GROUP), "left").join(langs, "lang", "left").select(
        *GROUP,
        F.coalesce("group_total", F.lit(0)).alias("group_total"),
        F.coalesce("lang_total", F.lit(0)).alias("lang_total"),
        F.coalesce("terms", F.lit(0)).alias("terms"),
        F.coalesce("last", F.lit(-1)).alias("last"),
        (F.row_number().over(by_name) - 1).cast("long").alias("at"),
    )
    groups = groups.withColumn(
        "sets", (F.floor(F.max("at").over(Window.partitionBy("lang")) / SET_GROUPS) + 1).cast("int")
    )
    groups = materialize(groups, "divergence-groups")

    own = share(F.col("count"), F.col("group_total"), F.col("terms"))
    used = dimension_join(bitmaps(cells), groups, list(GROUP))
    sizes = kept.groupBy("lang", "block").agg(F.first("size").cast("int").alias("size"))
    unused = groups.where("last >= 0").select(
        *GROUP, F.explode(F.sequence(F.lit(0), F.col("last"))).alias("block"),
        F.lit(0).cast("long").alias("count"),
        F.array(*[F.lit(0).cast("long")] * WORDS).alias("bits"),
        "group_total", "terms", "at", "sets",
    )
    maps = used.select(*unused.columns).unionByName(unused).withColumn("share", own)
    sums = materialize(pair_sums(maps.join(sizes, ["lang", "block"])), "divergence-pairs")

    # every pair of the language, also where no block tells its groups apart
    name = groups.select("lang", F.col("at"), "source")
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    listed = groups.select("lang", F.col("at").alias("a"), "source", "terms").withColumn(
        "others", F.max("a").over(Window.partitionBy("lang"))
    )
    # a language without kept terms has no sums: its pairs are made here, all 0
    none = (
        listed.where("terms = 0")
        .select("lang", "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others"))).alias("b"))
        .where("a <> b").withColumn("value", F.lit(0).cast("long"))
    )
    pairs = (
        both.unionByName(none)
        .join(name.withColumnRenamed("at", "a"), ["lang", "a"])
        .join(name.toDF("lang", "b", "item"), ["lang", "b"])
        .select(*GROUP, F.lit("pair").alias("part"), "item", "value")
    )
    facts = dimension_join(cells, groups, list(GROUP))
    overall = share(F.col("total"), F.col("lang_total"), F.col("terms"))
    terms = facts.select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), (own - overall).alias("value"))
    order = Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), F.col("item"))
    rank = F.row_number().over(order).alias("rank")
    top = terms.where("value > 0").select("*", rank).where(F.col("rank") <= TOP_TERMS)
    return pairs.select("*", rank).unionByName(top)

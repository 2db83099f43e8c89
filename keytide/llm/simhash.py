"""SimHash fingerprints and exact linking of those within a few bits.

Linking works on the *segment-popcount embedding*: a fingerprint is cut into segments and
each segment is replaced by its number of set bits. The Manhattan distance of two
embeddings never exceeds the Hamming distance of the fingerprints, so a range join on
embeddings finds a superset of all links, which is then verified bit by bit.

The range join is a grid join on *slabs*: if the Manhattan distance over three slabs of
segments is at most ``d``, then, for radii with ``sum(radius + 1) > d``, one slab differs by
at most its radius. Every fingerprint is filed under its own cell of each slab and probes
the cells within the radius.
"""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytide.llm.components import connected_components
from keytide.llm.textio import id_text, map_batches
from keytide.session import materialize

SHINGLE_WORDS = 4
HASH_SEED = 42
MAX_DISTANCE = 4
SEGMENT_BITS = 2
#: (segments, radius) of each slab; segments sum to 32, radii + 1 sum to more than MAX_DISTANCE.
SLABS = ((12, 1), (12, 1), (8, 0))

#: Near copies of the pipeline: words of a shingle and the least Jaccard similarity.
NEAR_WORDS, NEAR = 5, 0.8
#: Candidates share all minima of one band: 99.9 % of the pairs at NEAR, by 1 - (1 - NEAR^5)^20.
BANDS, BAND_ROWS = 20, 5
#: Bits of a slot in the table of wanted documents: 4 MB.
SLOT_BITS = 25
#: Up to so many sets of a band key become pairs with each other; more are compared in blocks of about
#: so many sets and shingles.
BUCKET = 32
BLOCK, BLOCK_SHINGLES = 512, 1 << 19


def shingle_hashes(text: bytes, size: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of every run of ``size`` words, repeats included; all words where there are fewer.

    Only A-Z are lower-cased and only ASCII white space parts words, as ``bytes`` does it.
    """
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(joined, HASH_SEED)], np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *[e + 1 for e in ends[:-size]]]
    return np.fromiter(
        [xxh64_intdigest(joined[s:e], HASH_SEED) for s, e in zip(starts, ends[size - 1 :])],
        np.uint64,
        len(starts),
    )


def fingerprint_of(hashes: np.ndarray, block: int = 1 << 16) -> int:
    """A bit is set where over half of the hashes have it; no hashes give zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), block):
        part = hashes[at : at + block].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = ones * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp long)``, a row for each document; NULL or wordless texts have zero."""

    def make():
        def apply(batch):
            texts = batch.column("text").cast(pa.binary())
            return {
                "doc_id": batch.column("doc_id"),
                "fp": [fingerprint_of(shingle_hashes(t.as_py(), size)) for t in texts],
            }

        return apply

    return map_batches(id_text(docs), "doc_id long, fp long", make)


def popcounts(fp: Column, segment_bits: int = SEGMENT_BITS) -> list[Column]:
    mask = (1 << segment_bits) - 1
    return [
        F.bit_count(F.shiftrightunsigned(fp, s * segment_bits).bitwiseAND(F.lit(mask)))
        for s in range(64 // segment_bits)
    ]


def slab_cells(fp: Column, slabs=SLABS) -> list[Column]:
    """The cell of each slab, its popcounts written in base ``SEGMENT_BITS + 1``."""
    counts, cells = popcounts(fp), []
    for width, _ in slabs:
        own, counts = counts[:width], counts[width:]
        cells.append(
            reduce(lambda a, c: a * F.lit(SEGMENT_BITS + 1) + c, own, F.lit(0).cast("long"))
        )
    return cells


def probe_cells(fp: Column, slabs=SLABS) -> Column:
    """``array<struct<slab, cell>>``: the own cells and those one step away in slabs of radius 1."""
    counts, out = popcounts(fp), []
    for slab, (width, radius) in enumerate(slabs):
        own, counts = counts[:width], counts[width:]
        cell = slab_cells(fp, slabs)[slab]
        out.append(F.struct(F.lit(slab).alias("slab"), cell.alias("cell")))
        if radius:
            for i, step in itertools.product(range(width), (-1, 1)):
                inside = own[i] > 0 if step < 0 else own[i] < SEGMENT_BITS
                weight = step * (SEGMENT_BITS + 1) ** (width - 1 - i)
                out.append(
                    F.when(
                        inside,
                        F.struct(F.lit(slab).alias("slab"), (cell + F.lit(weight)).alias("cell")),
                    )
                )
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def links(distinct: DataFrame, max_distance: int = MAX_DISTANCE, slabs=SLABS) -> DataFrame:
    """``(a, b)`` of all different fingerprints at most ``max_distance`` bits apart, ``a < b``.

    ``distinct`` has one row per ``fp``. A pair may come once for each slab that finds it.
    """
    if sum(width for width, _ in slabs) * SEGMENT_BITS != 64:
        raise ValueError("slabs must cover 64 bits")
    if sum(radius + 1 for _, radius in slabs) <= max_distance or max(r for _, r in slabs) > 1:
        raise ValueError("radii are at most 1, and radii + 1 must sum to more than max_distance")
    key = lambda slab, cell: cell * F.lit(len(slabs)) + slab
    filed = distinct.select(
        F.explode(F.array(*[key(F.lit(s), c) for s, c in enumerate(slab_cells(F.col("fp"), slabs))])),
        F.col("fp").alias("b"),
    ).toDF("key", "b")
    probes = distinct.select(
        F.explode(F.transform(probe_cells(F.col("fp"), slabs), lambda x: key(x["slab"], x["cell"]))),
        F.col("fp").alias("a"),
    ).toDF("key", "a")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance
    return (
        probes.join(filed, (probes.key == filed.key) & (F.col("a") < F.col("b")) & close)
        .select("a", "b")
    )


def near_duplicates(
    docs: DataFrame, max_distance: int = MAX_DISTANCE, size: int = SHINGLE_WORDS
) -> DataFrame:
    """``(doc_id, fp, component_id)``: documents whose fingerprints link, directly or by steps.

    ``component_id`` is the smallest ``doc_id`` of the component, the document's own where
    nothing links. Equal fingerprints are one node, so exact copies never become pairs.
    Repeated rows are kept; NULL texts count as empty; a NULL ``doc_id`` is never the
    smallest. Columns other than ``doc_id`` and ``text`` are not read.
    """
    prints = materialize(fingerprints(docs, size), "simhash")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    found = connected_components(links(nodes.select("fp"), max_distance), "simhash")
    found = found.select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(found, "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted = materialize(rooted, "simhash-rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def band_keys(hashes: np.ndarray) -> list[int]:
    """One number for each band: the same in two sets if all the band's minima are."""
    draws = np.random.default_rng(HASH_SEED)
    odd = draws.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mask = draws.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)
    minima = np.array([((hashes ^ m) * o).min() for m, o in zip(mask, odd)], np.uint64)
    from xxhash import xxh64_intdigest

    rows = minima.reshape(BANDS, BAND_ROWS)
    return [_signed(xxh64_intdigest(r.tobytes(), seed=k)) for k, r in enumerate(rows)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _slot() -> Column:
    return F.xxhash64("doc_id").bitwiseAND(F.lit((1 << SLOT_BITS) - 1))


def marked_slots(ids: DataFrame) -> np.ndarray:
    """A bit for each slot that the hash of some ``doc_id`` falls in: a table of fixed size,
    whatever the number of ids, so that it can be sent to every task."""
    words = ids.select(_slot().alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(F.lit(63)).cast("int"))).alias("bits")
    )
    table = np.zeros(1 << (SLOT_BITS - 6), np.int64)
    got = words.toArrow()
    table[got["word"].to_numpy()] = got["bits"].to_numpy()
    return table


def shingle_sets(docs: DataFrame, whole: bool, wanted: DataFrame | None = None) -> DataFrame:
    """``(doc_id, node, size)`` and the band keys, or the ``whole`` set: ``node`` stands for the
    set of a document's five-word shingles.

    Of ``wanted``, a table of ids, all documents are made, and of others but a few.
    """
    rows = id_text(docs).withColumn("slot", _slot())
    slots = None if wanted is None else docs.sparkSession.sparkContext.broadcast(marked_slots(wanted))

    def make():
        from xxhash import xxh64_intdigest

        def apply(batch):
            if slots is not None:
                at = batch.column("slot").to_numpy()
                bits = slots.value[at >> 6] >> (at & 63)
                batch = batch.filter(pa.array((bits & 1).astype(bool)))
            texts = batch.column("text").cast(pa.binary())
            sets = [np.unique(shingle_hashes(t.as_py(), NEAR_WORDS)) for t in texts]
            out = {
                "doc_id": batch.column("doc_id"),
                "node": [_signed(xxh64_intdigest(x.tobytes(), HASH_SEED)) for x in sets],
                "size": [len(x) for x in sets],
            }
            if whole:
                return out | {"shingles": [x.view(np.int64) for x in sets]}
            return out | {"bands": [band_keys(x) if len(x) else [] for x in sets]}

        return apply

    last = "shingles" if whole else "bands"
    return map_batches(rows, f"doc_id long, node long, size long, {last} array<long>", make)


def similar_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(a, b)`` of different shingle sets with a Jaccard similarity of at least ``NEAR``: so many
    that all sets so similar which share a band of minima are linked, directly or by steps.

    Each candidate is checked on the whole sets. A band key that more than ``BUCKET`` sets have
    pairs all of them with one of them, another one in each band; what that leaves unlinked
    is compared by ``rest_of_buckets``.
    """
    filed = nodes.select("node", "size", F.explode("bands").alias("key"))
    filed = materialize(filed, "near-bands")
    by_hash = F.struct(F.xxhash64("node", "key").alias("h"), F.col("node"), F.col("size"))
    buckets = filed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("held"), F.min(by_hash).alias("first")
    )
    shared = filed.join(buckets.where("n > 1"), "key")
    few = shared.where(F.col("n") <= BUCKET).select("key", "node", "size")
    other = few.select("key", F.col("node").alias("b"), F.col("size").alias("b_size"))
    found = few.join(other, "key").select(F.col("node").alias("a"), "size", "b", "b_size")
    many = materialize(shared.where(F.col("n") > BUCKET), "near-many")
    found = found.union(many.select("node", "size", "first.node", "first.size"))
    # the smaller set must be as large as the larger one's share
    found = found.where("a <> b").where(F.least("size", "b_size") >= NEAR * F.greatest("size", "b_size"))
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = materialize(found, "near-candidates")
    sets = _whole_sets(docs, nodes, found.select(F.col("a").alias("node")).union(found.select("b")))
    pairs = found.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    both = F.size(F.array_intersect("x", "y"))
    linked = pairs.where(both >= NEAR * (F.size("x") + F.size("y") - both)).select("a", "b")
    if not many.take(1):
        return linked
    linked = materialize(linked, "near-linked")
    return linked.union(rest_of_buckets(docs, nodes, many, linked))


def _whole_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(node, shingles)`` of all ``wanted`` nodes, stored."""
    wanted = wanted.distinct()
    ids = nodes.join(wanted, "node").select(F.col("least").alias("doc_id"))
    # texts stay where they are read: the ids go to them, and only sets of shingles are shuffled
    sets = shingle_sets(docs, True, ids).join(wanted, "node", "left_semi")
    return materialize(sets.dropDuplicates(["node"]).select("node", "shingles"), "near-sets")


def rest_of_buckets(docs: DataFrame, nodes: DataFrame, many: DataFrame, linked: DataFrame) -> DataFrame:
    """Links between sets of one band key that ``linked`` does not join, directly or by steps.

    Only sets of different components are compared, so dense groups, which are joined already, cost
    nothing. A key's sets are dealt to blocks, and any two blocks that hold more than one
    component meet in a task, which gives a link for each two components it joins: never
    more rows than sets, whatever the number of pairs.
    """
    joined = connected_components(linked, "near-some").withColumnRenamed("root", "of")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("held") / BLOCK_SHINGLES))
    members = many.join(joined, "node", "left").select(
        "key", "node", F.coalesce("of", "node").alias("of"), F.pmod(F.xxhash64("key", "node"), blocks).alias("block")
    )
    members = materialize(members, "near-members")
    seen = members.groupBy("key", "block").agg(F.min("of").alias("low"), F.max("of").alias("high"))
    seen = materialize(seen, "near-blocks")
    mixed = seen.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high")
    seen = seen.join(mixed.select("key"), "key")
    left, right = seen.toDF("key", "i", "low", "high"), seen.toDF("key", "j", "low_j", "high_j")
    cells = left.join(right, "key").where("i <= j and least(low, low_j) <> greatest(high, high_j)").select("key", "i", "j")
    dealt = cells.withColumn("block", F.explode(F.array_distinct(F.array("i", "j")))).join(members, ["key", "block"])
    dealt = materialize(dealt, "near-cells")
    sets = _whole_sets(docs, nodes, dealt.select("node"))
    return dealt.join(sets, "node").groupBy("key", "i", "j").applyInArrow(cell_links, "a long, b long")


def cell_links(cell: pa.Table) -> pa.Table:
    """``(a, b)`` that join the components ``of`` of one or two blocks, as far as sets are similar.

    Of two sets of different components one is not of the most frequent: only those are looked up.
    """
    node, block = cell.column("node").to_numpy(), cell.column("block").to_numpy()
    across = block.min() < block.max()
    _, of, frequent = np.unique(cell.column("of").to_numpy(), return_inverse=True, return_counts=True)
    shingles = cell.column("shingles").combine_chunks()
    size = shingles.value_lengths().to_numpy().astype(np.int64)
    ends = np.cumsum(size)
    different, ids = np.unique(shingles.flatten().to_numpy(), return_inverse=True)
    mark = np.zeros(len(different), np.int64)
    a, b = [], []
    for k in np.flatnonzero(of != frequent.argmax()):
        may = of != of[k]
        if across:
            may &= block != block[k]
        if not may.any():
            continue
        own = ids[ends[k] - size[k] : ends[k]]
        mark[own] = 1
        both = np.add.reduceat(mark[ids], ends - size)
        mark[own] = 0
        hits = np.flatnonzero(may & (both >= NEAR * (size + size[k] - both)))
        joins, first = np.unique(of[hits], return_index=True)
        a += [node[k]] * len(first)
        b += node[hits[first]].tolist()
        of[np.isin(of, joins)] = of[k]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_copies(docs: DataFrame) -> DataFrame:
    """``(doc_id, component_id)``: documents linked, directly or by steps, by shingle sets with a
    similarity of at least ``NEAR``; ids as in ``near_duplicates``."""
    prints = materialize(shingle_sets(docs, False), "near")
    nodes = materialize(
        prints.groupBy("node").agg(
            F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("bands").alias("bands")
        ),
        "near-nodes",
    )
    found = connected_components(similar_sets(docs, nodes), "near")
    rooted = nodes.join(found, "node", "left").select(
        "node", "least", F.coalesce("root", "node").alias("root")
    )
    rooted = materialize(rooted, "near-rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(least, "root").select("node", "component_id")
    return prints.join(labels, "node").select("doc_id", "component_id")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """The documents without near duplicates: of each component that with the smallest id.

    Rows that repeat that id are dropped too, so one row stays per component. Rows without
    an id can't be told apart by it and stay.
    """
    return _representatives(docs, near_duplicates(docs.where("doc_id is not null")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``keep_representatives``, then the same for documents that share at least ``NEAR`` of
    their different five-word shingles, however many bits their fingerprints differ in."""
    docs = materialize(keep_representatives(docs), "near-input")
    return _representatives(docs, near_copies(docs.where("doc_id is not null")))


def _representatives(docs: DataFrame, labels: DataFrame) -> DataFrame:
    keep = labels.where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    kept = docs.join(keep, docs["doc_id"] == keep["kept_id"]).select(docs["*"])
    return kept.dropDuplicates(["doc_id"]).union(docs.where("doc_id is null"))


def simhash_query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )

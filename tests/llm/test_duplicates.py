import random

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import corpus_pipeline as pipeline
from keytide.llm import simhash, suffixes
from keytide.llm.components import connected_components
from tests.llm.fixtures import TEXTS, documents, rows_of


def fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [words[i : i + 4] for i in range(len(words) - 3)] or ([words] if words else [])
    hashes = [xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark):
    rnd = random.Random(1)
    base = [f"w{rnd.randrange(400)}" for _ in range(300)]
    rows = list(TEXTS)
    for i in range(60):
        words = list(base)
        for _ in range(rnd.randrange(6)):
            words[rnd.randrange(300)] = "changed"
        rows.append((100 + i, " ".join(words)))
    docs = documents(spark, rows)
    got = simhash.simhash_query(docs).collect()
    assert len(got) == len(rows)
    prints = {i: fingerprint(t) for i, t in rows if i is not None}
    ids = sorted(prints)
    close = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    want = components(ids, close)
    assert len(set(want.values())) < len(ids) - 30
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id])
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))
    assert simhash.simhash_query(documents(spark, [])).count() == 0


def test_links_find_all_pairs_within_the_distance(spark):
    rnd = random.Random(2)
    centres = [rnd.getrandbits(64) for _ in range(40)]
    prints = set(centres) | {0, (1 << 64) - 1}
    for c in centres:
        for flips in (1, 2, 3, 4, 4, 4, 5, 6):
            prints.add(c ^ sum(1 << b for b in rnd.sample(range(64), flips)))
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    got = {tuple(sorted(r)) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    want = {
        tuple(sorted((a, b))) for a, p in signed.items() for b, q in signed.items() if a < b and (p ^ q).bit_count() <= 4
    }
    assert got == want and len(want) > 200
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([], "fp long"), max_distance=9)


@pytest.mark.parametrize("n", [0, 1, 50])
def test_components_of_chains_and_stars(spark, n):
    pairs = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, n)]
    got = connected_components(spark.createDataFrame(pairs, "a long, b long"))
    roots = {r.node: r.root for r in got.collect()}
    assert len({roots[i] for i in range(n + 1) if i in roots}) == min(n, 1)
    assert len(set(roots.values())) == (0 if n == 0 else 1 if n == 1 else 2)


def brute_repeats(rows, size=suffixes.MIN_WORDS):
    """Windows seen before, in order of id."""
    seen, out = {}, []
    for i, text in sorted(dict(rows).items()):
        words, own = (text or "").split(), []
        for p in range(len(words) - size + 1):
            window = tuple(words[p : p + size])
            if window in seen:
                own.append((p, p + size, seen[window]))
            else:
                seen[window] = i
        out += [(i, a, b - a, f) for a, b, f in suffixes.merge(own)]
    return sorted(out)


def passages(n=30):
    rnd = random.Random(3)
    new = lambda k: [f"u{rnd.randrange(10**6)}" for _ in range(k)]
    shared = [new(k) for k in (50, 51, 60, 200)]
    rows = []
    for i in range(n):
        part = shared[i % 4][:49] if i % 7 == 0 else shared[i % 4]
        rows.append((i, " ".join(new(rnd.randrange(80)) + part + new(rnd.randrange(80)))))
    rows += [(100, rows[3][1]), (101, "again " * 120), (102, "again " * 130), (103, ""), (104, None)]
    return rows


def test_repeats_against_brute_force(spark):
    rows = passages()
    got = rows_of(suffixes.repeats(documents(spark, rows + rows[:1]).repartition(3)).drop("row"))
    assert got == brute_repeats(rows)


def test_repeats_across_partitions_of_the_sort(spark):
    windows = spark.range(4000).select(
        F.when(F.col("id") < 3000, F.lit(7)).otherwise(F.col("id")).alias("content"),
        (F.col("id") % 1000).alias("doc_id"), F.lit(0).cast("long").alias("row"),
        (F.col("id") / 1000).cast("int").alias("pos"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = suffixes.repeated_windows(windows).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len({(r.doc_id, r.pos) for r in got}) == 2999
    assert {r.first_doc_id for r in got} == {0} and (0, 0) not in {(r.doc_id, r.pos) for r in got}


def test_removed_passages(spark):
    rows = passages()
    docs = documents(spark, rows)
    got = suffixes.remove_repeats(docs)
    assert got.columns == docs.columns and got.count() == len(rows)
    spans = {}
    for i, start, n, _ in brute_repeats(rows):
        spans.setdefault(i, []).append((start, start + n))
    for r in got.collect():
        text = dict(rows)[r.doc_id]
        if r.doc_id in spans:
            words = text.split()
            kept = [w for k, w in enumerate(words) if not any(a <= k < b for a, b in spans[r.doc_id])]
            assert r.text.split() == kept and r.n_chars == len(r.text)
        else:
            assert r.text == text
    assert brute_repeats([(r.doc_id, r.text) for r in got.collect()]) == []


def test_awkward_rows(spark):
    assert suffixes.remove_repeats(documents(spark)).count() == len(TEXTS)
    assert suffixes.repeats(documents(spark, [])).count() == 0
    cut = {r.doc_id: r.text for r in suffixes.remove_repeats(documents(spark)).collect()}
    assert cut[2] == "a b c" and cut[1] is None and len(cut[5].split()) < 60


def test_near_copies_of_the_pipeline(spark):
    rnd = random.Random(5)
    texts, kept, close = [], set(), []
    for base in range(40):
        words = [f"w{rnd.randrange(5000)}" for _ in range(300)]
        other = list(words)
        for at in rnd.sample(range(300), 1 + base % 8):
            other[at] = f"x{rnd.randrange(5000)}"
        texts += [(2 * base, " ".join(words)), (2 * base + 1, " ".join(other))]
        x, y = (set(zip(*(w[k:] for k in range(5)))) for w in (words, other))
        bits = fingerprint(texts[-2][1]) ^ fingerprint(texts[-1][1])
        near = len(x & y) / len(x | y) >= 0.8 or bits.bit_count() <= 4
        kept |= {2 * base} if near else {2 * base, 2 * base + 1}
        close.append(len(x & y) / len(x | y))
    assert min(close) < 0.8 < 0.85 < max(close)
    rows = pipeline.drop_near_duplicates(spark, documents(spark, texts), "").collect()
    assert {r.doc_id for r in rows} == kept and len(rows) == len(kept)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """More sets with one band key than are paired: pairs and chains away from the key's first set."""
    rnd = random.Random(9)
    texts = []
    for base in range(30):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
        for step in range(1 + base % 4):
            texts.append(" ".join(words))
            words = words[3 + base % 9 :] + [f"w{rnd.randrange(10**6)}" for _ in range(3 + base % 9)]
    docs = documents(spark, list(enumerate(texts)))
    sets = [set(simhash.shingle_hashes(t.encode(), simhash.NEAR_WORDS).tolist()) for t in texts]
    near = lambda x, y: len(x & y) >= simhash.NEAR * len(x | y)
    pairs = {(i, j) for i in range(len(sets)) for j in range(i) if near(sets[i], sets[j])}
    of = list(range(len(sets)))
    for i, j in pairs:
        of = [min(of[i], of[j]) if x in (of[i], of[j]) else x for x in of]
    nodes = simhash.shingle_sets(docs, False).select(
        "node", F.col("doc_id").alias("least"), "size", F.array(F.lit(7).cast("long")).alias("bands")
    )
    nodes = nodes.localCheckpoint()
    ids = {r.node: r.least for r in nodes.collect()}
    assert len(ids) == len(texts) > 2 * simhash.BUCKET and len(set(of)) < len(of)
    for block in (512, 16):
        monkeypatch.setattr(simhash, "BLOCK", block)
        links = [(ids[r.a], ids[r.b]) for r in simhash.similar_sets(docs, nodes).collect()]
        assert {(max(x), min(x)) for x in links} <= pairs
        got = list(range(len(sets)))
        for i, j in links:
            got = [min(got[i], got[j]) if x in (got[i], got[j]) else x for x in got]
        assert got == of

"""The audits of filters and of sources against plain Python."""

import itertools
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from keytide.llm import divergence, interaction
from tests.llm.fixtures import EXTRA, TEXTS, rows_of


def awkward(n=260, seed=3):
    rnd = np.random.default_rng(seed)
    words = [f"w{i % 23}" for i in range(60)] + ["Café", "ABC", "中文", "$x", "a|b", "THE"]
    rows = [(i, t, [None, "", "en"][k % 3], ["s", None][k % 2]) for k, (i, t) in enumerate(TEXTS)]
    for i in range(100, 100 + n):
        some = rnd.choice(len(words), int(rnd.integers(0, 400)))
        rows.append((i, " \t".join(words[w] for w in some), "en" if i % 3 else "de", f"s{i % 4}"))
    rows += [(400 + i, rows[30][1], ["en", "de", None][i % 3], "s0") for i in range(50)]
    return rows + [rows[40], rows[40], (None, rows[40][1], "en", "s1")]


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", *[f"'{c}' AS {c}" for c in EXTRA], "0 AS n", "'k' AS key", "1 AS part", "2 AS at")


LABELS = [(i, i % 2, int(i % 5 == 0)) for i in range(100, 400, 3)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (9999, 1, 1)]


def brute_filters(rows):
    marks = defaultdict(lambda: [False, False])
    for i, q, x in LABELS:
        marks[i][0] |= q == 1
        marks[i][1] |= x == 1
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    parts = defaultdict(list)
    for i, t, lang, _ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and i > least[t],
        }
        good, toxic = marks[i] if i is not None else (False, False)
        parts[lang or ""].append(("".join(f for f in "ABCDE" if fails[f]), good, toxic))
    out = []
    for part, docs in parts.items():
        steps = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for k, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                failing = sum(f in d[0] for d in docs)
                alone = sum(d[0] == f for d in docs)
                lost = sum(d[1] for d in gone), sum(d[2] for d in gone)
                steps.append((part, order, k, len(left), len(gone), failing - len(gone), alone, *lost))
        shares = Counter()
        for s in steps:
            shares[s[1][s[2] - 1]] += s[4]
        out += [(*s, shares[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


FILTER_COLUMNS = (
    "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley",
)


def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS n", "'x' AS key")


def test_filters_against_brute_force(spark):
    rows = awkward()
    got = rows_of(interaction.audit(table(spark, rows), labels(spark)), *FILTER_COLUMNS)
    assert got == brute_filters(rows)
    assert {r[0] for r in got} == {"", "en", "de"} and len(got) == 1800


def test_filters_of_empty_tables(spark):
    none = table(spark, [(1, "a", "en", "s")]).limit(0)
    assert interaction.audit(none, labels(spark)).count() == 0
    one = interaction.audit(table(spark, [(1, None, None, None)]), labels(spark).limit(0))
    assert {(r.part, r.kept + r.removed + r.redundant) for r in one.collect()} <= {("", 0), ("", 1)}
    assert one.count() == 600


@pytest.mark.parametrize("n", [2, 3, 5, 6])
def test_least_squares_gives_shapley_values(n):
    """Solved weights are those of the definition by orders, for any game."""
    orders = list(itertools.permutations(range(n)))
    want = [[Fraction(0)] * (1 << n) for _ in range(n)]
    for order in orders:
        before = 0
        for i in order:
            want[i][before | 1 << i] += Fraction(1, len(orders))
            want[i][before] -= Fraction(1, len(orders))
            before |= 1 << i
    assert interaction.shapley_weights(n) == want


def test_filters_add_up_by_text_before_parts_meet(spark):
    plan = interaction.audit(table(spark, awkward()), labels(spark))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan


def brute_sources(rows):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")) for _, t, lang, source in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    in_docs, counts, groups = Counter(), Counter(), defaultdict(set)
    for lang, source, words in docs:
        groups[lang].add(source)
        words = [w.translate(lower) for w in words]
        in_docs.update({(lang, w) for w in words})
        counts.update((lang, source, w) for w in words)
    out = []
    for lang, sources in groups.items():
        kept = [w for (own, w), n in in_docs.items() if own == lang and n >= 30]
        v = len(kept)

        def shares(of):
            total = sum(of.values())
            return {w: 1 + 10**9 * (of[w] + 5) // (total + 5 * v) for w in kept}

        own = {s: {w: counts[lang, s, w] for w in kept} for s in sources}
        p = {s: shares(c) for s, c in own.items()}
        q = shares({w: sum(own[s][w] for s in sources) for w in kept})
        for s in sources:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in sources if o != s]
            terms = [(p[s][w] - q[w], w) for w in kept if own[s][w] and p[s][w] > q[w]]
            for part, items, most in (("pair", pairs, None), ("term", terms, 50)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, x, r) for r, (x, i) in enumerate(items[:most], 1)]
    return sorted(out)


SOURCE_COLUMNS = ("lang", "source", "part", "item", "value", "rank")


@pytest.mark.parametrize("set_groups", [2, 64])
def test_sources_against_brute_force(spark, set_groups, monkeypatch):
    monkeypatch.setattr(divergence, "SET_GROUPS", set_groups)
    monkeypatch.setattr(divergence, "HELD", 50)
    rows = awkward()
    got = rows_of(divergence.divergence(table(spark, rows)), *SOURCE_COLUMNS)
    assert got == brute_sources(rows)
    # a language without kept terms has differences of 0
    assert {r[4] for r in got if r[0] == "" and r[2] == "pair"} == {0}


def test_many_terms_fill_many_blocks(spark):
    """More terms of one frequency than a block has bits, in unequal groups."""
    rnd = np.random.default_rng(5)
    vocabulary = ["t" + "".join(chr(97 + int(d)) for d in f"{i:03d}") for i in range(700)]
    rows = [
        (i, " ".join(w for w in vocabulary if rnd.random() < 0.3 + 0.1 * (i % 5)), "en", f"s{i % 5}") for i in range(200)
    ]
    assert rows_of(divergence.divergence(table(spark, rows)), *SOURCE_COLUMNS) == brute_sources(rows)


def test_sources_of_empty_table(spark):
    assert divergence.divergence(table(spark, [(1, "a", "en", "s")]).limit(0)).count() == 0


def test_shares_are_exact_beyond_longs(spark):
    n, total, terms = 3 * 10**13 + 7, 9 * 10**15 + 1, 12345
    df = spark.createDataFrame([(n, total, terms)], "c long, t long, v long")
    from pyspark.sql import functions as F

    got = df.select(divergence.share(F.col("c"), F.col("t"), F.col("v"))).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * terms)


def test_terms_of_long_texts_are_parted_once(monkeypatch):
    text = ("Straße, ÄPFEL x" * 50 + "y" * 300).encode()
    whole = [w for part in divergence.words_of(text) for w in part]
    monkeypatch.setattr(divergence, "PIECE", 7)
    assert [w for part in divergence.words_of(text) for w in part] == whole
    assert whole[0] == "straße".encode() and whole[1] == "Äpfel".encode()

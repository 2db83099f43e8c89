"""How filters of a corpus interact: what each removes in every order, and its fair share.

A document fails some subset of the filters. All that is asked follows from ``v(S)``, the number of
documents that at least one filter of the coalition ``S`` removes: in an order, a step removes
``v(before and this) - v(before)``. The share of a filter over all orders, its Shapley value, is
the solution of a weighted least squares problem over all coalitions: fit ``v`` by a sum of one
number for each filter, weighted by the Shapley kernel, such that all numbers sum to what all
filters remove together. Its normal equations don't depend on the documents, so they are solved
once in rationals, with one right-hand side for each coalition.

On Spark: one pass over the texts leaves a few numbers for each document. Rows are added up by
(text digest, part), so copies of a text never meet in one task; then by (part, failed filters),
at most 32 rows for each part.
"""

from __future__ import annotations

import itertools
import json
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The filters, a bit each from the lowest; the last one fails copies of another document.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 200, 50, 3
WHITE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
MEASURES = ("n", "good", "toxic")


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails; it must not be NULL."""
    words = F.array_remove(F.split(text, WHITE, -1), "")
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))

    def judge(w: Column) -> Column:
        n, different = F.size(w).cast("long"), F.size(F.array_distinct(w)).cast("long")
        fails = (
            n < MIN_WORDS,
            different * 100 < n * MIN_DISTINCT_PERCENT,
            upper.cast("long") * 100 > F.length(text).cast("long") * MAX_UPPER_PERCENT,
            text.rlike(SYMBOLS),
        )
        bits = [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)]
        return bits[0] + bits[1] + bits[2] + bits[3]

    # the detour over an array splits a text once
    return F.transform(F.array(words), judge)[0]


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, fails, n, good, toxic)``: documents by part and subset of failed filters."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        text.alias("text"),
    )
    digest = F.unhex(F.sha2("text", 256))
    rows = rows.select("doc_id", "part", digest.alias("digest"), own_failures(F.col("text")).alias("own"))
    same = ["doc_id", "part", "digest", "own"]
    rows = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("n"))
    # rows without an id have no label; spread by their digest they don't meet in one task
    spread = F.concat(F.lit("none:"), F.hex("digest"))
    rows = rows.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), spread))
    marks = (
        labels.where("doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").cast("string").alias("key"))
        .agg(F.max(F.col("quality") == 1).alias("is_good"), F.max(F.col("toxic") == 1).alias("is_toxic"))
    )
    rows = rows.join(marks, "key", "left").withColumns(
        {m: F.when(F.col(f"is_{m}"), F.col("n")).otherwise(0) for m in MEASURES[1:]}
    )
    # by text and part: all documents, those without an id, those with the smallest id
    texts = rows.groupBy("digest", "part", "own").agg(
        *[F.sum(m).alias(m) for m in MEASURES],
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
        F.min("doc_id").alias("least"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", *MEASURES))).alias("first"),
    )
    least = F.min("least").over(Window.partitionBy("digest"))
    texts = texts.withColumn("leads", F.coalesce(F.col("least") == least, F.lit(False)))
    stays = {m: F.when(F.col("leads"), F.col(f"first.{m}")).otherwise(0) for m in MEASURES}
    stays["n"] = stays["n"] + F.col("no_id")
    kinds = [
        F.struct(F.col("own").alias("fails"), *[stays[m].alias(m) for m in MEASURES]),
        F.struct((F.col("own") + COPY).alias("fails"), *[(F.col(m) - stays[m]).alias(m) for m in MEASURES]),
    ]
    split = texts.select("part", F.inline(F.array(*kinds))).where("n > 0")
    return split.groupBy("part", "fails").agg(*[F.sum(m).alias(m) for m in MEASURES])


def coalition_removals(tabulated: DataFrame, n_filters: int = len(FILTERS)) -> DataFrame:
    """One row for each part: for each measure an array, at ``S`` what coalition ``S`` removes,
    and ``total``, all its documents."""
    hit = lambda s, m: F.sum(F.when(F.col("fails").bitwiseAND(s) != 0, F.col(m)).otherwise(0))
    every = range(1 << n_filters)
    arrays = [F.array(*[hit(s, m) for s in every]).alias(m) for m in MEASURES]
    return tabulated.groupBy("part").agg(*arrays, F.sum("n").alias("total"))


def solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """``x`` with ``matrix x = right``, all in rationals; ``right`` may have many columns."""
    n = len(matrix)
    rows = [list(m) + list(r) for m, r in zip(matrix, right)]
    for col in range(n):
        pivot = next(r for r in range(col, n) if rows[r][col])
        rows[col], rows[pivot] = rows[pivot], rows[col]
        rows[col] = [v / rows[col][col] for v in rows[col]]
        for r in range(n):
            if r != col and rows[r][col]:
                by = rows[r][col]
                rows[r] = [a - by * b for a, b in zip(rows[r], rows[col])]
    return [r[n:] for r in rows]


def shapley_weights(n_filters: int = len(FILTERS)) -> list[list[Fraction]]:
    """For each filter what each coalition's removals count for in its Shapley value.

    Minimises the sum over the coalitions but the empty and the full one of
    ``kernel(S) (v(S) - v(none) - sum of the members' values)^2`` where all values sum to
    ``v(all) - v(none)``: normal equations with a multiplier for that constraint.
    """
    everyone = (1 << n_filters) - 1
    members = lambda s: [i for i in range(n_filters) if s >> i & 1]
    kernel = {
        s: Fraction(n_filters - 1, math.comb(n_filters, k) * k * (n_filters - k))
        for s in range(1, everyone)
        for k in [len(members(s))]
    }
    size = n_filters + 1
    matrix = [[Fraction(0)] * size for _ in range(size)]
    right = [[Fraction(0)] * (everyone + 1) for _ in range(size)]
    for s, w in kernel.items():
        for i in members(s):
            for j in members(s):
                matrix[i][j] += w
            right[i][s] += w
            right[i][0] -= w
    for i in range(n_filters):
        matrix[i][n_filters] = matrix[n_filters][i] = Fraction(1)
    right[n_filters][everyone], right[n_filters][0] = Fraction(1), Fraction(-1)
    return solve(matrix, right)[:n_filters]


def order_steps(filters: str = FILTERS) -> list[dict]:
    """Every step of every order: its filter and the coalition that came before."""
    out = []
    for order in itertools.permutations(range(len(filters))):
        before = 0
        for step, i in enumerate(order, 1):
            name = "".join(filters[j] for j in order)
            out.append({"filter_order": name, "step": step, "i": i, "before": before})
            before |= 1 << i
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley)``: one row for each part, order of the filters and step; zeros included.

    A part is a value of ``lang``, NULL and empty are one. NULL texts count as empty. A row without
    ``doc_id`` is never a copy, makes none and has no labels; rows that repeat an id are documents
    of their own, and of equal texts all with the smallest id stay. A document is good or toxic
    where any of its labels says so. An empty table has no parts. Texts are equal where their
    SHA-256 is.
    """
    orders = math.factorial(len(FILTERS))
    weights = [[w * orders for w in row] for row in shapley_weights()]
    if any(w.denominator != 1 for row in weights for w in row):
        raise ArithmeticError("sums over all orders are whole numbers")
    removed = coalition_removals(failures(docs, labels))

    def share(row: list[Fraction]) -> Column:
        terms = [F.col("n")[s] * int(w) for s, w in enumerate(row) if w]
        return sum(terms[1:], terms[0])

    removed = removed.withColumn("shares", F.array(*[share(row) for row in weights]))
    steps = F.from_json(
        F.lit(json.dumps(order_steps())), "array<struct<filter_order string, step int, i int, before int>>"
    )
    at = removed.select("*", F.inline(steps)).withColumn("bit", F.call_function("shiftleft", F.lit(1), F.col("i")))
    everyone = len(FILTERS)
    here = lambda m: F.get(m, F.col("before") + F.col("bit")) - F.get(m, F.col("before"))
    rest = F.lit((1 << everyone) - 1)
    return at.select(
        "part", "filter_order", "step",
        (F.col("total") - F.get("n", F.col("before") + F.col("bit"))).alias("kept"),
        here("n").alias("removed"),
        (F.get("n", F.col("bit")) - here("n")).alias("redundant"),
        (F.get("n", rest) - F.get("n", rest - F.col("bit"))).alias("unique_fails"),
        here("good").alias("good_lost"),
        here("toxic").alias("toxic_lost"),
        F.get("shares", F.col("i")).alias("shapley"),
    )

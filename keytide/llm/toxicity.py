"""Toxicity by two class-conditional Kneser-Ney models over the characters of words.

Each class has its own counts of the longest n-grams; what they leave to rarer expressions
goes, by absolute discounting, to one shared Kneser-Ney model of continuation counts, so an
expression that neither class has seen is as likely under both. A document's score is the
mean over its words of log P(word | toxic) - log P(word | ordinary), put on 0..1 by a
logistic curve that is fitted on labelled rows kept out of the counts. In learning a word
counts once in a document, so that a line repeated a thousand times in one document is one
piece of evidence. In scoring, ratios of less than EVIDENCE nats count as 0: over the many
ordinary words of a long text their noise would bury the few words that tell.

Contexts never leave a word (a word starts at START and ends at END), so what a word adds is
a function of the word, computed once per worker for each different word.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keytide.llm.textio import Memory, filter_texts, id_text, map_batches
from keytide.session import materialize

ORDER = 6
#: At most so many labelled documents are learnt from, half of them of each class.
TRAIN_ROWS = 20_000
#: Of the smaller class, one in so many fits the logistic curve and is kept out of the counts.
CURVE_FOLDS = 4
FOLDS = 5
#: Taken from each class's count of an n-gram and given to the shared model. So much that a
#: handful of documents, by chance in one class, tells nothing.
CLASS_DISCOUNT = 4.0
#: Ratios of a word that are nearer to 0 than this count as 0.
EVIDENCE = 5.0
START, END = "\x02", "\x03"
#: Documents scored at once.
AT_ONCE = 64

_M = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of all ids whose labels nothing is learnt from; false for NULL."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def gram_keys(text: str, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words written as START word END, one after the other: keys of the n-gram ending at
    each character, keys of its context, and whether the character is one to be predicted."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = points == ord(START)
    at = np.arange(len(points))
    since = at - np.maximum.accumulate(np.where(starts, at, 0))
    gram, context, power = points.copy(), np.zeros(len(points), np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for back in range(1, order):
            inside = since >= back
            older = np.zeros(len(points), np.uint64)
            older[back:] = points[:-back]
            context += np.where(inside, older * power, np.uint64(0))
            power = power * _M
            gram += np.where(inside, older * power, np.uint64(0))
    return gram, context, ~starts


@dataclass(frozen=True)
class ToxicityModel:
    """Log-likelihood ratios of seen n-grams and, for unseen ones, of their contexts."""

    grams: np.ndarray
    gram_llr: np.ndarray
    contexts: np.ndarray
    context_llr: np.ndarray
    slope: float = 0.0
    bias: float = -math.inf

    def word_llrs(self, words: list[str]) -> np.ndarray:
        if not words or not len(self.grams):
            return np.zeros(len(words))
        gram, context, counts = gram_keys("".join(f"{START}{w}{END}" for w in words))
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        seen = self.grams[at] == gram
        to = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        other = np.where(self.contexts[to] == context, self.context_llr[to], 0.0)
        llr = np.where(seen, self.gram_llr[at], other) * counts
        whole = np.add.reduceat(llr, np.flatnonzero(~counts))
        return np.where(np.abs(whole) < EVIDENCE, 0.0, whole)


def words_of(text: str) -> list[str]:
    """Lower-case words; the characters that mark word ends here count as white space."""
    return text.lower().replace(START, " ").replace(END, " ").split()


def text_llrs(model: ToxicityModel):
    """A function from texts to their mean ratios, that remembers words."""
    known = Memory()

    def apply(texts: list[str]) -> list[float]:
        out = []
        for at in range(0, len(texts), AT_ONCE):
            split = [words_of(t) for t in texts[at : at + AT_ONCE]]
            known.fill({w for words in split for w in words}, lambda new: model.word_llrs(new).tolist())
            out += [sum(map(known.__getitem__, w)) / len(w) if w else 0.0 for w in split]
        return out

    return apply


def mean_llr(docs: DataFrame, model) -> DataFrame:
    """``(doc_id, llr)``: the mean over the words of every whole text, 0 without words.

    ``model`` is a broadcast ``ToxicityModel``.
    """

    def make():
        llrs = text_llrs(model.value)
        return lambda b: {"doc_id": b.column("doc_id"), "llr": llrs(b.column("text").to_pylist())}

    return map_batches(id_text(docs), "doc_id long, llr double", make)


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``(doc_id, text, toxic, curve, weight)``: at most ``rows`` labelled documents, none held out.

    Of each class those with the smallest hashed ids, ``rows / 2`` at most. As many of one as of
    the other are counted, so that neither model knows more words than the other by size alone;
    the rest is for the curve, weighted by ``weight`` to the share that the class has of all
    labels. Labels other than 0 and 1 and contradictory rows of an id don't count.
    """
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("labelled"), F.col("toxic").cast("int"))
        .where("labelled is not null and toxic in (0, 1)")
        .where(~held_out(F.col("labelled")))
        .groupBy("labelled")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
        .where("toxic = most")
        .drop("most")
    )
    n = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    taken = [min(n.get(k, 0), rows // 2) for k in (0, 1)]
    counted = min(taken) * (CURVE_FOLDS - 1) // CURVE_FOLDS
    parts = []
    for k in (0, 1):
        order = (F.xxhash64("labelled"), F.col("labelled"))
        some = usable.where(F.col("toxic") == k).orderBy(*order).limit(taken[k])
        # one window over at most rows / 2 rows
        rank = F.row_number().over(Window.partitionBy("toxic").orderBy(*order))
        weight = n.get(k, 0) / max(1, taken[k] - counted)
        parts.append(
            some.select("labelled", "toxic", (rank > counted).alias("curve"), F.lit(weight).alias("weight"))
        )
    # bounded by ``rows``, so it is sent to the documents, not they to it
    picked = F.broadcast(parts[0].union(parts[1]))
    return (
        id_text(docs).join(picked, F.col("doc_id") == F.col("labelled"))
        .select("doc_id", "text", "toxic", "curve", "weight")
    )


def class_counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """``(s, toxic_n, ordinary_n)``: counts of the longest n-grams, by class."""

    def make():
        from collections import Counter

        def apply(batch):
            both = (Counter(), Counter())
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                both[toxic].update(set(words_of(text.as_py())))
            flat = [(w, k, n) for k, c in enumerate(both) for w, n in c.items()]
            w, k, n = zip(*flat) if flat else ((), (), ())
            return {"word": w, "toxic": k, "n": n}

        return apply

    words = (
        map_batches(rows.select("text", "toxic"), "word string, toxic int, n long", make)
        .groupBy("word")
        .agg(
            F.sum(F.col("n") * F.col("toxic")).alias("toxic_n"),
            F.sum(F.col("n") * (1 - F.col("toxic"))).alias("ordinary_n"),
        )
    )
    padded = F.concat(F.lit(START), F.col("word"), F.lit(END))
    ends = F.sequence(F.lit(2), F.length(padded))
    first = lambda e: F.greatest(F.lit(1), e - F.lit(order - 1))
    grams = F.transform(ends, lambda e: F.substring(padded, first(e), e - first(e) + 1))
    return (
        words.select(F.explode(grams).alias("s"), "toxic_n", "ordinary_n")
        .groupBy("s")
        .agg(F.sum("toxic_n").alias("toxic_n"), F.sum("ordinary_n").alias("ordinary_n"))
    )


def _context(s: str = "s") -> Column:
    return F.expr(f"substring({s}, 1, length({s}) - 1)")


def _discount(ones: float | None, twos: float | None) -> float:
    """n1 / (n1 + 2 n2), kept away from 0 and 1."""
    ones, twos = ones or 0, twos or 0
    return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5


def shared_model(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """``(s, p)``: Kneser-Ney of continuation counts, for all n-grams shorter than ``order``.

    The count of ``s`` is the number of characters that are seen before it, whatever the class.
    """
    longest = grams.select("s", F.length("s").alias("k"))
    suffixes = longest.select(
        F.explode(F.transform(F.sequence(F.lit(1), F.col("k")), lambda i: F.expr("s").substr(i, F.col("k")))).alias("t")
    ).distinct()
    counts = (
        suffixes.where("length(t) > 1")
        .groupBy(F.expr("substring(t, 2)").alias("s"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    w = Window.partitionBy("h", "k")
    counts = materialize(
        counts.select("s", "n", F.length("s").alias("k"), _context().alias("h"))
        .withColumn("total", F.sum("n").over(w))
        .withColumn("kinds", F.count(F.lit(1)).over(w)),
        "toxicity-shared",
    )
    few = {
        r.k: (r.ones, r.twos)
        for r in counts.groupBy("k")
        .agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos"))
        .collect()
    }
    levels = [
        counts.where("k = 1").select("s", ((F.col("n") + 1) / (F.col("total") + F.col("kinds") + 1)).alias("p"))
    ]
    for k in range(2, order):
        d = _discount(*few.get(k, (0, 0)))
        shorter = levels[-1].select(F.col("s").alias("tail"), F.col("p").alias("below"))
        levels.append(
            counts.where(F.col("k") == k)
            .join(shorter, F.expr("substring(s, 2)") == F.col("tail"))
            .select(
                "s",
                (
                    F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("total")
                    + d * F.col("kinds") / F.col("total") * F.col("below")
                ).alias("p"),
            )
        )
        levels[-1] = materialize(levels[-1], f"toxicity-shared-{k}")
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out


def ratios(
    grams: DataFrame, order: int = ORDER, discount: float = CLASS_DISCOUNT
) -> tuple[DataFrame, DataFrame]:
    """``(s, llr)`` of seen n-grams and ``(h, llr)`` of contexts, for n-grams not seen after them."""
    w = Window.partitionBy("h")
    top = grams.withColumn("h", _context())
    for c in ("toxic", "ordinary"):
        top = top.withColumn(f"{c}_h", F.sum(f"{c}_n").over(w)).withColumn(
            f"{c}_left", F.sum(F.least(F.col(f"{c}_n"), F.lit(discount))).over(w)
        )
    gamma = lambda c: F.when(F.col(f"{c}_h") > 0, F.col(f"{c}_left") / F.col(f"{c}_h")).otherwise(1.0)
    top = materialize(top, "toxicity-top")
    shared = shared_model(grams, order).select(F.col("s").alias("tail"), F.col("p").alias("below"))
    joined = top.join(shared, F.expr("substring(s, 2)") == F.col("tail"))

    def p(c: str) -> Column:
        own = F.greatest(F.col(f"{c}_n") - discount, F.lit(0.0)) / F.col(f"{c}_h")
        return F.when(F.col(f"{c}_h") > 0, own).otherwise(0.0) + gamma(c) * F.col("below")

    contexts = top.groupBy("h").agg(F.first(F.log(gamma("toxic") / gamma("ordinary"))).alias("llr"))
    return joined.select("s", F.log(p("toxic") / p("ordinary")).alias("llr")), contexts


def _keyed(df: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and ratios. Bounded by the sample the model is fitted on."""

    def make():
        def apply(batch):
            grams = batch.column(text).to_pylist()
            return {"key": [_key(g) for g in grams], "llr": batch.column("llr")}

        return apply

    got = map_batches(df.select(text, "llr"), "key long, llr double", make).toArrow()
    keys = got["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys, kind="stable")
    return keys[order], got["llr"].to_numpy()[order].astype(np.float32)


def _key(gram: str) -> int:
    value = 0
    for back, c in enumerate(reversed(gram)):
        value += ord(c) * pow(int(_M), back, 1 << 64)
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Count, smooth and fit the curve. Without rows of both classes no text is called toxic."""
    sc = docs.sparkSession.sparkContext
    train = materialize(training_rows(docs, labels, rows), "toxicity-train")
    classes = {r.toxic for r in train.where("not curve").select("toxic").distinct().collect()}
    if classes != {0, 1}:
        none = np.empty(0)
        return ToxicityModel(none.astype(np.uint64), none, none.astype(np.uint64), none)
    grams = materialize(class_counts(train.where("not curve")), "toxicity-grams")
    seen, contexts = ratios(grams)
    model = ToxicityModel(*_keyed(seen, "s"), *_keyed(contexts, "h"))
    curve = train.where("curve")
    scored = mean_llr(curve, sc.broadcast(model)).withColumnRenamed("doc_id", "scored")
    known = curve.select("doc_id", "toxic", "weight").distinct()
    pairs = scored.join(known, F.col("scored") == F.col("doc_id")).select("llr", "toxic", "weight")
    slope, bias = _logistic(*(c.to_numpy() for c in pairs.toArrow().columns))
    return ToxicityModel(model.grams, model.gram_llr, model.contexts, model.context_llr, slope, bias)


def _logistic(
    x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2, steps: int = 60
) -> tuple[float, float]:
    """Newton's method on a slope and a bias, over at most ``TRAIN_ROWS`` numbers."""
    if len(set(y.tolist())) < 2:
        return 10.0, -1.0
    scale = float(np.std(x)) or 1.0
    design = np.column_stack([x / scale, np.ones(len(x))])
    weights = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -40, 40)))
        slope = design.T @ (w * (p - y)) + ridge * weights
        curve = (design * (w * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        weights = weights - np.clip(np.linalg.solve(curve, slope), -2, 2)
    return float(weights[0] / scale), float(weights[1])


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document.

    NULL and wordless texts get the score of a mean ratio of 0. Rows are kept as they are,
    repeated ones too; of the columns only ``doc_id`` and ``text`` are read.
    """
    llr = mean_llr(docs, docs.sparkSession.sparkContext.broadcast(model))
    z = F.lit(model.slope) * F.col("llr") + F.lit(model.bias)
    chance = F.lit(0.0) if model.bias == -math.inf else 1 / (1 + F.exp(-z))
    return llr.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), chance.alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that are not predicted to be toxic."""
    model = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        llrs = text_llrs(sent.value)
        return lambda texts: [not model_score(sent.value, x) >= 0.5 for x in llrs(texts)]

    return filter_texts(docs, make)


def model_score(model: ToxicityModel, llr: float) -> float:
    return 1 / (1 + math.exp(-max(-700.0, model.slope * llr + model.bias)))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))

import zlib

import numpy as np
import pytest

from keytide.llm import quality, toxicity
from tests.llm.fixtures import TEXTS, documents

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")


def test_toxicity_on_held_out_rows(spark, tables):
    docs, labels = tables
    scored = toxicity.toxicity(docs, labels).toPandas()
    assert (scored.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in scored.doc_id]).all()
    assert scored.score.between(0, 1).all() and (scored.predicted == (scored.score >= 0.5)).all()
    known = scored.merge(labels.toPandas(), on="doc_id")
    held = known[known.held_out]
    assert (held.predicted == held.toxic).mean() > 0.9
    assert held[held.toxic == 1].score.mean() > held[held.toxic == 0].score.mean() + 0.3


def test_held_out_labels_are_not_used(spark, tables):
    docs, labels = tables
    flipped = labels.withColumn(
        "toxic", toxicity.F.when(toxicity.held_out(labels["doc_id"]), 1 - labels["toxic"]).otherwise(labels["toxic"])
    )
    a, b = (toxicity.fit(docs, x) for x in (labels, flipped))
    assert (a.slope, a.bias) == (b.slope, b.bias) and np.array_equal(a.gram_llr, b.gram_llr)


def test_shared_model_is_a_distribution(spark):
    rows = spark.createDataFrame([("abc abd abd", 0), ("abe xyz", 1)], "text string, toxic int")
    grams = toxicity.class_counts(rows, 3).cache()
    assert {r.s: (r.toxic_n, r.ordinary_n) for r in grams.collect()}["\x02ab"] == (1, 2)
    shared = {r.s: r.p for r in toxicity.shared_model(grams, 3).collect()}
    assert all(0 < p < 1 for p in shared.values())
    assert sum(p for s, p in shared.items() if len(s) == 1) < 1


def test_without_both_classes_nothing_is_toxic(spark):
    labels = spark.createDataFrame([(2, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        rows = toxicity.toxicity(documents(spark), some).collect()
        assert len(rows) == len(TEXTS) and {r.predicted for r in rows} == {0} and {r.score for r in rows} == {0.0}
    assert toxicity.toxicity(documents(spark, []), labels).count() == 0


def test_toxicity_keeps_columns_and_rows(spark, tables):
    docs, labels = tables
    both = documents(spark)
    from keytide.llm.textio import filter_texts

    kept = filter_texts(both, lambda: lambda texts: [len(t) < 10 for t in texts])
    assert kept.columns == both.columns and kept.count() == sum(len(t or "") < 10 for _, t in TEXTS)
    assert toxicity.reject_toxic(both, labels).count() <= len(TEXTS)


def test_em_recovers_labellers():
    rnd = np.random.default_rng(1)
    m = len(quality.LABELLERS)
    good = rnd.random(20_000) < 0.8
    low = np.where(good[:, None], rnd.random((20_000, m)) < 0.001, rnd.random((20_000, m)) < 0.35)
    votes = np.where(low, 0, 1)
    codes, counts = np.unique(votes @ 3 ** np.arange(m - 1, -1, -1), return_counts=True)
    post = dict(zip(codes.tolist(), quality.estimate(codes, counts.astype(float))))
    said = np.array([post[c] for c in votes @ 3 ** np.arange(m - 1, -1, -1)]) > 0.5
    assert (said == good).mean() > 0.97


def test_quality_against_labels_it_never_sees(spark, tables):
    docs, labels = tables
    known = quality.quality(docs).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (known[known.quality == 1].predicted == 1).mean() > 0.97
    assert (known[known.quality == 0].predicted == 0).mean() > 0.5


def test_quality_of_awkward_rows(spark):
    rows = quality.quality(documents(spark)).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality(documents(spark, [])).count() == 0
    kept = quality.reject_low(documents(spark))
    assert kept.columns == documents(spark).columns

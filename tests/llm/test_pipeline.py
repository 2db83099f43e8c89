import corpus_pipeline as pipeline
from keytide.llm import simhash, suffixes
from keytide.session import materialize
from tests.llm.fixtures import documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_the_given_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf), f"test-{name}")
        assert kept.columns == COLUMNS
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "simhash":
            assert simhash.near_duplicates(kept).where("doc_id <> component_id").count() == 0
        if name == "suffix_array":
            assert kept.count() == docs.count() and suffixes.repeats(kept).count() == 0
        sizes.append(kept.count())
        docs = kept
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4]
    packed = pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.collect()}


def test_stages_on_awkward_rows(spark, sf):
    for rows in (documents(spark), documents(spark, [])):
        docs = rows
        for name, stage in pipeline.STAGES:
            docs = materialize(stage(spark, docs, sf), f"awkward-{name}")
        assert docs.count() >= 0

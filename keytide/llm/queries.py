"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

try:
    from public_tokenizers import path as tokenizer_path
except ImportError:  # vocabularies elsewhere: a folder named by TOKENIZERS

    def tokenizer_path(name: str) -> str:
        import os

        return os.path.join(os.environ.get("TOKENIZERS", "/opt/tokenizers"), name)


from keytide.llm import (
    ann,
    bpe,
    divergence,
    flat_graph,
    interaction,
    lm,
    maxscore,
    packing,
    quality,
    simhash,
    suffixes,
    toxicity,
    warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.toxicity(docs, labels)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


def op5_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.search(_table(spark, sf_dir, "embeddings"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_query(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(_table(spark, sf_dir, "documents")).drop("row")


def op11_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_graph.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_ann": op2_ann,
    "op3_toxicity": op3_toxicity,
    "op4_packing": op4_packing,
    "op5_maxscore": op5_maxscore,
    "op6_warc": op6_warc,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_suffix_array": op10_suffix_array,
    "op11_filter_interaction": op11_filter_interaction,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_source_divergence": op13_source_divergence,
}

#: Learnt models, 64-bit XXH64 and tokenizers are beyond SQL; those queries are tested by brute
#: force, round trips and held-out accuracy.
ORACLES: dict[str, str] = {
    "op5_maxscore": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v AS q, v AS c
            WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op6_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest,
                   strlen(coalesce(html, '')) AS n
            FROM pages
        ), f AS (
            SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS least
            FROM p
        )
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> least THEN least END AS refers_to
        FROM f
    """,
    "op11_filter_interaction": r"""
        WITH d AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ), marks AS (
            SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
        ), f AS (
            SELECT part,
                   (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END)
                   || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
                   || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END)
                   || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
                   || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails,
                   coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
            FROM d LEFT JOIN marks USING (doc_id)
        ), c AS (
            SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x
            FROM f GROUP BY part, fails
        ), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l), o AS (
            SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
            FROM l a, l b, l c, l d, l e
            WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
        ), s AS (
            SELECT filter_order, CAST(k AS INTEGER) AS step, filter_order[k] AS own, filter_order[:k - 1] AS earlier,
                   filter_order[:k] AS upto
            FROM o, (SELECT unnest(range(1, 6)) AS k)
        ), r AS (
            SELECT part, filter_order, step, own,
                   coalesce(sum(n) FILTER (translate(fails, upto, '') = fails), 0) AS kept,
                   coalesce(sum(n) FILTER (contains(fails, own) AND translate(fails, earlier, '') = fails), 0) AS removed,
                   coalesce(sum(n) FILTER (contains(fails, own) AND translate(fails, earlier, '') <> fails), 0) AS redundant,
                   coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails,
                   coalesce(sum(g) FILTER (contains(fails, own) AND translate(fails, earlier, '') = fails), 0) AS good_lost,
                   coalesce(sum(x) FILTER (contains(fails, own) AND translate(fails, earlier, '') = fails), 0) AS toxic_lost
            FROM c, s GROUP BY part, filter_order, step, own
        )
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
               CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
        FROM r
    """,
    "op13_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
            FROM documents
        ), w AS (SELECT r, lang, source, unnest(words) AS term FROM d),
        kept AS (
            SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30
        ), langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
        used AS (
            SELECT w.lang, w.source, w.term, count(*) AS c
            FROM w JOIN kept ON w.lang = kept.lang AND w.term = kept.term GROUP BY ALL
        ), groups AS (
            SELECT g.lang, g.source, coalesce((SELECT sum(c) FROM used WHERE lang = g.lang AND source = g.source), 0) AS n
            FROM (SELECT DISTINCT lang, source FROM d) AS g
        ), p AS (
            SELECT g.lang, g.source, k.term, coalesce(u.c, 0) AS c,
                   1 + (1000000000::HUGEINT * (coalesce(u.c, 0) + 5)) // (g.n + 5 * l.v)::HUGEINT AS p,
                   1 + (1000000000::HUGEINT * (k.c + 5)) // (l.n + 5 * l.v)::HUGEINT AS q
            FROM groups g JOIN langs l ON g.lang = l.lang JOIN kept k ON k.lang = g.lang
            LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term
        ), pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), every AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
            FROM (
                SELECT * FROM every
                UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q
            )
        )
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
        FROM ranked WHERE part = 'pair' OR rank <= 50
    """,
}

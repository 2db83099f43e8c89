"""Small tables with everything that is awkward about real ones."""

from __future__ import annotations

from public_tokenizers import path

WORD_BPE, BYTE_BPE = path("word_bpe_49k.json"), path("byte_bpe_50k.json")

#: Columns that operators use inside, so a clash would show.
EXTRA = ("row", "fp", "lo", "hi", "runs", "_spans", "kept_id", "component_id", "known", "score", "block")
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
TEXTS = [
    (0, ""), (1, None), (2, "a b c"), (3, "the same row twice"), (3, "the same row twice"), (4, LONG),
    (5, LONG + " end"), (6, "x" * 100_000), (7, " \n\t "), (8, "naïve café 中文 🙂 ́"), (9, "A b C"),
    (10, "tie tie tie tie"), (11, "tie tie tie tie"), (None, "no id here"), (12, "\x1c\x85<|endoftext|>"),
]


def documents(spark, rows=TEXTS, extra=EXTRA):
    """documents with clashing extra columns."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in rows], schema)
    return df.selectExpr("*", *[f"'{c}' AS {c}" for c in extra])


def rows_of(df, *columns):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=key)

"""Strict validation of raw JSON messages: accepted rows and a quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Size limit in bytes and the two known fields.
MAX_BYTES = 1_048_576
FIELDS = ("key", "body")
# Without it Spark calls a text with a repeated field no JSON.
DUPLICATES = "spark.sql.variant.allowDuplicateKeys"
# Variant types a text field may have; null leaves it empty.
TEXT_TYPES = ("STRING", "VOID")


def _type_of(variant: Column) -> Column:
    return F.coalesce(F.schema_of_variant(variant), F.lit("VOID"))


def _member(field: str) -> Column:
    """Member called ``field`` in any case, the last one if there are several."""
    named = F.filter("_names", lambda n: F.lower(n) == field)
    return F.try_element_at("_members", F.try_element_at(named, F.lit(-1)))


def judge_messages(raw: DataFrame, col: str = "raw", max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add ``key``, ``body``, ``reason`` and ``field``; reason is NULL for good rows.

    One pass, no shuffle. The reasons, in the order they are tested: empty,
    too_large, badly_formed, wrong_type, unknown_key, multiple_values. Absent and
    null fields are empty strings, names match in any case, the last of a
    repeated field wins.

    Spark's JSON functions ignore what follows the first value. So ``[<text>,<mark>]``
    is parsed, where the mark is a hash of the text: two elements of which the
    second is the mark mean that the text was exactly one value. Only a text that
    fails this is parsed once more on its own.
    """
    if raw.sparkSession.conf.get(DUPLICATES, "false") != "true":
        raise RuntimeError(f"repeated fields need {DUPLICATES}=true (keytide.session.configure)")
    text = F.when(F.octet_length(col) <= max_bytes, F.col(col))
    mark = F.xxhash64(col)
    marked = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark.cast("string"), F.lit("]")))
    parsed = raw.select(
        *raw.columns,
        F.trim(F.translate(F.coalesce(col, F.lit("")), "\t\r\n", "   ")).alias("_trimmed"),
        text.alias("_text"),
        mark.alias("_mark"),
        F.try_variant_get(marked, "$", "array<variant>").alias("_pair"),
    )
    is_single = F.coalesce(
        (F.size("_pair") == 2)
        & (F.try_variant_get(F.get("_pair", F.lit(1)), "$", "bigint") == F.col("_mark")),
        F.lit(False),
    )
    value = F.when(is_single, F.get("_pair", F.lit(0))).otherwise(F.try_parse_json("_text"))
    parsed = _once(parsed, raw.columns, ["_trimmed", "_text"], _single=is_single, _value=value)
    members = F.try_variant_get("_value", "$", "map<string,variant>")
    parsed = _once(
        parsed,
        raw.columns,
        ["_trimmed", "_text", "_single"],
        _type=F.when(F.col("_value").isNotNull(), _type_of(F.col("_value"))),
        _members=members,
    )
    # Document order of the names matters only where some member is amiss.
    fine = F.forall(
        F.map_entries("_members"),
        lambda m: m["key"].isin(*FIELDS) & _type_of(m["value"]).isin(*TEXT_TYPES),
    )
    names = F.when(fine, F.map_keys("_members")).otherwise(F.json_object_keys("_text"))
    parsed = _once(
        parsed, raw.columns, ["_trimmed", "_text", "_single", "_type", "_members"], _names=names
    )
    first_amiss = F.get(
        F.filter(
            "_names",
            lambda n: ~F.lower(n).isin(*FIELDS)
            | ~_type_of(F.try_element_at("_members", n)).isin(*TEXT_TYPES),
        ),
        F.lit(0),
    )
    parsed = _once(
        parsed,
        raw.columns,
        ["_trimmed", "_text", "_single", "_type"],
        _amiss=first_amiss,
        **{f"_{f}": _member(f) for f in FIELDS},
    )
    misnamed = ~F.lower("_amiss").isin(*FIELDS)
    reason = (
        F.when(F.col("_trimmed") == "", "empty")
        .when(F.col("_text").isNull(), "too_large")
        .when(F.col("_type").isNull(), "badly_formed")
        .when(~(F.col("_type").startswith("OBJECT") | (F.col("_type") == "VOID")), "wrong_type")
        .when(misnamed, "unknown_key")
        .when(F.col("_amiss").isNotNull(), "wrong_type")
        .when(~F.col("_single"), "multiple_values")
    )
    field = F.when(reason == "unknown_key", F.col("_amiss")).when(
        reason == "wrong_type", F.lower("_amiss")
    )
    texts = {f: F.coalesce(F.try_variant_get(f"_{f}", "$", "string"), F.lit("")) for f in FIELDS}
    return _once(parsed, raw.columns, [], **texts, reason=reason, field=field)


def _once(df: DataFrame, original: list[str], keep: list[str], **columns: Column) -> DataFrame:
    """Select with each new column evaluated once per row.

    A generator over one struct keeps the optimizer from copying the expressions into
    every filter and projection above, which would parse each text several times.
    """
    struct = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*original, *keep, F.inline(F.array(struct)))


def validate_messages(
    raw: DataFrame, col: str = "raw", max_bytes: int = MAX_BYTES
) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``: messages with key and body, and rows with a reason."""
    judged = judge_messages(raw, col, max_bytes)
    accepted = judged.where(F.col("reason").isNull()).drop(col, "reason", "field")
    rejected = judged.where(F.col("reason").isNotNull()).drop("key", "body")
    return accepted, rejected

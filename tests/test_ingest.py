from pyspark.sql import functions as F

from keytide.operators.ingest import validate_messages

BIG = '{"key":"' + "a" * (1_048_577 - 10) + '"}'
# raw text -> (key, body) if accepted, else (reason, field)
ACCEPTED = {
    '{"key":"a","body":"b"}': ("a", "b"),
    '{"key":"a"}': ("a", ""),
    "{}": ("", ""),
    '{"key":null}': ("", ""),
    '{"key":"a","key":"c"}': ("c", ""),
    '{"KEY":"a"}': ("a", ""),
    ' \n{"body":"é"}\t': ("", "é"),
    "null": ("", ""),
}
REJECTED = {
    "": ("empty", None),
    "   ": ("empty", None),
    '{"key":"a"': ("badly_formed", None),
    "{'key':'a'}": ("badly_formed", None),
    '{"key":1}': ("wrong_type", "key"),
    '{"body":{"a":1}}': ("wrong_type", "body"),
    "[1]": ("wrong_type", None),
    '"s"': ("wrong_type", None),
    "5": ("wrong_type", None),
    '{"zzz":1}': ("unknown_key", "zzz"),
    '{"key":"a"} {"key":"b"}': ("multiple_values", None),
    '{"key":"a"}x': ("multiple_values", None),
    '{"key":"a"}]': ("multiple_values", None),
    '{"key":"a"},{"key":"b"}': ("multiple_values", None),
    '{"key":"a"},5],[': ("multiple_values", None),
    '{"key":"a"},0]': ("multiple_values", None),
    '{"zzz":1,"key":2}': ("unknown_key", "zzz"),
    '{"key":1,"body":2}': ("wrong_type", "key"),
    '{"BODY":2,"zzz":1}': ("wrong_type", "body"),
    BIG: ("too_large", None),
}


def test_every_body_is_judged(spark):
    texts = [*ACCEPTED, *REJECTED]
    raw = spark.createDataFrame(list(enumerate(texts)), "id int, raw string")
    accepted, rejected = validate_messages(raw)
    good = {texts[r.id]: (r.key, r.body) for r in accepted.collect()}
    bad = {texts[r.id]: (r.reason, r.field) for r in rejected.select("id", "reason", "field").collect()}
    assert good == ACCEPTED
    assert bad == REJECTED


def test_exactly_the_limit_is_accepted(spark):
    text = '{"key":"' + "a" * (1_048_576 - 10) + '"}'
    raw = spark.createDataFrame([(text,)], "raw string")
    accepted, _ = validate_messages(raw)
    assert accepted.select(F.length("key")).first()[0] == 1_048_576 - 10


def test_null_text_is_empty(spark):
    raw = spark.createDataFrame([(None,)], "raw string")
    assert validate_messages(raw)[1].first().reason == "empty"

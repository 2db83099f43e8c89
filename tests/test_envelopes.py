"""Trace documents read piece by piece."""

import json
import random

import pytest

from keytide.operators import latency
from keytide.sources import read_traces
from keytide.sources.envelopes import traces_in
from tests.test_endpoints_traces import DUMP, LATENCY

AWKWARD = [
    {"traceID": "]}{[\"data\": [", "spans": [], "text": "näïve \\ \" 中文 🙂"},
    {"traceID": "nested", "data": [1, [2, {"data": []}]]},
    {},
]


def document(traces, **how):
    return json.dumps({"total": 0, "errors": None, "data": traces, "after": {"x": [1]}}, **how)


@pytest.mark.parametrize("how", [{}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False}])
@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_every_cut_gives_the_same_traces(how, size):
    text = document(AWKWARD, **how) + "\n" + document([], **how) + document(DUMP, **how)
    pieces = [text[i : i + size] for i in range(0, len(text), size)]
    assert list(traces_in(iter(pieces))) == AWKWARD + DUMP
    rnd = random.Random(size)
    cuts = sorted(rnd.sample(range(len(text)), 30))
    pieces = [text[a:b] for a, b in zip([0, *cuts], [*cuts, None])]
    assert list(traces_in(iter(pieces))) == AWKWARD + DUMP


@pytest.mark.parametrize("cut", [-2, -3, 40, -200])
def test_a_cut_off_document_is_an_error(cut):
    text = json.dumps({"data": DUMP})[:cut]
    with pytest.raises(ValueError):
        list(traces_in(iter([text])))


def test_no_document_no_traces():
    assert list(traces_in(iter([]))) == [] == list(traces_in(iter(['{"errors": []}'])))


def test_a_long_document_is_not_held(monkeypatch):
    """The first traces come out before a small part of the text has been read."""
    from keytide.sources import envelopes

    monkeypatch.setattr(envelopes, "PIECE", 1_000)
    read = 0

    def pieces():
        nonlocal read
        yield '{"data": ['
        for i in range(100_000):
            read += 1
            yield json.dumps({"traceID": str(i), "spans": []}) + ","
        yield '{"traceID": "last"}]}'

    found = traces_in(pieces())
    for i in range(5_000):
        assert next(found)["traceID"] == str(i)
        assert read < i + 200


def test_folder_filters_and_shapes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(document(DUMP[:2], indent=1))
    (tmp_path / "in" / "b.json").write_text(document(DUMP[2:]) + document([{"traceID": 5, "spans": {}, "processes": 1}, 7]))
    (tmp_path / "in" / "_hidden").write_text("no json")
    path = str(tmp_path / "in")
    traces = read_traces(spark, path, envelope=True)
    assert {tuple(r) for r in latency.trace_latency(traces).collect()} == LATENCY
    ids = lambda df: {r.traceID for r in df.collect()}
    assert ids(traces) == {t["traceID"] for t in DUMP} | {"5"}
    assert ids(read_traces(spark, path, service="producer", envelope=True)) == {"all"}
    assert ids(read_traces(spark, "file:" + path, since=140, envelope=True)) == {t["traceID"] for t in DUMP[:4]}
    assert ids(read_traces(spark, "file://" + path, since=141, envelope=True)) == set()
    assert read_traces(spark, path, limit=2, envelope=True).count() == 2

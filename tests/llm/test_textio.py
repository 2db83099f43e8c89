"""Slices of batches, memories of bounded size, and what mended caps used to change."""

import numpy as np
import pyarrow as pa
import pytest

from keytide.llm import bpe, maxscore, quality, simhash, textio
from tests.llm.fixtures import BYTE_BPE
from tests.llm.test_vectors import table


@pytest.mark.parametrize("most", [1, 10, 25, 10_000])
def test_slices_are_bounded_and_whole(monkeypatch, most):
    monkeypatch.setattr(textio, "SLICE_BYTES", most)
    texts = ["", None, "abc", "é" * 9, "x" * 60, "", "tail"]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts), "n": list(range(7))})
    parts = list(textio.slices(batch))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    for part in parts:
        assert part.num_rows == 1 or sum(len((t or "").encode()) for t in part["text"].to_pylist()) <= most
    plain = batch.select(["n"])
    assert list(textio.slices(plain)) == [plain]


def test_a_memory_forgets_but_knows_what_it_is_asked():
    made = []
    memory = textio.Memory(most=200)

    def make(words):
        made.extend(words)
        return [w.upper() for w in words]

    for i in range(50):
        words = {f"w{i}", f"w{i + 1}", "the"}
        memory.fill(words, make)
        assert all(memory[w] == w.upper() for w in words)
        assert memory.chars == sum(map(len, memory)) + textio.ENTRY * len(memory) <= 200
    many = {f"word{i}" for i in range(100)}
    memory.fill(many, make)
    assert many <= set(memory)
    memory.fill({"a"}, make)
    assert set(memory) == {"a"}
    before = len(made)
    memory.fill({"a"}, make)
    assert len(made) == before


def test_a_memory_keeps_frequent_words_through_a_flood():
    made = []
    memory = textio.Memory(most=400)
    for i in range(200):
        memory.fill({"the", f"rare{i}"}, lambda new: (made.extend(new), [len(w) for w in new])[1])
        assert memory["the"] == 3 and memory[f"rare{i}"] == len(f"rare{i}")
        assert memory.chars <= 200
    assert made.count("the") == 1 and len(made) == 201


def test_ids_of_short_pieces_are_those_of_the_merge():
    vocabulary = bpe.Vocabulary.of(BYTE_BPE)
    rnd = np.random.default_rng(0)
    pieces = [bytes(rnd.choice(list(b" etaoinsabcXYZ0.\xc3\xa9"), int(rnd.integers(1, 60)))) for _ in range(400)]
    for piece in pieces + [b" " + b"a" * 63, b"aaaa", " naïve".encode()]:
        assert vocabulary.merge_ids(piece) == [vocabulary.ids[t] for t in vocabulary.merge(piece)]


def test_components_that_may_overflow_are_an_error(spark):
    large = [(i, [300_000.0 if i == 3 else 1.0, 2.0], 0) for i in range(5)]
    with pytest.raises(Exception, match="beyond 2\\^28"):
        maxscore.search(table(spark, large)).collect()
    edge = [(100 * i, [262_143.0, -262_143.0], 0) for i in range(2)]
    scores = {r.score for r in maxscore.search(table(spark, edge)).collect()}
    assert scores == {2 * (262_143 * 1024) ** 2}


@pytest.mark.parametrize(
    "text,vote",
    [
        ("Государственный праздник " * 30, 1),
        ("Это обычный русский текст о погоде и море. " * 20, 2),
        ("这是一个没有空格的普通中文句子它说的是天气和大海" * 10 + "。 好", 1),
        ("นี่คือข้อความภาษาไทยธรรมดาเกี่ยวกับอากาศ" * 5 + " ครับ", 1),
        ("x" * 40 + " " + "y" * 40, 0),
        ("an ordinary sentence about the weather", 2),
    ],
)
def test_word_length_is_in_characters(text, vote):
    at = [name for name, _, _ in quality.LABELLERS].index("word_length")
    pattern = quality.votes(quality.signals(text))
    assert pattern // 3 ** (len(quality.LABELLERS) - 1 - at) % 3 == vote


def test_the_table_of_wanted_ids_misses_none(spark):
    docs = spark.createDataFrame([(i, f"a b c d e {i} f g") for i in range(3000)], "doc_id long, text string")
    wanted = spark.range(0, 3000, 7).withColumnRenamed("id", "doc_id")
    made = {r.doc_id for r in simhash.shingle_sets(docs, True, wanted).collect()}
    assert {r.doc_id for r in wanted.collect()} <= made
    assert len(made) < 500
    assert simhash.shingle_sets(docs, True, wanted.limit(0)).count() == 0

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from keytide.llm import lm, packing
from tests.llm.fixtures import TEXTS, WORD_BPE, documents, rows_of

LIBRARY = Tokenizer.from_file(WORD_BPE)


def test_chunks_equal_whole_texts():
    rnd = random.Random(1)
    odd = list("abeo  \n\t'sStT12 .!#éÉ中　\x1c\x85🙂́ΣσİA<|>")
    texts = ["".join(rnd.choice(odd) for _ in range(rnd.randrange(40))) for _ in range(3000)]
    texts += ["<|endoftext|>a <|STARTOFTEXT|>", "x" * 500, *[t or "" for _, t in TEXTS]]
    encoder = packing.ChunkEncoder.of(WORD_BPE)
    for text, want in zip(texts, LIBRARY.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want.ids


def test_words_are_merged_once_and_equal_whole_texts():
    rnd = random.Random(2)
    latin = [chr(c) for c in range(256)]
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    letters = [c for c in latin if c.isalpha()]
    texts = [a + b + c for a in letters for b in "aÀ" for c in ("", ",", "'s", "'", "_", "²", "5.")]
    texts += [m + n for m in marks for n in ["", "s", "'t", *marks]]
    for _ in range(3000):
        word = "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 90)))
        texts.append(word + "".join(rnd.choice(marks) for _ in range(rnd.randrange(4))))
        texts.append(" ".join("".join(rnd.choice(latin) for _ in range(rnd.randrange(9))) for _ in range(5)))
    texts += ["abc<|endoftext|>", "abc<|", "ABC,’ σας Σ, İa. ﬁt’s", "été, e\u0301te\u0301, ÉTÉ."]
    encoder = packing.ChunkEncoder(WORD_BPE)
    for text, want in zip(texts, LIBRARY.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want.ids

    encoder, whole = packing.ChunkEncoder(WORD_BPE), []

    class Whole:
        def encode_batch_fast(self, chunks, tokenizer=encoder.tokenizer, **kind):
            whole.extend(chunks)
            return tokenizer.encode_batch_fast(chunks, **kind)

        encode_batch = encode_batch_fast

    encoder.tokenizer = Whole()
    texts = ["Thorn thorn, THORN. été", "thorn!! thorn Été; don't", "thorn, 12"]
    got = [encoder.encode(text) for text in texts]
    assert sorted(whole) == ["12", "don't"]

    encoder, merged = packing.ChunkEncoder(WORD_BPE), []

    class Model:
        def tokenize(self, word, model=encoder.model):
            merged.append(word)
            return model.tokenize(word)

    encoder.model = Model()
    assert [encoder.encode(text) for text in texts] == got
    assert sorted(merged) == sorted(["thorn", "Ã©tÃ©", ",", ".", "!!", ";"])


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_everything_once(seed):
    rnd = np.random.default_rng(seed)
    capacity = 64
    lengths = np.unique(rnd.integers(1, capacity + 1, 40))
    counts = rnd.integers(1, [5, 200, 1000, 3][seed], len(lengths))
    made = packing.plan(lengths, counts, capacity)
    sequence, offset, length = [], [], []
    for n, times in zip(lengths, counts):
        s, o = made.places(np.full(times, n), np.arange(times))
        sequence.append(s), offset.append(o), length.append(np.full(times, n))
    sequence, offset, length = map(np.concatenate, (sequence, offset, length))
    order = np.lexsort((offset, sequence))
    sequence, offset, length = sequence[order], offset[order], length[order]
    first = np.r_[True, sequence[1:] != sequence[:-1]]
    assert (offset[first] == 0).all()
    assert (offset[1:] == offset[:-1] + length[:-1])[~first[1:]].all()
    assert (offset + length <= capacity).all()
    assert len(np.unique(sequence)) == made.sequences
    # lengths over half the capacity need a sequence each
    bound = max(math.ceil(length.sum() / capacity), (2 * length > capacity).sum())
    plain = sum(packing.best_fit(lengths, counts, capacity).values())
    assert bound <= made.sequences <= min(bound * 1.2 + 1, plain * 1.02 + 1)


def test_knapsack_against_all_choices():
    best, taken = packing.knapsack(np.array([3, 5]), np.array([4.0, 7.0]), 11)
    assert best.tolist() == [0, 0, 0, 4, 4, 7, 8, 8, 11, 12, 14, 15]
    assert taken[10] == 5


def test_best_fit_takes_remainders_only():
    capacity, rest = 256, []
    lengths = np.arange(1, capacity + 1)
    for scale in (2, 20, 200):
        counts = np.maximum(1, scale * 5 * np.exp(-lengths / 50)).astype(np.int64)
        solved = packing.configurations(lengths, counts, capacity)
        cover = Counter()
        for config, amount in solved.items():
            for n in config:
                cover[n] += amount
        assert [cover[n] for n in lengths.tolist()] == pytest.approx(counts.tolist())
        chosen, left = packing.rounded(solved, dict(zip(lengths.tolist(), counts.tolist())), capacity)
        rest.append(sum(left.values()) / counts.sum())
        assert packing.plan(lengths, counts, capacity).sequences <= 1.01 * lengths @ counts / capacity + 1
    assert rest[2] < rest[1] < rest[0] and rest[2] < 0.05


def test_best_fit_in_bulk_equals_piece_by_piece():
    rnd = np.random.default_rng(3)
    for _ in range(40):
        lengths = np.unique(rnd.integers(1, 33, 12))
        counts = rnd.integers(0, 30, len(lengths))
        rooms = []
        for n in np.repeat(lengths, counts)[::-1]:
            fits = [r for r in rooms if r >= n]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else 32) - n)
        got = packing.best_fit(lengths, counts, 32)
        assert sorted(32 - sum(c) for c, times in got.items() for _ in range(times)) == sorted(rooms)
        used = Counter()
        for config, times in got.items():
            used.update({n: times * config.count(n) for n in set(config)})
        assert [used[n] for n in lengths.tolist()] == counts.tolist()


def test_packed_documents(spark):
    want = Counter()
    for i, text in TEXTS:
        ids = np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, at in enumerate(range(0, len(ids), 4096)):
            some = ids[at : at + 4096]
            want[(i, piece, at, len(some), zlib.crc32(some.tobytes()))] += 1
    rows = packing.pack(documents(spark).repartition(3), WORD_BPE).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    at: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 4096
    assert packing.pack(documents(spark, []), WORD_BPE).count() == 0


def brute_scores(texts):
    ids = [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]
    words, pairs = Counter(), Counter()
    for x in ids:
        words.update(x)
        pairs.update(zip(x, x[1:]))
    total, out = sum(words.values()), []
    for x in ids:
        own, own_pairs, score = Counter(x), Counter(zip(x, x[1:])), 0.0
        for k, w in enumerate(x):
            alone = math.log(max(words[w] - own[w], 1) / max(total - len(x), 1))
            known = pairs[(x[k - 1], w)] - own_pairs[(x[k - 1], w)] if k else 0
            if k and known > 0:
                score += math.log(known / (words[x[k - 1]] - own[x[k - 1]]))
            else:
                score += alone + (math.log(lm.BACKOFF) if k else 0.0)
        out.append((len(x), score if x else None))
    return out


@pytest.mark.parametrize("block_tokens", [lm.BLOCK_TOKENS, 5_000])
def test_backoff_scores_against_brute_force(spark, block_tokens):
    got = rows_of(lm.scores(documents(spark), WORD_BPE, block_tokens=block_tokens))
    want = [(i, n, s) for (i, _), (n, s) in zip(TEXTS, brute_scores([t for _, t in TEXTS]))]
    want.sort(key=lambda r: tuple((x is not None, x) for x in r))
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2]
        assert (a[2] is None) == (b[2] is None) and (a[2] is None or a[2] == pytest.approx(b[2]))
    assert lm.scores(documents(spark, []), WORD_BPE).count() == 0


def test_tokens_are_made_by_one_thread(spark):
    """In the workers of op7 as in those of op4."""

    def setting(batches):
        import os

        import pyarrow as pa

        for batch in batches:
            packing.ChunkEncoder(WORD_BPE)
            found = os.environ.get("TOKENIZERS_PARALLELISM")
            yield pa.RecordBatch.from_pydict({"found": [found] * batch.num_rows})

    coded = lm.tokens(documents(spark, TEXTS), WORD_BPE)
    assert {r.found for r in coded.mapInArrow(setting, "found string").collect()} == {"false"}

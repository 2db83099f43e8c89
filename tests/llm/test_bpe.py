import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

from keytide.llm import bpe
from tests.llm.fixtures import BYTE_BPE, TEXTS, documents, rows_of

ODD = list("abeo  \n\t'sStT12 .!#é中　\x1c\x85🙂́<|")


class Toy(bpe.Vocabulary):
    def __init__(self, merges):
        self.merges, self.rank = merges, {m: i for i, m in enumerate(merges)}
        self.ids = {bytes([b]): b for b in range(256)} | {a + b: 256 + i for i, (a, b) in enumerate(merges)}
        self.lookahead = bpe.sufficient_lookahead(merges)


def random_merges(rnd):
    tokens, merges = [b"a", b"b"], []
    while len(merges) < 30:
        pair = (rnd.choice(tokens), rnd.choice(tokens))
        if pair not in merges and len(pair[0] + pair[1]) < 9 and pair[0] + pair[1] not in tokens:
            merges.append(pair)
            tokens.append(pair[0] + pair[1])
    return merges


def test_lookahead_is_sufficient_for_any_merge_list():
    rnd = random.Random(5)
    for _ in range(40):
        toy = Toy(random_merges(rnd))
        text = bytes(rnd.choice(b"ab") for _ in range(3 * toy.lookahead + 200))
        whole = toy.merge(text)
        cut = rnd.randrange(toy.lookahead, len(text))
        known, at = toy.merge(text[:cut]), 0
        for ours, theirs in zip(known, whole):
            at += len(ours)
            if at > cut - toy.lookahead:
                break
            assert ours == theirs


def test_transducer_equals_whole_merge_and_holds_little():
    rnd = random.Random(6)
    vocabulary = bpe.Vocabulary.of(BYTE_BPE)
    piece = "".join(rnd.choice("etaoinsrh") for _ in range(40_000)).encode()
    transducer, out, most = bpe.PieceTransducer(vocabulary), [], 0
    for at in range(0, len(piece), 700):
        out += transducer.feed(piece[at : at + 700])
        most = max(most, len(transducer.held))
    assert out + transducer.finish() == vocabulary.merge(piece)
    assert most < 5 * vocabulary.lookahead


def test_encoding_and_decoding_equal_the_library():
    rnd = random.Random(7)
    library, encoder = Tokenizer.from_file(BYTE_BPE), bpe.encoder_of(BYTE_BPE)
    texts = ["".join(rnd.choice(ODD) for _ in range(rnd.randrange(50))) for _ in range(2000)]
    texts += [t or "" for _, t in TEXTS] + ["<|endoftext|>a<|endoftext|>", "a  ", " " * 70_000 + "b", "-=" * 40_000]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = b"".join(encoder.encode(text))
        assert np.frombuffer(ids, "<u4").tolist() == want.ids
        decoder = bpe.Decoder(encoder.vocabulary)
        got = "".join(decoder.feed(ids[at : at + 4]) for at in range(0, len(ids), 4)) + decoder.finish()
        assert got == library.decode(want.ids, skip_special_tokens=False)


def test_broken_bytes_decode_as_in_the_library():
    library, vocabulary = Tokenizer.from_file(BYTE_BPE), bpe.Vocabulary.of(BYTE_BPE)
    rnd = random.Random(8)
    for _ in range(300):
        ids = [rnd.randrange(50257) for _ in range(20)]
        decoder = bpe.Decoder(vocabulary)
        got = decoder.feed(np.array(ids, "<u4").tobytes()) + decoder.finish()
        assert got == library.decode(ids, skip_special_tokens=False)


def test_digests_of_awkward_rows(spark):
    library = Tokenizer.from_file(BYTE_BPE)
    want = []
    for i, text in TEXTS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        raw, decoded = np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = rows_of(bpe.digests(documents(spark), BYTE_BPE))
    assert got == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))
    assert bpe.digests(documents(spark, []), BYTE_BPE).count() == 0
    back = bpe.decode(bpe.encode(documents(spark), BYTE_BPE), BYTE_BPE)
    assert {r.text for r in back.collect()} == {t or "" for _, t in TEXTS}


def test_frequent_chunks_outlive_a_flood_of_rare_ones(monkeypatch):
    """A chunk that comes again and again is merged once, with a mark after it or without."""
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    encoder = bpe.Encoder(bpe.Vocabulary.of(BYTE_BPE))
    merged, merge_ids = [], encoder.vocabulary.merge_ids
    monkeypatch.setattr(encoder.vocabulary, "merge_ids", lambda piece: merged.append(piece) or merge_ids(piece))
    rare = lambda k: "x" + "".join(chr(97 + int(d)) for d in str(k))
    text = " ".join(f"word {rare(k)} word, word.\nAnd" for k in range(200))
    got = np.frombuffer(b"".join(b"".join(encoder.encode(t)) for t in ["a " + text] * 2), "<u4").tolist()
    assert merged.count(b" word") == 1 and len(encoder.known) + len(encoder.before) <= 40
    want = Tokenizer.from_file(BYTE_BPE).encode("a " + text, add_special_tokens=False)
    assert got == 2 * want.ids

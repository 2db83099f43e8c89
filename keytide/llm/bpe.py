"""Byte-level BPE as a streaming transducer, and its inverse.

How far to the right can a byte decide about a token? A merge at the end of what is known may
take a piece that an earlier text would have merged to the left; the merge to the left that is
lost, or gained, comes later in the merge list, and its right part begins with the left part of
the first. So influence moves left along chains of merges of rising rank, each of which moves it
by the length of its left part. ``lookahead`` is the longest such chain, plus what the first
merge may hold of known bytes. A token that ends at least ``lookahead`` bytes before the end of
what is known can't change any more: it is emitted and its bytes are forgotten.

Decoding is a state machine from bytes to text: it holds at most the three bytes of an
unfinished character.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import sys
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from keytide.llm.textio import id_text, map_batches

#: Fixed value: what parts a text before merges, of the pre-tokenizer of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters fed at once, chunks a worker remembers (half of them from before), and the longest that are.
BLOCK, REMEMBERED, LONGEST = 1 << 16, 600_000, 64
#: Below this character every Unicode version agrees on what a letter is; marks that follow words.
PLAIN, MARKS = "\u0250", tuple(".,;:!?")
#: Bits of an id in the number of a pair.
ID_BITS = 24


def byte_characters() -> dict[str, int]:
    """Printable characters that stand for bytes in the vocabulary file, and their bytes."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after which nothing that follows can change a token; ``merges`` in order of rank."""
    chains: dict[bytes, int] = {}
    longest = widest = 0
    for left, right in merges:
        before = max((chains.get(right[:i], 0) for i in range(1, len(right) + 1)), default=0)
        chain = before + len(left)
        chains[left] = max(chains.get(left, 0), chain)
        longest, widest = max(longest, chain), max(widest, len(left) + len(right))
    return longest + widest


class Vocabulary:
    """Merges by rank, ids and bytes of tokens, special tokens, of a vocabulary file."""

    _of_path: dict[str, Vocabulary] = {}

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_characters()
        raw = lambda s: bytes(letters[c] for c in s)
        model = spec["model"]
        self.ids = {raw(t): i for t, i in model["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = [(raw(a), raw(b)) for a, b in pairs]
        self.rank = {m: i for i, m in enumerate(self.merges)}
        #: the same by ids: of a pair its rank, of a rank the id that the pair becomes
        self.rank_of = {self.ids[a] << ID_BITS | self.ids[b]: i for i, (a, b) in enumerate(self.merges)}
        self.made = [self.ids[a + b] for a, b in self.merges]
        self.byte_ids = [self.ids.get(bytes([b])) for b in range(256)]
        self.lookahead = sufficient_lookahead(self.merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.ids.values(), *self.special.values()], default=-1) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in self.ids.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode("utf-8")

    @classmethod
    def of(cls, path: str) -> Vocabulary:
        """One for each worker process."""
        if path not in cls._of_path:
            cls._of_path[path] = cls(path)
        return cls._of_path[path]

    def merge(self, piece: bytes) -> list[bytes]:
        """Tokens of a piece: the pair of lowest rank first, the leftmost of equals.

        A heap over the pairs of a linked list, so long pieces take n log n steps.
        """
        if piece in self.ids and len(piece) == 1:
            return [piece]
        import heapq

        parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        rank = self.rank
        heap = [(r, i) for i in range(len(parts) - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(parts) or rank.get((parts[i], parts[j])) != r:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
                if (r := rank.get((parts[i], parts[after[j]]))) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := rank.get((parts[before[i]], parts[i]))) is not None:
                heapq.heappush(heap, (r, before[i]))
        return [p for p in parts if p is not None]


    def merge_ids(self, piece: bytes) -> list[int]:
        """Ids of a short piece's tokens, by ``merge``'s rule; looks for the lowest rank anew each time."""
        parts = list(map(self.byte_ids.__getitem__, piece))
        rank_of, made, none = self.rank_of.get, self.made, len(self.made)
        ranks = [rank_of(a << ID_BITS | b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            lowest = min(ranks)
            if lowest == none:
                break
            i = ranks.index(lowest)
            parts[i : i + 2] = (made[lowest],)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of(parts[i] << ID_BITS | parts[i + 1], none)
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << ID_BITS | parts[i], none)
        return parts


class PieceTransducer:
    """Tokens of one piece that comes in parts, in memory that the piece's length doesn't change."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.held = vocabulary, b""

    def feed(self, more: bytes) -> list[bytes]:
        """Tokens that are stable with what has come."""
        self.held += more
        ahead = self.vocabulary.lookahead
        if len(self.held) < 4 * ahead:
            return []
        stable, at = [], 0
        for token in self.vocabulary.merge(self.held):
            if at + len(token) > len(self.held) - ahead:
                break
            stable.append(token)
            at += len(token)
        self.held = self.held[at:]
        return stable

    def finish(self) -> list[bytes]:
        held, self.held = self.held, b""
        return self.vocabulary.merge(held) if held else []


class Encoder:
    """Whole texts to ids; remembers the ids of chunks between spaces."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import regex

        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are taken as little-endian 32-bit numbers")
        self.vocabulary = vocabulary
        self.pieces = regex.compile(PATTERN)
        #: a space between two white-space characters may belong to either side's piece
        self.inner_space = regex.compile(r"[\s\x1c-\x1f] [\s\x1c-\x1f]|[\s\x1c-\x1f] $")
        self.specials = regex.compile("|".join(map(regex.escape, vocabulary.special))) if vocabulary.special else None
        marks = {m: vocabulary.byte_ids[ord(m)] for m in MARKS}
        self.marks = {m: array("I", [i]).tobytes() for m, i in marks.items() if i is not None}
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def encode(self, text: str) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids, a part for each block of the text."""
        at = 0
        if self.specials:
            for m in self.specials.finditer(text):
                yield from self._plain(text[at : m.start()])
                yield np.array([self.vocabulary.special[m[0]]], "<u4").tobytes()
                at = m.end()
        yield from self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> Iterator[bytes]:
        """A piece never spans a single space and the character that follows it, unless white
        space is on both sides of that space; so texts are cut before such spaces."""
        if not text:
            return
        if self.inner_space.search(text):
            yield from self._pieces(text)
            return
        at = 0
        while at < len(text):
            end = text.rfind(" ", at + 1, at + BLOCK) if at + BLOCK < len(text) else len(text)
            if end <= at:
                end = text.find(" ", at + 1)
                end = len(text) if end < 0 else end
            chunks = text[at:end].split(" ")
            # every chunk but the first, and the first but at the start, has its space in front
            first = self._chunk(chunks[0]) if chunks[0] else b""
            found = list(map(self.known.get, chunks[1:]))
            if None in found:
                found = [self._spaced(w) if ids is None else ids for w, ids in zip(chunks[1:], found)]
            yield first + b"".join(found)
            at = end

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(self._pieces(chunk))

    def _spaced(self, word: str) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            ids = self.before.get(word)
            if ids is None:
                ids = self._new(word)
            if len(word) <= LONGEST:
                # chunks that come again are taken over, so rare ones never push out frequent ones
                if 2 * len(self.known) >= REMEMBERED:
                    self.known, self.before = {}, self.known
                self.known[word] = ids
        return ids

    def _new(self, word: str) -> bytes:
        """Letters alone are one piece, and so is a mark after them; what else there is, the pattern tells."""
        if len(word) < LONGEST and (word.isascii() or max(word) < PLAIN):
            if word.isalpha():
                return array("I", self.vocabulary.merge_ids(b" " + word.encode("utf-8"))).tobytes()
            if word[-1:] in self.marks and word[:-1].isalpha():
                # the letters are mostly known without the mark
                return self._spaced(word[:-1]) + self.marks[word[-1]]
        return b"".join(self._pieces(" " + word))

    def _pieces(self, text: str) -> Iterator[bytes]:
        merge_ids, ids = self.vocabulary.merge_ids, self.vocabulary.ids
        for m in self.pieces.finditer(text):
            start, end = m.span()
            if end - start <= LONGEST:
                piece = m[0]
                if piece[0] == " " and piece.isascii() and piece[1:].isalpha():
                    yield self._spaced(piece[1:])
                else:
                    yield array("I", merge_ids(piece.encode("utf-8"))).tobytes()
                continue
            part: list[int] = []
            for token in self._stream(text, start, end):
                part.append(ids[token])
                if len(part) >= BLOCK:
                    yield array("I", part).tobytes()
                    part = []
            yield array("I", part).tobytes()

    def _stream(self, text: str, start: int, end: int) -> Iterator[bytes]:
        transducer = PieceTransducer(self.vocabulary)
        step = max(256, 4 * self.vocabulary.lookahead)
        for at in range(start, end, step):
            yield from transducer.feed(text[at : min(end, at + step)].encode("utf-8"))
        yield from transducer.finish()


class Decoder:
    """Ids to text, in parts; bytes that are no UTF-8 become replacement characters."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.bytes_of = vocabulary.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return self.state.decode(raw)

    def finish(self) -> str:
        return self.state.decode(b"", True)


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Vocabulary.of(path))
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids array<int>)`` of whole texts; NULL and empty texts have no ids."""

    def make():
        encoder = encoder_of(path)

        def apply(batch):
            ids = [np.frombuffer(b"".join(encoder.encode(t.as_py())), "<u4").astype(np.int32) for t in batch.column("text")]
            return {"doc_id": batch.column("doc_id"), "ids": ids}

        return apply

    return map_batches(id_text(docs), "doc_id long, ids array<int>", make)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)``; NULL ids give an empty text."""

    def make():
        vocabulary = Vocabulary.of(path)

        def apply(batch):
            texts = []
            for ids in batch.column("ids"):
                decoder = Decoder(vocabulary)
                texts.append(decoder.feed(np.array(ids.as_py() or [], "<u4").tobytes()) + decoder.finish())
            return {"doc_id": batch.column("doc_id"), "text": texts}

        return apply

    return map_batches(encoded.select("doc_id", "ids"), "doc_id long, text string", make)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: encoded, decoded and hashed as a stream.

    Ids and decoded text exist a block at a time. Repeated rows are kept; of the columns only
    ``doc_id`` and ``text`` are read.
    """

    def make():
        encoder = encoder_of(path)

        def apply(batch):
            n, ids_sha, text_sha = [], [], []
            for text in batch.column("text"):
                decoder, ids_hash, text_hash, count = Decoder(encoder.vocabulary), hashlib.sha256(), hashlib.sha256(), 0
                for ids in encoder.encode(text.as_py()):
                    count += len(ids) // 4
                    ids_hash.update(ids)
                    text_hash.update(decoder.feed(ids).encode("utf-8"))
                text_hash.update(decoder.finish().encode("utf-8"))
                n.append(count)
                ids_sha.append(ids_hash.hexdigest())
                text_sha.append(text_hash.hexdigest())
            return {"doc_id": batch.column("doc_id"), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

        return apply

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(id_text(docs), schema, make)

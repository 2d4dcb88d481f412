"""Piece vocabularies, and tries of distinct pre-tokens walked level by level with numpy."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

SPACE = "▁"
#: Longer pre-tokens are taken one by one instead of in the trie.
LONGEST = 32
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_TABLE_BITS = 18
#: A run of spaces with the word behind it, a line end, or a word at the start of a line.
PRETOKEN = re.compile(r" +[^ \n]*|\n|[^ \n]+")
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


class Vocabulary:
    """The pieces of a SentencePiece model file, with a hash table over their rolling hashes."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        if norm.name != "identity" or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("only the identity normaliser with a dummy prefix and escaped spaces is compiled here")
        self.unigram = spec.trainer_spec.model_type == 1
        self.text = [p.piece for p in spec.pieces]
        self.score = np.array([p.score for p in spec.pieces])
        self.kind = np.array([p.type for p in spec.pieces])
        self.plain = np.isin(self.kind, (NORMAL, USER))
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.text) if self.kind[i] == BYTE}
        self.unknown = int(np.flatnonzero(self.kind == UNKNOWN)[0])
        used = [self.text[i] for i in np.flatnonzero(self.plain)]
        if any(SPACE in p.lstrip(SPACE) or (len(p) > 1 and ("\n" in p or " " in p)) for p in used):
            raise ValueError("a piece spans a space or a line end, so texts cannot be cut there")
        self.longest = max(map(len, used))
        self.number = {self.text[i]: int(i) for i in np.flatnonzero(self.plain)}
        self.size = np.array([len(t) for t in self.text])
        self.power = np.array([pow(int(_MULT), i, 1 << 64) for i in range(LONGEST + self.longest + 2)], np.uint64)
        self.hash = np.array([self._hash(t) for t in self.text], np.uint64)
        self._build(np.flatnonzero(self.plain))

    def _hash(self, text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_MULT) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _build(self, ids: np.ndarray) -> None:
        """Two tables with different mixing; what collides in the first lies alone in the second."""
        keys = self.hash[ids]
        if len(set(keys.tolist())) < len(keys):
            raise ValueError("two pieces have one hash")
        self.first = np.full(1 << _TABLE_BITS, -1, np.int32)
        slot = (keys * _MIX[0]) >> np.uint64(64 - _TABLE_BITS)
        _, lone = np.unique(slot, return_index=True)
        self.first[slot[lone]] = ids[lone]
        rest = np.setdiff1d(np.arange(len(ids)), lone)
        bits = _TABLE_BITS
        while True:
            slot = (keys[rest] * _MIX[1]) >> np.uint64(64 - bits)
            if len(np.unique(slot)) == len(slot):
                break
            bits += 1
        self.second_bits = np.uint64(64 - bits)
        self.second = np.full(1 << bits, -1, np.int32)
        self.second[slot] = ids[rest]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these rolling hashes, or -1."""
        got = self.first[(hashes * _MIX[0]) >> np.uint64(64 - _TABLE_BITS)]
        got = np.where((got >= 0) & (self.hash[got] == hashes), got, -1)
        missing = np.flatnonzero(got < 0)
        other = self.second[(hashes[missing] * _MIX[1]) >> self.second_bits]
        got[missing] = np.where((other >= 0) & (self.hash[other] == hashes[missing]), other, -1)
        return got


class Trie:
    """The trie of some sorted distinct strings, none longer than ``LONGEST``, as arrays.

    A node is a distinct prefix. It is held by the first string that has it, and ``fresh(d)`` gives those strings at
    depth d. ``share(d, values)`` hands a node's value on to the other strings that run through it.
    """

    def __init__(self, vocabulary: Vocabulary, words: list[str]):
        self.n, self.vocabulary = len(words), vocabulary
        self.length = np.fromiter(map(len, words), np.int64, self.n)
        self.depth = int(self.length.max(initial=0))
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.zeros((self.n, self.depth), np.uint32)
        codes[np.arange(self.depth) < self.length[:, None]] = flat
        self.codes = codes = np.ascontiguousarray(codes.T)
        same = np.ones(max(0, self.n - 1), bool)
        common = np.zeros(self.n, np.int64)
        for d in range(self.depth):
            same &= (codes[d, 1:] == codes[d, :-1]) & (codes[d, 1:] != 0)
            common[1:] += same
        self.common = common
        self.rolled = np.zeros((self.depth + 1, self.n), np.uint64)
        for d in range(self.depth):
            self.rolled[d + 1] = self.rolled[d] * _MULT + codes[d].astype(np.uint64) + np.uint64(1)

    def fresh(self, d: int) -> np.ndarray:
        return np.flatnonzero((self.length >= d) & (self.common < d))

    def share(self, d: int, rows: np.ndarray, *values: np.ndarray) -> None:
        """Fill each string's entry from the holder of its node at depth d."""
        holder = np.zeros(self.n, np.int64)
        holder[rows] = rows
        holder = np.maximum.accumulate(holder)
        through = self.length >= d
        for v in values:
            v[through] = v[holder[through]]

    def piece(self, rows: np.ndarray, d: int, k: int) -> np.ndarray:
        """The piece that spells the last k characters up to depth d, or -1."""
        return self.vocabulary.find(self.rolled[d, rows] - self.rolled[d - k, rows] * self.vocabulary.power[k])


def pretokens(text: str) -> list[str]:
    """The text behind a dummy space, cut before spaces that follow other characters and around line ends; no piece
    spans such a cut."""
    return PRETOKEN.findall(" " + text)


def grouped(values: Iterable[str | None], characters: int = 1_500_000) -> Iterator[list[list[str]]]:
    """Pre-tokens of consecutive texts, in groups of bounded total length (one text at least)."""
    group, held = [], 0
    for v in values:
        group.append(pretokens(v) if v else [])
        held += len(v or "")
        if held > characters:
            yield group
            group, held = [], 0
    if group:
        yield group

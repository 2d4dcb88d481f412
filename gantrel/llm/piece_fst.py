"""SentencePiece encoding and decoding as shortest paths in a composed transducer.

Three transducers over characters are compiled: the normaliser (a dummy space before the text, spaces escaped), the pieces
(a trie whose final states put out their piece and return to the root) and the byte fallback (a character without a
piece, at a cost). Their composition remembers the last piece: the arc to the next one weighs zero if merging would leave
the two apart and infinity if not, as the file holds merges and no probabilities. A text is composed with it lazily, and
the path of least weight in the tropical semiring, where weights add along a path and the least of all paths counts, is
the encoding. No piece spans a cut between pre-tokens, so they are composed one by one; and as the least weight at a prefix
depends on the prefix alone, the distinct pre-tokens of a batch are composed together along their trie.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .pieces import LONGEST, SPACE, Trie, Vocabulary, grouped

STORE = 200_000
_OTHER = -2  # a character without a piece, which nothing merges with
#: Weight of the fallback for one character; of pieces that stay apart, and of those that would merge.
FALLBACK, ONE, ZERO = 1.0, 0.0, np.inf


class PieceTransducer:
    def __init__(self, path: str):
        v = self.vocabulary = Vocabulary(path)
        if v.unigram:
            raise ValueError("arcs are compiled from merges, which a unigram model does not have")
        if any(len(t) > 1 and not all(c in v.number for c in t) for t in v.number):
            raise ValueError("a piece has a character that is no piece")
        runs = [i for t, i in v.number.items() if set(t) == {SPACE} and len(t) > 1]
        self.longest_run = max([1, *(len(v.text[i]) for i in runs)])
        if len({v.score[i] for i in runs}) > 1 or (runs and v.score[runs[0]] > min(v.score[i] for t, i in v.number.items() if len(t) > 1 and i not in set(runs))):
            raise ValueError("runs of spaces are expected to merge last, from the left")
        mergeable = [i for t, i in v.number.items() if len(t) > 1 and i not in set(runs)]
        mergeable.sort(key=lambda i: -v.score[i])
        self.rank = np.full(len(v.text) + 1, -1, np.int64)  # -1: a character, never merged
        self.rank[mergeable] = np.arange(len(mergeable))
        self.left, self.right = np.arange(len(v.text)), np.arange(len(v.text))
        self.ends = v.plain.copy()  # pieces that merging their own characters gives
        self.ends[runs] = False
        order = {v.text[i]: n for n, i in enumerate(mergeable)}
        for i in mergeable:
            parts = _merge(v.text[i], order)
            if len(parts[-1]) == 1:
                a, b = parts[-2]
                self.left[i], self.right[i] = v.number[a], v.number[b]
            else:
                self.ends[i] = False
        self.order, self.runs = order, {len(v.text[i]): i for i in runs} | {1: v.number[SPACE]}
        self.run_order = {v.text[i]: 0 for i in runs}
        self.pieces = [bytes([int(t[3:5], 16)]) if k == 6 else t.replace(SPACE, " ").encode() if p else b"" for t, k, p in zip(v.text, v.kind, v.plain)]
        self.pieces[v.unknown] = " ⁇ ".encode()
        self.store: dict[str, bytes] = {}
        self._compile()

    def _compile(self) -> None:
        """The normaliser composed with the pieces: a trie over the characters of the text, in which a space stands for
        its escape. ``arcs`` leads from a state by a character, ``output`` names the piece of a final state."""
        self.arcs: dict[int, int] = {}
        self.output = [-1]
        for text, i in self.vocabulary.number.items():
            if not self.ends[i]:
                continue
            state = 0
            for c in text.replace(SPACE, " "):
                state = self.arcs.setdefault(state << 21 | ord(c), len(self.output))
                if state == len(self.output):
                    self.output.append(-1)
            self.output[state] = i

    def shortest_path(self, word: str) -> list[int]:
        """Pieces of one pre-token of any length; ``_OTHER`` for each character that falls back. For each place all last
        pieces are kept that a path of finite weight ends with, each with its least weight."""
        best: list[dict[int, tuple[float, int, int]]] = [{-1: (ONE, 0, -1)}, *({} for _ in word)]

        def relax(start: int, end: int, piece: int) -> None:
            for last, (weight, _, _) in best[start].items():
                if piece == _OTHER:
                    weight += FALLBACK
                elif last >= 0 and not self._apart(last, piece):
                    continue
                if weight < best[end].get(piece, (ZERO,))[0]:
                    best[end][piece] = (weight, start, last)

        for start in range(len(word)):
            state: int | None = 0
            for end in range(start, len(word)):
                state = self.arcs.get(state << 21 | ord(word[end]))
                if state is None:
                    break
                if self.output[state] >= 0:
                    relax(start, end + 1, self.output[state])
            if word[start].replace(" ", SPACE) not in self.vocabulary.number:
                relax(start, start + 1, _OTHER)
        out, at = [], len(word)
        last = min(best[at], key=lambda i: best[at][i][0]) if word else -1
        while at:
            out.append(last)
            _, at, last = best[at][last]
        return out[::-1]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves each pair of pieces apart: undoing their merges, latest first, no pair at the border
        may have merged before."""
        v, out = self.vocabulary, np.ones(len(a), bool)
        a, b, limit, live = a.copy(), b.copy(), np.full(len(a), np.iinfo(np.int64).max), np.flatnonzero((a >= 0) & (b >= 0))
        while len(live):
            x, y = a[live], b[live]
            joined = v.find(v.hash[x] * v.power[v.size[y]] + v.hash[y])
            rank = np.where(joined >= 0, self.rank[joined], -1)
            bad = (rank >= 0) & (rank < limit[live])
            out[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[on], x[on], y[on], rx[on], ry[on]
            undo = rx > ry
            limit[live] = np.where(undo, rx, ry + 1)
            a[live], b[live] = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return out

    def many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The shortest paths of sorted distinct pre-tokens without runs of spaces, their pieces end to end with the number
        of pieces of each; ``_OTHER`` for each character that falls back."""
        trie = Trie(self.vocabulary, words)
        shape = (trie.depth + 1, trie.n)
        weight, last, step = np.full(shape, ZERO), np.full(shape, -1, np.int64), np.zeros(shape, np.int64)
        weight[0] = ONE
        for d in range(1, trie.depth + 1):
            rows = trie.fresh(d)
            least, piece, back = np.full(len(rows), ZERO), np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
            for k in range(1, min(d, self.vocabulary.longest) + 1):
                found = trie.piece(rows, d, k)
                before = weight[d - k, rows]
                if k == 1:
                    other = found < 0
                    least[other], piece[other], back[other] = before[other] + FALLBACK, _OTHER, 1
                hit = np.flatnonzero((found >= 0) & self.ends[found] & (before < least))
                if not len(hit):
                    continue
                arc = np.where(self.apart(last[d - k, rows[hit]], found[hit]), ONE, ZERO)
                path = before[hit] + arc
                better = path < least[hit]
                hit = hit[better]
                least[hit], piece[hit], back[hit] = path[better], found[hit], k
            weight[d, rows], last[d, rows], step[d, rows] = least, piece, back
            trie.share(d, rows, weight[d], last[d], step[d])
        at, rows, taken = trie.length.copy(), np.flatnonzero(trie.length), []
        counts = np.zeros(trie.n, np.int64)
        while len(rows):
            taken.append((rows, last[at[rows], rows]))
            counts[rows] += 1
            at[rows] -= step[at[rows], rows]
            rows = rows[at[rows] > 0]
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        for i, (rows, pieces) in enumerate(taken):
            out[ends[rows] - 1 - i] = pieces
        return out, counts

    @lru_cache(maxsize=1 << 16)  # noqa: B019
    def _apart(self, a: int, b: int) -> bool:
        return bool(self.apart(np.array([a]), np.array([b]))[0])

    def _ids(self, word: str, parts: list[int]) -> bytes:
        """Bytes of the ids, with the fallback for characters without a piece."""
        if _OTHER in parts:
            v, ids, at = self.vocabulary, [], 0
            for p in parts:
                if p == _OTHER:
                    ids += [v.bytes[b] for b in word[at].encode()] if len(v.bytes) == 256 else [v.unknown]
                    at += 1
                else:
                    ids.append(p)
                    at += int(v.size[p])
            parts = ids
        return np.array(parts, "<u4").tobytes()

    def learn(self, tokens: set[str]) -> None:
        if len(self.store) > STORE:
            self.store.clear()
        new = tokens.difference(self.store)
        runs = [t for t in new if t.startswith("  ")]
        words = {*new.difference(runs), *(" " + t.lstrip(" ") for t in runs)}
        short = sorted(w for w in words if len(w) <= LONGEST)
        base = {w: self._ids(w, self.shortest_path(w)) for w in words if len(w) > LONGEST}
        if short:
            pieces, counts = self.many([w.replace(" ", SPACE) for w in short])
            ends = np.cumsum(counts)
            odd = np.add.reduceat(np.append(pieces == _OTHER, False), ends - counts) * (counts > 0) > 0
            flat, stops = pieces.astype("<u4").tobytes(), (4 * ends).tolist()
            base.update(zip(short, map(flat.__getitem__, map(slice, [0, *stops], stops))))
            for i in np.flatnonzero(odd).tolist():
                base[short[i]] = self._ids(short[i], pieces[ends[i] - counts[i] : ends[i]].tolist())
        space = np.array([self.runs[1]], "<u4").tobytes()
        for t in runs:  # the last space may merge with the word; what is left of the run merges from the left
            run, ids = len(t) - len(t.lstrip(" ")), base[" " + t.lstrip(" ")]
            run, ids = (run, ids[4:]) if ids[:4] == space else (run - 1, ids)
            base[t] = np.array([self.runs[n] for n in self._run(run)], "<u4").tobytes() + ids
        self.store.update((t, base[t]) for t in new)

    @lru_cache(maxsize=4096)  # noqa: B019
    def _run(self, n: int) -> tuple[int, ...]:
        """Lengths of the pieces that a run of n spaces merges to, the leftmost pair first; a piece of the longest kind
        merges no further, so the rest of a long run is a run of its own."""
        full = max(0, n // self.longest_run - 2)
        rest = _merge(SPACE * (n - full * self.longest_run), self.run_order)[-1] if n else []
        return (self.longest_run,) * full + tuple(map(len, rest))

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the ids' pieces without the dummy space."""
        joined = b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return joined[1:] if joined[:1] == b" " else joined


def _merge(text: str, order: dict[str, int]) -> list[list[str]]:
    """All states of the characters as the best pair, the leftmost of equal ones, is merged again and again."""
    parts = list(text)
    states = [parts]
    while True:
        ranks = [order.get(a + b, -1) for a, b in zip(parts, parts[1:])]
        good = [r for r in ranks if r >= 0]
        if not good:
            return states
        i = ranks.index(min(good))
        parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]
        states.append(parts)


@lru_cache(maxsize=1)
def _transducer(path: str) -> PieceTransducer:
    return PieceTransducer(path)


def _encoded(fst: PieceTransducer, values: Iterator[str | None]) -> Iterator[bytes]:
    for group in grouped(None if v is None else v.replace(SPACE, " ") for v in values):
        fst.learn(set().union(*group))
        get = fst.store.__getitem__
        for g in group:
            yield b"".join(map(get, g))


def encode(text: Column, model_path: str) -> Column:
    """Little-endian unsigned 32-bit ids of each whole text, as binary. Null and empty texts have no ids."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fst = _transducer(model_path)
        for batch in batches:
            yield pa.array(list(_encoded(fst, (v.as_py() for v in batch))), pa.binary())

    return F.arrow_udf(run, "binary")(text)


def decode(ids: Column, model_path: str) -> Column:
    """Text of the ids that ``encode`` gives: the text itself, but that the escape sign U+2581 comes back as a space.
    Null and empty ids give an empty text; byte pieces that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fst = _transducer(model_path)
        for batch in batches:
            yield pa.array([fst.decode(v.as_py() or b"").decode("utf-8", "replace") for v in batch], pa.string())

    return F.arrow_udf(run, "string")(ids)


CHECKED = "struct<n_ids:bigint,ids_crc32:bigint,decoded_sha256:string,round_trip:boolean>"


def encode_and_decode(text: Column, model_path: str) -> Column:
    """Number and CRC-32 of each text's ids, the SHA-256 of the text decoded from them and whether it is the text; null
    texts count as empty."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fst = _transducer(model_path)
        for batch in batches:
            rows = []
            for value, ids in zip(batch, _encoded(fst, (v.as_py() for v in batch))):
                back = fst.decode(ids)
                rows.append((len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back).hexdigest(), back == (value.as_py() or "").encode()))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 4, kinds)], names=["n_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    return F.arrow_udf(run, CHECKED)(text)

"""Token counts under a unigram model, with the dynamic program shared along a trie.

The distinct pre-tokens of a batch go into a trie. The forward score of a node, the best weight of any segmentation of
its prefix, is computed once for all pre-tokens that share the prefix; a terminal's number of tokens is stored. A
document's count is the sum over its pre-tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .pieces import LONGEST, SPACE, Trie, Vocabulary, grouped

#: Weights are integers in this many parts of a nat, so that ties are exact; a token less breaks them.
PARTS, TIE = 10_000, 1 << 12
#: Of an unknown character, below the worst piece.
PENALTY = 10.0
#: Most stored terminals; past it the store starts afresh.
STORE = 250_000


class UnigramCounter:
    """Numbers of tokens of pre-tokens. A model file of another kind than unigram has ranks for scores; its pieces then
    weigh as Zipf's law would have them, ``-ln(rank + 1)``."""

    def __init__(self, path: str):
        v = self.vocabulary = Vocabulary(path)
        nats = v.score if v.unigram else -np.log(1.0 + _ranks(v))
        self.weight = np.round(nats * PARTS).astype(np.int64) * TIE - 1
        worst = int(np.round((nats[v.plain].min() - PENALTY) * PARTS))
        self.unknown = worst * TIE
        self.store: dict[str, int] = {}

    def _unknown_size(self, code: int) -> int:
        """Tokens of a character without a piece: its bytes, if the file has pieces for them, else one."""
        return (1 if code < 0x80 else 2 if code < 0x800 else 3 if code < 0x10000 else 4) if len(self.vocabulary.bytes) == 256 else 1

    def one(self, word: str) -> int:
        """The same for one pre-token of any length, without the trie."""
        v, word = self.vocabulary, word.replace(" ", SPACE)
        best, count = [0], [0]
        for d in range(1, len(word) + 1):
            size = self._unknown_size(ord(word[d - 1]))
            top = (best[d - 1] + self.unknown - size, count[d - 1] + size) if word[d - 1] not in v.number else None
            for k in range(1, min(d, v.longest) + 1):
                if (i := v.number.get(word[d - k : d])) is not None:
                    got = (best[d - k] + int(self.weight[i]), count[d - k] + 1)
                    if top is None or got[0] > top[0]:
                        top = got
            best.append(top[0])
            count.append(top[1])
        return count[-1]

    def many(self, words: list[str]) -> np.ndarray:
        """Numbers of tokens of sorted distinct pre-tokens."""
        trie = Trie(self.vocabulary, [w.replace(" ", SPACE) for w in words])
        best = np.zeros((trie.depth + 1, trie.n), np.int64)
        count = np.zeros((trie.depth + 1, trie.n), np.int64)
        for d in range(1, trie.depth + 1):
            rows = trie.fresh(d)
            single = trie.piece(rows, d, 1)
            code = trie.codes[d - 1, rows]
            size = np.where(code < 0x80, 1, np.where(code < 0x800, 2, np.where(code < 0x10000, 3, 4))) if len(self.vocabulary.bytes) == 256 else np.ones(len(rows), np.int64)
            known = single >= 0
            top = best[d - 1, rows] + np.where(known, self.weight[single], self.unknown - size)
            tokens = count[d - 1, rows] + np.where(known, 1, size)
            for k in range(2, min(d, self.vocabulary.longest) + 1):
                found = trie.piece(rows, d, k)
                hit = np.flatnonzero(found >= 0)
                got = best[d - k, rows[hit]] + self.weight[found[hit]]
                better = got > top[hit]
                hit = hit[better]
                top[hit], tokens[hit] = got[better], count[d - k, rows[hit]] + 1
            best[d, rows], count[d, rows] = top, tokens
            trie.share(d, rows, best[d], count[d])
        return count[trie.length, np.arange(trie.n)]

    def learn(self, words: set[str]) -> None:
        """Store the terminals of pre-tokens not met before."""
        if len(self.store) > STORE:
            self.store.clear()
        new = words.difference(self.store)
        short = sorted(w for w in new if len(w) <= LONGEST)
        if short:
            self.store.update(zip(short, self.many(short).tolist()))
        for w in new:
            if len(w) > LONGEST:
                self.store[w] = self.one(w)


def _ranks(v: Vocabulary) -> np.ndarray:
    order = np.lexsort((np.arange(len(v.text)), -v.score))
    ranks = np.empty(len(order))
    ranks[order] = np.arange(len(order))
    return ranks


@lru_cache(maxsize=1)
def _counter(path: str) -> UnigramCounter:
    return UnigramCounter(path)


def token_counts(text: Column, model_path: str) -> Column:
    """Struct of n_pretokens and n_tokens of each whole text.

    Null and empty texts have none of either. A character without a piece counts as its UTF-8 bytes. Ties between
    segmentations go to fewer tokens. A pure function of the text, so repeated rows get equal counts.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(model_path)
        for batch in batches:
            words, tokens = [], []
            for group in grouped(v.as_py() for v in batch):
                counter.learn(set().union(*group))
                get = counter.store.__getitem__
                words += map(len, group)
                tokens += [sum(map(get, g)) for g in group]
            yield pa.StructArray.from_arrays([pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["n_pretokens", "n_tokens"])

    return F.arrow_udf(run, "struct<n_pretokens:bigint,n_tokens:bigint>")(text)

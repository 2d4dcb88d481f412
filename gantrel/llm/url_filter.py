"""URL filtering with one bit-parallel automaton for all rules.

Every rule is a pair of globs over the canonical URL, which is the host, a zero byte and the path. Each literal of
each glob owns one bit of a multiword mask; a star is a self-loop on the bit before it. One shift, one AND and one
OR per character move all globs at once (extended Shift-And), over a whole batch of URLs at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, without

SEPARATOR = 0
_LOW = np.uint64(1)


@dataclass(frozen=True)
class Rule:
    """``host`` and ``path`` may hold ``*`` (any run of bytes inside its part) and ``?`` (one byte)."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.lit(2**31 - 1)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.lit(2**31 - 1)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


class GlobAutomaton:
    """Globs over bytes, packed into 64-bit words; glob number i is the i-th pattern given."""

    def __init__(self, globs: Sequence[list[tuple[str, int]]]):
        """A glob is a list of ("byte", value), ("any", 0), ("loop", 0: any byte, 1: any but the separator)."""
        bits = sum(1 + sum(kind != "loop" for kind, _ in g) for g in globs)
        self.words = max(1, -(-bits // 64))
        step, loop = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        self.start, self.sticky = np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)
        self.accept: list[tuple[int, np.uint64]] = []
        at = 0
        for g in globs:
            self.start[at // 64] |= _LOW << np.uint64(at % 64)
            for kind, value in g:
                if kind == "loop":
                    w, bit = at // 64, _LOW << np.uint64(at % 64)
                    loop[:, w] |= bit
                    if value:
                        loop[SEPARATOR, w] &= ~bit
                else:
                    at += 1
                    w, bit = at // 64, _LOW << np.uint64(at % 64)
                    if kind == "byte":
                        step[value, w] |= bit
                    else:
                        step[np.arange(256) != SEPARATOR, w] |= bit
            w, bit = at // 64, _LOW << np.uint64(at % 64)
            self.accept.append((w, bit))
            if g and g[-1] == ("loop", 0):
                self.sticky[w] |= bit
            at += 1
        self.step, self.loop = step, loop

    def run(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Final masks, one row for each text; a text leaves once only accepted globs are alive in it."""
        final = np.zeros((len(starts), self.words), np.uint64)
        live = np.arange(len(starts))
        state = np.tile(self.start, (len(starts), 1))
        at = 0
        while len(live):
            ended = lengths[live] <= at
            settled = ended | ~(state & ~self.sticky).any(axis=1)
            if settled.any():
                final[live[settled]] = state[settled]
                live, state = live[~settled], state[~settled]
                if not len(live):
                    break
            c = flat[starts[live] + at]
            shifted = state << _LOW
            if self.words > 1:
                shifted[:, 1:] |= state[:, :-1] >> np.uint64(63)
            state = (shifted & self.step[c]) | (state & self.loop[c])
            at += 1
        return final

    def first(self, final: np.ndarray) -> np.ndarray:
        """The lowest glob number that accepts, or -1."""
        best = np.full(len(final), -1, np.int64)
        for i, (w, bit) in enumerate(self.accept):
            best[(best < 0) & ((final[:, w] & bit) != 0)] = i
        return best


def _part(text: str, loop_kind: int) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    for b in text.encode():
        out.append(("loop", loop_kind) if b == 42 else ("any", 0) if b == 63 else ("byte", b))
    return out


def compile_rules(rules: Sequence[Rule]) -> tuple[GlobAutomaton, list[Rule]]:
    """Two globs for each rule (the host, and its subdomains), longest rule first; of equal length, block first."""
    order = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
    globs = []
    for r in order:
        tail = [*_part(r.host, 1), ("byte", SEPARATOR), *_part(r.path, 1), ("loop", 0)]
        globs += [tail, [("loop", 1), ("byte", ord(".")), *tail]]
    return GlobAutomaton(globs), [r for r in order for _ in range(2)]


def filter_urls(df: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule (null if none fits) and verdict.

    A rule fits its host and every subdomain when the path starts with its path; the longest rule (host and path
    together) wins, a block before an allow of equal length. Where no rule fits, ``default`` is the verdict. Null
    URLs and URLs without ``://`` have empty host and path, so no rule fits them. Columns of the input with one of
    the four names are replaced; all other columns stay. Zero bytes, which no URL may hold, end a host.
    """
    automaton, owners = compile_rules(rules)
    texts = [r.text for r in owners]

    @F.arrow_udf("int")
    def winner(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = []
            for part in chunks(batch, 4096):
                part = part.cast(pa.large_binary())
                part = pa.concat_arrays([part])
                offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
                data = part.buffers()[2]
                flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
                found.append(automaton.first(automaton.run(flat, offsets[:-1], np.diff(offsets))))
            yield pa.array(np.concatenate(found), pa.int32())

    out = without(df.withColumn("__url", F.col(f"`{url}`")), "host", "path", "rule", "verdict", *([] if url.lower() not in {"host", "path", "rule", "verdict"} else [url]))
    out = out.withColumn("host", host_of(F.col("__url"))).withColumn("path", path_of(F.col("__url")))
    out = out.withColumn("__rule", winner(F.concat(F.col("host"), F.lit("\0"), F.col("path"))))
    names = F.array(*[F.lit(t) for t in texts]) if texts else F.array(F.lit(""))
    verdicts = F.array(*[F.lit(r.verdict) for r in owners]) if owners else F.array(F.lit(""))
    hit = F.col("__rule") >= 0
    return (
        out.withColumn("rule", F.when(hit, F.element_at(names, F.col("__rule") + 1)))
        .withColumn("verdict", F.when(hit, F.element_at(verdicts, F.col("__rule") + 1)).otherwise(F.lit(default)))
        .drop("__url", "__rule")
    )

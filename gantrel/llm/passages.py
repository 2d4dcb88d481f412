"""Repeated passages, found with compact windows.

A text is a sequence of 5-word shingles. The Cartesian tree over the shingles' hashes groups all subsequences of at least
``WIDTH`` shingles by the smallest hash in them, their signature: a compact window holds those with one signature. Equal
subsequences have equal signatures, so two passages that are alike share the windows of their equal runs.

An edit of a word spoils 5 shingles, and with them at most ``WIDTH - 1`` more subsequences on its left. A passage of n
shingles that is 0.8 similar to another has at most n / 9 spoilt ones, and some part of it of the shortest length no more
than its share. So it can only lie where most windows of a part as long as the shortest passage occur elsewhere too; this
necessary condition is counted, not sampled, and leaves the regions that take part in the search.

Regions are then joined on their windows' signatures: each window with the first region that has it. A first region may
share no more than a few words; windows that lie in no passage found so far are therefore joined again, with the first
region that has the same run of shingles before, behind or around the center, for several lengths of the run, up to most
of the shortest passage. So a window meets few regions however many share it, and the pairs grow as the windows do. A joined pair of
windows gives the shift between two regions; along each shift the shingles are compared, and runs at nearly the same
shift are put together to passages, span against span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bound_memory, broadcast_if_small, discard, frugal, join_split, materialize, release_shuffles, small_batches

WORDS = 5
#: Shingles in the shortest subsequences that are signed.
WIDTH = 12
#: A window's contexts: the runs of so many more shingles before its center and behind it, and on both sides. A run that
#: others quote in part, and that goes five shingles beyond the quote, has a context that does so too; equal passages of
#: 50 words have one of the last kind.
RADII, BOTH = (4, 8, 12), 17
#: Most subsequences in one window.
SPAN = 32_768
#: Bytes of texts that are hashed at once, as the arrays on the way take some forty times as many.
HASHED = 256 << 10
#: Runs whose shifts differ by no more than this from the next one are parts of one passage.
DRIFT = 10
#: Texts with passages up to which their spans are broadcast to all texts.
SPAN_ROWS = 250_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_random = np.random.default_rng(42)
_FOLDED = np.arange(256)
_FOLDED[65:91] += 32
_CODES = _random.integers(0, 1 << 63, 256, np.uint64)[_FOLDED]
_POWERS = np.cumprod(np.full(4096, np.uint64(0x9E3779B97F4A7C15)))
_FACTORS = _random.integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Factors of hashes along a run, one the other's inverse.
_STEP, _BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_IN_WORD = ~np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))


# --- shingles and windows -------------------------------------------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts, of the shingle that begins with it, and the texts' numbers of words. Words are
    what ASCII white space separates, their case ignored; the last ``WORDS - 1`` hashes of a text mean nothing."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    inside = _IN_WORD[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    first, sizes = edge[::2], edge[1::2] - edge[::2]
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(first, bounds))
    if not len(first):
        return np.zeros(0, np.uint64), counts
    begins = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(begins, sizes)
    words = np.add.reduceat(_CODES[data[inside]] * _POWERS[place & 4095], begins)
    words = mixed(words + sizes.astype(np.uint64))
    padded = np.concatenate((words, np.zeros(WORDS - 1, np.uint64)))
    total = np.zeros(len(words), np.uint64)
    for i, factor in enumerate(_FACTORS):
        total += padded[i : i + len(words)] * factor
    return mixed(total), counts


def compact_windows(values: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """(first, center, last) of every compact window at least ``shortest`` wide, by descending the Cartesian tree: each
    subsequence from [first, center] to [center, last] has its smallest value, the leftmost of equal ones, at the center."""
    out, stack = [], [(0, len(values))]
    while stack:
        a, b = stack.pop()
        if b - a < shortest:
            continue
        c = a + int(values[a:b].argmin())
        out.append((a, c, b - 1))
        stack.append((a, c))
        stack.append((c + 1, b))
    return out


def window_centers(values: np.ndarray, width: int) -> np.ndarray:
    """For each subsequence of ``width`` values the center of its compact window, for all windows at once: what a node of
    the Cartesian tree holds of them is the run of subsequences that have one center."""
    at, size = np.arange(len(values)), 1
    if len(values) < width:
        return at[:0]

    def lower(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[b] < values[a], b, a)

    while 2 * size <= width:
        at, size = lower(at[:-size], at[size:]), 2 * size
    rest = width - size
    return lower(at[:-rest], at[rest:]) if rest else at


def windows_of(texts: list[bytes], shortest: int) -> tuple[np.ndarray, ...]:
    """(text number, signature, first subsequence, their number, center) of the compact windows of all texts that have
    ``shortest`` shingles; a window is told by the subsequences of ``WIDTH`` shingles in it. Of adjacent
    windows of one signature, where a shingle repeats, all but the first are one."""
    hashes, counts = shingles(texts)
    ends = np.cumsum(counts)
    of = np.repeat(np.arange(len(texts)), counts)
    centers = window_centers(hashes, WIDTH)
    starts = np.arange(len(centers))
    of = of[: len(centers)]
    kept = (starts + WIDTH + WORDS - 1 <= ends[of]) & (counts[of] >= shortest + WORDS - 1)
    starts, centers, of = starts[kept], centers[kept], of[kept]
    keys = hashes[centers]
    opens = np.concatenate(([True], (keys[1:] != keys[:-1]) | (of[1:] != of[:-1]))) if len(starts) else np.zeros(0, bool)
    moves = np.concatenate(([False], centers[1:] != centers[:-1])) if len(starts) else opens
    moved = np.cumsum(moves & ~opens)
    second = moves & ~opens & (moved - np.maximum.accumulate(np.where(opens, moved, 0)) == 1)
    new = np.flatnonzero(opens | second | (starts % SPAN == 0))
    begin = (ends - counts)[of[new]]
    sizes = np.diff(np.append(new, len(starts)))
    return of[new], keys[new], starts[new] - begin, sizes, centers[new] - begin


def center_of(place: np.ndarray) -> np.ndarray:
    return (place >> 24) + (place >> 16 & 255)


def spoilt(shortest: int, similarity: float) -> int:
    """Most subsequences of ``WIDTH`` among ``shortest`` shingles that edits can have spoilt, the passage being similar."""
    lost = int(shortest * (1 - similarity) / (1 + similarity))
    return lost + (WIDTH - 1) * max(1, lost // (WORDS - 1))


def contexts_of(hashes: np.ndarray, sizes: np.ndarray, of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number for each window, contexts of all) of windows centered at shingle ``at`` of region ``of``; the regions, of so
    many ``sizes``, are laid end to end in ``hashes``. A context is the hash of a run and its kind, equal wherever the run
    is; runs that leave the region are no contexts. Sums from the start give every run's hash by one difference."""
    stops = np.cumsum(sizes)
    low, high = (stops - sizes)[of], stops[of]
    forth, back = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(hashes), f)))) for f in (_STEP, _BACK))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(hashes.astype(np.uint64)) * forth[:-1])))
    center = low + at
    runs = [(center - BOTH, 2 * BOTH + 1), *[(center - r, r + 1) for r in RADII], *[(center, r + 1) for r in RADII]]
    held, found = np.zeros((len(at), len(runs)), bool), np.zeros((len(at), len(runs)), np.uint64)
    for i, (first, n) in enumerate(runs):
        held[:, i] = inside = (first >= low) & (first + n <= high)
        a = first[inside]
        found[inside, i] = mixed((sums[a + n] - sums[a]) * back[a] + np.uint64(i))
    return held.sum(axis=1), found[held]


# --- passages of two regions ----------------------------------------------------------------------------------------


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def best_chains(first: np.ndarray, last: np.ndarray, from_: np.ndarray, to: np.ndarray, shortest: int, similarity: float) -> list[tuple[int, int]]:
    """Spans from the start of a run to the end of another whose runs make up enough of both sides: runs [first, last) of
    one text lie at [from_, to) of the other. The longest for each start; shorter ones lie within."""
    held = np.concatenate(([0], np.cumsum(last - first)))
    out: list[tuple[int, int]] = []
    for a in range(len(first)):
        if out and first[a] >= out[-1][0] and last[-1] <= out[-1][1]:
            break
        mine, other, m = last[a:] - first[a], to[a:] - from_[a], held[a + 1 :] - held[a]
        good = np.flatnonzero((mine >= shortest) & (other >= m) & (m >= similarity * (mine + other - m)))
        if len(good):
            span = int(first[a]), int(last[a + good[-1]])
            if not out or span[1] > out[-1][1]:
                if out and span[0] <= out[-1][1]:
                    out[-1] = (out[-1][0], span[1])
                else:
                    out.append(span)
    return out


def passages_between(mine: np.ndarray, at: int, other: np.ndarray, other_at: int, here: np.ndarray, there: np.ndarray, shortest: int, similarity: float, same_text: bool = False) -> list[tuple[int, int]]:
    """Shingle spans of a region (hashes ``mine``, the first at ``at``) that nearly repeat one of another region, tried at
    the shifts of the windows that both have, centered ``here`` and ``there``."""
    shifts, counts = np.unique(there - here, return_counts=True)
    groups = np.split(np.arange(len(shifts)), np.flatnonzero(np.diff(shifts) > DRIFT) + 1)
    groups.sort(key=lambda g: -int(counts[g].sum()))
    found: list[tuple[int, int]] = []
    for g in groups:
        low, high = shifts[g[0]], shifts[g[-1]]
        centers = here[(there - here >= low) & (there - here <= high)]
        if all(any(a <= c < b for a, b in found) for c in centers.tolist()) and found:
            continue
        partner = np.full(len(mine), -1, np.int64)

        def compare(shift: int) -> None:
            a, b = max(at, other_at - shift), min(at + len(mine), other_at + len(other) - shift)
            if a < b:
                same = mine[a - at : b - at] == other[a + shift - other_at : b + shift - other_at]
                held = partner[a - at : b - at]
                x = np.flatnonzero(same & (held < 0))
                held[x] = x + a + shift

        for d in sorted(g.tolist(), key=lambda i: (-counts[i], abs(int(shifts[i])))):
            shift = int(shifts[d])
            if not (partner[here[there - here == shift] - at] >= 0).all():
                compare(shift)
        # Runs beyond an inserted or lost word may share no joined window: they lie at shifts close by.
        if 0 < np.count_nonzero(partner >= 0) < len(mine):
            tried = {int(shifts[d]) for d in g}
            near = {s + i for s in tried for i in range(-DRIFT, DRIFT + 1)} - tried
            for shift in sorted(near, key=lambda s: (min(abs(s - t) for t in tried), s)):
                if not (same_text and shift >= 0):
                    compare(shift)
        step = np.flatnonzero(partner >= 0)
        if not len(step):
            continue
        cut = np.flatnonzero((np.diff(step) != 1) | (np.diff(partner[step]) != 1)) + 1
        first, last = step[np.concatenate(([0], cut))], step[np.concatenate((cut - 1, [len(step) - 1]))]
        found += [(a + at, b + at) for a, b in best_chains(first, last + 1, partner[first], partner[last] + 1, shortest, similarity)]
    return sorted(found)


# --- search ---------------------------------------------------------------------------------------------------------


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of consecutive sorted rows, cut only where the first ``keys`` columns change."""
    held: list[np.ndarray] = []
    for batch in batches:
        cols = [np.asarray(c) for c in batch.columns]
        if not len(cols[0]):
            continue
        if held:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        other = np.flatnonzero(np.any([c != c[-1] for c in cols[:keys]], axis=0))
        cut = int(other[-1]) + 1 if len(other) else 0
        held = [c[cut:] for c in cols]
        if cut:
            yield [c[:cut] for c in cols]
    if held:
        yield held


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, copies, several) of rows (doc_id, text): ``texts`` (doc, tie, text), each text under the smallest doc_id
    that has it; ``copies`` (doc_id, same, first), all others; ``several``, the ids of more than one row. ``tie`` tells
    the texts of such an id apart and is 0 elsewhere."""
    rows = docs.filter("doc_id is not null").select("doc_id", "text", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("same"))
    names = materialize(rows.select("doc_id", "same"), "names")
    several = materialize(names.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "several")
    shared = names.groupBy("same").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("first <> last")
    copies = materialize(join_split(names, shared.drop("last"), ["same"], names.count()).filter("doc_id <> first").select("doc_id", "same", "first").distinct(), "copies")
    discard(names)
    own = rows.join(broadcast_if_small(copies.select("doc_id", "same")), ["doc_id", "same"], "left_anti")
    few = broadcast_if_small(several)
    once = own.join(few, "doc_id", "left_anti").select(F.col("doc_id").alias("doc"), F.lit(0).cast("long").alias("tie"), "text")
    odd = own.join(few, "doc_id", "left_semi").dropDuplicates(["doc_id", "same"]).select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("tie"), "text")
    return once.unionByName(odd), copies, several


def parts_of(batches: Iterator[pa.RecordBatch], text: int, length=pc.binary_length) -> Iterator[pa.RecordBatch]:
    """All rows in order, in batches whose texts, in column ``text``, make up ``HASHED`` bytes besides the first's; lists
    count as their ``length`` says."""
    for batch in batches:
        sizes = pc.fill_null(length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        edge = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // HASHED)) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(sizes)]):
            yield batch.slice(a, b - a)


def window_rows(texts: DataFrame, shortest: int) -> DataFrame:
    """(key, doc, tie, place) of all windows of all texts; ``place`` holds the first subsequence, how far behind it the
    center lies and the number of subsequences."""

    @frugal
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, 2):
            of, keys, first, sizes, center = windows_of(list(as_bytes(batch.column(2))), shortest)
            doc, tie = (np.asarray(batch.column(i))[of] for i in (0, 1))
            place = first << 24 | (center - first) << 16 | sizes
            for at in range(0, len(of), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(c[part], pa.int64()) for c in (keys.view(np.int64), doc, tie, place)], ["key", "doc", "tie", "place"])

    return texts.select("doc", "tie", "text").mapInArrow(cut, "key bigint, doc bigint, tie bigint, place bigint")


VIABLE = "doc bigint, tie bigint, begins array<bigint>, ends array<bigint>, keys array<bigint>, places array<bigint>"


def viable_texts(shared: DataFrame, shortest: int, similarity: float) -> DataFrame:
    """Rows of ``VIABLE`` for texts that have a part of ``shortest`` shingles most of whose windows are among ``shared``
    (key, doc, tie, place): the regions of such parts, with a margin as long around, and the shared windows in them."""
    parts = shortest - WIDTH + 1
    wanted = parts - spoilt(shortest, similarity)

    @frugal
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 4]
        for doc, tie, place, key in _whole_groups(batches, 2):
            edge = np.flatnonzero((doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])) + 1
            rows = []
            for a, b in zip(np.concatenate(([0], edge)).tolist(), np.concatenate((edge, [len(doc)])).tolist()):
                p = place[a:b]
                first, center, size = p >> 24, center_of(p), p & 65535
                if int(size.sum()) < wanted:
                    continue
                change = np.zeros(int(first[-1] + size[-1]) + parts + 1, np.int64)
                np.add.at(change, first, 1)
                np.add.at(change, first + size, -1)
                seen = np.concatenate(([0], np.cumsum(np.cumsum(change) > 0)))
                good = seen[parts:] - seen[:-parts] >= wanted
                if not good.any():
                    continue
                begin, end = runs_of(good)
                core = np.zeros(len(change) + shortest, np.int64)
                np.add.at(core, begin, 1)
                np.add.at(core, end - 1 + shortest, -1)
                within = np.cumsum(core)[center] > 0
                lo, hi = np.maximum(begin - shortest, 0), end - 1 + 2 * shortest
                apart = np.flatnonzero(lo[1:] > hi[:-1])
                rows.append((int(doc[a]), int(tie[a]), lo[np.concatenate(([0], apart + 1))], hi[np.concatenate((apart, [len(hi) - 1]))], key[a:b][within], p[within]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["doc", "tie", "begins", "ends", "keys", "places"])

    rows = shared.select("doc", "tie", "place", "key").repartition("doc", "tie").sortWithinPartitions("doc", "tie", "place")
    return rows.mapInArrow(judge, VIABLE)


REGIONS = "doc bigint, tie bigint, begin bigint, hashes array<int>, keys array<bigint>, places array<bigint>"


def regions_of(texts: DataFrame, viable: DataFrame, named: DataFrame) -> DataFrame:
    """Rows of ``REGIONS``: each region's shingle hashes, of which 32 bits are enough along a shift, and shared windows.
    ``named`` is (doc, tie) of ``viable``, materialised alone: as columns beside long lists they pass for far larger."""

    @frugal
    def slice_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 2]
        for batch in parts_of(batches, 2):
            hashes, counts = shingles(list(as_bytes(batch.column(2))))
            stops = np.cumsum(counts)
            rows = []
            for i, (doc, tie, begins, ends, keys, places) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4, 5, 6)))):
                own = hashes[stops[i] - counts[i] : stops[i] - WORDS + 1]
                key, place = np.array(keys, np.int64), np.array(places, np.int64)
                for a, b in zip(begins, ends):
                    here = (center_of(place) >= a) & (center_of(place) < b)
                    rows.append((doc, tie, a, own[a:b].astype(np.uint32).view(np.int32), key[here], place[here]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["doc", "tie", "begin", "hashes", "keys", "places"])

    some = texts.join(broadcast_if_small(named), ["doc", "tie"], "left_semi")
    return some.join(viable, ["doc", "tie"]).select("doc", "tie", "text", "begins", "ends", "keys", "places").mapInArrow(slice_up, REGIONS)


_REGION, _SOURCE = ["doc", "tie", "begin"], ["sdoc", "stie", "sbegin"]
_HERE = "named_struct('doc', doc, 'tie', tie, 'place', place)"
_THERE = "named_struct('doc', sdoc, 'tie', stie, 'place', splace)"


def _slices(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each list begins and ends, and the values of all."""
    return lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)


def verified(pairs: DataFrame, regions: DataFrame, shortest: int, similarity: float) -> DataFrame:
    """(doc, tie, source, start, end): the passages of regions that nearly repeat one of the region they are paired with,
    ``pairs`` (_REGION, place, _SOURCE, splace) holding a row for each window that both have."""
    spark = pairs.sparkSession
    grouped = pairs.repartition(*_REGION).groupBy(*_REGION, *_SOURCE).agg(F.collect_set(F.struct("place", "splace")).alias("at"))
    grouped = grouped.select(*_REGION, *_SOURCE, F.col("at.place").alias("here"), F.col("at.splace").alias("there"))
    grouped = materialize(grouped, "pairs")
    release_shuffles(spark)
    counts = grouped.groupBy(*_SOURCE).agg(F.count("*").alias("n"))
    named = regions.select(*[F.col(a).alias(b) for a, b in zip(_REGION, _SOURCE)], F.col("hashes").alias("other"))
    sources = materialize(named.join(counts, _SOURCE), "sources")

    @frugal
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            lists = [_slices(column(c)) for c in ("here", "there", "hashes", "other")]
            rows = []
            for i, (doc, tie, begin, sdoc, stie, sbegin) in enumerate(zip(*(column(c).to_pylist() for c in (*_REGION, *_SOURCE)))):
                here, there, mine, other = (values[at[i] : at[i + 1]] for at, values in lists)
                spans = passages_between(mine, begin, other, sbegin, center_of(here), center_of(there), shortest, similarity, (doc, tie) == (sdoc, stie))
                rows += [(doc, tie, sdoc, a, b + WORDS - 1) for a, b in spans]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc", "tie", "source", "start", "end"])

    both = join_split(grouped.join(regions.select(*_REGION, "hashes"), _REGION), sources, _SOURCE, grouped.count())
    with small_batches(spark, 512):
        found = materialize(both.mapInArrow(verify, "doc bigint, tie bigint, source bigint, start bigint, end bigint").distinct(), "passages")
    discard(grouped, sources)
    release_shuffles(spark)
    return found


def first_pairs(windows: DataFrame) -> DataFrame:
    """Each window (key, _REGION, place) with the first that has its key, if that is another."""
    first = windows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("doc", "tie", "place", "begin")).alias("f")).filter("n > 1")
    first = first.select("key", "n", F.col("f.doc").alias("sdoc"), F.col("f.tie").alias("stie"), F.col("f.begin").alias("sbegin"), F.col("f.place").alias("splace"))
    first = materialize(first, "leaders")
    return join_split(windows, first, ["key"], first.agg(F.sum("n")).first()[0] or 0).filter(f"{_THERE} < {_HERE}").drop("key", "n")


CONTEXTS = "key bigint, doc bigint, tie bigint, begin bigint, place bigint, open boolean, contexts array<bigint>"


def _window_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in CONTEXTS.split(", ")]
    for batch in parts_of(batches, 3, pc.list_value_length):
        (stops, hashes), (ends, keys), (_, places), (_, opens) = ((at, values[at[0] : at[-1]]) for at, values in map(_slices, batch.columns[3:]))
        of = np.repeat(np.arange(len(batch)), np.diff(ends))
        doc, tie, begin = (np.asarray(batch.column(i))[of] for i in range(3))
        counts, found = contexts_of(hashes.view(np.uint32), np.diff(stops), of, center_of(places) - begin)
        contexts = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(found.view(np.int64)))
        yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in (keys, doc, tie, begin, places, opens)], contexts], names)


def context_rows(regions: DataFrame, spans: DataFrame) -> DataFrame:
    """(key, _REGION, place, open, contexts) of all windows whose signature some open window has, which lies in none of its
    text's ``spans`` (doc, tie, spans). ``contexts`` are hashes of those runs of shingles that lie in the region."""
    center = lambda p: F.shiftright(p, 24) + F.shiftright(p, 16).bitwiseAND(F.lit(255))
    closed = lambda p: F.exists("spans", lambda s: (s["start"] <= center(p)) & (center(p) + WORDS <= s["end"]))
    marked = regions.join(spans, ["doc", "tie"], "left").withColumn("opens", F.transform("places", lambda p: ~F.coalesce(closed(p), F.lit(False))))
    signed = marked.select(F.inline(F.arrays_zip("keys", "opens"))).filter("opens").select(F.col("keys").alias("key"))
    wanted = materialize(signed.distinct(), "signatures")
    rows = marked.select(*_REGION, "hashes", "keys", "places", "opens").mapInArrow(frugal(_window_contexts), CONTEXTS)
    return rows.join(broadcast_if_small(wanted), "key", "left_semi")


def open_pairs(regions: DataFrame, found: DataFrame) -> DataFrame:
    """Each open window with the first that has one of its contexts, for each of them."""
    spans = materialize(merged_spans(found.withColumnsRenamed({"doc": "doc_id", "tie": "text_key"})).select(F.col("doc_id").alias("doc"), F.col("text_key").alias("tie"), "spans"), "closed")
    rows = materialize(context_rows(regions, broadcast_if_small(spans, SPAN_ROWS)), "contexts")
    each = rows.select(*_REGION, "place", "open", F.explode("contexts").alias("key"))
    first = each.groupBy("key").agg(F.count_if("open").alias("n"), F.count("*").alias("m"), F.min(F.struct("doc", "tie", "place", "begin")).alias("f")).filter("n > 0 and m > 1")
    first = first.select("key", "n", F.col("f.doc").alias("sdoc"), F.col("f.tie").alias("stie"), F.col("f.begin").alias("sbegin"), F.col("f.place").alias("splace"))
    first = materialize(first, "leaders")
    mine = each.filter("open").select("key", *_REGION, "place")
    return join_split(mine, first, ["key"], first.agg(F.sum("n")).first()[0] or 0).filter(f"{_THERE} < {_HERE}").drop("key", "n")


def repeated_passages(docs: DataFrame, min_words: int = 50, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, source, start, end): each passage of at least ``min_words`` words that nearly repeats one of a
    text with a smaller doc_id, or an earlier one of its own text (source is then the doc_id). Positions count words from
    0. A passage begins and ends with shingles that match, and its matching shingles, in order, make up ``similarity`` of
    those of both sides. Of the texts that hold a passage, those are named that the search compared.

    Null ids, null, empty and short texts have no passages. Equal rows count as one text; a text that equals one of a
    smaller doc_id is one passage as a whole. The texts of a repeated id are told apart by ``text_key``, the XXH64 of the
    text, which is 0 for all other ids. Other columns are not read. An empty table gives no rows.
    """
    spark, shortest = docs.sparkSession, min_words - WORDS + 1
    if shortest < 2 * WIDTH:
        raise ValueError(f"passages must have {2 * WIDTH + WORDS - 1} words at least")
    bound_memory(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    texts, copies, several = distinct_texts(rows)
    windows = materialize(window_rows(texts, shortest), "windows")
    counts = materialize(windows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "counts")
    release_shuffles(spark)
    viable = materialize(viable_texts(join_split(windows, counts, ["key"], windows.count()), shortest, similarity), "viable")
    discard(windows, counts)
    release_shuffles(spark)
    named = materialize(viable.select("doc", "tie"), "named")
    regions = materialize(regions_of(texts, viable, named), "regions")
    discard(viable, named)
    each = regions.select(*_REGION, F.explode(F.arrays_zip("keys", "places")).alias("w")).select(*_REGION, "w.*")
    first = verified(first_pairs(each.select(F.col("keys").alias("key"), *_REGION, F.col("places").alias("place"))), regions, shortest, similarity)
    more = verified(open_pairs(regions, first), regions, shortest, similarity)
    discard(regions)
    found = first.unionByName(more).distinct().select(F.col("doc").alias("doc_id"), F.col("tie").alias("text_key"), "source", "start", "end")
    whole = keyed_rows(rows, several).withColumn("same", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).join(broadcast_if_small(copies), ["doc_id", "same"])
    size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    whole = whole.select("doc_id", "text_key", F.col("first").alias("source"), F.lit(0).cast("long").alias("start"), size.alias("end")).filter(F.col("end") >= min_words)
    return found.unionByName(whole.distinct())


def keyed_rows(rows: DataFrame, several: DataFrame) -> DataFrame:
    """Rows (doc_id, text, ...) with the ``text_key`` that ``repeated_passages`` gives them, null for null ids."""
    marked = rows.join(broadcast_if_small(several.select("doc_id", F.lit(True).alias("__several"))), "doc_id", "left")
    key = F.when(F.col("doc_id").isNotNull(), F.when(F.col("__several"), F.xxhash64("text")).otherwise(F.lit(0)).cast("long"))
    return marked.withColumn("text_key", key).drop("__several")


def repeated_ids(rows: DataFrame) -> DataFrame:
    """(doc_id): the ids of more than one row."""
    return materialize(rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").select("doc_id"), "several")


def merged_spans(passages: DataFrame) -> DataFrame:
    """(doc_id, text_key, spans, sources): the union of each text's passages as ordered, disjoint word spans."""
    spans = F.array_sort(F.collect_set(F.struct("start", "end")))
    merge = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda done, s: F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.try_element_at(done, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(done, F.lit(-1))["end"], s["end"]).alias("end"))))).otherwise(F.concat(done, F.array(s))),
    )
    return passages.groupBy("doc_id", "text_key").agg(spans.alias("spans"), F.array_sort(F.collect_set("source")).alias("sources")).withColumn("spans", merge)


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for t, s in zip(texts, spans):
        data, found = (t.as_py() or "").encode(), s.as_py()
        if not found:
            out.append(t.as_py())
            continue
        at = [m.start() for m in _WORD.finditer(data)] + [len(data)]
        kept, last = [], 0
        for span in found:
            kept.append(data[last : at[min(span["start"], len(at) - 1)]])
            last = at[min(span["end"], len(at) - 1)]
        out.append(b"".join([*kept, data[last:]]).decode())
    return pa.array(out, pa.string())


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the words of the spans and the white space behind them; unchanged where spans is null or empty."""
    return F.arrow_udf(_cut, "string")(text, spans)


def with_spans(docs: DataFrame, min_words: int = 50, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``__spans`` and ``__sources``, the merged passages of the row's text; null where it has none."""
    found = materialize(merged_spans(repeated_passages(docs, min_words, similarity, doc_id, text)), "spans")
    named = found.select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key"), F.col("spans").alias("__spans"), F.col("sources").alias("__sources"))
    several = repeated_ids(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"))).select(F.col("doc_id").alias("__several"))
    marked = docs.join(broadcast_if_small(several), F.col(f"`{doc_id}`").cast("long") == F.col("__several"), "left")
    key = F.when(F.col("__several").isNotNull(), F.xxhash64(F.col(f"`{text}`"))).otherwise(F.lit(0).cast("long"))
    same = (F.col(f"`{doc_id}`").cast("long") == F.col("__doc")) & (key == F.col("__key"))
    return marked.join(broadcast_if_small(named, SPAN_ROWS), same, "left").drop("__several", "__doc", "__key")


def remove_repeats(docs: DataFrame, min_words: int = 50, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every repeated passage cut from the later text, the first one staying.

    A text of which no word is left goes; all others, null and empty ones included, stay with all their columns, equal
    rows alike. Columns of the names that are used on the way (``spans``, ``sources``) may exist in the input.
    """
    joined = with_spans(docs, min_words, similarity, doc_id, text)
    kept = joined.withColumn(text, without_spans(F.col(f"`{text}`"), F.col("__spans")))
    return kept.filter(F.col("__spans").isNull() | F.col(f"`{text}`").rlike(r"[^\x20\x09-\x0D]")).select(*[F.col(f"`{c}`") for c in docs.columns])

"""Packing token sequences by cutting-stock column generation.

Documents are cut into full sequences and one remainder. The remainders' lengths form a histogram of at most
``CLASSES`` classes, whatever the number of documents. A linear program over filling patterns is solved by column
generation: the simplex method prices new patterns with a knapsack dynamic program over the duals. Rounded patterns
are dealt to the documents ranked within their class; the few that rounding leaves over are laid end to end and cut.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_memory, frugal, materialize

CAPACITY = 2048
UNIT = 4
CLASSES = CAPACITY // UNIT
END_ID = 1
#: Column generation ends once the bound of the duals proves the plan this close to the optimum, or after so many pivots.
TOLERANCE, MAX_PIVOTS = 5e-4, 4000


# --- tokens ---------------------------------------------------------------------------------------------------------


class _Encoder:
    """Ids as the tokenizer file defines them.

    Plain Latin text goes through a byte-pair encoder built from the file's own vocabulary, as its ids are its merge
    order; any other text, and text that holds a special token's string, goes through the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.fast = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.odd = re.compile("[^\x00-ɏ]" + "".join("|" + re.escape(s) for s in special))
        self.path, self.slow = path, None

    def ids(self, text: str) -> np.ndarray:
        if self.odd.search(text):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids_crc32 bigint, ids binary"


def pieces_of(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, start, length, doc_tokens, ids_crc32, ids): each document's ids and the end id, cut at every full
    sequence. ``ids`` are little-endian unsigned 32-bit. Null text counts as empty: one piece of the end id alone."""

    @frugal
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        kinds = [pa.int64()] * 5 + [pa.binary()]
        names = ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids"]
        end = np.array([END_ID], np.uint32)
        for batch in batches:
            rows, held = [], 0
            for key, value in zip(batch.column(0), batch.column(1)):
                ids = np.concatenate((encoder.ids(value.as_py() or ""), end)).astype("<u4")
                for start in range(0, len(ids), CAPACITY):
                    part = ids[start : start + CAPACITY].tobytes()
                    rows.append((key.as_py(), start, len(part) // 4, len(ids), zlib.crc32(part), part))
                held += 4 * len(ids)
                if held > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    bound_memory(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES)


# --- patterns -------------------------------------------------------------------------------------------------------


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for each capacity with any number of each item, and the item taken last there (-1: none)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    ordered, worth = sizes[order], values[order]
    fits = np.searchsorted(ordered, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        n = fits[c]
        best[c] = best[c - 1]
        if n:
            got = best[c - ordered[:n]] + worth[:n]
            i = int(got.argmax())
            if got[i] > best[c] + 1e-12:
                best[c], last[c] = got[i], order[i]
    return best, last


def _unpack(last: np.ndarray, sizes: np.ndarray, capacity: int, n: int) -> np.ndarray:
    counts = np.zeros(n)
    while capacity > 0:
        if last[capacity] < 0:
            capacity -= 1
        else:
            counts[last[capacity]] += 1
            capacity -= sizes[last[capacity]]
    return counts


def start_basis(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> np.ndarray:
    """A pattern for each size, largest first: as many of it as fit, then the largest others that last as long. No
    pattern holds a size larger than its own, so the patterns form a basis, and a feasible one."""
    left, basis = demand.astype(float).copy(), np.zeros((len(sizes), len(sizes)))
    for i in range(len(sizes) - 1, -1, -1):
        copies = capacity // sizes[i]
        basis[i, i] = copies
        room, times = capacity - copies * sizes[i], left[i] / copies
        j = min(i, int(np.searchsorted(sizes, room, side="right"))) - 1
        while j >= 0 and times > 0 and room >= sizes[0]:
            n = min(room // sizes[j], left[j] // times)
            if n >= 1:
                basis[j, i] = n
                left[j] -= n * times
                room -= n * sizes[j]
            j = min(j, int(np.searchsorted(sizes, room, side="right"))) - 1
    return basis


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often to use each so that they cover the demand with fewest sequences: the linear
    program's optimum, before rounding."""
    m = len(sizes)
    if not m:
        return np.zeros((0, 0)), np.zeros(0)
    basis = start_basis(sizes, demand, capacity)
    cost = np.ones(m)
    inverse = np.linalg.inv(basis)
    use = np.maximum(inverse @ demand, 0)
    pivots = 0

    def enter(column: np.ndarray, price: float) -> bool:
        nonlocal inverse, use, pivots
        step = inverse @ column
        rows = np.flatnonzero(step > 1e-9)
        if not len(rows):
            return False
        ratio = use[rows] / step[rows]
        r = rows[int(ratio.argmin())]
        basis[:, r], cost[r] = column, price
        pivots += 1
        if pivots % 100 == 0:
            inverse = np.linalg.inv(basis)
        else:
            pivot_row = inverse[r] / step[r]
            inverse -= np.outer(step, pivot_row)
            inverse[r] = pivot_row
        use = np.maximum(inverse @ demand, 0)
        return True

    while pivots < MAX_PIVOTS:
        dual = cost @ inverse
        if dual.min() < -1e-9:  # more of this length than asked for is worth it
            i = int(dual.argmin())
            if not enter(-np.eye(m)[i], 0.0):
                break
            continue
        best, last = knapsack(dual, sizes, capacity)
        if best[capacity] <= 1 + TOLERANCE:
            break
        forced = dual + best[capacity - sizes]
        columns = [_unpack(last, sizes, capacity, m)]
        for i in np.argsort(-forced, kind="stable")[:24]:
            column = _unpack(last, sizes, capacity - int(sizes[i]), m)
            column[i] += 1
            columns.append(column)
        moved = False
        for column in columns:
            if (cost @ inverse) @ column > 1 + TOLERANCE / 2:
                moved |= enter(column, 1.0)
        if not moved:
            break
    real = cost > 0
    return basis[:, real], use[real]


class Plan(NamedTuple):
    """Interval table: items of a class with ranks from ``first`` to below ``end`` go to sequences from ``base`` on,
    ``count`` to each, in places from ``slot`` on."""

    keys: np.ndarray
    first: np.ndarray
    end: np.ndarray
    base: np.ndarray
    count: np.ndarray
    slot: np.ndarray
    sequences: int


_SHIFT = 44


def round_patterns(histogram: dict[int, int]) -> Plan:
    """Solve for the histogram (class to number of pieces), round down, then up where the pieces last."""
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[c] for c in sizes.tolist()], float)
    patterns, use = solve_patterns(sizes, demand)
    times = np.floor(use + 1e-7).astype(np.int64)
    patterns = np.round(patterns).astype(np.int64)
    left = demand.astype(np.int64) - patterns @ times if len(sizes) else np.zeros(0, np.int64)
    for p in np.argsort(times - use, kind="stable"):
        if (patterns[:, p] <= left).all():
            times[p] += 1
            left -= patterns[:, p]
    rows, ranks, base = [], dict.fromkeys(range(len(sizes)), 0), 0
    for p in np.flatnonzero(times):
        slot = 0
        for c in np.flatnonzero(patterns[:, p])[::-1]:
            n = int(patterns[c, p])
            rows.append((int(sizes[c]), ranks[c], ranks[c] + n * int(times[p]), base, n, slot))
            ranks[c] += n * int(times[p])
            slot += n
        base += int(times[p])
    rows.sort()
    t = np.array(rows, np.int64).reshape(-1, 6)
    return Plan((t[:, 0] << _SHIFT) + t[:, 1], t[:, 1], t[:, 2], t[:, 3], t[:, 4], t[:, 5], base)


# --- operator -------------------------------------------------------------------------------------------------------


class Packed(NamedTuple):
    """``plan``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. ``pieces``: the token ids, by
    (doc_id, start), as cut before packing; ``sequence_ids`` joins both."""

    plan: DataFrame
    pieces: DataFrame


def _tail_cuts(total: int) -> list[int]:
    """Starts, after the last full sequence, of ever smaller powers of two that make up the rest."""
    at, rest = total - total % CAPACITY, total % CAPACITY
    out = []
    while rest:
        out.append(at)
        size = 1 << (rest.bit_length() - 1)
        at, rest = at + size, rest - size
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> Packed:
    """Pack every document into sequences of at most 2,048 ids.

    Null and empty texts are one end id. Long texts are cut; equal rows are packed as often as they occur, different
    texts of one id each for itself, and rows of a null id keep it. An empty table gives an empty plan. Other columns of the input are not read. Sequences padded beyond ``UNIT - 1`` ids a
    piece do not occur except where no pieces of fitting length exist; the end of the leftovers' stream is cut into
    powers of two, which need no padding.
    """
    pieces = materialize(pieces_of(docs, tokenizer_path, doc_id, text), "pieces")
    small = pieces.drop("ids").withColumn("cls", F.ceil(F.col("length") / UNIT).cast("int"))
    counted = {r["cls"]: r["n"] for r in small.groupBy("cls").agg(F.count("*").alias("n")).collect()}
    plan = round_patterns(counted)
    buckets = max(16, sum(counted.values()) // 20_000)

    salted = small.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    sizes = salted.groupBy("cls", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("cls", "bucket", (F.sum("n").over(Window.partitionBy("cls").orderBy("bucket")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("cls", "bucket").orderBy("doc_id", "start")) - 1
    ranked = salted.withColumn("within", within).join(before, ["cls", "bucket"]).withColumn("rank", F.col("before") + F.col("within"))

    def place(cls: pa.Array, rank: pa.Array) -> pa.Array:
        c, r = np.asarray(cls).astype(np.int64), np.asarray(rank).astype(np.int64)
        seq, slot = np.full(len(c), -1, np.int64), np.zeros(len(c), np.int64)
        if len(plan.keys) and len(c):
            i = np.searchsorted(plan.keys, (c << _SHIFT) + r, side="right") - 1
            ok = (i >= 0) & (plan.keys[i] >> _SHIFT == c) & (r < plan.end[i])
            j = r - plan.first[i]
            seq = np.where(ok, plan.base[i] + j // plan.count[i], -1)
            slot = np.where(ok, plan.slot[i] + j % plan.count[i], 0)
        return pa.StructArray.from_arrays([pa.array(seq, pa.int64()), pa.array(slot, pa.int64())], names=["seq", "slot"])

    placed = materialize(ranked.withColumn("at", F.arrow_udf(place, "struct<seq:bigint,slot:bigint>")("cls", "rank")).select("doc_id", "start", "length", "doc_tokens", "ids_crc32", "cls", "at.seq", "at.slot"), "placed")
    sequence = Window.partitionBy("seq").orderBy("slot", "doc_id", "start")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = placed.filter("seq >= 0").withColumn("offset", F.sum("length").over(sequence) - F.col("length")).withColumnRenamed("seq", "sequence_id").select(columns)

    # What rounding leaves over: at most CLASSES patterns' worth of pieces, however many documents there are.
    rest = placed.filter("seq < 0")
    total = rest.agg(F.sum("length")).first()[0] or 0
    if not total:
        return Packed(whole, pieces)
    full, tail = total // CAPACITY, _tail_cuts(total)
    stream = rest.withColumn("at", F.sum("length").over(Window.orderBy(F.desc("cls"), "doc_id", "start")) - F.col("length"))
    to = F.col("at") + F.col("length")
    marks = F.filter(
        F.concat(F.transform(F.sequence(F.floor(F.col("at") / CAPACITY), F.floor(to / CAPACITY)), lambda k: k * CAPACITY), F.array(*[F.lit(t).cast("long") for t in tail]).cast("array<bigint>")),
        lambda c: (c > F.col("at")) & (c < to) & (c <= F.lit(full * CAPACITY) if not tail else F.lit(True)),
    )
    cut = stream.withColumn("begins", F.array_sort(F.array_distinct(F.concat(F.array("at"), marks)))).select("*", F.posexplode("begins").alias("i", "begin"))
    cut = cut.withColumn("ends", F.coalesce(F.try_element_at("begins", F.col("i") + 2), to))
    tails = F.array(*[F.lit(t).cast("long") for t in tail]).cast("array<bigint>")
    behind = F.size(F.filter(tails, lambda t: t <= F.col("begin")))
    number = F.when(F.col("begin") < full * CAPACITY, F.floor(F.col("begin") / CAPACITY)).otherwise(F.lit(full) + behind - 1)
    opens = F.when(F.col("begin") < full * CAPACITY, F.floor(F.col("begin") / CAPACITY) * CAPACITY).otherwise(F.array_max(F.filter(tails, lambda t: t <= F.col("begin"))))
    parts = cut.select(
        "doc_id",
        F.col("start").alias("piece"),
        (F.col("start") + F.col("begin") - F.col("at")).alias("start"),
        (F.col("ends") - F.col("begin")).alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.lit(plan.sequences) + number).cast("long").alias("sequence_id"),
        (F.col("begin") - opens).cast("long").alias("offset"),
        (F.size("begins") > 1).alias("is_cut"),
    )
    parts = materialize(parts, "parts")
    cut_parts = parts.filter("is_cut").withColumnRenamed("ids_crc32", "piece_crc32")
    # A piece is told by its place and by what it holds, so different texts of one id stay apart and equal ones share ids.
    whole_piece = ["doc_id", "piece", "piece_crc32", "doc_tokens"]
    held = pieces.select("doc_id", F.col("start").alias("piece"), F.col("ids_crc32").alias("piece_crc32"), "doc_tokens", "ids")
    wanted = F.broadcast(cut_parts.select(*[F.col(c).alias(f"__{c}") for c in whole_piece]).distinct())
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in whole_piece]
    held = held.join(wanted, same[0] & same[1] & same[2] & same[3]).select(*[f"__{c}" for c in whole_piece], "ids").dropDuplicates([f"__{c}" for c in whole_piece])
    torn = cut_parts.join(held, same[0] & same[1] & same[2] & same[3])
    torn = torn.withColumn("ids_crc32", F.crc32(F.substring(F.col("ids"), (4 * (F.col("start") - F.col("piece")) + 1).cast("int"), (4 * F.col("length")).cast("int"))))
    return Packed(whole.unionByName(parts.filter("not is_cut").select(columns)).unionByName(torn.select(columns)), pieces)


def sequence_ids(packed: Packed) -> DataFrame:
    """The plan with each piece's ids as a column of little-endian unsigned 32-bit numbers."""
    plan = packed.plan.withColumn("piece", F.floor(F.col("start") / CAPACITY) * CAPACITY)
    held = packed.pieces.select(F.col("doc_id").alias("__doc"), F.col("start").alias("__piece"), "ids").dropDuplicates(["__doc", "__piece", "ids"])
    both = plan.join(held, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("piece") == F.col("__piece")))
    part = F.substring(F.col("ids"), (4 * (F.col("start") - F.col("piece")) + 1).cast("int"), (4 * F.col("length")).cast("int"))
    return both.withColumn("ids", part).filter(F.crc32("ids") == F.col("ids_crc32")).drop("piece", "__doc", "__piece")

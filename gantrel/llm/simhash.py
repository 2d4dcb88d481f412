"""Near-duplicate search over SimHash fingerprints in shards of BK-trees.

Fingerprints within the radius of each other agree on one of ``radius + 1`` blocks, so every fingerprint goes to one shard
for each block, and linked ones meet in at least one. Of a block as many bits are the key as make shards of a few hundred
fingerprints. A shard of bounded size is one BK-tree, whose children are keyed by their Hamming distance to the parent; a
search follows only the edges within the radius, which passes by most of the shard. A larger shard is cut into trees of
bounded size, and every part of it is sent to and searched in each of them. Shards emit a spanning forest of
their links, never all pairs; components are then found by alternating star contractions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bound_memory, broadcast_if_small, discard, frugal, join_split, materialize, small_batches

SEED = 42
#: Most fingerprints in one tree, and about how many a shard has.
TREE, SHARD = 4096, 256


# --- fingerprints ---------------------------------------------------------------------------------------------------


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of each run of ``words`` ASCII-lower-cased words joined by spaces; of the whole sequence if it is shorter;
    nothing for a text without words. Words are what ASCII white space separates."""
    parts = text.lower().split()
    if len(parts) < words:
        return [xxhash.xxh64_intdigest(b" ".join(parts), SEED)] if parts else []
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip((ends - sizes).tolist(), ends[words - 1 :].tolist())]


def majority(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint for each run of hashes: a bit is set if more than half of the run have it."""
    out = np.zeros(len(counts), np.uint64)
    full = counts > 0
    if full.any():
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, starts[full], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > counts[full][:, None], axis=1).reshape(-1).view(">u8").astype(np.uint64)
    return out


def fingerprint(text: Column, words: int = 3) -> Column:
    """The SimHash of the whole text's shingles, repeats included, as a signed 64-bit number. Null, empty and wordless
    texts have fingerprint 0."""

    @frugal
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found, hashes, counts = [], [], []

            def flush() -> None:
                n = np.array(counts, np.int64)
                found.append(majority(np.array(hashes, np.uint64), np.cumsum(n) - n, n))
                hashes.clear()
                counts.clear()

            for t in as_bytes(batch):
                h = shingle_hashes(t, words)
                hashes += h
                counts.append(len(h))
                if len(hashes) > 50_000:
                    flush()
            flush()
            yield pa.array(np.concatenate(found).view(np.int64), pa.int64())

    return F.arrow_udf(run, "bigint")(text)


# --- BK-trees -------------------------------------------------------------------------------------------------------


class BKTree:
    """Distinct integers; a child hangs on the edge that has its Hamming distance to the parent."""

    def __init__(self) -> None:
        self.items: list[int] = []
        self.children: list[dict[int, int]] = []
        self.visits = 0  # of searches

    def add(self, item: int) -> None:
        at = 0
        while self.items:
            d = (self.items[at] ^ item).bit_count()
            if d == 0:
                return
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = len(self.items)
                break
            at = nxt
        self.items.append(item)
        self.children.append({})

    def within(self, item: int, radius: int) -> list[tuple[int, int]]:
        """(distance, stored item) of all stored items within the radius."""
        found, stack = [], [0] if self.items else []
        while stack:
            at = stack.pop()
            self.visits += 1
            d = (self.items[at] ^ item).bit_count()
            if d <= radius:
                found.append((d, self.items[at]))
            kids = self.children[at]
            if len(kids) <= 2 * radius:
                stack += [child for edge, child in kids.items() if d - radius <= edge <= d + radius]
            else:
                stack += [kids[edge] for edge in range(d - radius, d + radius + 1) if edge in kids]
        return found


def forest(tree: list[int], probes: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links (item, root) that connect what lies within the radius of each other among ``tree``'s items, or between them
    and ``probes``; at most one for each item."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(x: int, y: int) -> None:
        a, b = root(x), root(y)
        if a != b:
            parent[max(a, b)] = min(a, b)

    held = BKTree()
    if probes is None:
        for x in tree:
            for _, y in held.within(x, radius):
                join(x, y)
            held.add(x)
    else:
        for x in tree:
            held.add(x)
        for x in probes:
            for _, y in held.within(x, radius):
                join(x, y)
    return [(x, r) for x in list(parent) if (r := root(x)) != x]


# --- shards ---------------------------------------------------------------------------------------------------------


def block_keys(value: Column, radius: int, n: int) -> Column:
    """An array of shard keys for ``n`` different values: two within ``radius`` bits share one. The 64 bits are cut into
    ``radius + 1`` blocks, of which at least one is untouched; the key is a block's number and its first bits, so many
    that a shard has about ``SHARD`` values of n."""
    blocks = radius + 1
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    wanted = max(1, (max(1, n // SHARD)).bit_length())
    keys = []
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        bits = min(wanted, b - a)
        keys.append(F.shiftrightunsigned(value, b - bits).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(i << 40))
    return F.array(*keys)


def shard_links(keyed: DataFrame, radius: int) -> DataFrame:
    """(u, v): a spanning forest of the links among the rows (id, fp, key) of equal key whose fingerprints lie within the
    radius."""
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > TREE)
    parts = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / TREE).cast("int")
    dealt = keyed.join(large, "key", "left").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = dealt.select("key", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "id", "fp")
    rows = rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "part", "id")

    def links(key: np.ndarray, a: np.ndarray, b: np.ndarray, part: np.ndarray, ids: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero((key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
        start, end = np.concatenate(([0], edge)), np.concatenate((edge, [len(key)]))
        out: list[tuple[int, int]] = []
        for s, e in zip(start[end - start > 1].tolist(), end[end - start > 1].tolist()):
            names, items = ids[s:e].tolist(), fp[s:e].view(np.uint64).tolist()
            split = e - s if a[s] == b[s] else int((part[s:e] == a[s]).sum())
            found = forest(items[:split], items[split:] if split < e - s else None, radius)
            name = dict(zip(items, names))
            out += [(name[x], name[y]) for x, y in found]
        pair = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0], pa.int64()), pa.array(pair[:, 1], pa.int64())], ["u", "v"])

    @frugal
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            cols = [np.asarray(c) for c in batch.columns]
            if not len(cols[0]):
                continue
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            other = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
            cut = other[-1] + 1 if len(other) else 0
            held = [c[cut:] for c in cols]
            if cut:
                yield links(*[c[:cut] for c in cols])
        if held:
            yield links(*held)

    bound_memory(keyed.sparkSession)
    return rows.mapInArrow(search, "u bigint, v bigint").distinct()


# --- components -----------------------------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v) but the roots, the smallest of each component, by alternating
    large-star and small-star steps. Each round is written to the shared folder, so lineage stays short."""
    edges = materialize(links.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        old, edges = edges, materialize(small, "edges")
        discard(old)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def linked_prints(nodes: DataFrame, radius: int) -> DataFrame:
    """``nodes`` (fp, first, n), a row for each fingerprint, with ``root``, the same for those that links of at most
    ``radius`` differing bits connect."""
    keyed = nodes.select(F.col("fp").alias("id"), "fp", F.explode(block_keys(F.col("fp"), radius, nodes.count())).alias("key"))
    roots = components(shard_links(keyed, radius))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (signed 64-bit) and component_id, the smallest doc_id reachable over links of at most
    ``radius`` differing bits, for every row.

    Null and wordless texts have fingerprint 0 and link like any other; equal rows get equal results. A null doc_id is
    judged like any other but names no component. An empty table gives no rows. Only the two named columns are read, so other columns cannot clash.
    """
    prints = materialize(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), words).alias("fp")), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    rooted = linked_prints(nodes, radius)
    classes = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    named = materialize(join_split(rooted.select("root", "fp", F.col("n").alias("rows")), classes, ["root"], nodes.count()).select("fp", "component_id", F.col("rows").alias("n")), "named")
    discard(nodes)
    return join_split(prints, named, ["fp"], prints.count()).select("doc_id", "fp", "component_id")


# --- similar documents ----------------------------------------------------------------------------------------------

#: Bands of min-hashes over a text's distinct shingles, and hash functions in each. Two texts of similarity 0.8 share no
#: band with probability (1 - 0.8**5)**25, about 1 in 20,000, whatever edits tell them apart.
BANDS, BAND_ROWS = 25, 5


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of the hashes under each of ``BANDS * BAND_ROWS`` functions."""
    out = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for start in range(0, len(hashes), 1024):
        x = hashes[None, start : start + 1024] * _FACTORS[:, None]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out = np.minimum(out, x.min(axis=1))
    return out


_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band, of its number and its min-hashes; none for a text without shingles."""
    if not len(hashes):
        return []
    rows = min_hashes(hashes).reshape(BANDS, BAND_ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(rows)]


def _sketches(words: int):
    @frugal
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            prints, keys = [], []
            for t in as_bytes(batch):
                hashes = shingle_set(t, words)
                prints.append(int(set_print(hashes)) if len(hashes) else None)
                keys.append(band_keys(hashes))
            yield pa.StructArray.from_arrays([pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["fp", "keys"])

    return run


def set_print(hashes: np.ndarray) -> np.int64:
    """The SimHash of distinct shingles, as a signed 64-bit number."""
    return majority(hashes, np.zeros(1, np.int64), np.array([len(hashes)])).view(np.int64)[0]


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct shingle hashes in order."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two whole shingle sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def first_pairs(keyed: DataFrame) -> DataFrame:
    """(u, v): each row of (id, key, first) with the first of its key."""
    return keyed.filter("id <> first").select(F.col("id").alias("u"), F.col("first").alias("v")).distinct()


def group_links(sets: list[np.ndarray], classes: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of positions that link ``sets`` of similarity ``least`` or more, a spanning forest over the given classes:
    each set is counted against all at once while any is in another class."""
    sizes = np.array([len(x) for x in sets], np.int64)
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    starts, held = np.cumsum(sizes) - sizes, np.zeros(int(at.max()) + 1, np.int64)
    classes, out = classes.copy(), []
    for i, (start, size) in enumerate(zip(starts.tolist(), sizes.tolist())):
        if (classes == classes[i]).all():
            continue
        own = at[start : start + size]
        held[own] = 1
        both = np.add.reduceat(held[at], starts)
        held[own] = 0
        for j in np.flatnonzero((classes != classes[i]) & (both / (sizes + size - both) >= least)).tolist():
            if classes[j] != classes[i]:
                out.append((i, j))
                classes[classes == classes[j]] = classes[i]
    return out


#: Texts in one part of a key whose pairs are all measured; two parts meet in a task.
PART = 512


def open_links(keyed: DataFrame, roots: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """(u, v): a spanning forest of the links among rows of equal key that ``roots`` leaves in different classes, but those
    to the key's first, which ``first_pairs`` has. A text (doc_id, text) is sent to each pair of parts once, and pairs are
    never rows."""
    rest = keyed.filter("id <> first")
    named = rest.join(roots, rest["id"] == roots["node"], "left").select("key", "id", F.coalesce("root", "id").alias("class"))
    several = named.groupBy("key").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.min("class").alias("a"), F.max("class").alias("b")).filter("a <> b")
    rows = materialize(named.join(several.select("key", "parts"), "key"), "open")
    involved = materialize(rows.select(F.col("id").alias("doc_id")).distinct(), "involved")
    held = materialize(texts.join(broadcast_if_small(involved), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    dealt = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "id", "class")
    dealt = dealt.join(held.select(F.col("doc_id").alias("id"), "text"), "id").select("key", "a", "b", "id", "class", "text")

    @frugal
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, classes, sets = None, [], [], []

        def found() -> pa.RecordBatch:
            pairs = group_links(sets, np.array(classes, np.int64), least) if len(set(classes)) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[p[i]] for p in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])

        for batch in batches:
            *keys, own, named = (batch.column(i).to_pylist() for i in range(5))
            for at, i, c, t in zip(zip(*keys), own, named, as_bytes(batch.column(5))):
                if at != group:
                    yield found()
                    group, ids, classes, sets = at, [], [], []
                ids.append(i)
                classes.append(c)
                sets.append(shingle_set(t, words))
        yield found()

    bound_memory(keyed.sparkSession)
    with small_batches(keyed.sparkSession, 128):
        links = dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "id").mapInArrow(search, "u bigint, v bigint")
        links = materialize(links.distinct(), "links")
    discard(rows, involved, held)
    return links


def similar_documents(docs: DataFrame, words: int = 5, least: float = 0.8, doc_id: str = "doc_id", text: str = "text", radius: int = 2) -> DataFrame:
    """(doc_id, same, component_id, kept): near-duplicate classes of the distinct texts, linked where the shingle sets'
    similarity is at least ``least``; component_id is the smallest doc_id of the class. ``same`` is the MD5 of the row's
    text; ``kept`` marks the rows of the class's first text under its first id.

    Equal texts are one node, different texts of one id are several. Candidates are texts whose SimHash fingerprints lie in
    one component of links within ``radius``, found in the shards of BK-trees, and, as similar texts may differ in more
    bits than a tree can pass by, texts that share a band of min-hashes. Each is measured against the first of the
    component or band, then all pairs of one that are still in different classes are, inside tasks. Null and empty texts are equal to
    each other only. Texts shorter than a shingle count as one shingle. Rows of a null doc_id take their text's class, which is
    null if no row with an id has one of its texts.
    """
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), digest.alias("same"), F.col(text).alias("text"))
    sketched = rows.select("doc_id", "same", F.arrow_udf(_sketches(words), "fp bigint, keys array<bigint>")("text").alias("sketch"))
    bands = materialize(sketched.select("doc_id", "same", "sketch.fp", "sketch.keys"), "bands")
    # A node is named by the smallest id that has its text, or by a hash of the text where that id has several.
    by_text = materialize(bands.groupBy("same").agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys"), F.first("fp").alias("fp"), F.count("*").alias("n")), "first")
    clash = bands.select("doc_id", "same").distinct().groupBy("doc_id").agg(F.count("*").alias("m")).filter("m > 1 or doc_id is null").select(F.col("doc_id").alias("f"))
    clash = broadcast_if_small(materialize(clash, "clash"))
    named = by_text.join(clash, F.col("first").eqNullSafe(F.col("f")), "left").withColumn("id", F.when(F.col("f").isNotNull() | F.col("first").isNull(), F.xxhash64("same")).otherwise(F.col("first")))
    first = materialize(named.select("same", "first", "n", "id", "keys", "fp"), "nodes")
    texts = rows.join(broadcast_if_small(clash.select(F.col("f").alias("c"))), F.col("doc_id") == F.col("c"), "left")
    texts = texts.select(F.when(F.col("c").isNotNull() | F.col("doc_id").isNull(), F.xxhash64("same")).otherwise(F.col("doc_id")).alias("doc_id"), "text")
    prints = materialize(first.filter("fp is not null").groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "prints")
    trees = materialize(linked_prints(prints, radius).select("fp", "n", F.col("root").alias("key")), "trees")
    near = join_split(first.filter("fp is not null").select("fp", "id"), trees, ["fp"], first.count()).select("id", "key")
    keyed = materialize(first.select("id", F.explode("keys").alias("key")).unionByName(near), "keyed")
    discard(by_text, prints, trees)
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1")
    met = materialize(join_split(keyed, shared, ["key"], keyed.count()).select("key", "id", "first"), "met")
    discard(keyed)

    @frugal
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            u, v = (batch.column(i).to_pylist() for i in (0, 1))
            keep = []
            for other, x, y in zip(v, *(as_bytes(batch.column(i)) for i in (2, 3))):
                if known[0] != other:
                    known = (other, shingle_set(y, words))
                keep.append(similarity(shingle_set(x, words), known[1]) >= least)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, k in zip(ids, keep) if k], pa.int64()) for ids in (u, v)], ["u", "v"])

    def links(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs, "pairs")
        involved = materialize(pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct(), "involved")
        held = materialize(texts.join(broadcast_if_small(involved), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
        both = pairs.join(held.select(F.col("doc_id").alias("u"), F.col("text").alias("x")), "u").join(held.select(F.col("doc_id").alias("v"), F.col("text").alias("y")), "v")
        bound_memory(docs.sparkSession)
        with small_batches(docs.sparkSession, 128):
            found = materialize(both.select("u", "v", "x", "y").mapInArrow(measure, "u bigint, v bigint"), "links")
        discard(pairs, involved, held)
        return found

    near = links(first_pairs(met))
    roots = components(near.unionByName(open_links(met, components(near), texts, words, least)))
    discard(met, near)
    rooted = first.join(roots, first["id"] == roots["node"], "left").select("same", "first", "n", F.coalesce("root", "id").alias("root"))
    heads = rooted.groupBy("root").agg(F.min(F.when(F.col("first").isNotNull(), F.struct("first", "same"))).alias("head"), F.count("*").alias("n"))
    classes = materialize(join_split(rooted.select("root", "same", F.col("first"), F.col("n").alias("rows")), heads, ["root"], first.count()).select("same", F.col("head.first").alias("component_id"), F.col("head.same").alias("head"), F.col("rows").alias("n")), "classes")
    discard(first)
    found = join_split(bands.select("doc_id", "same"), classes, ["same"], bands.count())
    return found.select("doc_id", "same", "component_id", ((F.col("doc_id") == F.col("component_id")) & (F.col("same") == F.col("head"))).alias("kept"))


def hexadecimal(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")

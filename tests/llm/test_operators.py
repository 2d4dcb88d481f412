"""Corpus operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and extra
columns."""

import hashlib
import math
import os
import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gantrel.llm import langid, media, packing, passages, piece_fst, pieces, simhash, token_counts, topk, toxicity, url_filter

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, stems=("the", "re", "an", "ti", "ed", "on", "sh", "ou")):
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [None, "", " ", "a", "a b", "  two  spaces   here ", "line\n\nbreaks\tand tabs\r\n", "Ünïcödé ß 漢字 😀 é", "x" * 3000, prose(rng, 6000), "<|endoftext|> in text", "$$$ 123 !!", "▁ escape"]
    out += [prose(rng, rng.randint(1, 300)) for _ in range(30)]
    return [*out, *out[20:24]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- media ---


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 2048, 2049, 6144, 100_001])
def test_container_round_trip(n):
    payload = media.pad(random.Random(n).randbytes(n))
    data = media.mux_bytes(payload)
    (track,) = media.probe_bytes(data)
    assert media.payload_of(data, track) == payload
    assert (track["codec"], track["width"], track["height"], track["samples"]) == ("raw ", 8, 8, len(payload) // 64)
    for at, size in zip(track["key_offsets"], track["key_sizes"]):
        assert size == 64 and (at - track["key_offsets"][0]) % (64 * media.CHUNK_FRAMES) == 0


def test_probe_survives_damage():
    data = media.mux_bytes(media.pad(os.urandom(5000)))
    assert media.probe_bytes(b"") == [] and media.probe_bytes(b"junk") == []
    for cut in range(0, len(data), 97):
        media.probe_bytes(data[:cut])
    rng = random.Random(2)
    head = data.index(b"moov") - 4
    for _ in range(3000):
        bad = bytearray(data)
        for _ in range(rng.randint(1, 4)):
            bad[rng.randrange(head, len(bad)) if rng.random() < 0.8 else rng.randrange(32)] = rng.choice([0, 1, 0x7F, 0xFF, rng.randrange(256)])
        for track in media.probe_bytes(bytes(bad)):
            assert len(track["key_offsets"]) == len(track["key_sizes"]) and len(media.payload_of(bytes(bad), track)) <= len(bad) * (1 + len(track["chunk_sizes"]))
    deep = b""
    for _ in range(3000):
        deep = media._box(b"moov", deep)
    assert media.probe_bytes(deep) == []
    huge = data.replace(b"stsz" + bytes(4) + (64).to_bytes(4, "big"), b"stsz" + bytes(4) + (1).to_bytes(4, "big"))
    at = huge.index(b"stsz") + 12
    huge = huge[:at] + b"\xff\xff\xff\xff" + huge[at + 4 :]
    assert media.probe_bytes(huge)[0]["samples"] <= len(huge)


def test_media_columns(spark, docs, texts):
    rows = docs.select("doc_id", media.mux(F.col("text")).alias("m"), media.round_trip(F.col("text")).alias("r")).select("doc_id", "r", media.payload_digest("m").alias("p"), media.probe("m").alias("q"), F.sha2("m", 256).alias("h")).collect()
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert r.r.payload_sha256 == r.p.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.r.tail_crc32 == r.p.tail_crc32 == zlib.crc32(padded[-64:]) and r.r.media_sha256 == r.h
        assert r.q.samples == len(padded) // 64 and r.q.codec == "raw " and len(r.q.keyframes) == -(-r.q.samples // 32)
    nothing = spark.createDataFrame([(None,), (b"",)], "m binary").select(media.probe("m").alias("q")).collect()
    assert all(r.q.tracks == 0 and r.q.codec is None for r in nothing)


# --- packing ---


def check_plan(rows, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert sorted(by_doc) == sorted(texts)
    for d, parts in by_doc.items():
        ids = np.array([*t.encode(texts[d] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
    return by_seq


def test_packing(docs, texts, empty):
    packed = packing.pack_documents(docs, BPE)
    rows = packed.plan.collect()
    check_plan(rows, dict(enumerate(texts)))
    for r in packing.sequence_ids(packed).collect():
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    assert packing.pack_documents(empty, BPE).plan.count() == 0


def test_packing_of_null_ids(spark):
    text = prose(random.Random(1), 900)
    df = spark.createDataFrame([(None, text), *[(i, prose(random.Random(i), 700)) for i in range(6)]], "doc_id long, text string")
    rows = packing.pack_documents(df, BPE).plan.collect()
    mine = sorted((r for r in rows if r.doc_id is None), key=lambda r: r.start)
    assert sum(r.length for r in mine) == mine[0].doc_tokens and [r.start for r in mine] == [sum(m.length for m in mine[:i]) for i in range(len(mine))]


def test_pattern_program():
    rng = np.random.default_rng(3)
    sizes = np.arange(20, 300, 7)
    demand = rng.integers(1, 400, len(sizes)).astype(float)
    patterns, use = packing.solve_patterns(sizes, demand, 512)
    assert (sizes @ patterns <= 512).all() and (patterns @ use >= demand - 1e-6).all()
    assert use.sum() <= (sizes @ demand) / 512 * 1.01
    values = rng.random(len(sizes))
    best, _ = packing.knapsack(values, sizes, 512)
    slow = [0.0]
    for c in range(1, 513):
        slow.append(max([slow[-1], *(slow[c - s] + v for s, v in zip(sizes, values) if s <= c)]))
    assert np.allclose(best, slow)


# --- pieces ---


def test_sentencepiece_equals_library(docs, texts, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in docs.select("doc_id", piece_fst.encode("text", PIECES).alias("ids")).select("*", piece_fst.decode("ids", PIECES).alias("back"), piece_fst.encode_and_decode(F.lit("a"), PIECES).alias("c")).collect():
        text = texts[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == sp.encode(text), text[:50]
        assert r.back == text.replace("▁", " ")
    assert empty.select(piece_fst.encode("text", PIECES)).count() == 0


def test_paths_of_pretokens_together_and_alone():
    fst, rng = piece_fst.PieceTransducer(PIECES), random.Random(6)
    words = sorted({" " * rng.randint(0, 1) + "".join(rng.choice("etaonshér9漢") for _ in range(rng.randint(1, 30))) for _ in range(500)} - {" "})
    flat, counts = fst.many([w.replace(" ", pieces.SPACE) for w in words])
    ends = np.cumsum(counts)
    assert [flat[e - n : e].tolist() for e, n in zip(ends, counts)] == [fst.shortest_path(w) for w in words]


def test_fst_on_random_words():
    import sentencepiece

    sp, fst, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_fst.PieceTransducer(PIECES), random.Random(1)
    alphabet = "etaoinshrdluéßñ.,!0129AZ\n 漢ж  "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    for text in [*texts, *(" " * n + tail for n in range(70) for tail in ("", "word", "9", "\n"))]:
        assert np.frombuffer(next(piece_fst._encoded(fst, [text])), "<u4").tolist() == sp.encode(text), repr(text)


def viterbi_count(counter, word):
    best = {0: (0, 0)}
    v = counter.vocabulary
    word = word.replace(" ", pieces.SPACE)
    for d in range(1, len(word) + 1):
        options = []
        for k in range(1, min(d, v.longest) + 1):
            i = v.number.get(word[d - k : d])
            if i is not None:
                options.append((best[d - k][0] + int(counter.weight[i]), best[d - k][1] + 1))
        if word[d - 1] not in v.number:
            size = len(word[d - 1].encode())
            options.append((best[d - 1][0] + counter.unknown - size, best[d - 1][1] + size))
        best[d] = max(options, key=lambda o: o[0])
    return best[len(word)][1]


def test_token_counts(docs, texts):
    counter = token_counts.UnigramCounter(PIECES)
    got = {r.doc_id: r.c for r in docs.select("doc_id", token_counts.token_counts("text", PIECES).alias("c")).collect()}
    for i, t in enumerate(texts):
        words = pieces.pretokens(t) if t else []
        assert (got[i].n_pretokens, got[i].n_tokens) == (len(words), sum(viterbi_count(counter, w) for w in words)), t


# --- top-k ---


def test_topk(spark):
    rng = np.random.default_rng(0)
    x = np.floor(64 * rng.normal(size=(700, 64)) / 8)
    x[5] = x[6] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0] * 63 + [None]), (902, [1.0] * 63 + [float("nan")]), (903, [float("inf")] * 64), (None, [1.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>").withColumn("score", F.lit("clash"))
    got = defaultdict(list)
    for r in topk.exact_topk(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    full = (x @ x.T).astype(int)
    for q in range(0, 700, 20):
        want = sorted((int(i) for i in range(700) if i != q), key=lambda i: (-full[q, i], i))[:20]
        assert got[q] == [(i, full[q, i]) for i in want]
    assert len(got) == 35
    few = topk.exact_topk(df.filter("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert len(few) == 3
    assert topk.exact_topk(df.filter("vec_id < 0"), F.lit(True)).count() == 0


def test_topk_of_repeated_rows(spark):
    """Equal rows count once, unequal ones of an id each for itself."""
    rng = np.random.default_rng(3)
    x = rng.integers(-20, 20, (100, 64))
    y = np.concatenate((-x[7, :1], x[7, 1:]))
    df = spark.createDataFrame([(i, v.astype(float).tolist()) for i, v in enumerate(x)] * 3 + [(7, y.astype(float).tolist())], "vec_id long, vector array<double>")
    got = defaultdict(list)
    for r in topk.exact_topk(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in range(0, 100, 20):
        rows = [(i, int(x[q] @ x[i])) for i in range(100) if i != q] + [(7, int(x[q] @ y))]
        assert got[q] == sorted(rows, key=lambda r: (-r[1], r[0]))[:20]


def test_topk_of_large_components(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-(2**27), 2**27, (60, 64))
    x[3] = x[9]
    df = spark.createDataFrame([(i, v.astype(float).tolist()) for i, v in enumerate(x)] + [(99, [2.0**40] * 64)], "vec_id long, vector array<double>")
    full = x.astype(object) @ x.T.astype(object)
    got = defaultdict(list)
    for r in topk.exact_topk(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got == {q: [(i, full[q, i]) for i in sorted((i for i in range(60) if i != q), key=lambda i: (-full[q, i], i))[:20]] for q in (0, 20, 40)}


def test_topk_query_leaves_out_odd_vectors(spark, tmp_path):
    from gantrel.llm.queries import QUERIES

    rows = [(i, [0.1 * i] * 64) for i in range(30)]
    rows += [(100, [float("nan")] * 64), (101, [float("inf")] + [0.0] * 63), (102, [-float("inf")] * 64), (103, [None] * 64), (104, None), (120, [float("nan")] + [9.0] * 63)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op4_exact_topk"](spark, str(tmp_path)).collect()
    assert {r.query_id for r in got} == {0, 20} and all(r.vec_id < 30 for r in got) and len(got) == 40


def test_bounds_hold():
    rng = np.random.default_rng(1)
    q, c = rng.normal(size=(20, 64)) * 9, rng.normal(size=(50, 64)) * 9
    before = np.full((20, 50), np.inf)
    for s in topk.LEVELS:
        bound = topk.segment_features(q, s) @ topk.segment_features(c, s).T
        assert (bound >= q @ c.T - 1e-9).all() and (bound <= before + 1e-9).all()
        before = bound


def test_rotated_bounds_close_most_pairs():
    """On vectors of few strong axes the rotated statistics close nearly all pairs, and the results stay exact."""
    rng = np.random.default_rng(3)
    axes = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    c = np.floor(rng.normal(size=(9000, 64)) * 2000.0 * 0.6 ** np.arange(64) @ axes.T)
    q = np.floor(rng.normal(size=(40, 64)) * 2000.0 * 0.6 ** np.arange(64) @ axes.T)
    turn = topk.rotation(c[:500])
    assert np.allclose(turn @ turn.T, np.eye(64)) and topk.rotation(np.zeros((3, 6))) is None
    shares = []
    at, ids, score = topk.block_topk(np.arange(-40, 0), q, np.arange(9000), c, 20, turn=turn, survivors=shares)
    want = np.lexsort((np.broadcast_to(np.arange(9000), (40, 9000)), -(q @ c.T)), axis=1)[:, :20]
    assert (ids.reshape(40, 20) == want).all() and (score.reshape(40, 20) == np.take_along_axis(q @ c.T, want, 1)).all()
    assert len(shares) > 4 and np.mean([s[-1] for s in shares]) < 0.1


# --- urls ---


def slow_rule(url):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else "allow"


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://example.org", "http://EXAMPLE.org/es/x", "https://a.example.org/en/12?q#f", "http://notexample.org/es/", "http://x.com/fr/", "http://com/de/a", "http://evil.net/a.org/", "http://x.com?/de/", "ftp://a.b.org/" + "p" * 9000, "http://x.org#/es/", "http://ÄX.org/é"]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, host string")
    from gantrel.llm.queries import URL_RULES

    for r in url_filter.filter_urls(df, URL_RULES).collect():
        assert (r.host, r.path, r.rule, r.verdict) == slow_rule(urls[r.page_id])


def test_globs_over_many_words():
    import fnmatch

    rng = random.Random(2)
    rules = [url_filter.Rule("block", "".join(rng.choice("ab*?") for _ in range(rng.randint(1, 6))), "/" + "".join(rng.choice("ab*?") for _ in range(rng.randint(0, 5)))) for _ in range(60)]
    automaton, owners = url_filter.compile_rules(rules)
    assert automaton.words > 5
    texts = [("".join(rng.choice("ab.") for _ in range(rng.randint(0, 7))), "/" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 7)))) for _ in range(300)]
    data = [f"{h}\0{p}".encode() for h, p in texts]
    flat = np.frombuffer(b"".join(data), np.uint8)
    size = np.array([len(d) for d in data])
    final = automaton.run(flat, np.cumsum(size) - size, size)
    for i, (h, p) in enumerate(texts):
        for j, r in enumerate(owners):
            want = fnmatch.fnmatchcase(h, ("*." if j % 2 else "") + r.host) and fnmatch.fnmatchcase(p, r.path + "*")
            w, bit = automaton.accept[j]
            assert bool(final[i, w] & bit) == want, (h, p, r, j)


# --- simhash ---


def slow_print(text, words):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(items, linked):
    """Smallest key of each connected class, by repeated relaxation over all pairs."""
    name = {k: k for k in items}
    moved = True
    while moved:
        moved = False
        for a in items:
            for b in items:
                if name[b] < name[a] and linked(items[a], items[b]):
                    name[a], moved = name[b], True
    return name


def test_simhash(spark, docs, texts, empty):
    got = simhash.near_duplicates(docs.withColumn("fp", F.lit("clash"))).select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fp"), "component_id").collect()
    prints = {i: slow_print(t, 3) for i, t in enumerate(texts)}
    name = closure(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    assert {r.doc_id: (r.fp, r.component_id) for r in got} == {i: (f"{p:016x}", name[i]) for i, p in prints.items()}
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("n", [1, 10**5, 10**12])
def test_shards_keep_every_link(spark, monkeypatch, n):
    monkeypatch.setattr(simhash, "TREE", 16)
    rng = random.Random(4)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values):
        for _ in range(6):
            v ^= 1 << rng.randrange(64)
            values.add(v)
    base = rng.getrandbits(64)
    values |= {base ^ (1 << i) for i in range(64)}  # one shard far over a tree's size
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(s,) for s in signed], "fp long").select(F.col("fp").alias("id"), "fp", F.explode(simhash.block_keys(F.col("fp"), 2, n)).alias("key"))
    roots = {r.node: r.root for r in simhash.components(simhash.shard_links(df, 2)).collect()}
    name = closure(dict(zip(signed, values)), lambda a, b: (a ^ b).bit_count() <= 2)
    assert {s: roots.get(s, s) for s in signed} == name


def test_components_of_a_chain(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (None, 3)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def test_bk_tree():
    rng = random.Random(3)
    items = [rng.getrandbits(16) for _ in range(500)]
    tree = simhash.BKTree()
    for i in items:
        tree.add(i)
    for _ in range(50):
        x = rng.getrandbits(16)
        assert sorted(y for _, y in tree.within(x, 3)) == sorted(y for y in set(items) if (x ^ y).bit_count() <= 3)


def test_bk_tree_passes_by_most_of_a_shard():
    rng = random.Random(8)
    tree = simhash.BKTree()
    for _ in range(simhash.SHARD):
        tree.add(rng.getrandbits(64))
    tree.visits = 0
    for _ in range(100):
        tree.within(rng.getrandbits(64), 2)
    assert tree.visits < 0.5 * 100 * simhash.SHARD


def test_similar_documents(spark):
    rng = random.Random(7)
    base = [prose(rng, 200, stems=("alpha", "be", "gam", "del", "eps", "ze", "et", "thet", "io", "kap")) for _ in range(12)]
    rows, want = [], {}
    for i, t in enumerate(base):
        w = t.split()
        near = w[:100] + ["changed"] + w[101:]
        far = [x if j % 6 else "other" for j, x in enumerate(w)]
        for j, text in enumerate((t, t, " ".join(near), " ".join(far))):
            rows.append((10 * i + j, text))
            want[10 * i + j] = 10 * i + (3 if j == 3 else 0)
    rows += [(1000, None), (1001, ""), (1002, "one two")]
    want |= {1000: 1000, 1001: 1000, 1002: 1002}
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_similar_documents_behind_a_reordered_text(spark):
    """Near copies of each other are linked although a text of the same words, but not of the same order, comes first."""
    words = random.Random(5).sample([f"w{i}" for i in range(5000)], 200)
    mixed = random.Random(6).sample(words, 200)
    rows = [(1, " ".join(mixed)), (2, " ".join(words)), (3, " ".join(words + words[:5]))]
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == {1: 1, 2: 2, 3: 2}


def test_similar_documents_with_added_blocks(spark):
    """Texts with an appended block of new words, of similarity 0.8 exactly, are found."""
    rng = random.Random(8)
    rows = []
    for i in range(150):
        words = [f"w{rng.randrange(10**9)}" for _ in range(124)]
        rows += [(2 * i, " ".join(words[:100])), (2 * i + 1, " ".join(words))]
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: i - i % 2 for i, _ in rows}


def test_similar_documents_of_many_shingles(spark):
    """Long texts are judged by all their shingles: similarities just over the least link, those just under do not."""
    rng = random.Random(12)
    rows, want = [], {}
    for i in range(40):
        words = [f"w{rng.randrange(10**9)}" for _ in range(2004)]
        whole = 1604 + (12 if i % 2 else -12)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:whole]))]
        want |= {2 * i: 2 * i, 2 * i + 1: 2 * i + 1 - i % 2}
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def without_shared_band(rng, n, added):
    """Words and a block to append such that both texts share no band of min-hashes, their fingerprints but for two bits."""
    word = lambda: f"w{rng.randrange(10**9)}"
    words, block = [word() for _ in range(n)], [word() for _ in range(added)]
    own = simhash.shingle_set(" ".join(words).encode(), 5)

    def cost(block):
        other = simhash.shingle_set(" ".join(words + block).encode(), 5)
        a, b = (simhash.majority(x, np.zeros(1, np.int64), np.array([len(x)]))[0] for x in (own, other))
        return len(set(simhash.band_keys(own)) & set(simhash.band_keys(other))) + max(0, int(a ^ b).bit_count() - 2)

    least = cost(block)
    while least:
        tried = list(block)
        tried[rng.randrange(added)] = word()
        if (c := cost(tried)) <= least:
            block, least = tried, c
    return words, block


def test_similar_documents_that_share_no_band(spark):
    """Texts of close fingerprints meet in the BK-trees though no band has both; they link only where their shingles are
    similar enough."""
    rows, want = [], {}
    for i, added in enumerate((25, 25, 40)):
        words, block = without_shared_band(random.Random(i), 104, added)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words + block))]
        want |= {2 * i: 2 * i, 2 * i + 1: 2 * i + (added > 25)}
    rows += [(10, " "), (11, "\t"), (12, "Two words"), (13, "two  words")]
    want |= {10: 10, 11: 11, 12: 12, 13: 12}
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_similar_documents_of_a_loose_group(spark, monkeypatch):
    """Copies of one text, each with edits of its own, of which few are like the first: classes are those of all pairs, and
    no pair is a row of a join."""
    monkeypatch.setattr(simhash, "PART", 40)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(160)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(160), rng.choice((1, 2, 4, 5))):
            words[at] = f"v{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    sets = [simhash.shingle_set(t.encode(), 5) for _, t in rows]
    want = list(range(150))
    for i in range(150):
        for j in range(i):
            if want[i] != want[j] and simhash.similarity(sets[i], sets[j]) >= 0.8:
                a, b = sorted((want[i], want[j]))
                want = [a if w == b else w for w in want]
    joined = []
    mapped = type(spark.range(1)).mapInArrow

    def counted(df, run, *others, **named):
        joined.append(df.count())
        return mapped(df, run, *others, **named)

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", counted)
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.component_id for r in got.orderBy("doc_id").collect()] == want and 1 < len(set(want)) < 150
    assert max(joined) < 26 * 150  # fewer than texts in bands and components; their pairs are 6,902


# --- passages ---


def test_compact_windows_cover_once():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 50, 80).astype(np.uint64)
    windows = passages.compact_windows(values, 7)
    for i in range(80):
        for j in range(i + 6, 80):
            holds = [(a, c, b) for a, c, b in windows if a <= i <= c <= j <= b]
            assert len(holds) == 1 and values[holds[0][1]] == values[i : j + 1].min()


def test_windows_are_cut_in_bounded_memory():
    """A batch of many texts takes the memory of a few; its windows are those of all texts at once."""

    class Taken:
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    rng = random.Random(4)
    texts = [None, "", *(" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice((20, 400, 600)))) for _ in range(1500)), None]
    batch = pa.RecordBatch.from_pydict({"doc": list(range(len(texts))), "tie": [0] * len(texts), "text": texts})
    tracemalloc.start()
    got = pa.Table.from_batches(passages.window_rows(Taken(), 46)(iter([batch.slice(0, 0), batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert batch.nbytes > 3 << 20 and peak < 32 << 20

    def subsequences(of, keys, first, sizes):  # however windows are split
        behind = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.stack((np.repeat(of, sizes), np.repeat(first, sizes) + behind, np.repeat(keys, sizes).view(np.int64)))

    key, doc, place = (got.column(c).to_numpy() for c in ("key", "doc", "place"))
    whole = passages.windows_of([(t or "").encode() for t in texts], 46)[:4]
    assert (subsequences(doc, key, place >> 24, place & 65535) == subsequences(*whole)).all() and len(key) > 50_000


def test_repeated_passages(spark, empty):
    rng = random.Random(11)
    stems = [f"w{i}x" for i in range(200)]
    fresh = lambda n: [rng.choice(stems) + rng.choice(stems) for _ in range(n)]
    passage, short = fresh(70), fresh(30)
    near = passage[:35] + ["edited"] + passage[36:]
    rows = {
        1: fresh(40) + passage + fresh(40),
        2: fresh(20) + passage + fresh(60),
        3: fresh(33) + near + fresh(5),
        4: fresh(50) + short + fresh(50),
        5: fresh(10) + short + fresh(80),
        6: (once := fresh(60)) + fresh(30) + once,
        7: passage,
        8: fresh(300),
    }
    data = [(i, " ".join(w)) for i, w in rows.items()] + [(9, None), (10, ""), (8, " ".join(rows[8]))]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("spans", F.lit(1))
    found = {r.doc_id: (r.spans, r.sources) for r in passages.merged_spans(passages.repeated_passages(df)).collect()}
    assert sorted(found) == [2, 3, 6, 7]
    for i, (start, source) in {2: (20, 1), 3: (33, 1), 6: (90, 6), 7: (0, 1)}.items():
        (span,), sources = found[i]
        assert span.start == start and source in sources and abs(span.end - start - (60 if i == 6 else 70)) <= 1
    left = {(r.doc_id, r.text) for r in passages.remove_repeats(df).collect()}
    assert {i for i, _ in left} == {1, 2, 3, 4, 5, 6, 8, 9, 10}
    kept = dict(left)
    assert kept[2] == " ".join(rows[2][:20] + rows[2][90:]) and kept[1] == data[0][1] and kept[9] is None
    assert passages.repeated_passages(empty).count() == 0 and passages.remove_repeats(empty).count() == 0


def test_passages_behind_earlier_quotes(spark):
    """Full copies are found though earlier texts hold parts of the passage, each too short to be one."""
    rng = random.Random(21)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, want = [], {}
    for i in range(0, 200, 10):
        passage = fresh(60)
        parts = [passage[:30], passage[15:45], passage[30:], passage, passage, passage]
        rows += [(i + j, " ".join(fresh(40) + part + fresh(40))) for j, part in enumerate(parts)]
        want |= {i + 4: (40, 100), i + 5: (40, 100)}
    found = passages.merged_spans(passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {r.doc_id: (r.spans[0].start, r.spans[0].end) for r in found} == want


def test_contexts_are_hashed_once(spark, monkeypatch):
    """Contexts are equal just where the runs of shingles are, whole in the region; the plan takes no slice for each."""
    rng = random.Random(22)
    runs = [[rng.randrange(-(2**31), 2**31) for _ in range(60)] for _ in range(3)]
    regions, want = [], {}
    for doc, n in enumerate((70, 90, 12, 200, 70)):
        hashes = [h for _ in range(9) for h in rng.choice(runs)[rng.randrange(9) :]][:n]
        centers = sorted(rng.sample(range(n), n // 3))
        regions.append((doc, doc % 2, 100, hashes, [7 if c % 3 else doc * 1000 + c for c in centers], [(100 + c - 5) << 24 | 5 << 16 | 1 for c in centers]))
        for c in centers:
            ends = [(c - 17, c + 18), *[(c - r, c + 1) for r in (4, 8, 12)], *[(c, c + r + 1) for r in (4, 8, 12)]]
            want[doc, c + 100] = [(i, *hashes[a:b]) for i, (a, b) in enumerate(ends) if a >= 0 and b <= n]
    df = spark.createDataFrame(regions, passages.REGIONS)
    spans = spark.createDataFrame([(1, 1, [(100, 120), (150, 170)])], "doc long, tie long, spans array<struct<start:long,end:long>>")
    monkeypatch.setattr(passages, "HASHED", 150)
    got = passages.context_rows(df, spans)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" not in plan and "xxhash64(" not in plan
    rows, known = got.collect(), {}
    opens = lambda doc, c: not (doc == 1 and (100 <= c <= 115 or 150 <= c <= 165))
    assert {(r.doc, c): r.open for r in rows if (c := (r.place >> 24) + 5)} == {k: opens(*k) for k in want if opens(*k) or (k[1] - 100) % 3}
    for r in rows:
        runs_here = want[r.doc, (r.place >> 24) + 5]
        assert len(r.contexts) == len(runs_here) and (r.tie, r.begin) == (r.doc % 2, 100)
        for run, key in zip(runs_here, r.contexts):
            assert known.setdefault(run, key) == key
    assert len(set(known.values())) == len(known) < sum(map(len, want.values()))


def test_texts_without_regions_are_not_shuffled(spark, monkeypatch):
    """The few names of texts with regions are broadcast, however long the lists of windows beside them."""
    rng, plans = random.Random(23), {}
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage = fresh(5000)
    rows = [(i, " ".join((passage if i < 20 else fresh(60)) + fresh(20))) for i in range(60)]
    keep = passages.materialize

    def held(df, tag):
        plans[tag] = df._jdf.queryExecution().optimizedPlan().toString()
        return keep(df, tag)

    monkeypatch.setattr(passages, "materialize", held)
    monkeypatch.setattr("gantrel.llm.common.BROADCAST_BYTES", 8 << 10)
    found = passages.merged_spans(passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))).collect()
    assert {(r.doc_id, *map(tuple, r.spans)) for r in found} == {(i, (0, 5000)) for i in range(1, 20)}
    semi = [line for line in plans["regions"].splitlines() if "Join LeftSemi" in line]
    assert semi and all("strategy=broadcast" in line for line in semi)


# --- models ---


def test_language_id(spark, docs, empty):
    rng = random.Random(9)
    stems = {"aa": ("the", "ing", "wh", "th"), "bb": ("der", "ung", "sch", "ö"), "cc": ("que", "eau", "oi", "é")}
    rows = [(i, prose(rng, rng.randint(5, 80), stems[lang]), lang) for i, lang in enumerate(list(stems) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.filter("doc_id % 3 <> 1 or doc_id > 0"))
    fresh = [(1000 + i, prose(rng, 30, stems[lang]).upper() + " !!", lang) for i, lang in enumerate(list(stems) * 10)]
    odd = [(1, None, None), (2, "", None), (3, "12 $$", None), (4, "½ ² Ⅷ ①", None)]
    got = spark.createDataFrame(fresh + odd, "doc_id long, text string, lang string").select("lang", langid.identify(model, F.col("text")).alias("r")).collect()
    assert all(r.r.lang_pred == (r.lang or "und") and 0 <= r.r.score <= 1 for r in got)
    none = langid.train(empty)
    assert {r.p.lang_pred for r in docs.select(langid.identify(none, F.col("text")).alias("p")).collect()} == {"und"}


def test_nystrom_equals_kernel_regression():
    """With every text a landmark, the folded weights give the kernel ridge regression's values."""
    rng = random.Random(1)
    texts = [prose(rng, 20, s) for s in (("the", "ing"), ("der", "ung")) for _ in range(10)]
    seen = np.zeros(1 << langid.BITS, bool)
    sets = [langid.presence(t, seen) for t in texts]
    model = langid.fit(sets, ["a"] * 10 + ["b"] * 10)
    k = np.array([[len(np.intersect1d(x, y)) / math.sqrt(len(x) * len(y)) for y in sets] for x in sets])
    y = np.array([1.0] * 10 + [-1.0] * 10)
    centered = np.linalg.solve(k + langid.RIDGE * np.eye(20), np.stack((y, np.ones(20)), axis=1))
    bias = centered[:, 0].sum() / (centered[:, 1].sum() + 1e-6)
    want = k @ (centered[:, 0] - bias * centered[:, 1]) + bias
    folded = np.array([model.weights[model.columns[s], 0].sum() / math.sqrt(len(s)) + model.bias[0] for s in sets])
    assert np.allclose(folded, want, atol=2e-2)


def test_toxicity(spark, empty):
    rng = random.Random(13)
    bad = ["vequun", "vequdeux", "vequtrois", "scum", "moron"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        words = prose(rng, rng.randint(20, 80)).split()
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", ",", "!!"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic if i % 97 else not toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (5, None, None), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df.filter("doc_id % 5 <> 0"), lab.filter("doc_id % 5 <> 0"))
    fresh = spark.createDataFrame([(1, "a quiet line"), (2, "you SCUM and moron!! veququatre"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.s for r in fresh.select("doc_id", toxicity.score(model, F.col("text")).alias("s")).collect()}
    assert got[2] >= 0.5 > got[1] and got[3] == got[4] < 0.5
    held = df.filter("doc_id % 5 = 0").select("doc_id", toxicity.score(model, F.col("text")).alias("s")).collect()
    assert sum((r.s >= 0.5) == (r.doc_id % 6 == 0) for r in held) >= 0.97 * len(held)
    assert toxicity.train(df, lab.limit(0)).bias == -30.0 and toxicity.train(empty, lab).voters == []


def test_label_model_on_simulated_votes():
    """Votes of known rates: four independent voters, and nine copies of a fifth that is wrong in half of what it says. The
    rates come back, the copies are one clique and do not outvote the others; a third of the labels is not given."""
    rng = np.random.default_rng(5)
    n, prior = 6000, 0.3
    y = (rng.random(n) < prior).astype(int)
    on, off = np.array([0.7, 0.6, 0.8, 0.5]), np.array([0.05, 0.04, 0.1, 0.02])
    single = rng.random((n, 4)) < np.where(y[:, None] == 1, on, off)
    noisy = (rng.random(n) < np.where(y == 1, 0.35, 0.3))[:, None] & (rng.random((n, 9)) < 0.95)
    votes = np.concatenate((single, noisy), axis=1).astype(float)
    gold = np.where(rng.random(n) < 0.67, np.where(rng.random(n) < 0.97, y, 1 - y), -1)
    posterior, rates, cliques = toxicity.label_model(votes, gold, prior, np.ones(n))
    assert len(set(cliques[:4])) == 4 and len(set(cliques[4:])) == 1 and cliques[4] not in cliques[:4]
    assert np.abs(rates[1, :4] - on).max() < 0.08 and np.abs(rates[0, :4] - off).max() < 0.05
    right = ((posterior > 0.5) == y).mean()
    alone = (single.sum(axis=1) >= 2) == y
    assert right > 0.92 and right >= alone.mean() - 0.01
    only_noisy = (single.sum(axis=1) == 0) & (noisy.sum(axis=1) >= 8) & (gold <= 0)
    assert only_noisy.any() and posterior[only_noisy].max() < 0.5


def test_shapes_vote_whatever_the_word():
    assert {"~caps", "~marks"} <= set(toxicity.cues("STOP!!")) and "~drawn" in toxicity.cues("sooo") and "~masked" in toxicity.cues("id*ot")
    assert toxicity.cues("a") == [] and toxicity.cues("plain") == ["=plain", "^plai"]

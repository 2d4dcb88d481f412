"""Registered queries and stages on whole small tables: their columns, repeated ids and rows, empty tables, clashing names;
passages and ids against brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gantrel.llm import langid, packing, passages, simhash, toxicity
from gantrel.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = {
    "op1_media_columns": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op2_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op4_exact_topk": ["query_id", "rank", "vec_id", "score"],
    "op5_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op6_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op7_simhash": ["doc_id", "fingerprint", "component_id"],
    "op9_language_id": ["doc_id", "held_out", "lang_pred", "score"],
}


def fresh(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at, rng = tmp_path_factory.mktemp("tables"), random.Random(1)
    rows = [(i, " ".join(fresh(rng, rng.randint(0, 90))), "en", "s", 1) for i in range(40)]
    rows += [(50, None, None, None, None), (51, "", "en", "s", 0), (5, rows[5][1], "en", "s", 1), (5, "another text of one id", "de", "s", 1), (None, "no id at all", "en", "s", 1), (52, "½ ²", "en", "s", 3)]
    spark.createDataFrame(rows, SCHEMA).withColumn("spans", F.lit(1)).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(i % 25, [float(i % 7 - 3)] * 64) for i in range(60)], "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame([(1, "http://A.example.org/es/x?q", ""), (2, None, ""), (3, "nothing", "")], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return str(at)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, tables)
    got = df.collect()
    assert set(COLUMNS.get(name, ["doc_id"])) <= set(df.columns)
    if "doc_id" in df.columns and name != "op2_packing":
        assert len(got) == 46
    if "held_out" in df.columns:
        m, hit = (5, 0) if name == "op5_toxicity" else (3, 1)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % m == hit) for r in got if r.doc_id is not None)
    if name == "op9_language_id":
        assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (50, 51, 52)} == {50: "und", 51: "und", 52: "und"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_on_empty_tables(spark, tables, tmp_path, name):
    for t in ("documents", "labels", "embeddings", "pages"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_stages_on_odd_tables(spark, tables, tmp_path):
    """Repeated ids, null ids, clashing names; then no rows at all."""
    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumn("__lang", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns and out.count() <= docs.count()
        assert stage(spark, docs.limit(0), tables).count() == 0
    assert corpus_pipeline.packing_stage(spark, docs.limit(0), tables).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    rng = random.Random(2)
    a, b = " ".join(fresh(rng, 80)), " ".join(fresh(rng, 80))
    rows = [(1, a), (5, a), (5, b), (5, b), (7, b + " more"), (None, a)]
    kept = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(((r.doc_id or 0), r.text) for r in kept) == sorted([(1, a), (5, b), (0, a)])


def test_passages_of_repeated_ids(spark):
    """Spans of one text are not cut from another text of its id."""
    rng = random.Random(3)
    p, other = fresh(rng, 60), fresh(rng, 200)
    rows = [(1, " ".join(fresh(rng, 20) + p)), (5, " ".join(p + fresh(rng, 30))), (5, " ".join(other)), (None, " ".join(p))]
    left = passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r.doc_id, len(r.text.split())) for r in left}
    assert got == {(1, 80), (5, 30), (5, 200), (None, 60)}


def test_packing_of_repeated_ids(spark):
    """Every piece's crc is that of ids of a text of its id, however the texts of an id are cut."""
    rng = random.Random(4)
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i % 3, " ".join(fresh(rng, rng.randint(1, 200)))) for i in range(30)] * 2
    plan = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), path).plan.collect()
    encoder = packing._encoder(path)
    ids = {}
    for i, t in rows:
        full = np.append(encoder.ids(t), 1).astype("<u4")
        ids.setdefault((i, len(full)), []).append(full)
    assert sum(r.length for r in plan) == sum(len(x) for v in ids.values() for x in v)
    for r in plan:
        assert r.ids_crc32 in {zlib.crc32(x[r.start : r.start + r.length].tobytes()) for x in ids[r.doc_id, r.doc_tokens]}
    used = {}
    for r in plan:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    padding = sum(2048 - n for n in used.values() if n & (n - 1))  # none at a power of two
    assert max(used.values()) <= 2048 and padding < 4 * len(plan)


def test_packing_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(5)
    encoder, slow = packing._encoder(path), Tokenizer.from_file(path)
    signs = "abcDEF 123''\n\t  .,!?éßñ\u0301\u200d漢字😀ж\u00a0\u2028\x00\x1f'll 're"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    assert all(encoder.ids(t).tolist() == slow.encode(t, add_special_tokens=False).ids for t in texts)


def test_samples_of_repeated_ids_are_bounded(spark):
    rows = spark.range(0, 6000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("word "), (F.col("id") % 3000).cast("string")).alias("text"), F.lit("en").alias("lang"))
    assert langid.train(rows).languages == ["en"]
    labels = spark.createDataFrame([(7, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.train(rows, labels).voters == []


# --- passages against brute force ---


def words_of(spans):
    return {i for a, b in spans for i in range(a, b)}


def slow_passages(texts):
    """Word spans of every text that nearly repeat one of an earlier text, at all shifts that any shingle gives."""
    data = {i: t.encode() for i, t in texts.items()}
    hashes = {i: h[: max(0, int(n[0]) - 4)] for i, (h, n) in ((i, passages.shingles([t])) for i, t in data.items())}
    found = {}
    for i, mine in hashes.items():
        for j, other in hashes.items():
            if j < i:
                here, there = np.nonzero(mine[:, None] == other[None, :])
                if len(here):
                    spans = passages.passages_between(mine, 0, other, 0, here, there, 46, 0.8)
                    found.setdefault(i, set()).update(words_of((a, b + 4) for a, b in spans))
    return {i: w for i, w in found.items() if w}


def test_passages_equal_brute_force(spark):
    """Edits, shared heads, quotes of parts, families of near copies and lines that many texts share, in any order."""
    rng = random.Random(31)
    lines = [fresh(rng, n) for n in (8, 14, 25, 38)]
    heads = [fresh(rng, 35) for _ in range(5)]
    texts, i = {}, 0

    def put(*parts):
        nonlocal i
        texts[i] = " ".join(w for p in parts for w in p)
        i += 1

    for k in range(60):
        body = heads[k % 5] + fresh(rng, 25)
        put(fresh(rng, 30), heads[k % 5], fresh(rng, 60))
        put(fresh(rng, 20), lines[k % 4], body, fresh(rng, 25))
        edited = list(body)
        if k % 3:
            edited[rng.randrange(5, 55)] = "edited"
        if k % 7 == 0:
            del edited[30]
        put(fresh(rng, 15), edited, lines[(k + 1) % 4], fresh(rng, 10))
    base = fresh(rng, 150)
    for _ in range(25):
        copy = list(base)
        for _ in range(rng.randint(1, 6)):
            copy[rng.randrange(150)] = f"e{rng.randrange(4)}"
        put(copy, lines[rng.randrange(4)])
    want = slow_passages(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: words_of((s.start, s.end) for s in r.spans) for r in passages.merged_spans(passages.repeated_passages(df)).collect()}
    assert len(want) > 60 and set(got) <= set(want)
    assert len(set(got) & set(want)) >= 0.97 * len(want)
    assert all(got[d] <= want[d] for d in got)
    assert sum(len(got.get(d, set())) for d in want) >= 0.97 * sum(map(len, want.values()))


def test_swapped_halves_are_no_passage(spark):
    rng, rows = random.Random(32), []
    for k in range(0, 120, 2):
        a, b = fresh(rng, 40), fresh(rng, 40)
        rows += [(k, " ".join(a + fresh(rng, 500) + b)), (k + 1, " ".join(b + a))]
    assert passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_window_centers_are_the_tree_nodes():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 40, 90).astype(np.uint64)
    centers = passages.window_centers(values, 12)
    for a, c, b in passages.compact_windows(values, 12):
        assert (centers[max(a, c - 11) : min(c, b - 11) + 1] == c).all()


def test_near_duplicate_output_recall(spark):
    """Random edits around the least similarity: every pair that brute force links is in one class."""
    rng, rows = random.Random(33), []
    for k in range(60):
        words = fresh(rng, 150)
        rows.append((3 * k, words))
        for j in (1, 2):
            copy = list(words)
            for _ in range(rng.randint(1, 4)):
                copy[rng.randrange(len(copy))] = "edited"
            rows.append((3 * k + j, copy + fresh(rng, rng.randint(0, 12))))
    sets = {i: simhash.shingle_set(" ".join(w).encode(), 5) for i, w in rows}
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()}
    pairs = [(a, b) for a in sets for b in range(a + 1, min(a - a % 3 + 3, len(rows))) if simhash.similarity(sets[a], sets[b]) >= 0.8]
    assert len(pairs) > 60 and all(got[a] == got[b] for a, b in pairs)

"""The stages of the pipeline on planted cases, each written and read again as its user does."""

import random

from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, stems):
    return [" ".join(["".join(rng.choice(stems) for _ in range(rng.randint(2, 5)))]) for _ in range(n)]


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    stems = {"en": ["the", "ing", "wh", "an", "ou", "re", "st", "ly", "ed", "on"], "de": ["der", "ung", "sch", "ö", "heit", "ver", "ge", "ein", "ß", "au"]}
    text = {i: prose(rng, rng.randint(90, 160), stems["en" if i % 3 else "de"]) for i in range(240)}
    shared = prose(rng, 70, stems["en"])
    text[10] = text[10][:30] + shared + text[10][30:]
    text[50] = text[50][:60] + shared + text[50][60:]
    toxic = [i for i in text if i % 8 == 7]
    for i in toxic:
        for w in ("moron", "scum", "idiot"):
            text[i].insert(rng.randrange(len(text[i])), w)
    rows = {i: " ".join(w) for i, w in text.items()}
    rows[300], rows[301] = rows[20], " ".join(text[21][:40] + ["changed"] + text[21][41:])
    rows[302], rows[303], rows[304] = None, "", "123 $$ !!"
    rows[305] = " ".join(prose(rng, 100, stems["en"]))
    docs = spark.createDataFrame([(305, rows[305], "en", "s", 1)] + [(i, t, "en" if i % 3 else "de", "s", len(t or "")) for i, t in rows.items()], SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i in toxic)) for i in text], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert at.columns == docs.columns
        kept[name] = {r.doc_id for r in at.select("doc_id").collect()}
    assert set(rows) - kept["language_id"] == {302, 303, 304}
    assert kept["language_id"] - kept["toxicity"] == set(toxic)
    assert kept["toxicity"] - kept["near_duplicates"] == {300, 301}
    assert kept["near_duplicates"] == kept["substring_dedup"] == kept["packing"]
    assert spark.read.parquet(f"{tmp_path}/near_duplicates").filter("doc_id = 305").count() == 1
    cut = spark.read.parquet(f"{tmp_path}/substring_dedup").filter("doc_id in (10, 50)").select("doc_id", "text", "n_chars").collect()
    assert {r.doc_id: r.text for r in cut} == {10: rows[10], 50: " ".join(text[50][:60] + text[50][130:])}
    assert all(r.n_chars == len(r.text) for r in cut)
    assert at.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_language_stage_drops_unlearned_languages(spark, tmp_path):
    rng = random.Random(4)
    stems = (["the", "ing", "wh", "an", "ou", "re", "st", "ly", "ed", "on"], ["der", "ung", "sch", "ö", "heit", "ver", "ge", "ein", "ß", "au"])
    rows = [(i, " ".join(prose(rng, rng.randint(3, 120), stems[i % 2])), ("en", "de")[i % 2], "s", 1) for i in range(300)]
    odd = ["Привет мир, это русский текст о погоде", "今天天气很好，我们去公园散步吧", "aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQ=", "asdfjkl qwerpoiu zxcv asdf lkjh qwer"]
    docs = spark.createDataFrame(rows + [(1000 + i, t, None, "s", 1) for i, t in enumerate(odd)], SCHEMA)
    kept = corpus_pipeline.language_stage(spark, docs, str(tmp_path)).select("doc_id").collect()
    assert {r.doc_id for r in kept} == set(range(300))

"""Hand-derived numbers of layout resolution, rules, text, reports and sources."""

import base64
import json
import os
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gantrel.functions import scalar as S
from gantrel.functions import text as T
from gantrel.operators import layout as L
from gantrel.operators import hooks as H
from gantrel.operators import raster, rules, search
from gantrel.operators import reports as O
from gantrel.sources import files, images
from gantrel.sources.spec import deep_merge, load_spec
from gantrel.streaming.reports import current, upsert_stream

KEYS = ["template", "variant"]
ELEMENTS = "template string, variant string, role string, x long, y long, w long, h long"
MEMBERS = "template string, variant string, role string, edge string, anchor_role string, position double, enabled boolean"


def boxes(spark, *rows):
    return spark.createDataFrame([("t", "v", *r) for r in rows], ELEMENTS)


def aligned(spark, edge, position=None, anchor=None, enabled=True):
    e = boxes(spark, ("headline", 590, 12, 300, 58), ("date", 620, 80, 220, 20), ("location", 640, 110, 180, 20))
    m = spark.createDataFrame([("t", "v", r, edge, anchor, position, enabled) for r in ("date", "location")], MEMBERS)
    return {r.role: r.x for r in L.align_groups(e, m, KEYS).collect()}


def test_groups_follow_their_anchor(spark):
    assert aligned(spark, "left", anchor="headline") == {"headline": 590, "date": 590, "location": 590}
    assert aligned(spark, "right", position=900.0) == {"headline": 590, "date": 680, "location": 720}
    assert aligned(spark, "center", position=600.0) == {"headline": 590, "date": 490, "location": 510}
    assert aligned(spark, "left", anchor="headline", enabled=False) == {"headline": 590, "date": 620, "location": 640}


def test_group_errors(spark):
    e = boxes(spark, ("a", 1, 1, 1, 1))
    m = spark.createDataFrame([("t", "v", "nobody", "left", None, 1.0, True), ("t", "v", "a", "top", None, None, True), ("t", "v", "a", "left", "gone", None, None)], MEMBERS)
    got = sorted(r.error for r in L.group_errors(e, m, KEYS).collect())
    assert got == ["anchor without box", "in several groups", "one of position and anchor", "unknown member", "unsupported edge"]


def test_flow_segments(spark):
    e = boxes(spark, ("upper", 20, 20, 360, 40), ("lower", 20, 130, 360, 40))
    o = spark.createDataFrame([("t", "v", "o", 220, 0, 100, 100, 10)], "template string, variant string, name string, x long, y long, w long, h long, pad long")
    got = {r.role: (r.segment.lo, r.segment.w) for r in L.flow_segments(e, o, KEYS, F.lit(20), F.lit(380), F.col("x")).collect()}
    assert got == {"upper": (20, 190), "lower": (20, 360)}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 120), st.integers(0, 40)), max_size=5))
def test_subtraction_is_disjoint_and_inside(spark, cuts):
    cuts = [(float(a), float(a + n)) for a, n in cuts]
    df = spark.createDataFrame([(cuts,)], "c array<struct<lo:double,hi:double>>")
    got = [(s.lo, s.hi) for s in df.select(L.subtract_cuts(F.lit(0), F.lit(100), F.col("c")).alias("s")).first().s]
    assert all(0 <= a and b <= 100 and b - a >= 1 for a, b in got)
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))
    assert all(b <= lo or a >= hi for a, b in got for lo, hi in cuts if hi > lo)


def test_override_to_null_wins(spark):
    base = spark.createDataFrame([(1, 5, 6)], "k long, x long, y long")
    patch = spark.createDataFrame([(1, True, False, None, 9)], "k long, has_x boolean, has_y boolean, x long, y long")
    assert L.overlay(base, patch, ["k"], ["x", "y"]).first().asDict() == {"k": 1, "x": None, "y": 6}


def test_directions_and_paths(spark):
    df = spark.createDataFrame([("مرحبا Hi",)], "t string")
    d = S.resolved_direction(F.lit(None).cast("string"), F.col("t"))
    row = df.select(d.alias("d"), S.physical_alignment(F.lit(None), F.lit("left"), d).alias("a"), S.physical_alignment(F.lit(None), F.lit("force-left"), d).alias("f"), S.resolve_path(F.lit("@skill/a"), "/s", "/b").alias("p"), S.safe_output(F.lit("a/../b")).alias("o")).first()
    assert tuple(row) == ("rtl", "right", "left", "/b/a", False)
    with pytest.raises(Exception, match="unknown direction"):
        df.select(S.resolved_direction(F.lit("up"), F.col("t"))).collect()
    with pytest.raises(Exception, match="unknown edge"):
        df.select(S.edge_value(F.lit("center"), *[F.lit(1)] * 4)).collect()


def judged(spark, qa, boxes, configured=(), obstacles=()):
    kind = "struct<x:bigint,y:bigint,w:bigint,h:bigint"
    schema = f"template string, variant string, boxes map<string,{kind}>>, configured map<string,{kind}>>, obstacles map<string,{kind},pad:bigint>>"
    pics = spark.createDataFrame([("t", "v", boxes if boxes is None else {f"{k}.ink_box" if "." not in k else k: b for k, b in boxes.items()}, dict(configured), dict(obstacles))], schema)
    found = rules.judge(pics, load_spec(spark, {"templates": {"t": {"qa": qa}}}).rules, KEYS).collect()
    return sorted((r.rule, r.roles, r.actual, r.expected) for r in found)


def test_rules_are_strict(spark):
    b = {"a": (0, 0, 10, 10), "b": (10, 0, 10, 10), "c": (5, 12, 10, 10)}
    assert judged(spark, {"non_overlap": [["a", "b"]], "spacing": [{"from": "a", "to": "c", "min": 2}]}, b) == []
    assert judged(spark, {"spacing": [{"from": "a", "to": "c", "min": 3}]}, b) == [("spacing", "a,c", '{"axis":"y","gap":2}', '{"min":3.0,"metric":"ink_box"}')]
    missing = judged(spark, {"spacing": [["a", "d"]], "alignment_groups": [{"roles": ["a", "d"], "tolerance": 0}], "containment": ["d"]}, b)
    assert missing == [(f"{k}.missing_metric", "d", None, "ink_box") for k in ("alignment", "containment", "spacing")]
    assert judged(spark, {"spacing": [["a", "b"]]}, None) == [("missing_render_metrics", "", None, "report")]
    around = {"a": (0, 0, 5, 5)}
    assert [r[0] for r in judged(spark, {"containment": [{"roles": ["a", "b"], "tolerance": 5}, {"role": "a", "tolerance": 4}]}, b, around)] == ["containment", "containment.missing_safe_box"]
    face = {"face": (12, 0, 5, 5, None), "own": (12, 0, 5, 5, 0)}
    clear = judged(spark, {"obstacle_clearance": [{"roles": ["a"], "padding": 3, "obstacles": ["face", "own", "gone"]}]}, b, (), face)
    assert [(r[0], r[1]) for r in clear] == [("obstacle_clearance", "a,obstacle:face"), ("obstacle_clearance.missing_obstacle", "a,obstacle:gone")]
    with pytest.raises(Exception, match="unknown edge"):
        judged(spark, {"alignment_groups": [{"roles": ["a", "b"], "edge": "middle"}]}, b)


def test_specification_shapes(spark, tmp_path):
    path = tmp_path / "spec.json"
    path.write_text(json.dumps({"locales": [{"language": "de"}], "templates": {"t": {"elements": {"a": {}, "b": {"type": "image"}}, "qa": {"obstacle_clearance": True, "containment": True, "non_overlap": [{"from": "a", "to": "b"}, ["x", "y", "z"]]}}}}))
    s = load_spec(spark, path)
    assert [(r.kind, r.roles) for r in s.rules.orderBy("ord").collect()] == [("non_overlap", ["a", "b"]), ("obstacle_clearance", ["a"]), ("containment", ["a", "b"])]
    assert s.variants.first().variant == "de" and s.templates.first().canvas_w is None
    assert deep_merge({"a": {"b": 1, "c": [1]}, "d": 2}, {"a": {"c": [2]}, "d": {"e": 3}}) == {"a": {"b": 1, "c": [2]}, "d": {"e": 3}}


def test_images_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    grid = rng.integers(0, 256, (9, 11, 4)).astype(np.uint8)
    frames = [rng.integers(0, 100, (20, 30)) for _ in range(3)]
    gif = images.encode_gif(frames, rng.integers(0, 256, (100, 3)), [100, 0, 250], loop=3)
    (tmp_path / "a.png").write_bytes(images.encode_png(grid))
    (tmp_path / "b.gif").write_bytes(gif)
    px = {(r.origin[-5:], r.y, r.x): (r.r, r.g, r.b, r.a) for r in files.read_images(spark, str(tmp_path)).collect()}
    assert all(px["a.png", y, x] == tuple(grid[y, x]) for y in range(9) for x in range(11)) and len(px) == 99 + 600
    assert images.probe(gif) | {"format": "GIF"} == {"format": "GIF", "mode": "P", "width": 30, "height": 20, "frames": 3, "durations_ms": [100, 0, 250], "loop": 3, "error": None}
    for at in range(0, len(gif), 7):
        images.probe(gif[:at])
        images.probe(gif[:at] + b"\xff" + gif[at + 1 :])
    assert images.probe(gif[:100])["error"] and images.probe(b"")["error"] == "not an image"


def test_hooks(spark):
    rows = spark.createDataFrame([("t", "v", "a", "text", 3), ("t", "v", "b", "image", 4)], "template string, variant string, role string, type string, w long")
    drawn = H.draw_elements(rows, H.load_hooks({"draw_element": lambda r: {"w": r["w"]} if r["role"] == "a" else None, "after_frame": 3}), {"image": F.create_map(F.lit("by"), F.lit("image"))}, KEYS)
    assert {r.role: r.metrics for r in drawn.collect()} == {"a": {"w": "3"}, "b": {"by": "image"}}
    with pytest.raises(Exception, match="unsupported element type"):
        H.draw_elements(rows, H.load_hooks(None), {"image": F.create_map(F.lit("by"), F.lit("image"))}, KEYS).collect()


def test_distances_and_medians(spark):
    rng = np.random.default_rng(4)
    on = rng.random((9, 14)) < 0.8
    off = np.argwhere(~on)
    want = np.array([[min(((p - (y, x)) ** 2).sum() for p in off) if on[y, x] else 0 for x in range(14)] for y in range(9)])
    assert (raster.distance_squared(on) == want).all() and (raster.distance_squared(np.ones((2, 3), bool)) == -1).all()
    assert [raster.median_kernel(*s) for s in ((8, 8), (80, 200), (100, 96))] == [9, 11, 13]
    with pytest.raises(ValueError, match="nine"):
        raster.matrix_3x3([1, 2])


def test_wrapping(spark):
    df = spark.createDataFrame([("one two three",), ("กิบุ",), ("a\r\nb\n",), ("",)], "t string")
    assert [r.w for r in df.select(T.wrap(T.words(F.col("t")), F.lit(7), " ").alias("w")).collect()][0] == ["one two", "three"]
    assert [r.w for r in df.select(T.wrap_clusters(F.col("t"), F.lit(1)).alias("w")).collect()][1] == ["กิ", "บุ"]
    assert [r.p for r in df.select(T.paragraphs(F.col("t")).alias("p")).collect()][2:] == [["a", "b"], [""]]


@settings(max_examples=12, deadline=None)
@given(st.text("ab cd", max_size=60), st.integers(1, 20))
def test_wrapping_keeps_everything_but_spaces(spark, text, limit):
    lines = spark.createDataFrame([(text,)], "t string").select(T.wrap(T.words(F.col("t")), F.lit(limit), " ").alias("w")).first().w
    assert "".join(lines).replace(" ", "") == text.replace(" ", "")
    assert all(len(s) <= limit or " " not in s for s in lines)


def cluster_lines(text, limit):
    """Lines by cluster, one cluster after the other."""
    done, line, wide = [], "", 0
    for c in re.findall(r"(?s)(?:\u200d+[^\u200d]?|[^\u200d])(?:\u0301|\u200d+[^\u200d]?)*", text):
        if wide + 1 <= limit:
            line, wide = line + c, wide + 1
        else:
            done, line = [*done, line.rstrip()], c.lstrip()
            wide = 1 if line else 0
    return [*done, line.rstrip()]


def test_wrapping_by_matches(spark):
    """Lines are those of the folds over units, whatever signs join, and at any limit."""
    rng = random.Random(7)
    texts = ["", " ", "a\u200d b", "\u0301", *("".join(rng.choices(signs, k=rng.randrange(1, 40))) for signs in ("ab ", "ab \t\xa0", "a \u0301", "ab \u200d", "ab \u0301\u200d", "a\U0001f600 \u3000\u0301\u200d") for _ in range(60))]
    df = spark.createDataFrame([(t, n) for t in texts for n in (0, 1, 2, 3, 7, 12, 300)], "t string, n int")
    t, n = F.col("t"), F.col("n")
    units = F.filter(F.split(t, f"[{T.GAPS}]+"), lambda w: w != "")
    fits = F.size(units) > 1
    rows = df.select("t", "n", T.wrap_words(t, n).alias("w"), T.wrap(units, n, " ").alias("w0"), T.wrap_clusters(t, n).alias("c"), *[T.by_words(T.spaced(t), n, F.lit(m)).alias(m) for m in ("auto", "word", "manual")], (fits & F.forall(units, lambda x: T.width(x) <= n)).alias("auto0")).collect()
    assert [(r.t, r.n, r.w, r.auto, r.word, r.manual) for r in rows] == [(r.t, r.n, r.w0, r.auto0, True, False) for r in rows]
    assert [(r.t, r.n, r.c) for r in rows] == [(r.t, r.n, cluster_lines(r.t, r.n)) for r in rows]


@pytest.mark.parametrize("mode", ["word", "grapheme", "auto"])
def test_wrapping_grows_with_the_text(spark, mode):
    """A paragraph of many lines takes no longer than its characters ask for, joining signs or not; copying the lines so far
    for each further one took minutes."""
    words = ["lorem", "ipsum", "e\u0301te"]
    for n in (2, 3):
        df = spark.createDataFrame([(n,)], "n int").select(F.repeat(F.lit(" ".join(words[:n]) + " "), 150_000).alias("t"))
        start = time.time()
        got = df.select(T.wrap_paragraph(F.col("t"), F.lit(11), F.lit(mode)).alias("w")).select(F.size("w").alias("n"), F.array_max(F.transform("w", T.width)).alias("widest")).first()
        assert time.time() - start < 30 and got.widest == 11 and got.n >= 130_000


def fitted(text, mode, single, box_w, box_h, low, high, max_lines):
    """Every size from the largest down, every line one after the other."""
    width = lambda t: len(re.findall(r"(?s)(?:\u200d+[^\u200d]?|[^\u200d])(?:\u0301|\u200d+[^\u200d]?)*", t))
    for z in range(high, max(low, single or high + 1) - 1, -1):
        if "\n" not in text and width(text) * z <= 2 * box_w and z * 112 <= 100 * box_h:
            return (z, 1, "single_line_preferred")
    parts = text.split("\n")
    for z in range(high, low - 1, -1):
        limit, n, ok = 2 * box_w // z, 0, True
        for p in parts[:-1] if len(parts) > 1 and not parts[-1] else parts:
            words = re.findall(r"[^\t \xa0]+", p)
            if mode == "manual":
                n, ok = n + 1, ok and width(p) <= limit
            elif mode == "word" or (mode == "auto" and len(words) > 1 and all(width(w) <= limit for w in words)):
                got, wide = 0, 0
                for w in words:
                    got, wide = (got, wide + width(" " + w)) if got and wide + width(" " + w) <= limit else (got + 1, width(w))
                    ok = ok and width(w) <= limit
                n += max(got, 1)
            else:
                n, ok = n + len(cluster_lines(p, limit)), ok and limit >= 1
        if ok and n <= max_lines and n * z * 112 <= 100 * box_h:
            return (z, n, "wrapped" if n > 1 else "single_line")
    return None


@pytest.mark.parametrize("box", [(240, 90, 12, 40, 3), (30, 200, 3, 40, 7), (4, 300, 2, 20, 40)])
def test_sizes_are_the_largest_that_fit(spark, box):
    rng = random.Random(box[0])
    texts = ["", "\n", "\n\n", "a" * 300, "word " * 200, *("".join(rng.choices(signs, k=rng.randrange(1, 60))) for signs in ("abc ", "ab \t\xa0", "abcde \n", "abcd \u0301", "abc \u0301\u200d\u3000\n") for _ in range(40))]
    rows = [(t, m, s) for t in texts for m, s in (("auto", None), ("word", None), ("grapheme", 5), ("manual", None), (None, 18))]
    df = spark.createDataFrame(rows, "t string, m string, s int")
    got = df.select("t", "m", "s", T.fit_size(F.col("t"), *box, F.col("m"), F.col("s")).alias("f")).collect()
    assert [(r.t, r.m, r.s, r.f and tuple(r.f)) for r in got] == [(*r, fitted(*r, *box)) for r in rows]


def test_sizes_are_tried_without_folding_again(spark):
    """Lines are counted once a limit, and not at all where the text is too much for it; each of them was folded some
    sixteen times."""
    df = spark.range(20_000).select(F.concat(F.repeat(F.lit("word "), 100), F.col("id").cast("string")).alias("t"))
    start = time.time()
    got = df.select(T.fit_size(F.col("t"), 240, 90, 12, 40, 3).alias("f")).select(F.count("*"), F.count("f")).first()
    assert time.time() - start < 30 and tuple(got) == (20_000, 0)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_fitting_is_dealt_over_tasks(spark):
    """One small file is many tasks' work."""
    import gantrel.plans.text as plans

    plan = plans.fit_text(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [c_custkey" in plan


def test_merge_keeps_skipped_metrics(spark):
    schema = "k string, status string, metric long, ord long"
    base = spark.createDataFrame([("wide", "rendered", 1, 1), ("portrait", "rendered", 2, 2)], schema)
    update = spark.createDataFrame([("new", "rendered", 5, 1), ("wide", "rendered", 9, 2), ("portrait", "skipped", None, 3)], schema)
    merged = O.merge_reports(base, update, ["k"])
    assert [(r.k, r.status, r.metric) for r in merged.orderBy("place").collect()] == [("wide", "rendered", 9), ("portrait", "skipped", 2), ("new", "rendered", 5)]
    again = O.merge_reports(merged.withColumn("ord", F.row_number().over(__import__("pyspark").sql.Window.orderBy("place"))).drop("place"), update, ["k"])
    assert {(r.k, r.metric) for r in again.collect()} == {("wide", 9), ("portrait", 2), ("new", 5)}


def test_stream_upsert(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    for i, part in enumerate(([{"k": "a", "status": "rendered", "metric": 1, "ord": 1}], [{"k": "a", "status": "skipped", "ord": 2}, {"k": "b", "status": "rendered", "metric": 3, "ord": 3}])):
        (source / f"{i}.json").write_text("\n".join(map(json.dumps, part)))
        updates = spark.readStream.schema("k string, status string, metric long, ord long").json(str(source))
        upsert_stream(updates, store, str(tmp_path / "ck"), ["k"]).awaitTermination(60)
    assert {(r.k, r.status, r.metric) for r in current(spark, store, 1).collect()} == {("a", "skipped", 1), ("b", "rendered", 3)}


def test_file_inventory(spark, tmp_path):
    png = base64.b64decode("iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJAAAADUlEQVR42mNk+M9QDwADhgGAWjR9awAAAABJRU5ErkJggg==")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "p.PNG").write_bytes(png)
    (tmp_path / "copy.txt").write_text("x")
    before = {r.relative: r for r in files.inventory(spark, str(tmp_path)).collect()}
    assert (before["sub/p.PNG"].kind, before["sub/p.PNG"].width, before["sub/p.PNG"].format, before["copy.txt"].kind) == ("image", 1, "PNG", "other")
    first = spark.createDataFrame([(r.relative, r.sha256) for r in before.values()], "relative string, sha256 string")
    (tmp_path / "copy.txt").write_text("y")
    (tmp_path / "new.txt").write_text("n")
    (tmp_path / "sub" / "p.PNG").unlink()
    diff = {r.relative: r.state for r in O.inventory_diff(first, files.inventory(spark, str(tmp_path)), "relative", "sha256").collect()}
    assert diff == {"copy.txt": "changed", "new.txt": "added", "sub/p.PNG": "removed"}


def test_report_source(spark, tmp_path):
    path = str(tmp_path / "report.json")
    (tmp_path / "report.json").write_text(json.dumps([{"variant": "en", "template": "wide", "status": "rendered", "metrics": {"title": {"ink_box": [1, 2, 3, 4], "lines": ["a"]}}}, {"variant": "fr", "template": "wide", "status": "skipped"}]))
    df = files.read_report(spark, path)
    assert df.filter("metrics is null").count() == 1 and df.selectExpr("metrics['title'].ink_box[3] as h").first().h == 4.0


def test_raster():
    grid = np.array([[1, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 0], [1, 0, 0, 1]], bool)
    assert raster.label(grid).max() == 3 and len(set(raster.label(grid)[[0, 1], [1, 2]])) == 1
    m = raster.homography([(0, 0), (1, 0), (1, 1), (0, 1)], [(0, 0), (2, 0), (2, 2), (0, 2)])
    assert np.allclose(m @ [0.5, 0.5, 1], [1, 1, 1])
    assert raster.kmeans_rows(np.array([0, 1, 7, 8]), np.ones(4), 2).tolist() == [0.5, 7.5]


def test_fits_of_images_match_numpy(spark):
    import os

    from gantrel.plans import pixels as queries

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no tables here")
    grids = {}
    for r in queries.gray(spark, data).filter("image < 20").collect():
        grids.setdefault(r.image, np.zeros((8, 8)))[r.y, r.x] = r.v
    y, x = np.mgrid[0:8, 0:8].astype(float)
    ring = ~((x >= 2) & (x <= 5) & (y >= 2) & (y <= 5))
    design = np.stack([np.ones_like(x), x, y, x * x, x * y, y * y], axis=-1)
    for r in queries.poly_fit(spark, data).filter("image < 20").collect():
        w = np.linalg.lstsq(design[ring], grids[r.image][ring], rcond=None)[0]
        assert abs(r.center - w @ [1, 3.5, 3.5, 12.25, 12.25, 12.25]) < 1e-3
    for r in queries.kmeans_lines(spark, data).filter("image < 20").collect():
        rows = np.repeat(np.arange(8), (grids[r.image] > 140).sum(axis=1))
        splits = [rows[:i] for i in range(1, len(rows)) if rows[i] != rows[i - 1]]
        best = min((((a - a.mean()) ** 2).sum() + ((b := rows[len(a) :]) - b.mean()) @ (b - b.mean()) for a in splits), default=0.0)
        got = sum(min((v - c) ** 2 for c in r.centers) for v in rows)
        assert got <= best + 1e-2


def test_morphology_matches_numpy(spark):
    rng = np.random.default_rng(0)
    grid = rng.random((12, 15)) > 0.8
    rows = [(0, y, x, int(grid[y, x])) for y in range(12) for x in range(15)]
    df = spark.createDataFrame(rows, "image long, y long, x long, m int")
    got = np.zeros((12, 15), int)
    for r in raster.morphology(df, "image", "m", [("dilate", 5, 3)]).collect():
        got[r.y, r.x] = r.m
    padded = np.pad(grid, ((1, 1), (2, 2)))
    want = np.max([padded[i : i + 12, j : j + 15] for i in range(3) for j in range(5)], axis=0)
    assert (got == want).all()


def test_searches(spark):
    df = spark.range(0, 120, 7)
    got = df.select("id", search.highest_feasible(25, 95, lambda q: q <= F.col("id")).alias("q"), search.first_fit([300, 64, 1], 2, 256, lambda c: c <= F.col("id")).alias("c")).collect()
    assert all(r.q == (min(95, r.id) if r.id >= 25 else None) and r.c == (64 if r.id >= 64 else 2 if r.id >= 2 else None) for r in got)


def test_flagship_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["template", "variant", "rule", "roles", "actual", "expected", "severity"] and df.count() > 0

"""Queries over real files and documents: specifications, reports, inventories, images, copies and hooks. What a query
reads it first writes, under the session's warehouse, from the stored tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gantrel.operators import hooks as H
from gantrel.operators import reports as O
from gantrel.operators.layout import specification_sized
from gantrel.sources import files, images
from gantrel.sources.spec import load_spec
from gantrel.sources.tables import projection, with_projections

from .registry import query

W = with_projections
KEYS = ["template", "variant"]


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see: under the checkpoint folder where one is set, else the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- specification ---

SPEC = {
    "variants": [
        {"id": "en", "language": "en_US", "copy": {"title": "Hello", "cta": "Go"}, "assets": {"logo": "a/en.png"}},
        {"language": "ar", "values": {"title": "مرحبا"}, "layout_overrides": {"wide": {"title": {"box": [1, 2, 3, 4]}, "date": {"enabled": False}}}, "obstacle_overrides": {"wide": {"face": None, "new": [5, 6, 7, 8]}}},
        {"id": "", "language": ""},
    ],
    "templates": {
        "wide": {
            "canvas": [960, 540], "background": "bg.png", "output": "wide.gif", "animation": {"frames": 3, "loop": 0, "durations_ms": [100, 100, 200]},
            "elements": {"title": {"type": "text", "box": [10, 20, 300, 40], "z": 2}, "date": {"box": [10, 70, 200, 20], "copy_key": "when"}, "logo": {"type": "image", "box": [1, 2, 3], "enabled": False}, "cta": {"type": "button", "fixed_text": "Buy"}},
            "alignment_groups": {"left": {"members": ["title", "date"], "edge": "left", "anchor_role": "title"}},
            "obstacles": {"face": [400, 10, 50, 60], "badge": {"box": [500, 20, 30, 30], "padding": 4}, "odd": [1, 2]},
            "qa": {"spacing": [["title", "date"], {"from": "date", "to": "cta", "axis": "x", "min": 6}, ["one"]], "non_overlap": [{"roles": ["title", "cta"], "metric": "content_box"}], "obstacle_clearance": True, "containment": ["title", {"roles": ["date", "cta"], "tolerance": 2}], "elements": {"title": {"max_lines": 2, "containment_tolerance": 1}}},
        },
        "tall": {"canvas": [300, 600], "output": "tall.png", "elements": {"title": {"type": "text", "box": [0, 0, 300, 50]}}, "qa": {"alignment_groups": [{"roles": ["title"]}, {"roles": ["title", "date"], "edge": "right", "tolerance": 3}], "containment": True}},
    },
}
_SPEC = json.dumps(SPEC, ensure_ascii=False).replace("'", "''")


@query(f"""WITH doc AS (SELECT CAST('{_SPEC}' AS JSON) AS d), t AS (SELECT unnest(json_keys(d->'templates')) AS template, d->'templates' AS ts FROM doc),
e AS (SELECT template, unnest(json_keys(ts->template->'elements')) AS role, unnest(range(len(json_keys(ts->template->'elements')))) AS ord, ts->template->'elements' AS es FROM t)
SELECT template, role, ord, coalesce(es->role->>'type', 'text') AS type, coalesce(CAST(es->role->>'z' AS BIGINT), 0) AS z, coalesce(CAST(es->role->>'enabled' AS BOOLEAN), true) AS enabled,
  CASE WHEN json_array_length(es->role->'box') = 4 THEN list_transform(range(4), lambda i: CAST(json_extract_string(es->role->'box', '$[' || i || ']') AS DOUBLE)) END AS box, es->role->>'fixed_text' AS fixed_text, coalesce(es->role->>'value_key', es->role->>'copy_key', role) AS value_key FROM e""")
def spec_elements(spark: SparkSession, d: str) -> DataFrame:
    """Elements of a specification document; a box of other than four numbers is none."""
    e = load_spec(spark, json.dumps(SPEC)).elements
    return e.select("template", "role", F.col("ord").cast("long").alias("ord"), "type", F.col("z").cast("long").alias("z"), "enabled", "box", "fixed_text", "value_key")


@query(f"""WITH doc AS (SELECT CAST('{_SPEC}' AS JSON) AS d), t AS (SELECT unnest(json_keys(d->'templates')) AS template, d->'templates' AS ts FROM doc),
o AS (SELECT template, unnest(json_keys(ts->template->'obstacles')) AS name, ts->template->'obstacles' AS os FROM t),
b AS (SELECT template, name, CASE WHEN json_type(os->name) = 'ARRAY' THEN os->name ELSE os->name->'box' END AS box, CASE WHEN json_type(os->name) = 'OBJECT' THEN CAST(os->name->>'padding' AS DOUBLE) END AS pad FROM o)
SELECT template, name, CASE WHEN json_array_length(box) = 4 THEN CAST(box->>0 AS DOUBLE) END AS x, CASE WHEN json_array_length(box) = 4 THEN CAST(box->>3 AS DOUBLE) END AS h, pad FROM b""")
def find_box(spark: SparkSession, d: str) -> DataFrame:
    """Obstacles given bare or with a padding, as boxes where they have four numbers."""
    return load_spec(spark, SPEC).obstacles.select("template", "name", "x", "h", "pad")


@query("""SELECT * FROM (VALUES ('wide', 0, 'spacing', 'title,date', 'ink_box', 'y', 0.0::DOUBLE), ('wide', 1, 'spacing', 'date,cta', 'ink_box', 'x', 6), ('wide', 2, 'non_overlap', 'title,cta', 'content_box', 'y', 0), ('wide', 3, 'obstacle_clearance', 'title,date,cta', 'ink_box', 'y', 0),
('wide', 4, 'containment', 'title', 'ink_box', 'y', 0), ('wide', 5, 'containment', 'date,cta', 'ink_box', 'y', 2), ('wide', 6, 'containment', 'title', 'ink_box', 'y', 1), ('tall', 0, 'alignment', 'title,date', 'ink_box', 'y', 3), ('tall', 1, 'containment', 'title', 'ink_box', 'y', 0)) t(template, ord, kind, roles, metric, axis, amount)""")
def pair_roles(spark: SparkSession, d: str) -> DataFrame:
    """Rules of every shape that a specification may give them in, as rows of one."""
    r = load_spec(spark, SPEC).rules
    return r.select("template", F.col("ord").cast("int").alias("ord"), "kind", F.array_join("roles", ",").alias("roles"), "metric", "axis", "amount")


@query("""SELECT * FROM (VALUES ('en', 'en_US', 'Hello', 'a/en.png', 'wide', 960, 540, 3, 400), ('en', 'en_US', 'Hello', 'a/en.png', 'tall', 300, 600, NULL, NULL), ('ar', 'ar', 'مرحبا', NULL, 'wide', 960, 540, 3, 400), ('ar', 'ar', 'مرحبا', NULL, 'tall', 300, 600, NULL, NULL),
('default', '', NULL, NULL, 'wide', 960, 540, 3, 400), ('default', '', NULL, NULL, 'tall', 300, 600, NULL, NULL)) t(variant, language, title, logo, template, w, h, frames, total_ms)""")
def spec_pictures(spark: SparkSession, d: str) -> DataFrame:
    """Every picture that a specification asks for: its variants by its templates, both as small as the document."""
    s = load_spec(spark, SPEC)
    both = s.templates.join(specification_sized(s.variants.drop("ord", "background")), F.lit(True))
    total = F.aggregate("durations_ms", F.lit(0), lambda a, x: a + x)
    return both.select("variant", "language", F.try_element_at("copy", F.lit("title")).alias("title"), F.try_element_at("assets", F.lit("logo")).alias("logo"), "template", F.col("canvas_w").alias("w"), F.col("canvas_h").alias("h"), "frames", total.alias("total_ms"))


@query("""SELECT * FROM (VALUES ('en', 'wide', 'face', 400.0::DOUBLE, NULL::DOUBLE), ('en', 'wide', 'badge', 500, 4), ('en', 'wide', 'odd', NULL, NULL), ('ar', 'wide', 'badge', 500, 4), ('ar', 'wide', 'odd', NULL, NULL), ('ar', 'wide', 'new', 5, NULL), ('default', 'wide', 'face', 400, NULL), ('default', 'wide', 'badge', 500, 4), ('default', 'wide', 'odd', NULL, NULL)) t(variant, template, name, x, pad)""")
def spec_obstacles(spark: SparkSession, d: str) -> DataFrame:
    """Obstacles of every variant: an override to null deletes, an unknown name adds."""
    s = load_spec(spark, SPEC)
    base = s.obstacles.join(specification_sized(s.variants.select("variant")), F.lit(True)).select("variant", "template", "name", F.col("x").alias("bx"), F.col("pad").alias("bpad"), F.lit(True).alias("given"))
    over = s.obstacle_overrides.select("variant", "template", "name", "x", "pad", "deleted")
    met = base.join(over, ["variant", "template", "name"], "full_outer").filter("coalesce(deleted, false) = false")
    new = F.col("deleted").isNotNull()
    return met.select("variant", "template", "name", F.when(new, F.col("x")).otherwise(F.col("bx")).alias("x"), F.when(new, F.col("pad")).otherwise(F.col("bpad")).alias("pad"))


# --- reports ---


@query(W("SELECT variant, template, status, CAST(metric AS BIGINT) AS font_size, CASE WHEN metric IS NOT NULL THEN [1.0::DOUBLE, CAST(metric AS DOUBLE)] END AS box FROM base_rows WHERE status = 'rendered'", "base_rows"))
def scan_report(spark: SparkSession, d: str) -> DataFrame:
    """The rendered rows of a report that was written as JSON files and is read with its fixed schema."""
    path = folder(spark, "report")
    size = F.struct(F.array(F.lit(1.0), F.col("metric").cast("double")).alias("box"), F.col("metric").cast("int").alias("font_size"))
    rows = projection(spark, d, "base_rows").select(F.col("variant").cast("string").alias("variant"), F.lit("en").alias("language"), F.col("template").cast("string").alias("template"), "status", F.when(F.col("metric").isNotNull(), F.create_map(F.lit("title"), size)).alias("metrics"))
    files.write_report(rows, path)
    read = files.read_report(spark, path, lines=True).filter("status = 'rendered'")
    title = F.try_element_at("metrics", F.lit("title"))
    return read.select(F.col("variant").cast("long").alias("variant"), F.col("template").cast("long").alias("template"), "status", title["font_size"].cast("long").alias("font_size"), title["box"].alias("box"))


# --- files ---

_BODY = "repeat(n_name || ' é ', CAST(n_nationkey % 9 + 1 AS INT))"
_NAMED = "'r' || CAST(n_regionkey AS STRING) || '/' || lower(replace(n_name, ' ', '_')) || CASE n_nationkey % 7 WHEN 0 THEN '.PNG' WHEN 1 THEN '.ttf' WHEN 2 THEN '.csv' WHEN 3 THEN '.svg' WHEN 4 THEN '.gif' WHEN 5 THEN '.png' ELSE '' END"


def _put(rows: DataFrame, path: str) -> None:
    """Write (relative, content) rows as files under ``path`` from the executors, through the file system of the path."""
    conf = rows.sparkSession._jsc.hadoopConfiguration()
    jvm = rows.sparkSession._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    for r in rows.toLocalIterator():  # a file for each nation: the asset folder of a project, not a corpus
        out = fs.create(jvm.org.apache.hadoop.fs.Path(at, r.relative))
        out.write(bytearray(r.content))
        out.close()


def _frame(k: int, n: int) -> np.ndarray:
    y, x = np.mgrid[0:6, 0 : 5 + k % 3]
    return (k * 7 + x * 3 + y * 5 + n * 11) % 100


def _asset(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """PNG, GIF or text of a struct (k, kind, text)."""
    palette = np.stack([np.arange(100) * 2, 255 - np.arange(100), np.arange(100) + 50], axis=1)
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            k, kind = r["k"], r["kind"]
            if kind == 4 and k % 2 == 0:
                out.append(images.encode_gif([_frame(k, i) for i in range(2 + k % 3)], palette, [100 + 10 * i for i in range(2 + k % 3)], loop=k % 4))
            elif kind == 0 or (kind == 5 and k % 3):
                grid = _frame(k, 0)
                out.append(images.encode_png(np.stack([grid, 255 - grid, grid + 50, np.where(grid % 2, 255, 90)][: 4 if kind == 0 else 3], axis=-1)))
            else:
                out.append(r["text"].encode())
        yield pa.array(out, pa.binary())


def _assets(spark: SparkSession, d: str) -> str:
    n = spark.read.parquet(f"{d}/nation.parquet")
    rows = n.select(F.expr(_NAMED).alias("relative"), F.struct(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") % 7).alias("kind"), F.expr(_BODY).alias("text")).alias("a"))
    path = folder(spark, "assets")
    _put(rows.select("relative", F.arrow_udf(_asset, "binary")("a").alias("content")), path)
    return path


_KINDS = "CASE k7 WHEN 0 THEN 'image' WHEN 1 THEN 'font' WHEN 2 THEN 'spreadsheet' WHEN 3 THEN 'vector' WHEN 4 THEN 'image' WHEN 5 THEN 'image' ELSE 'other' END"
_N = f"n AS (SELECT n_nationkey AS k, n_nationkey % 7 AS k7, {_NAMED.replace('STRING', 'VARCHAR')} AS relative, {_BODY} AS body FROM nation), f AS (SELECT *, CASE WHEN k7 = 4 AND k % 2 = 0 THEN 'GIF' WHEN k7 = 0 OR (k7 = 5 AND k % 3 <> 0) THEN 'PNG' END AS format FROM n)"


@query(f"WITH {_N} SELECT relative, {_KINDS} AS kind, CASE WHEN format IS NULL THEN sha256(body) END AS sha256, CASE WHEN format IS NULL THEN CAST(strlen(body) AS BIGINT) END AS bytes FROM f")
def asset_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Kind, size and digest of every file of a folder; of images, whose compressed bytes may differ, the kind only."""
    found = files.inventory(spark, _assets(spark, d))
    text = F.col("format").isNull()
    return found.select("relative", "kind", F.when(text, F.col("sha256")).alias("sha256"), F.when(text, F.col("bytes")).alias("bytes"))


@query(f"""WITH {_N} SELECT relative, format, CASE format WHEN 'GIF' THEN 'P' WHEN 'PNG' THEN CASE k7 WHEN 0 THEN 'RGBA' ELSE 'RGB' END END AS mode, CASE WHEN format IS NOT NULL THEN 5 + k % 3 END AS width, CASE WHEN format IS NOT NULL THEN 6 END AS height,
CASE format WHEN 'GIF' THEN 2 + k % 3 WHEN 'PNG' THEN 1 END AS frames, CASE format WHEN 'GIF' THEN list_transform(range(2 + k % 3), lambda i: 100 + 10 * i) END AS durations_ms, CASE format WHEN 'GIF' THEN k % 4 END AS loop, CASE WHEN format IS NULL THEN 'not an image' END AS error FROM f WHERE k7 IN (0, 4, 5)""")
def image_probe(spark: SparkSession, d: str) -> DataFrame:
    """Headers of all files with an image's suffix: size, mode, frames, durations and loop, or an error."""
    found = files.inventory(spark, _assets(spark, d)).filter("kind = 'image'")
    number = {"width": "long", "height": "long", "frames": "long", "durations_ms": "array<bigint>", "loop": "long"}
    return found.select("relative", *[F.col(f"header.{c}").cast(number[c]).alias(c) if c in number else F.col(f"header.{c}").alias(c) for c in ("format", "mode", "width", "height", "frames", "durations_ms", "loop", "error")])


@query(f"WITH {_N}, p AS (SELECT relative, k, k7, y, x, (k * 7 + x * 3 + y * 5) % 100 AS v FROM f CROSS JOIN range(6) a(y) CROSS JOIN range(7) b(x) WHERE format IS NOT NULL AND x < 5 + k % 3) SELECT relative, y, x, CASE k7 WHEN 4 THEN v * 2 ELSE v END AS r, 255 - v AS g, v + 50 AS b, CASE WHEN k7 = 0 AND v % 2 = 0 THEN 90 ELSE 255 END AS a FROM p")
def image_decode(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of PNG files and of the first frames of GIF files that this engine wrote, as Spark's own reader has them."""
    root = _assets(spark, d)
    px = files.read_images(spark, root)
    return px.select(F.substring_index("origin", f"{root.split('/')[-1]}/", -1).alias("relative"), *[F.col(c).cast("long").alias(c) for c in "yxrgba"])


@query(f"WITH {_N} SELECT relative FROM f WHERE k7 IN (0, 4, 5)")
def image_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Files of a folder by a set of suffixes, whatever their case."""
    return files.image_inputs(spark, _assets(spark, d)).select("relative")


@query(f"WITH {_N}, b AS (SELECT relative, body, strlen(body) < 60 AS under, k % 5 = 0 AS present FROM f WHERE format IS NULL) SELECT relative, under AND NOT present AS copied, CASE WHEN under AND present THEN 'output exists' WHEN NOT under THEN 'over budget' END AS reason, CASE WHEN under AND NOT present THEN sha256(body) END AS sha256 FROM b")
def copy_through(spark: SparkSession, d: str) -> DataFrame:
    """Files under the budget copied byte by byte to a new folder, unless their output is there; the digest is of the
    copy."""
    root = _assets(spark, d)
    out = folder(spark, "copies")
    found = files.inventory(spark, root).filter("format is null")
    listed = spark.read.parquet(f"{d}/nation.parquet").filter("n_nationkey % 5 = 0").select(F.expr(_NAMED).alias("relative"))
    plan = files.copy_plan(found, listed, 60)
    _put(plan.filter("copied").join(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content"), "path").select("relative", "content"), out)
    copies = files.inventory(spark, out).select("relative", "sha256")
    return plan.select("relative", "copied", "reason").join(copies, "relative", "left")


# --- hooks ---


@query(W("""SELECT template, variant, CAST(role AS VARCHAR) AS role, CASE WHEN k % 5 = 0 THEN 'hook' WHEN role % 2 = 0 THEN 'text' ELSE 'rect' END AS by_, CASE WHEN k % 5 = 0 THEN (w + 10) * h WHEN role % 2 = 0 THEN w + 10 ELSE h END AS size FROM boxes WHERE k % 4 <> 1 AND h > 20""", "boxes").replace("by_", "drawn_by"))
def element_hooks(spark: SparkSession, d: str) -> DataFrame:
    """All hooks at once: before the frame boxes grow, custom elements are drawn by the hook, others by type, and after
    the frame low ones go. Every fourth element is disabled."""

    def draw(row: dict) -> dict | None:
        return {"by": "hook", "size": row["w"] * row["h"]} if row["k"] % 5 == 0 else None

    hooks = H.load_hooks({"before_frame": lambda df: df.withColumn("w", F.col("w") + 10), "draw_element": draw, "after_frame": lambda df: df.filter("h > 20")})
    rows = projection(spark, d, "boxes").filter("k % 4 <> 1").withColumns({"type": F.when(F.col("role") % 2 == 0, F.lit("text")).otherwise(F.lit("rect")), "role": F.col("role").cast("string")})
    metric = lambda by, size: F.create_map(F.lit("by"), F.lit(f'"{by}"'), F.lit("size"), size.cast("string"))
    drawn = H.draw_elements(rows, hooks, {"text": metric("text", F.col("w")), "rect": metric("rect", F.col("h"))}, [*KEYS, "k"])
    return drawn.select(*KEYS, "role", F.replace(F.col("metrics")["by"], F.lit('"'), F.lit("")).alias("drawn_by"), F.col("metrics")["size"].cast("long").alias("size"))


@query(W("SELECT template, variant, CAST(role AS VARCHAR) AS role FROM boxes WHERE k % 4 <> 1 AND k % 6 <> 0 AND role IN (0, 2, 3, 6) AND role % 3 <> 2", "boxes"))
def overlay_elements(spark: SparkSession, d: str) -> DataFrame:
    """Elements that an overlay draws: enabled, with a box, of the wanted types and roles."""
    rows = projection(spark, d, "boxes").select(*KEYS, F.col("role").cast("string").alias("role"), (F.col("k") % 4 != 1).alias("enabled"), F.when(F.col("k") % 6 != 0, F.array("x", "y", "w", "h")).alias("box"), F.when(F.col("role") % 3 == 2, F.lit("image")).otherwise(F.lit("text")).alias("type"))
    return O.overlay_elements(rows, {"text", "button"}, {"0", "2", "3", "6"}).select(*KEYS, "role")

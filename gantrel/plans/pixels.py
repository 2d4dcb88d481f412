"""Queries over pixels: every vector is an 8x8 gray image."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gantrel.functions import scalar as S
from gantrel.operators import pixels as P
from gantrel.operators import raster

from .registry import query

PX = """px AS (SELECT vec_id AS image, (i - 1) // 8 AS y, (i - 1) % 8 AS x, greatest(0, least(255, CAST(floor((CAST(e AS DOUBLE) + 1) * 128) AS BIGINT))) AS v
  FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings) t)"""
RGB = f"{PX}, rgb AS (SELECT image, y, x, v AS r, (v * 7 + x * 11) % 256 AS g, (v * 3 + y * 29) % 256 AS b, CASE WHEN (v + image) % 5 = 0 THEN 0 WHEN image % 3 = 0 THEN 255 ELSE 200 + v % 56 END AS a FROM px)"


def gray(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("i", "e"))
    v = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("e").cast("double") + 1) * 128)))
    return e.select("image", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).cast("long").alias("x"), v.cast("long").alias("v"))


def rgb(spark: SparkSession, d: str) -> DataFrame:
    v, x, y, i = (F.col(c) for c in ("v", "x", "y", "image"))
    a = F.when((v + i) % 5 == 0, F.lit(0)).when(i % 3 == 0, F.lit(255)).otherwise(200 + v % 56)
    return gray(spark, d).select("image", "y", "x", v.alias("r"), ((v * 7 + x * 11) % 256).alias("g"), ((v * 3 + y * 29) % 256).alias("b"), a.cast("long").alias("a"))


def _sql(body: str, base: str = PX) -> str:
    return f"WITH {base}, {body.strip()[5:]}" if body.strip()[:5] == "WITH " else f"WITH {base} {body}"


@query(_sql("SELECT a.image, CAST(sum(abs(a.v - b.v)) AS BIGINT) AS total, max(abs(a.v - b.v)) AS most FROM px a JOIN px b ON b.image = a.image + 1 AND a.y = b.y AND a.x = b.x GROUP BY a.image"))
def pixel_absdiff(spark: SparkSession, d: str) -> DataFrame:
    """Difference of every image to the next one."""
    p = gray(spark, d)
    other = p.select((F.col("image") - 1).alias("image"), "y", "x", F.col("v").alias("u"))
    return p.join(other, ["image", "y", "x"]).groupBy("image").agg(F.sum(F.abs(F.col("v") - F.col("u"))).alias("total"), F.max(F.abs(F.col("v") - F.col("u"))).alias("most"))


@query(_sql("""SELECT image, count(*) FILTER (WHERE a AND b) AS both, count(*) AS either FROM (SELECT a.image, a.v > 128 AS a, coalesce(b.v > 128, false) AS b FROM px a LEFT JOIN px b ON b.image = a.image + 1 AND a.y = b.y AND a.x = b.x
UNION ALL SELECT b.image - 1, false, true FROM px b WHERE b.v > 128 AND NOT EXISTS (SELECT 1 FROM px a WHERE a.image = b.image - 1 AND a.y = b.y AND a.x = b.x)) t WHERE a OR b GROUP BY image"""))
def shape_iou(spark: SparkSession, d: str) -> DataFrame:
    on = gray(spark, d).filter("v > 128")
    return P.iou(on, on.withColumn("image", F.col("image") - 1), ["image"])


@query(_sql("SELECT image, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS n FROM px WHERE v > 150 GROUP BY image"))
def mask_bbox(spark: SparkSession, d: str) -> DataFrame:
    return P.bbox(gray(spark, d), ["image"], F.col("v") > 150)


@query(_sql("SELECT image, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS n FROM rgb WHERE a > 0 GROUP BY image", RGB))
def alpha_box(spark: SparkSession, d: str) -> DataFrame:
    return P.bbox(rgb(spark, d), ["image"], F.col("a") > 0)


@query(_sql("SELECT image, min(a) < 255 AS transparent FROM rgb GROUP BY image", RGB))
def has_transparency(spark: SparkSession, d: str) -> DataFrame:
    return rgb(spark, d).groupBy("image").agg((F.min("a") < 255).alias("transparent"))


@query(_sql("SELECT image, y, x FROM rgb WHERE (r-120)*(r-120)+(g-100)*(g-100)+(b-90)*(b-90) <= 2500 OR (r-140)*(r-140)+(g-30)*(g-30)+(b-200)*(b-200) <= 2500", RGB))
def color_mask(spark: SparkSession, d: str) -> DataFrame:
    """Pixels within 50 of either color; squares of integers stay exact."""
    near = lambda c: sum((F.col(n) - v) * (F.col(n) - v) for n, v in zip("rgb", c)) <= 2500
    return rgb(spark, d).filter(near((120, 100, 90)) | near((140, 30, 200))).select("image", "y", "x")


@query(_sql("SELECT image, printf('#%02X%02X%02X', CAST(trunc(quantile_cont(r, 0.5)) AS INTEGER), CAST(trunc(quantile_cont(g, 0.5)) AS INTEGER), CAST(trunc(quantile_cont(b, 0.5)) AS INTEGER)) AS color FROM rgb WHERE a > 0 GROUP BY image", RGB))
def median_color(spark: SparkSession, d: str) -> DataFrame:
    g = rgb(spark, d).filter("a > 0").groupBy("image").agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in "rgb"])
    return g.select("image", S.hex_color(F.col("r"), F.col("g"), F.col("b")).alias("color"))


@query(_sql("SELECT image, count(*) AS n FROM rgb WHERE r BETWEEN 90 AND 170 AND g <= 200 AND 2126*r + 7152*g + 722*b BETWEEN 600000 AND 1800000 AND greatest(r, g, b) - least(r, g, b) >= 40 GROUP BY image", RGB))
def material_filter(spark: SparkSession, d: str) -> DataFrame:
    """Pixels in channel, luma and chroma ranges; luma in ten-thousandths."""
    luma = 2126 * F.col("r") + 7152 * F.col("g") + 722 * F.col("b")
    chroma = F.greatest("r", "g", "b") - F.least("r", "g", "b")
    return rgb(spark, d).filter(F.col("r").between(90, 170) & (F.col("g") <= 200) & luma.between(600_000, 1_800_000) & (chroma >= 40)).groupBy("image").agg(F.count("*").alias("n"))


@query(_sql("""WITH bins AS (SELECT CAST(range AS BIGINT) AS bin FROM range(3)), imgs AS (SELECT DISTINCT image FROM px)
SELECT i.image, bin, count(v) AS n, CAST(round_even(quantile_cont(v, 0.25), 0) AS BIGINT) AS p25, CAST(round_even(quantile_cont(v, 0.5), 0) AS BIGINT) AS p50, CAST(round_even(quantile_cont(v, 0.75), 0) AS BIGINT) AS p75
FROM imgs i CROSS JOIN bins LEFT JOIN px p ON p.image = i.image AND p.v > 120 AND p.x >= round_even(bin * 8 / 3, 0) AND p.x < round_even((bin + 1) * 8 / 3, 0) GROUP BY i.image, bin"""))
def material_profile(spark: SparkSession, d: str) -> DataFrame:
    """Quartiles in three bins along x; empty bins stay, with no quartiles."""
    p = gray(spark, d)
    edges = [round(i * 8 / 3) for i in range(4)]
    of = F.when(F.col("x") < edges[1], 0).when(F.col("x") < edges[2], 1).otherwise(2).cast("long")
    bins = p.select("image").distinct().withColumn("bin", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])))
    found = p.filter("v > 120").withColumn("bin", of).groupBy("image", "bin").agg(F.count("*").alias("n"), F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    out = bins.join(found, ["image", "bin"], "left")
    return out.select("image", "bin", F.coalesce("n", F.lit(0)).alias("n"), *[F.bround(F.col("q")[i]).cast("long").alias(f"p{p}") for i, p in enumerate((25, 50, 75))])


@query(_sql("""WITH hist AS (SELECT image, v, count(*) AS c FROM px GROUP BY image, v), cum AS (SELECT image, v, CAST(sum(c) OVER (PARTITION BY image ORDER BY v) AS BIGINT) AS w0, CAST(sum(c * v) OVER (PARTITION BY image ORDER BY v) AS BIGINT) AS s0, CAST(sum(c) OVER (PARTITION BY image) AS BIGINT) AS n, CAST(sum(c * v) OVER (PARTITION BY image) AS BIGINT) AS s FROM hist),
sc AS (SELECT image, v, (CAST(s0 AS DOUBLE) * n - CAST(s AS DOUBLE) * w0) * (CAST(s0 AS DOUBLE) * n - CAST(s AS DOUBLE) * w0) / (CAST(w0 AS DOUBLE) * (n - w0)) AS score FROM cum WHERE w0 < n)
SELECT image, v AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, v) AS k FROM sc) t WHERE k = 1"""))
def otsu_threshold(spark: SparkSession, d: str) -> DataFrame:
    return P.otsu(gray(spark, d), ["image"], "v")


@query(_sql("""WITH act AS (SELECT DISTINCT image, y FROM px WHERE v > 165), f AS (SELECT image, y, CASE WHEN y - lag(y) OVER (PARTITION BY image ORDER BY y) > 2 THEN 1 ELSE 0 END AS new FROM act), r AS (SELECT image, y, sum(new) OVER (PARTITION BY image ORDER BY y) AS run FROM f)
SELECT image, CAST(run AS BIGINT) AS run, min(y) AS start, max(y) + 1 AS "end" FROM r GROUP BY image, run"""))
def line_islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of rows that hold ink, gaps of one bridged."""
    rows = gray(spark, d).filter("v > 165").select("image", "y").distinct()
    return P.islands(rows, ["image"], "y", 1)


_DIL = "(SELECT max(q.m) FROM m q WHERE q.image = p.image AND abs(q.x - p.x) <= 2 AND abs(q.y - p.y) <= 1)"
_M = "m AS (SELECT image, y, x, CASE WHEN v > 165 THEN 1 ELSE 0 END AS m FROM px)"


@query(_sql(f"WITH {_M} SELECT p.image, p.y, p.x, CAST(max(q.m) AS BIGINT) AS m FROM m p JOIN m q ON q.image = p.image AND abs(q.x - p.x) <= 2 AND abs(q.y - p.y) <= 1 GROUP BY 1, 2, 3"))
def morph_dilate(spark: SparkSession, d: str) -> DataFrame:
    return raster.morphology(_mask(spark, d), "image", "m", [("dilate", 5, 3)])


def _mask(spark: SparkSession, d: str) -> DataFrame:
    return gray(spark, d).select("image", "y", "x", (F.col("v") > 165).cast("int").alias("m"))


_CLOSED = f"{_M}, dil AS (SELECT p.image, p.y, p.x, max(q.m) AS m FROM m p JOIN m q ON q.image = p.image AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY 1, 2, 3), clo AS (SELECT p.image, p.y, p.x, min(q.m) AS m FROM dil p JOIN dil q ON q.image = p.image AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY 1, 2, 3)"


@query(_sql(f"WITH {_CLOSED} SELECT image, y, x, CAST(m AS BIGINT) AS m FROM clo"))
def morph_close(spark: SparkSession, d: str) -> DataFrame:
    return raster.morphology(_mask(spark, d), "image", "m", [("dilate", 3, 3), ("erode", 3, 3)])


_COMP = f"""{_M.replace('m AS', 'on_ AS').replace('FROM px)', 'FROM px WHERE v > 165)')}, reach AS (SELECT image, y AS sy, x AS sx, y, x FROM on_ UNION SELECT r.image, r.sy, r.sx, o.y, o.x FROM reach r JOIN on_ o ON o.image = r.image AND abs(o.y - r.y) <= 1 AND abs(o.x - r.x) <= 1),
root AS (SELECT image, y, x, min(sy * 8 + sx) AS root FROM reach GROUP BY image, y, x), comp AS (SELECT image, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area FROM root GROUP BY image, root)"""


@query(f"WITH RECURSIVE {PX}, {_COMP} SELECT * FROM comp")
def components(spark: SparkSession, d: str) -> DataFrame:
    """8-connected components of the bright pixels."""
    return raster.components(_mask(spark, d), "image", "m")


@query(f"WITH RECURSIVE {PX}, {_COMP} SELECT * FROM comp WHERE area >= 2")
def component_filter(spark: SparkSession, d: str) -> DataFrame:
    return raster.components(_mask(spark, d), "image", "m", 2)


@query(_sql("""WITH o(dy, dx) AS (SELECT * FROM range(-4, 5) a(dy) CROSS JOIN range(-4, 5) b(dx)), win AS (SELECT p.image, p.y, p.x, p.v, q.v AS u FROM px p CROSS JOIN o JOIN px q ON q.image = p.image AND q.y = greatest(0, least(7, p.y + dy)) AND q.x = greatest(0, least(7, p.x + dx)))
SELECT image, y, x, CAST(quantile_disc(u, 0.5) AS BIGINT) AS background, abs(any_value(v) - CAST(quantile_disc(u, 0.5) AS BIGINT)) AS contrast FROM win GROUP BY image, y, x"""))
def median_background(spark: SparkSession, d: str) -> DataFrame:
    """Median of each pixel's surroundings, edges repeated, and how far the pixel differs from it."""
    return raster.median_background(gray(spark, d), "image", "v").select("image", "y", "x", "background", "contrast")


@query(_sql("""WITH ext AS (SELECT image, y, x, v FROM px WHERE y < 3 AND x < 4), whole AS (SELECT image, y, x, CASE WHEN v > 100 THEN v ELSE 0 END AS m FROM px)
SELECT w.image, w.y, w.x, w.m AS canvas, coalesce(e.v, 0) AS region FROM whole w LEFT JOIN ext e ON e.image = w.image + 1 AND w.y = e.y + 2 AND w.x = e.x + 3 WHERE w.m > 0 OR e.v > 0"""))
def external_mask(spark: SparkSession, d: str) -> DataFrame:
    """Masks read as images: one as large as the canvas, and one as large as a region of 4x3 at (3, 2), moved there."""
    p = gray(spark, d)
    whole = p.select("image", "y", "x", F.when(F.col("v") > 100, F.col("v")).otherwise(0).alias("v"))
    region = p.filter("y < 3 and x < 4").withColumn("image", F.col("image") - 1)
    return P.external_masks(whole, region, ["image"], (8, 8), (3, 2, 4, 3)).filter("canvas > 0 or region > 0").select("image", "y", "x", "canvas", "region")


_DISK = "m AS (SELECT image, y, x, CASE WHEN v > 150 THEN 255 ELSE 0 END AS m FROM px)"


@query(_sql(f"""WITH {_DISK}, e AS (SELECT p.image, p.y, p.x, max(q.m) AS m FROM m p JOIN m q ON q.image = p.image AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY 1, 2, 3),
o AS (SELECT dy, dx, (2 - abs(dy)) * (2 - abs(dx)) AS wt FROM range(-1, 2) a(dy) CROSS JOIN range(-1, 2) b(dx))
SELECT p.image, p.y, p.x, any_value(p.m) AS expanded, CAST(round_even(sum(q.m * wt) / 16, 0) AS BIGINT) AS feathered FROM e p CROSS JOIN o JOIN e q ON q.image = p.image AND q.y = greatest(0, least(7, p.y + dy)) AND q.x = greatest(0, least(7, p.x + dx)) GROUP BY 1, 2, 3"""))
def mask_feather(spark: SparkSession, d: str) -> DataFrame:
    """A mask grown by one pixel all around, then smoothed by the 3x3 binomial kernel, edges repeated."""
    m = gray(spark, d).select("image", "y", "x", F.when(F.col("v") > 150, 255).otherwise(0).cast("long").alias("m"))
    return raster.expand_and_feather(m, "image", "m", 1, 1).select("image", "y", "x", "expanded", "feathered")


@query(_sql("""WITH poly(x0, y0, x1, y1) AS (VALUES (1.0, 0.5, 6.5, 2.0), (6.5, 2.0, 5.0, 7.0), (5.0, 7.0, 3.0, 4.0), (3.0, 4.0, 0.5, 6.5), (0.5, 6.5, 1.0, 0.5)), grid AS (SELECT y, x FROM range(8) a(y) CROSS JOIN range(8) b(x)),
ins AS (SELECT y, x, count(*) FILTER (WHERE (y0 > y + 0.5) <> (y1 > y + 0.5) AND x + 0.5 < (x1 - x0) * (y + 0.5 - y0) / (y1 - y0) + x0) % 2 = 1 AS inside FROM grid CROSS JOIN poly GROUP BY y, x)
SELECT px.image, CAST(sum(CASE WHEN inside THEN v ELSE 0 END) AS BIGINT) AS total, count(*) FILTER (WHERE inside) AS n FROM px JOIN ins ON ins.y = px.y AND ins.x = px.x GROUP BY px.image"""))
def polygon_mask(spark: SparkSession, d: str) -> DataFrame:
    """Pixels whose center lies in a concave polygon, by the even-odd rule."""
    inside = P.in_polygon(F.col("x") + 0.5, F.col("y") + 0.5, [(1.0, 0.5), (6.5, 2.0), (5.0, 7.0), (3.0, 4.0), (0.5, 6.5)])
    return gray(spark, d).groupBy("image").agg(F.sum(F.when(inside, F.col("v")).otherwise(0)).cast("long").alias("total"), F.count_if(inside).alias("n"))


@query("""WITH q AS (SELECT s_suppkey AS k, [[0.0, 0.0], [8.0, 0.0], [8.0, 8.0], [0.0, 8.0]] AS src, [[s_suppkey % 5, s_suppkey % 3], [90 + s_suppkey % 7, 2 + s_suppkey % 4], [80 + s_suppkey % 9, 70 + s_suppkey % 6], [3 + s_suppkey % 8, 60 + s_suppkey % 5]] AS dst FROM supplier)
SELECT k, i - 1 AS corner, CAST(dst[i][1] AS BIGINT) * 1000 AS x, CAST(dst[i][2] AS BIGINT) * 1000 AS y FROM q CROSS JOIN range(1, 5) r(i)""")
def homography_solve(spark: SparkSession, d: str) -> DataFrame:
    """The matrix that takes the full quad to four corners, solved for each row and applied to the quad: thousandths of the
    corners again."""
    k = F.col("s_suppkey")
    corners = F.array(*[F.array(x.cast("double"), y.cast("double")) for x, y in ((k % 5, k % 3), (90 + k % 7, 2 + k % 4), (80 + k % 9, 70 + k % 6), (3 + k % 8, 60 + k % 5))])
    rows = spark.read.parquet(f"{d}/supplier.parquet").select(k.alias("k"), raster.quad_matrix(F.lit(8.0), F.lit(8.0), corners).alias("m"))
    quad = F.posexplode(F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0))])).alias("corner", "p")
    m, x, y = (lambda i: F.col("m")[i]), F.col("p")[0], F.col("p")[1]
    at = rows.select("k", "m", quad).withColumn("d", m(6) * x + m(7) * y + m(8))
    return at.select("k", F.col("corner").cast("long").alias("corner"), F.round(1000 * (m(0) * x + m(1) * y + m(2)) / F.col("d")).cast("long").alias("x"), F.round(1000 * (m(3) * x + m(4) * y + m(5)) / F.col("d")).cast("long").alias("y"))


@query(_sql("""WITH g AS (SELECT y, x, CAST(floor((2 * x + y + 3) * 1.0 / (1 + x / 16.0)) AS BIGINT) AS sx, CAST(floor((x + 3 * y) * 1.0 / (1 + x / 16.0)) AS BIGINT) AS sy FROM range(8) a(y) CROSS JOIN range(8) b(x)), im AS (SELECT DISTINCT image FROM px)
SELECT im.image, g.y, g.x, coalesce(p.v, 0) AS v FROM im CROSS JOIN g LEFT JOIN px p ON p.image = im.image AND p.y = g.sy AND p.x = g.sx"""))
def inverse_warp(spark: SparkSession, d: str) -> DataFrame:
    """Every target pixel from the source pixel that the inverse matrix names, 0 outside the source."""
    matrix = [[2.0, 1.0, 3.0], [1.0, 3.0, 0.0], [1 / 16.0, 0.0, 1.0]]
    return raster.inverse_warp(gray(spark, d), "image", "v", matrix, (8, 8)).select("image", "y", "x", "v")


@query(_sql("""WITH s AS (SELECT image, y // 2 AS y, x // 2 AS x, sum(v) AS t FROM px GROUP BY 1, 2, 3) SELECT image, y, x, CAST(round_even(t / 4, 0) AS BIGINT) AS v FROM s"""))
def area_downsample(spark: SparkSession, d: str) -> DataFrame:
    """Supersampled pixels averaged by blocks of 2x2."""
    blocks = gray(spark, d).groupBy("image", F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")).agg(F.sum("v").alias("t"))
    return blocks.select("image", "y", "x", F.bround(F.col("t") / 4).cast("long").alias("v"))


_INSIDE = "(x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5)"
_AFTER = f"(CASE WHEN {_INSIDE} THEN (v * 3 + image) % 256 ELSE v END)"


def _inside() -> F.Column:
    return F.col("x").between(2, 5) & F.col("y").between(2, 5)


def _after() -> F.Column:
    return F.when(_inside(), (F.col("v") * 3 + F.col("image")) % 256).otherwise(F.col("v"))


@query(_sql(f"SELECT image, count(*) FILTER (WHERE {_INSIDE}) AS mask_pixels, count(*) FILTER (WHERE {_INSIDE} AND {_AFTER} <> v) AS changed_inside, count(*) FILTER (WHERE NOT {_INSIDE} AND {_AFTER} <> v) AS changed_outside, CAST(sum(CASE WHEN {_INSIDE} THEN abs({_AFTER} - v) ELSE 0 END) AS BIGINT) AS error_sum FROM px GROUP BY image"))
def erase_audit(spark: SparkSession, d: str) -> DataFrame:
    """Pixels changed inside and outside a mask, and the summed error inside."""
    changed = _after() != F.col("v")
    return gray(spark, d).groupBy("image").agg(
        F.count_if(_inside()).alias("mask_pixels"), F.count_if(_inside() & changed).alias("changed_inside"), F.count_if(~_inside() & changed).alias("changed_outside"),
        F.sum(F.when(_inside(), F.abs(_after() - F.col("v"))).otherwise(0)).alias("error_sum"),
    )


@query(_sql(f"SELECT image, y, x, CASE WHEN {_INSIDE} THEN 17 ELSE v END AS v FROM px"))
def erase_solid(spark: SparkSession, d: str) -> DataFrame:
    return gray(spark, d).select("image", "y", "x", F.when(_inside(), F.lit(17)).otherwise(F.col("v")).cast("long").alias("v"))


@query(_sql("""WITH poly(x0, y0, x1, y1) AS (VALUES (1.0, 1.0, 6.0, 2.0), (6.0, 2.0, 4.0, 7.0), (4.0, 7.0, 1.0, 1.0))
SELECT image, y, x FROM (SELECT image, y, x, count(*) FILTER (WHERE (y0 > y) <> (y1 > y) AND x < (x1 - x0) * (y - y0) / (y1 - y0) + x0) AS n FROM px CROSS JOIN poly GROUP BY image, y, x) t WHERE n % 2 = 1 OR (x <= 1 AND y >= 6)"""))
def region_mask(spark: SparkSession, d: str) -> DataFrame:
    """Pixels in a triangle or a box."""
    inside = P.in_polygon(F.col("x"), F.col("y"), [(1.0, 1.0), (6.0, 2.0), (4.0, 7.0)])
    return gray(spark, d).filter(inside | ((F.col("x") <= 1) & (F.col("y") >= 6))).select("image", "y", "x")


@query(_sql("SELECT image, y, x, greatest(CASE WHEN v > 140 THEN 255 ELSE 0 END, CASE WHEN x + y > 9 THEN 128 ELSE 0 END) AS m FROM px"))
def mask_union(spark: SparkSession, d: str) -> DataFrame:
    """Union of masks as rows, merged by their maximum."""
    p = gray(spark, d)
    a = p.select("image", "y", "x", F.when(F.col("v") > 140, 255).otherwise(0).alias("m"))
    b = p.filter("x + y > 9").select("image", "y", "x", F.lit(128).alias("m"))
    return a.unionByName(b).groupBy("image", "y", "x").agg(F.max("m").alias("m"))


@query(_sql("SELECT image, y, x, CAST(round_even(v * (255 - greatest(CASE WHEN x > 4 THEN 200 ELSE 0 END, CASE WHEN y > 4 THEN 90 ELSE 0 END)) / 255.0, 0) AS BIGINT) AS kept FROM px"))
def mask_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Keep mask times what no occluder covers."""
    cover = F.greatest(F.when(F.col("x") > 4, 200).otherwise(0), F.when(F.col("y") > 4, 90).otherwise(0))
    return gray(spark, d).select("image", "y", "x", F.bround(F.col("v") * (255 - cover) / 255.0).cast("long").alias("kept"))


@query(_sql("SELECT image, y, x, CAST(round_even(r * a / 255.0, 0) AS BIGINT) AS pr, CASE WHEN a = 0 THEN 0 ELSE CAST(round_even(round_even(r * a / 255.0, 0) * 255.0 / a, 0) AS BIGINT) END AS ur FROM rgb", RGB))
def premultiply(spark: SparkSession, d: str) -> DataFrame:
    """Premultiplied red and back; invisible pixels come back as 0."""
    pr = F.bround(F.col("r") * F.col("a") / 255.0)
    return rgb(spark, d).select("image", "y", "x", pr.cast("long").alias("pr"), F.when(F.col("a") == 0, F.lit(0)).otherwise(F.bround(F.try_divide(pr * 255.0, F.col("a")))).cast("long").alias("ur"))


@query(_sql("""WITH hor AS (SELECT image, y, x, v, coalesce(lag(v) OVER r, v) + 2 * v + coalesce(lead(v) OVER r, v) AS s FROM px WINDOW r AS (PARTITION BY image, y ORDER BY x)),
ver AS (SELECT image, y, x, v, coalesce(lag(s) OVER c, s) + 2 * s + coalesce(lead(s) OVER c, s) AS s FROM hor WINDOW c AS (PARTITION BY image, x ORDER BY y)) SELECT image, CAST(sum(abs(16 * v - s)) AS BIGINT) AS seam FROM ver WHERE x IN (2, 5) OR y IN (2, 5) GROUP BY image"""))
def boundary_score(spark: SparkSession, d: str) -> DataFrame:
    """Summed difference, in sixteenths, of the pixels on a border to their 3x3 smoothing; edges are repeated."""
    p = gray(spark, d)
    across, down = Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")
    smooth = lambda c, w: F.coalesce(F.lag(c).over(w), F.col(c)) + 2 * F.col(c) + F.coalesce(F.lead(c).over(w), F.col(c))
    s = p.withColumn("s", smooth("v", across)).withColumn("s", smooth("s", down))
    return s.filter("x in (2, 5) or y in (2, 5)").groupBy("image").agg(F.sum(F.abs(16 * F.col("v") - F.col("s"))).alias("seam"))


@query(_sql("WITH m AS (SELECT image, method, ord, CAST(sum(abs(v - CASE method WHEN 'telea' THEN 120 WHEN 'ns' THEN 128 ELSE 136 END)) AS BIGINT) AS score FROM px CROSS JOIN (VALUES ('telea', 0), ('ns', 1), ('polynomial', 2)) t(method, ord) GROUP BY 1, 2, 3) SELECT image, method, score FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score, ord) AS n FROM m) u WHERE n = 1"))
def select_method(spark: SparkSession, d: str) -> DataFrame:
    """The candidate with the lowest score; ties in the order of the candidates."""
    scores = gray(spark, d).groupBy("image").agg(*[F.sum(F.abs(F.col("v") - level)).alias(name) for name, level in (("telea", 120), ("ns", 128), ("polynomial", 136))])
    ranked = F.array_min(F.array(*[F.struct(F.col(n).alias("score"), F.lit(i).alias("i"), F.lit(n).alias("method")) for i, n in enumerate(("telea", "ns", "polynomial"))]))
    return scores.select("image", ranked.alias("r")).select("image", "r.method", "r.score")


@query(_sql("""WITH on_ AS (SELECT * FROM px WHERE v > 120), off_ AS (SELECT * FROM px WHERE v <= 120), dist AS (SELECT a.image, a.y, a.x, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d2 FROM on_ a JOIN off_ b ON b.image = a.image GROUP BY 1, 2, 3)
SELECT image, CAST(round_even(10 * quantile_cont(d2, 0.9), 0) AS BIGINT) AS p90 FROM dist GROUP BY image"""))
def stroke_width(spark: SparkSession, d: str) -> DataFrame:
    """90th percentile of the squared distance of ink to the nearest other pixel, in tenths."""
    near = raster.on_grids(gray(spark, d), "image", "v", ("d2",), lambda grid: (raster.distance_squared(grid > 120),))
    return near.filter("d2 > 0").groupBy("image").agg(F.bround(10 * F.percentile("d2", F.lit(0.9))).cast("long").alias("p90"))


@query()
def poly_fit(spark: SparkSession, d: str) -> DataFrame:
    """Quadratic fit of the ring outside a mask and its prediction at the center: Spark sums the normal equations of
    every image, so no image is collected; only 27 sums are solved for each."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    terms = [F.lit(1.0), x, y, x * x, x * y, y * y]
    ring = gray(spark, d).filter(~_inside())
    sums = ring.groupBy("image").agg(F.array(*[F.sum(a * b) for i, a in enumerate(terms) for b in terms[i:]]).alias("m"), F.array(*[F.sum(t * F.col("v")) for t in terms]).alias("r"))

    def solve(m: pd.Series, r: pd.Series) -> pd.Series:
        out = []
        for tri, right in zip(m, r):
            full = np.zeros((6, 6))
            full[np.triu_indices(6)] = tri
            w = raster.quadratic_fit(full + np.triu(full, 1).T, right)
            out.append(round(float(np.dot(w, [1, 3.5, 3.5, 12.25, 12.25, 12.25])), 4))
        return pd.Series(out)

    return sums.select("image", F.pandas_udf(solve, "double")("m", "r").alias("center"))


@query()
def kmeans_lines(spark: SparkSession, d: str) -> DataFrame:
    """Two line centers over the rows' ink, exact in one dimension, from one row of counts an image."""
    ink = gray(spark, d).filter("v > 140").groupBy("image", "y").agg(F.count("*").alias("n")).groupBy("image").agg(F.array_sort(F.collect_list(F.struct("y", "n"))).alias("rows"))

    def centers(ys: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([[round(float(c), 4) for c in raster.kmeans_rows(np.array(y), np.array(n), 2)] for y, n in zip(ys, ns)])

    return ink.select("image", F.pandas_udf(centers, "array<double>")("rows.y", "rows.n").alias("centers"))


@query(_sql("""WITH cand AS (SELECT image, font, size, w0, h0, cnt, 1 + image % 7 + font AS w1, 1 + (image * size) % 9 AS h1 FROM (SELECT image, max(x) - min(x) + 1 AS w0, max(y) - min(y) + 1 AS h0, count(*) AS cnt FROM px WHERE v > 150 GROUP BY image) t CROSS JOIN range(3) f(font) CROSS JOIN range(10, 15) s(size)),
scored AS (SELECT image, font, size, round(abs(ln(w1 / w0)) + abs(ln(h1 / h0)) + 1 - cnt / 64, 6) AS score FROM cand)
SELECT image, font, size, CAST(row_number() OVER (PARTITION BY image ORDER BY score, font, size) AS BIGINT) AS place FROM scored QUALIFY place <= 5"""))
def font_match(spark: SparkSession, d: str) -> DataFrame:
    """Five best of font and size candidates by shape score, ties in candidate order."""
    shape = P.bbox(gray(spark, d), ["image"], F.col("v") > 150)
    numbers = lambda a, b: F.explode(F.sequence(F.lit(a).cast("long"), F.lit(b).cast("long")))
    cand = shape.withColumn("font", numbers(0, 2)).withColumn("size", numbers(10, 14))
    w1, h1 = 1 + F.col("image") % 7 + F.col("font"), 1 + (F.col("image") * F.col("size")) % 9
    score = F.round(F.abs(F.log(w1 / F.col("w"))) + F.abs(F.log(h1 / F.col("h"))) + 1 - F.col("n") / 64, 6)
    place = F.row_number().over(Window.partitionBy("image").orderBy("score", "font", "size"))
    return cand.withColumn("score", score).withColumn("place", place.cast("long")).filter("place <= 5").select("image", "font", "size", "place")

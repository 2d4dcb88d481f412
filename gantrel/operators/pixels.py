"""Pixel relations in long form (image, y, x, values): differences, masks, morphology, boxes, histograms, shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bbox(mask: DataFrame, keys: Sequence[str], on: Column) -> DataFrame:
    """x, y, w, h and count of the pixels that are on; nothing for an empty mask."""
    g = mask.filter(on).groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), F.count("*").alias("n"))
    return g


def islands(rows: DataFrame, keys: Sequence[str], at: str, max_gap: int) -> DataFrame:
    """Runs of active positions: a run ends where more than ``max_gap`` positions are missing; its end is exclusive."""
    w = Window.partitionBy(*keys).orderBy(at)
    opened = rows.withColumn("__new", (F.col(at) - F.lag(at, 1).over(w) > max_gap + 1).cast("int"))
    numbered = opened.withColumn("run", F.sum(F.coalesce("__new", F.lit(0))).over(w))
    return numbered.groupBy(*keys, "run").agg(F.min(at).alias("start"), (F.max(at) + 1).alias("end"))


def otsu(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The threshold of largest between-class variance over each image's histogram, the lowest of equal ones. Only the
    histogram, at most 256 rows an image, is windowed."""
    hist = df.groupBy(*keys, value).agg(F.count("*").alias("c"))
    up, whole = Window.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys)
    cum = hist.select(*keys, value, F.sum("c").over(up).alias("w0"), F.sum(F.col("c") * F.col(value)).over(up).alias("s0"), F.sum("c").over(whole).alias("n"), F.sum(F.col("c") * F.col(value)).over(whole).alias("s"))
    spread = F.col("s0").cast("double") * F.col("n") - F.col("s").cast("double") * F.col("w0")
    score = spread * spread / (F.col("w0").cast("double") * (F.col("n") - F.col("w0")))
    return cum.filter("w0 < n").groupBy(*keys).agg(F.max_by(value, F.struct(score, -F.col(value))).alias("threshold"))


def iou(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """both and either counts of two masks given as rows of their pixels."""
    met = a.select(*keys, "y", "x", F.lit(1).alias("a")).join(b.select(*keys, "y", "x", F.lit(1).alias("b")), [*keys, "y", "x"], "full_outer")
    return met.groupBy(*keys).agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count("*").alias("either"))


def in_polygon(x: Column, y: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Even-odd rule at pixel corners."""
    inside = F.lit(False)
    for (x0, y0), (x1, y1) in zip(points, [*points[1:], points[0]]):
        crosses = (F.lit(y0) > y) != (F.lit(y1) > y)
        if y0 != y1:
            inside = F.when(crosses & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0), ~inside).otherwise(inside)
    return inside


def external_masks(canvas: DataFrame, region: DataFrame, keys: Sequence[str], size: tuple[int, int], box: tuple[int, int, int, int]) -> DataFrame:
    """(keys, y, x, canvas, region): a mask of the canvas's ``size`` beside one of the region's, whose pixels are moved to
    the region's ``box`` (x, y, w, h). A mask with a pixel outside its size raises."""
    left, top, w, h = box
    fits = lambda df, width, height: df.filter(F.when(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1), F.lit(True)).otherwise(F.raise_error(F.lit("mask of another size")).cast("boolean")))
    moved = fits(region, w, h).select(*keys, (F.col("y") + top).alias("y"), (F.col("x") + left).alias("x"), F.col("v").alias("region"))
    both = fits(canvas, *size).select(*keys, "y", "x", F.col("v").alias("canvas")).join(moved, [*keys, "y", "x"], "left")
    return both.withColumn("region", F.coalesce("region", F.lit(0)))

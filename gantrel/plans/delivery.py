"""Queries over byte budgets and encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gantrel.operators import search
from gantrel.sources.tables import projection, with_projections

from .registry import query

W = with_projections


@query(W("SELECT doc_id, n_chars, budget FROM ladder WHERE n_chars < budget", "ladder"))
def budget_check(spark: SparkSession, d: str) -> DataFrame:
    """Files already under their budget, strictly; these are copied as they are."""
    return projection(spark, d, "ladder").filter("n_chars < budget").select("doc_id", "n_chars", "budget")


@query(W("SELECT doc_id, CAST((SELECT max(q) FROM range(25, 96) r(q) WHERE n_chars * q // 95 < budget) AS BIGINT) AS quality FROM ladder", "ladder"))
def highest_quality(spark: SparkSession, d: str) -> DataFrame:
    """Highest quality whose size stays under budget."""
    best = search.highest_feasible(25, 95, lambda q: F.floor(F.col("n_chars") * q / 95) < F.col("budget"))
    return projection(spark, d, "ladder").select("doc_id", best.cast("long").alias("quality"))


@query(W("SELECT doc_id, CAST((SELECT max(c) FROM (VALUES (256), (224), (192), (160), (128), (96), (64), (48), (32), (2)) t(c) WHERE n_chars * (c + 20) // 256 < budget) AS BIGINT) AS colors FROM ladder", "ladder"))
def gif_color_budget(spark: SparkSession, d: str) -> DataFrame:
    """Most colors, from a ladder, whose size stays under budget."""
    best = search.first_fit([300, 256, 224, 192, 160, 128, 96, 64, 48, 32, 1], 2, 256, lambda c: F.floor(F.col("n_chars") * (c + 20) / 256) < F.col("budget"))
    return projection(spark, d, "ladder").select("doc_id", best.cast("long").alias("colors"))


@query(W("""SELECT doc_id, CASE WHEN n_chars < budget THEN 'copy' WHEN family = 0 AND n_chars * 7 // 10 < budget THEN 'png' WHEN family = 1 THEN 'jpeg' WHEN family = 2 THEN 'webp' WHEN family = 3 THEN 'gif' WHEN alpha = 1 THEN 'webp' ELSE 'jpeg' END AS codec FROM ladder""", "ladder"))
def codec_choice(spark: SparkSession, d: str) -> DataFrame:
    """Cheap options first: copy, lossless, then a lossy codec by suffix, or by alpha for what was lossless."""
    f, n, b = F.col("family"), F.col("n_chars"), F.col("budget")
    lossy = F.when(f == 1, F.lit("jpeg")).when(f == 2, F.lit("webp")).when(f == 3, F.lit("gif")).when(F.col("alpha") == 1, F.lit("webp")).otherwise(F.lit("jpeg"))
    return projection(spark, d, "ladder").select("doc_id", F.when(n < b, F.lit("copy")).when((f == 0) & (F.floor(n * 7 / 10) < b), F.lit("png")).otherwise(lossy).alias("codec"))

"""Queries over names, languages, paths and scalar geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gantrel.functions import scalar as S
from gantrel.sources.tables import projection, with_projections

from .registry import query

W = with_projections


@query("SELECT c_custkey, replace(lower(trim(c_mktsegment || '_' || c_name)), '_', '-') AS key, split_part(replace(lower(trim(c_mktsegment || '_' || c_name)), '_', '-'), '-', 1) AS base FROM customer")
def language_key(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/customer.parquet")
    key = S.language_key(F.concat_ws("_", "c_mktsegment", "c_name"))
    return rows.select("c_custkey", key.alias("key"), S.base_language(key).alias("base"))


_SAMPLES = [("latin", "abc"), ("hebrew", "aא"), ("arabic", "ش"), ("edge_low", "֐"), ("edge_high", "ࣿ"), ("above", "ऀ"), ("empty", "")]
_VALUES = "(VALUES " + ", ".join(f"('{n}', '{t}')" for n, t in _SAMPLES) + ") AS s(name, text)"
_LINES = f"(SELECT CAST(doc_id AS VARCHAR) AS name, text FROM documents UNION ALL SELECT name, text FROM {_VALUES})"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("name"), "text")
    return docs.unionByName(spark.createDataFrame(_SAMPLES, "name string, text string"))


@query(f"SELECT name, regexp_matches(text, '[֐-ࣿ]') AS rtl FROM {_LINES} t")
def is_rtl(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("name", S.is_rtl(F.col("text")).alias("rtl"))


_DIRECTION = "CASE length(name) % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'ltr' END"
_RESOLVED = f"CASE WHEN coalesce({_DIRECTION}, 'auto') = 'auto' THEN CASE WHEN regexp_matches(text, '[֐-ࣿ]') THEN 'rtl' ELSE 'ltr' END ELSE {_DIRECTION} END"


def _given_direction() -> F.Column:
    n = F.length("name") % 3
    return F.when(n == 0, F.lit("auto")).when(n == 1, F.lit("ltr"))


@query(f"SELECT name, {_RESOLVED} AS direction FROM {_LINES} t")
def resolved_direction(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("name", S.resolved_direction(_given_direction(), F.col("text")).alias("direction"))


@query(f"""WITH r AS (SELECT name, {_RESOLVED} AS direction, CASE length(name) % 2 WHEN 0 THEN 'left' ELSE 'force-left' END AS align, CASE WHEN length(text) % 7 = 0 THEN 'center' END AS physical FROM {_LINES} t)
SELECT name, coalesce(physical, CASE WHEN align = 'force-left' THEN 'left' WHEN direction = 'rtl' AND align = 'left' THEN 'right' ELSE align END) AS side FROM r""")
def physical_alignment(spark: SparkSession, d: str) -> DataFrame:
    direction = S.resolved_direction(_given_direction(), F.col("text"))
    align = F.when(F.length("name") % 2 == 0, F.lit("left")).otherwise(F.lit("force-left"))
    physical = F.when(F.length("text") % 7 == 0, F.lit("center"))
    return _texts(spark, d).select("name", S.physical_alignment(physical, align, direction).alias("side"))


@query(f"""SELECT name, CASE WHEN r THEN 'rtl' WHEN given = 'ltr' THEN 'ltr' END AS direction, CASE WHEN r OR given = 'ltr' THEN nullif(split_part(lang, '-', 1), 'default') END AS language
FROM (SELECT name, {_DIRECTION} AS given, regexp_matches(text, '[֐-ࣿ]') AS r, CASE length(name) % 2 WHEN 0 THEN 'ar-eg' ELSE 'default' END AS lang FROM {_LINES} t) u""")
def text_kwargs(spark: SparkSession, d: str) -> DataFrame:
    """Shaping arguments: only right-to-left or explicitly directed text has any."""
    lang = F.when(F.length("name") % 2 == 0, F.lit("ar-eg")).otherwise(F.lit("default"))
    shaped = S.is_rtl(F.col("text")) | (_given_direction() == "ltr")
    return _texts(spark, d).select("name", F.when(S.is_rtl(F.col("text")), F.lit("rtl")).when(_given_direction() == "ltr", F.lit("ltr")).alias("direction"), F.when(shaped, F.nullif(S.base_language(lang), F.lit("default"))).alias("language"))


_PATHS = "CASE n_nationkey % 3 WHEN 0 THEN '@skill/fonts/' || n_name WHEN 1 THEN '/abs/' || n_name ELSE '../' || n_name END"


@query(f"SELECT n_nationkey, CASE WHEN starts_with(p, '@skill/') THEN '/bundle/' || substr(p, 8) WHEN starts_with(p, '/') THEN p ELSE '/spec/' || p END AS resolved FROM (SELECT n_nationkey, {_PATHS} AS p FROM nation) t")
def resolve_path(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", S.resolve_path(F.expr(_PATHS), "/spec", "/bundle").alias("resolved"))


@query(f"SELECT n_nationkey, p AS path, NOT starts_with(p, '/') AND NOT list_contains(string_split(p, '/'), '..') AND p <> '' AS safe FROM (SELECT n_nationkey, {_PATHS} AS p FROM nation) t")
def safe_output(spark: SparkSession, d: str) -> DataFrame:
    p = F.expr(_PATHS)
    return spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", p.alias("path"), S.safe_output(p).alias("safe"))


@query(W("SELECT k, coalesce(nullif(ident, ''), nullif(language, ''), 'default') AS variant FROM variants", "variants"))
def variant_identifier(spark: SparkSession, d: str) -> DataFrame:
    return projection(spark, d, "variants").select("k", S.variant_identifier(F.col("ident"), F.col("language")).alias("variant"))


@query(W("SELECT k, coalesce(nullif(ident, ''), nullif(language, ''), 'default') AS variant, language FROM variants WHERE replace(lower(trim(coalesce(nullif(ident, ''), nullif(language, ''), 'default'))), '_', '-') IN ('brazil', 'ch-in', 'default') OR replace(lower(trim(language)), '_', '-') IN ('brazil', 'ch-in', 'default')", "variants"))
def select_variants(spark: SparkSession, d: str) -> DataFrame:
    """Variants by identifier or language, both normalised."""
    wanted = ["brazil", "ch-in", "default"]
    variant = S.variant_identifier(F.col("ident"), F.col("language"))
    return projection(spark, d, "variants").filter(S.language_key(variant).isin(wanted) | S.language_key(F.col("language")).isin(wanted)).select("k", variant.alias("variant"), "language")


@query(W("SELECT template, variant, role, x AS left_, y AS top_, x + w AS right_, y + h AS bottom_ FROM boxes", "boxes"))
def xyxy(spark: SparkSession, d: str) -> DataFrame:
    return projection(spark, d, "boxes").select("template", "variant", "role", F.col("x").alias("left_"), F.col("y").alias("top_"), (F.col("x") + F.col("w")).alias("right_"), (F.col("y") + F.col("h")).alias("bottom_"))


_EDGE = "CASE role % 6 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'top' WHEN 3 THEN 'bottom' WHEN 4 THEN 'center_x' ELSE 'center_y' END"


@query(W(f"""SELECT template, variant, role, edge, CAST(2 * CASE edge WHEN 'left' THEN x WHEN 'right' THEN x + w WHEN 'top' THEN y WHEN 'bottom' THEN y + h WHEN 'center_x' THEN x + w / 2 ELSE y + h / 2 END AS BIGINT) AS doubled
FROM (SELECT *, {_EDGE} AS edge FROM boxes) b""", "boxes"))
def edge_value(spark: SparkSession, d: str) -> DataFrame:
    value = S.edge_value(F.col("edge"), F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return projection(spark, d, "boxes").withColumn("edge", F.expr(_EDGE)).select("template", "variant", "role", "edge", (value * 2).cast("long").alias("doubled"))


@query(W("SELECT k, greatest(0, x - 8) AS sx, greatest(0, y - 10) AS sy, least(960, x + w + 8) - greatest(0, x - 8) AS sw, least(540, y + h + 10) - greatest(0, y - 10) AS sh FROM boxes", "boxes"))
def safe_box(spark: SparkSession, d: str) -> DataFrame:
    cols = S.padded_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), (8, 10, 8, 10), 960, 540)
    return projection(spark, d, "boxes").select("k", *[c.cast("long").alias(n) for c, n in zip(cols, ("sx", "sy", "sw", "sh"))])


@query(W("SELECT k, CASE WHEN abs(x - (960 - x - w)) <= greatest(4.0, 57.6) THEN 'center' WHEN x < 960 - x - w THEN 'left' ELSE 'right' END AS side FROM boxes", "boxes"))
def infer_alignment(spark: SparkSession, d: str) -> DataFrame:
    return projection(spark, d, "boxes").select("k", S.infer_alignment(F.col("x"), F.col("w"), F.lit(960)).alias("side"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name || CASE p_partkey % 3 WHEN 0 THEN '-Bold' WHEN 1 THEN '-SemiBoldItalic' ELSE '-Regular' END), 'bold|black|heavy|semibold') THEN 'bold' ELSE 'regular' END AS weight FROM part")
def font_metadata(spark: SparkSession, d: str) -> DataFrame:
    ending = F.expr("CASE p_partkey % 3 WHEN 0 THEN '-Bold' WHEN 1 THEN '-SemiBoldItalic' ELSE '-Regular' END")
    path = F.concat(F.lit("fonts/"), F.col("p_name"), ending, F.lit(".ttf"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.when(S.is_bold(path), F.lit("bold")).otherwise(F.lit("regular")).alias("weight"))


@query(W("""SELECT k, CASE mode WHEN 'stretch' THEN 300 ELSE greatest(1, CAST(round_even(w * s, 0) AS BIGINT)) END AS fw, CASE mode WHEN 'stretch' THEN 200 ELSE greatest(1, CAST(round_even(h * s, 0) AS BIGINT)) END AS fh,
  CAST(round_even(greatest(0.0, least(1.0, (k % 13) / 10.0)) * 255, 0) AS BIGINT) AS alpha
FROM (SELECT *, CASE WHEN mode = 'cover' THEN greatest(300 / w, 200 / h) ELSE least(300 / w, 200 / h) END AS s FROM (SELECT *, CASE k % 3 WHEN 0 THEN 'contain' WHEN 1 THEN 'cover' ELSE 'stretch' END AS mode FROM boxes) a) b""", "boxes"))
def image_fit(spark: SparkSession, d: str) -> DataFrame:
    """Size of a fitted image and its opacity as an alpha value."""
    rows = projection(spark, d, "boxes").withColumn("mode", F.expr("CASE k % 3 WHEN 0 THEN 'contain' WHEN 1 THEN 'cover' ELSE 'stretch' END"))
    fw, fh, _, _ = S.fit_scale(F.col("mode"), F.col("w"), F.col("h"), F.lit(300), F.lit(200))
    return rows.select("k", fw.alias("fw"), fh.alias("fh"), F.bround(S.clamp((F.col("k") % 13) / F.lit(10.0), 0.0, 1.0) * 255).cast("long").alias("alpha"))


@query("SELECT vec_id, CAST(list_min(xs) AS BIGINT) AS x, CAST(list_min(ys) AS BIGINT) AS y, CAST(list_max(xs) - list_min(xs) AS BIGINT) AS w, CAST(list_max(ys) - list_min(ys) AS BIGINT) AS h FROM (SELECT vec_id, list_transform(list_slice(embedding, 1, 8), lambda e: floor((CAST(e AS DOUBLE) + 1) * 128)) AS xs, list_transform(list_slice(embedding, 9, 16), lambda e: floor((CAST(e AS DOUBLE) + 1) * 128)) AS ys FROM embeddings) t")
def points_bbox(spark: SparkSession, d: str) -> DataFrame:
    """Bounding box of a polygon's points."""
    to_px = lambda e: F.floor((e.cast("double") + 1) * 128)
    xs, ys = (F.transform(F.slice("embedding", s, 8), to_px) for s in (1, 9))
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", xs.alias("xs"), ys.alias("ys"))
    return rows.select("vec_id", F.array_min("xs").alias("x"), F.array_min("ys").alias("y"), (F.array_max("xs") - F.array_min("xs")).alias("w"), (F.array_max("ys") - F.array_min("ys")).alias("h"))


@query("""SELECT vec_id, CAST(list_extract(p, 1) AS BIGINT) AS px, CAST(list_extract(p, 2) AS BIGINT) AS py FROM (SELECT vec_id, [round_even((x * 2 + y * 0.5 + 10) / (1 + x * 0.25 + y * 0.125), 0), round_even((y * 3 - x * 0.5 + 20) / (1 + x * 0.25 + y * 0.125), 0)] AS p
FROM (SELECT vec_id, floor((CAST(embedding[1] AS DOUBLE) + 1) * 128) AS x, floor((CAST(embedding[2] AS DOUBLE) + 1) * 128) AS y FROM embeddings) t) u""")
def homography_apply(spark: SparkSession, d: str) -> DataFrame:
    """Points through a fixed 3x3 matrix."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", *[F.floor((F.col("embedding")[i].cast("double") + 1) * 128).alias(n) for i, n in enumerate("xy")])
    x, y = F.col("x"), F.col("y")
    depth = 1 + x * 0.25 + y * 0.125
    return rows.select("vec_id", F.bround((x * 2 + y * 0.5 + 10) / depth).cast("long").alias("px"), F.bround((y * 3 - x * 0.5 + 20) / depth).cast("long").alias("py"))

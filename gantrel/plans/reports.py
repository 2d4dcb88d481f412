"""Queries over reports and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gantrel.functions import scalar as S
from gantrel.operators import reports as O
from gantrel.sources.tables import projection, with_projections

from . import quality
from .registry import query

W = with_projections
KEYS = ["variant", "template"]


@query(W("""SELECT coalesce(u.variant, b.variant) AS variant, coalesce(u.template, b.template) AS template, coalesce(u.status, b.status) AS status,
CAST(CASE WHEN u.ord IS NOT NULL AND NOT (u.status = 'skipped' AND u.metric IS NULL) THEN u.metric ELSE b.metric END AS BIGINT) AS metric, b.ord IS NULL AS added, CAST(coalesce(b.ord, u.ord) AS BIGINT) AS at
FROM base_rows b FULL OUTER JOIN update_rows u ON b.variant = u.variant AND b.template = u.template""", "base_rows", "update_rows"))
def merge_reports(spark: SparkSession, d: str) -> DataFrame:
    out = O.merge_reports(projection(spark, d, "base_rows"), projection(spark, d, "update_rows"), KEYS)
    return out.select(*KEYS, "status", F.col("metric").cast("long").alias("metric"), "place.added", F.col("place.at").cast("long").alias("at"))


@query(W("""SELECT variant, template, 'missing' AS state FROM (SELECT variant, template FROM base_rows EXCEPT SELECT variant, template FROM update_rows) a
UNION ALL SELECT variant, template, 'unexpected' FROM (SELECT variant, template FROM update_rows EXCEPT SELECT variant, template FROM base_rows) b""", "base_rows", "update_rows"))
def report_coverage(spark: SparkSession, d: str) -> DataFrame:
    return O.coverage(projection(spark, d, "base_rows"), projection(spark, d, "update_rows"), KEYS)


@query(W("SELECT variant, template FROM base_rows INTERSECT SELECT variant, template FROM update_rows", "base_rows", "update_rows"))
def shared_keys(spark: SparkSession, d: str) -> DataFrame:
    return projection(spark, d, "base_rows").select(*KEYS).intersect(projection(spark, d, "update_rows").select(*KEYS))


@query("SELECT conv_id, arg_max(role, turn) AS role, CAST(arg_max(length(text), turn) AS BIGINT) AS chars FROM (SELECT conv_id, turn, max(role) AS role, max_by(text, role) AS text FROM conversations GROUP BY conv_id, turn) t GROUP BY conv_id")
def report_last_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/conversations.parquet").groupBy("conv_id", "turn").agg(F.max("role").alias("role"), F.max_by("text", "role").alias("text"))
    return O.last_wins(rows.select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars")), ["conv_id"], "turn").select("conv_id", "role", "chars")


@query(W("SELECT variant, template, CASE WHEN (variant + template) % 4 = 0 THEN 'rendered' ELSE 'skipped' END AS status FROM base_rows WHERE (variant + template) % 4 = 0 OR (variant, template) IN (SELECT variant, template FROM update_rows)", "base_rows", "update_rows"))
def render_status(spark: SparkSession, d: str) -> DataFrame:
    """Outputs in the listing are skipped unless forced; here, those that are neither are left out."""
    listing = projection(spark, d, "update_rows").select(*KEYS, F.lit(True).alias("present"))
    forced = (F.col("variant") + F.col("template")) % 4 == 0
    rows = projection(spark, d, "base_rows").select(*KEYS).join(listing, KEYS, "left")
    return rows.filter(forced | F.col("present")).select(*KEYS, F.when(forced, F.lit("rendered")).otherwise(F.lit("skipped")).alias("status"))


@query(W("SELECT b.variant, b.template FROM base_rows b WHERE NOT EXISTS (SELECT 1 FROM update_rows u WHERE u.variant = b.variant AND u.template = b.template)", "base_rows", "update_rows"))
def missing_outputs(spark: SparkSession, d: str) -> DataFrame:
    return projection(spark, d, "base_rows").select(*KEYS).join(projection(spark, d, "update_rows").select(*KEYS), KEYS, "left_anti")


_KIND = """CASE WHEN s IN ('.png', '.jpg', '.jpeg', '.gif', '.webp', '.tif', '.tiff') THEN 'image' WHEN s IN ('.ttf', '.otf', '.ttc', '.woff', '.woff2') THEN 'font'
WHEN s IN ('.xlsx', '.xls', '.csv', '.tsv') THEN 'spreadsheet' WHEN s = '.svg' THEN 'vector' ELSE 'other' END"""
_SUFFIX = r"regexp_extract(lower(split_part(relative, '/', -1)), '[^.](\.[^.]+)$', 1)"


@query(W(f"SELECT relative, {_KIND} AS kind FROM (SELECT relative, {_SUFFIX} AS s FROM files) t", "files"))
def asset_kind(spark: SparkSession, d: str) -> DataFrame:
    return projection(spark, d, "files").select("relative", S.asset_kind(F.col("relative")).alias("kind"))


@query("SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1 FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("sha256"), F.sha1("text").alias("sha1"))


@query(W("""SELECT coalesce(b.relative, a.relative) AS relative, CASE WHEN b.relative IS NULL THEN 'added' WHEN a.relative IS NULL THEN 'removed' WHEN b.h IS NOT DISTINCT FROM a.h THEN 'unchanged' ELSE 'changed' END AS state
FROM (SELECT relative, sha256(text) AS h FROM files WHERE doc_id % 10 <> 1) b FULL OUTER JOIN (SELECT relative, CASE WHEN doc_id % 10 = 3 THEN sha256(text || '!') ELSE sha256(text) END AS h FROM files WHERE doc_id % 10 <> 2) a ON a.relative = b.relative""", "files"))
def inventory_diff(spark: SparkSession, d: str) -> DataFrame:
    files, k = projection(spark, d, "files"), F.col("doc_id") % 10
    before = files.filter(k != 1).select("relative", F.sha2("text", 256).alias("h"))
    after = files.filter(k != 2).select("relative", F.sha2(F.when(k == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return O.inventory_diff(before, after, "relative", "h")


@query(W("SELECT a.name, a.relative AS before, b.relative AS after FROM (SELECT split_part(relative, '/', -1) AS name, relative FROM files WHERE doc_id % 2 = 0) a JOIN (SELECT split_part('out/' || relative, '/', -1) AS name, 'out/' || relative AS relative FROM files WHERE doc_id % 3 = 0) b ON a.name = b.name", "files"))
def paired_scan(spark: SparkSession, d: str) -> DataFrame:
    from gantrel.sources.files import paired

    files = projection(spark, d, "files")
    return paired(files.filter("doc_id % 2 = 0").select("relative"), files.filter("doc_id % 3 = 0").select(F.concat(F.lit("out/"), "relative").alias("relative")))


@query(W("SELECT source AS grp, count(*) AS n, list_sort(list(relative))[1] AS first FROM files GROUP BY source", "files"))
def delivery_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of deliverables by directory; groups without any do not appear."""
    return projection(spark, d, "files").groupBy(F.col("source").alias("grp")).agg(F.count("*").alias("n"), F.min("relative").alias("first"))


@query(W("""WITH o AS (SELECT doc_id, source || '/' || CAST(bytes % 97 AS VARCHAR) || '.webp' AS output FROM files), n AS (SELECT *, row_number() OVER (PARTITION BY output ORDER BY doc_id) AS n FROM o)
SELECT doc_id, output, CASE WHEN n > 1 THEN 'two inputs' ELSE 'output exists' END AS error FROM n WHERE n > 1 OR output IN (SELECT source || '/' || CAST(bytes % 97 AS VARCHAR) || '.webp' FROM files WHERE bytes % 10 = 3)""", "files"))
def output_collision(spark: SparkSession, d: str) -> DataFrame:
    """Inputs whose output another one has already, and those whose output is there and must not be overwritten."""
    files = projection(spark, d, "files")
    output = F.concat("source", F.lit("/"), (F.col("bytes") % 97).cast("string"), F.lit(".webp"))
    existing = files.filter("bytes % 10 = 3").select(output.alias("output"))
    return O.collisions(files, output, "doc_id", existing).select("doc_id", "output", "error")


@query(W("SELECT image, frame, duration_ms, disposal FROM frames", "frames"))
def gif_frame_scan(spark: SparkSession, d: str) -> DataFrame:
    """Frames of an animation held as an ordered array, one row a frame again."""
    held = projection(spark, d, "frames").groupBy("image").agg(F.array_sort(F.collect_list(F.struct("frame", "duration_ms", "disposal"))).alias("f"))
    return held.select("image", F.inline("f"))


@query(W("SELECT image, count(*) AS frames, CAST(sum(duration_ms) AS BIGINT) AS total_ms, list(duration_ms ORDER BY frame)[1] AS first_ms, list(disposal ORDER BY frame)[-1] AS last_disposal FROM frames GROUP BY image", "frames"))
def gif_metadata(spark: SparkSession, d: str) -> DataFrame:
    rows = projection(spark, d, "frames").groupBy("image")
    return rows.agg(F.count("*").alias("frames"), F.sum("duration_ms").cast("long").alias("total_ms"), F.min_by("duration_ms", "frame").alias("first_ms"), F.max_by("disposal", "frame").alias("last_disposal"))


@query(W("SELECT image, unnest(list_sort(list_distinct([0, n // 2, n - 1]))) AS frame FROM (SELECT image, count(*) AS n FROM frames GROUP BY image) t", "frames"))
def representative_frames(spark: SparkSession, d: str) -> DataFrame:
    """First, middle and last frame."""
    n = projection(spark, d, "frames").groupBy("image").agg(F.count("*").alias("n"))
    picks = F.array_sort(F.array_distinct(F.array(F.lit(0).cast("bigint"), F.floor(F.col("n") / 2), F.col("n") - 1)))
    return n.select("image", F.explode(picks).alias("frame"))


@query(W("SELECT template, variant, string_agg(CAST(role AS VARCHAR) || ' ' || CAST(12 + k % 30 AS VARCHAR) || 'px/' || CAST(1 + k % 3 AS VARCHAR) || 'L', ' | ' ORDER BY role) AS s FROM boxes GROUP BY template, variant", "boxes").replace("SELECT template, variant, string_agg", "SELECT template, variant, CASE WHEN length(s) > 90 THEN left(s, 87) || '...' ELSE s END AS summary FROM (SELECT template, variant, string_agg") + ") t")
def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    part = F.concat(F.col("role").cast("string"), F.lit(" "), (12 + F.col("k") % 30).cast("string"), F.lit("px/"), (1 + F.col("k") % 3).cast("string"), F.lit("L"))
    rows = projection(spark, d, "boxes").groupBy("template", "variant").agg(F.array_sort(F.collect_list(F.struct("role", part.alias("t")))).alias("p"))
    s = F.array_join(F.col("p.t"), " | ")
    return rows.select("template", "variant", F.when(F.length(s) > 90, F.concat(F.substring(s, 1, 87), F.lit("..."))).otherwise(s).alias("summary"))


_GRID = "c AS (SELECT template, variant, row_number() OVER (PARTITION BY template ORDER BY variant) - 1 AS i, count(*) OVER (PARTITION BY template) AS n FROM pics)"


@query(quality.violations_sql(f", {_GRID} SELECT c.template, c.variant, i % greatest(1, least(4, n)) * 320 AS x, i // greatest(1, least(4, n)) * 200 AS y, CAST(coalesce(v.bad, 0) AS BIGINT) AS bad FROM c LEFT JOIN (SELECT template, variant, count(*) AS bad FROM vi GROUP BY 1, 2) v ON v.template = c.template AND v.variant = c.variant"))
def qa_grid_layout(spark: SparkSession, d: str) -> DataFrame:
    """Contact-sheet cell of every picture, with the number of its violations."""
    w = Window.partitionBy("template")
    cells = projection(spark, d, "boxes").select("template", "variant").distinct().withColumn("i", F.row_number().over(w.orderBy("variant")) - 1).withColumn("n", F.count("*").over(w))
    columns = F.greatest(F.lit(1), F.least(F.lit(4), F.col("n")))
    bad = quality.qa_violations(spark, d).groupBy("template", "variant").agg(F.count("*").alias("bad"))
    return cells.join(bad, ["template", "variant"], "left").select("template", "variant", (F.col("i") % columns * 320).cast("long").alias("x"), (F.floor(F.col("i") / columns) * 200).cast("long").alias("y"), F.coalesce("bad", F.lit(0)).cast("long").alias("bad"))


@query(W("SELECT source, h, CAST(sum(h) OVER (ORDER BY source ROWS UNBOUNDED PRECEDING) - h AS BIGINT) AS y FROM (SELECT source, 66 + CAST(ceil(count(*) / 5) AS BIGINT) * 180 AS h FROM files GROUP BY source) t", "files"))
def delivery_overview(spark: SparkSession, d: str) -> DataFrame:
    """Height and place of every group in the overview: one row a group, so one window partition is enough."""
    groups = projection(spark, d, "files").groupBy("source").agg((66 + F.ceil(F.count("*") / 5) * 180).cast("long").alias("h"))
    return groups.select("source", "h", O.running_offset(F.col("h"), ["source"]).alias("y"))

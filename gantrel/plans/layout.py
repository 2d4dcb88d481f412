"""Queries over layout resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gantrel.functions import scalar as S
from gantrel.operators import layout as L
from gantrel.sources.tables import projection, with_projections

from .registry import query

W = with_projections
KEYS = ["template", "variant"]


@query(W("SELECT t.template, coalesce(nullif(v.ident, ''), nullif(v.language, ''), 'default') AS variant, count(*) AS n FROM templates t CROSS JOIN variants v GROUP BY 1, 2", "templates", "variants"))
def expected_keys(spark: SparkSession, d: str) -> DataFrame:
    """Every template under every variant, both specification-sized."""
    t, v = projection(spark, d, "templates"), projection(spark, d, "variants")
    named = v.select(S.variant_identifier(F.col("ident"), F.col("language")).alias("variant"))
    return t.crossJoin(L.specification_sized(named)).groupBy("template", "variant").agg(F.count("*").alias("n"))


_MERGED = """merged AS (SELECT b.template, b.variant, b.role, b.k, CASE WHEN o.has_x = 1 THEN o.x ELSE b.x END AS x,
  CASE WHEN o.null_y = 1 THEN NULL ELSE b.y END AS y, b.w, b.h FROM boxes b LEFT JOIN overrides o ON b.template = o.template AND b.variant = o.variant AND b.role = o.role)"""


def merged(spark: SparkSession, d: str) -> DataFrame:
    patch = projection(spark, d, "overrides").select(*KEYS, "role", (F.col("has_x") == 1).alias("has_x"), (F.col("null_y") == 1).alias("has_y"), "x", F.lit(None).cast("bigint").alias("y"))
    return L.overlay(projection(spark, d, "boxes"), patch, [*KEYS, "role"], ["x", "y"])


@query(W(f"WITH {_MERGED} SELECT template, variant, role, x, y, w, h FROM merged", "boxes", "overrides"))
def merged_spec(spark: SparkSession, d: str) -> DataFrame:
    """Shallow overrides; an override to null wins over the base."""
    return merged(spark, d).select(*KEYS, "role", "x", "y", "w", "h")


@query(W("""SELECT coalesce(b.template, p.template) AS template, coalesce(b.name, p.name) AS name, coalesce(p.x, b.x) AS x, coalesce(p.y, b.y) AS y, coalesce(p.w, b.w) AS w, coalesce(p.h, b.h) AS h, coalesce(p.pad, b.pad) AS pad
FROM obstacles b FULL OUTER JOIN (SELECT template, CASE WHEN pad = 5 THEN name || 'n' ELSE name END AS name, x + 1 AS x, CASE WHEN pad = 5 THEN y END AS y, CASE WHEN pad = 5 THEN w END AS w, CASE WHEN pad = 5 THEN h END AS h, CASE WHEN pad > 3 THEN pad + 1 END AS pad, pad = 2 AS deleted FROM obstacles WHERE pad >= 2) p
ON b.template = p.template AND b.name = p.name WHERE NOT coalesce(p.deleted, false)""", "obstacles"))
def resolve_obstacles(spark: SparkSession, d: str) -> DataFrame:
    """Obstacles with overrides that delete, change and add."""
    base = projection(spark, d, "obstacles")
    new = F.col("pad") == 5
    patch = base.filter("pad >= 2").select(
        "template",
        F.when(new, F.concat("name", F.lit("n"))).otherwise(F.col("name")).alias("name"),
        (F.col("x") + 1).alias("x"),
        *[F.when(new, F.col(c)).alias(c) for c in "ywh"],
        F.when(F.col("pad") > 3, F.col("pad") + 1).alias("pad"),
        (F.col("pad") == 2).alias("deleted"),
    )
    return L.resolve_obstacles(base, patch, ["template", "name"])


def members_of(elements: DataFrame) -> DataFrame:
    """Groups by rule: roles 1 and 2 follow role 0, on an edge by variant; role 4 stands at 600; role 6's group is off."""
    edge = F.expr("CASE variant % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'center' END")
    return elements.filter("role in (1, 2, 4, 6)").select(
        *KEYS, "role", edge.alias("edge"),
        F.when(F.col("role") < 4, F.lit(0)).when(F.col("role") == 6, F.lit(5)).cast("bigint").alias("anchor_role"),
        F.when(F.col("role") == 4, F.lit(600.0)).alias("position"), (F.col("role") != 6).alias("enabled"),
    )


_RESOLVED = f"""{_MERGED}, placed AS (SELECT m.*, CASE m.variant % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'center' END AS edge,
  CASE WHEN m.role = 4 THEN 600.0 WHEN m.role IN (1, 2) THEN CASE m.variant % 3 WHEN 0 THEN CAST(a.x AS DOUBLE) WHEN 1 THEN CAST(a.x + a.w AS DOUBLE) ELSE a.x + a.w / 2 END END AS position
  FROM merged m LEFT JOIN merged a ON a.template = m.template AND a.variant = m.variant AND a.role = 0)
, resolved AS (SELECT template, variant, role, CAST(2 * coalesce(CASE edge WHEN 'left' THEN position WHEN 'right' THEN position - w ELSE position - w / 2 END, x) AS BIGINT) AS x2, y, w, h FROM placed)"""


@query(W(f"WITH {_RESOLVED} SELECT * FROM resolved", "boxes", "overrides"))
def resolve_elements(spark: SparkSession, d: str) -> DataFrame:
    """Overrides, then alignment groups on the boxes before any group moved; twice x, as centers may be halves."""
    elements = merged(spark, d)
    out = L.align_groups(elements, members_of(elements), KEYS)
    return out.select(*KEYS, "role", (F.col("x") * 2).cast("long").alias("x2"), "y", "w", "h")


@query(W(f"""WITH {_MERGED} SELECT g.template, g.variant, g.role, CASE WHEN g.role = 4 THEN CAST(1200 AS BIGINT) ELSE CAST(2 * CASE g.variant % 3 WHEN 0 THEN CAST(a.x AS DOUBLE) WHEN 1 THEN CAST(a.x + a.w AS DOUBLE) ELSE a.x + a.w / 2 END AS BIGINT) END AS guide2
FROM merged g LEFT JOIN merged a ON a.template = g.template AND a.variant = g.variant AND a.role = CASE g.role WHEN 6 THEN 5 ELSE 0 END WHERE g.role IN (1, 2, 4, 6) AND (g.role = 4 OR a.x IS NOT NULL)""", "boxes", "overrides"))
def alignment_guides(spark: SparkSession, d: str) -> DataFrame:
    """Where each group's line is drawn, disabled groups included; none without an anchor box."""
    elements = merged(spark, d)
    anchors = elements.select(*KEYS, F.col("role").alias("anchor_role"), F.col("x").alias("ax"), F.col("w").alias("aw"))
    at = F.expr("CASE edge WHEN 'left' THEN CAST(ax AS DOUBLE) WHEN 'right' THEN CAST(ax + aw AS DOUBLE) ELSE ax + aw / 2 END")
    lines = members_of(elements).join(anchors, [*KEYS, "anchor_role"], "left").withColumn("at", F.coalesce("position", at)).filter("at is not null")
    return lines.select(*KEYS, "role", (F.col("at") * 2).cast("long").alias("guide2"))


_CUTS = """cuts AS (SELECT b.template, b.variant, b.role, b.k, b.x, b.y, b.w, b.h, o.x - o.pad AS lo, o.x + o.w + o.pad AS hi FROM boxes b LEFT JOIN obstacles o ON o.template = b.template AND NOT (o.y + o.h + o.pad <= b.y OR o.y - o.pad >= b.y + b.h)),
ends AS (SELECT *, max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM cuts),
gaps AS (SELECT k, x, w, greatest(20, coalesce(before, 20)) AS lo, least(940, lo) AS hi FROM ends WHERE lo IS NOT NULL
  UNION ALL SELECT k, max(x), max(w), greatest(20, coalesce(max(hi), 20)), 940 FROM cuts GROUP BY k),
free AS (SELECT *, x + w / 2 AS anchor FROM gaps WHERE hi - lo >= 1),
best AS (SELECT k, lo, hi, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN lo <= anchor AND hi >= anchor THEN 0 ELSE 1 END, hi - lo DESC, abs((lo + hi) / 2 - anchor), lo) AS n FROM free)"""


@query(W(f"WITH {_CUTS} SELECT k, lo, hi - lo AS width FROM best WHERE n = 1", "boxes", "obstacles"))
def flow_segments(spark: SparkSession, d: str) -> DataFrame:
    """The widest free part of the band from 20 to 940, around the box's middle where it can."""
    boxes, obstacles = projection(spark, d, "boxes"), projection(spark, d, "obstacles")
    out = L.flow_segments(boxes, obstacles, ["template"], F.lit(20), F.lit(940), F.col("x") + F.col("w") / 2)
    return out.filter("segment is not null").select("k", F.col("segment.lo").cast("long").alias("lo"), F.col("segment.w").cast("long").alias("width"))


@query(W(f"WITH {_CUTS} SELECT k, lo, hi FROM free", "boxes", "obstacles"))
def subtract_interval(spark: SparkSession, d: str) -> DataFrame:
    """All free parts of the band."""
    boxes, obstacles = projection(spark, d, "boxes"), projection(spark, d, "obstacles")
    cuts = boxes.join(obstacles.select("template", *[F.col(c).alias(f"o{c}") for c in ("x", "y", "w", "h", "pad")]), "template", "left")
    met = ~((F.col("oy") + F.col("oh") + F.col("opad") <= F.col("y")) | (F.col("oy") - F.col("opad") >= F.col("y") + F.col("h")))
    grouped = cuts.groupBy("k").agg(F.collect_list(F.when(met, F.struct((F.col("ox") - F.col("opad")).cast("double").alias("lo"), (F.col("ox") + F.col("ow") + F.col("opad")).cast("double").alias("hi")))).alias("cuts"))
    return grouped.select("k", F.inline(L.subtract_cuts(F.lit(20), F.lit(940), F.col("cuts")))).select("k", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))


_MEMBERS = """mem AS (SELECT template, variant, CASE WHEN k % 7 = 0 THEN role + 100 ELSE role END AS role, CASE WHEN k % 5 = 0 THEN 'top' ELSE 'left' END AS edge, CASE WHEN k % 3 = 0 THEN role + 1 END AS anchor_role, CASE WHEN k % 4 = 0 THEN 10.0 END AS position FROM boxes WHERE k % 11 <> 0
  UNION ALL SELECT template, variant, role, 'left', NULL, 5.0 FROM boxes WHERE k % 13 = 0)"""


@query(W(f"""WITH {_MEMBERS} SELECT m.template, m.variant, m.role, 'unknown member' AS error FROM mem m WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.template = m.template AND b.variant = m.variant AND b.role = m.role)
UNION ALL SELECT template, variant, role, 'in several groups' FROM mem GROUP BY template, variant, role HAVING count(*) > 1 UNION ALL SELECT template, variant, role, 'unsupported edge' FROM mem WHERE edge = 'top'
UNION ALL SELECT template, variant, role, 'one of position and anchor' FROM mem WHERE (position IS NULL) = (anchor_role IS NULL)
UNION ALL SELECT m.template, m.variant, m.role, 'anchor without box' FROM mem m WHERE anchor_role IS NOT NULL AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.template = m.template AND b.variant = m.variant AND b.role = m.anchor_role)""", "boxes"))
def group_errors(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the members of alignment groups."""
    boxes, k = projection(spark, d, "boxes"), F.col("k")
    fields = lambda role, edge, anchor, position, on: boxes.select(*KEYS, role.alias("role"), edge.alias("edge"), anchor.cast("long").alias("anchor_role"), position.cast("double").alias("position"), on.alias("enabled"))
    named = fields(F.when(k % 7 == 0, F.col("role") + 100).otherwise(F.col("role")), F.when(k % 5 == 0, F.lit("top")).otherwise(F.lit("left")), F.when(k % 3 == 0, F.col("role") + 1), F.when(k % 4 == 0, F.lit(10.0)), k % 11 != 0)
    again = fields(F.col("role"), F.lit("left"), F.lit(None), F.lit(5.0), k % 13 == 0)
    return L.group_errors(boxes, named.unionByName(again), KEYS)


@query(W("SELECT template, variant, role, row_number() OVER (PARTITION BY template, variant ORDER BY k % 3, role) AS draw FROM boxes", "boxes"))
def z_order(spark: SparkSession, d: str) -> DataFrame:
    rows = projection(spark, d, "boxes").withColumn("z", F.col("k") % 3)
    return L.z_order(rows, KEYS, "z", "role").select(*KEYS, "role", F.col("draw").cast("long").alias("draw"))


@query(W("SELECT template, variant, role FROM boxes WHERE coalesce(CASE k % 4 WHEN 0 THEN false WHEN 1 THEN true END, true)", "boxes"))
def enabled_elements(spark: SparkSession, d: str) -> DataFrame:
    flag = F.when(F.col("k") % 4 == 0, F.lit(False)).when(F.col("k") % 4 == 1, F.lit(True))
    return projection(spark, d, "boxes").filter(F.coalesce(flag, F.lit(True))).select(*KEYS, "role")


@query("""WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 5 = 1 THEN 'fixed ' || c_name END AS fixed, CASE WHEN c_custkey % 4 = 0 THEN 'label' END AS value_key, CASE WHEN c_custkey % 4 = 1 THEN 'copy' WHEN c_custkey % 4 = 0 THEN 'title' END AS copy_key,
  MAP {'title': c_name, 'label': CASE WHEN c_custkey % 3 = 0 THEN '   ' ELSE c_mktsegment END, 'copy': CAST(c_nationkey AS VARCHAR)} AS vals FROM customer)
SELECT c_custkey, trim(coalesce(nullif(fixed, ''), vals[coalesce(value_key, copy_key, 'title')], '')) AS text, CASE WHEN fixed <> '' THEN 'en' ELSE 'xx' END AS language FROM t WHERE trim(coalesce(nullif(fixed, ''), vals[coalesce(value_key, copy_key, 'title')], '')) <> ''""")
def element_text(spark: SparkSession, d: str) -> DataFrame:
    """Fixed text if it is not empty, else the variant's value under the value key, the copy key or the role; elements
    whose text is blank are dropped. Fixed text has a language of its own."""
    rows = spark.read.parquet(f"{d}/customer.parquet")
    k = F.col("c_custkey")
    fixed = F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, F.concat(F.lit("fixed "), F.col("c_name")))
    values = F.create_map(F.lit("title"), "c_name", F.lit("label"), F.when(k % 3 == 0, F.lit("   ")).otherwise(F.col("c_mktsegment")), F.lit("copy"), F.col("c_nationkey").cast("string"))
    keyed = rows.select("c_custkey", fixed.alias("fixed"), values.alias("vals"), F.when(k % 4 == 0, F.lit("label")).alias("value_key"), F.when(k % 4 == 1, F.lit("copy")).when(k % 4 == 0, F.lit("title")).alias("copy_key"), F.lit("title").alias("role"))
    return S.element_text(keyed, F.lit("xx")).select("c_custkey", "text", "language")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END AS style, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 10 END AS size FROM part")
def stage_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/part.parquet")
    base = rows.select("p_partkey", F.col("p_brand").alias("style"), F.lit(10).alias("size"))
    patch = rows.select("p_partkey", (F.col("p_partkey") % 2 == 0).alias("has_style"), (F.col("p_partkey") % 3 == 0).alias("has_size"), F.col("p_type").alias("style"), F.col("p_size").alias("size"))
    return L.overlay(base, patch, ["p_partkey"], ["style", "size"])


_LEAVES = """base(path, value) AS (VALUES ('spacing.0', 'a'), ('typography.title.max_lines', '2'), ('typography.title.min_font_size', '12'), ('typography.date.max_lines', '1'), ('containment.tolerance', '0'), ('alignment', 'x')),
patch(path, value) AS (VALUES ('typography.title.max_lines', '3'), ('containment', 'true'), ('alignment.edge', 'left'), ('extra.deep.key', 'v'))"""


@query(f"""WITH {_LEAVES}, hit AS (SELECT b.path FROM base b JOIN patch p ON b.path = p.path OR starts_with(b.path, p.path || '.') OR starts_with(p.path, b.path || '.'))
SELECT path, value FROM patch UNION ALL SELECT path, value FROM base WHERE path NOT IN (SELECT path FROM hit)""")
def deep_merge(spark: SparkSession, d: str) -> DataFrame:
    """Recursive overlay of leaf paths: a patch removes the base leaves below, above and at its path."""
    base = spark.createDataFrame([("spacing.0", "a"), ("typography.title.max_lines", "2"), ("typography.title.min_font_size", "12"), ("typography.date.max_lines", "1"), ("containment.tolerance", "0"), ("alignment", "x")], "path string, value string")
    patch = spark.createDataFrame([("typography.title.max_lines", "3"), ("containment", "true"), ("alignment.edge", "left"), ("extra.deep.key", "v")], "path string, value string")
    return merge_leaves(base, patch)


def merge_leaves(base: DataFrame, patch: DataFrame) -> DataFrame:
    """Tables of (path, value). Every path meets only its own ancestors, by equality, so neither side need be small."""
    above = lambda p: F.transform(F.sequence(F.lit(1), F.size(F.split(p, r"\."))), lambda i: F.array_join(F.slice(F.split(p, r"\."), F.lit(1), i), "."))
    patches = patch.select(F.col("path").alias("p"))
    below = base.select("path", F.explode(above(F.col("path"))).alias("p")).join(patches, "p", "left_semi").select("path")
    over = patches.select(F.explode(above(F.col("p"))).alias("path"))
    return base.join(below, "path", "left_anti").join(over, "path", "left_anti").unionByName(patch)


_FONTS = """fonts AS (SELECT lower(n_name) AS language, 'bold' AS weight, 'b/' || n_name AS path, 1 AS prio FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT lower(n_name), 'regular', 'r/' || n_name, 1 FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'default', 'bold', 'b/default', 1 UNION ALL SELECT 'default', 'regular', 'r/default', 1
  UNION ALL SELECT lower(n_name), 'bold', 'own/' || n_name, 2 FROM nation WHERE n_nationkey % 4 = 0)"""


def _fonts(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/nation.parquet")
    rows = [("default", "bold", "b/default", 1), ("default", "regular", "r/default", 1)]
    low, name = F.lower("n_name").alias("language"), F.col("n_name")
    part = lambda k, w, p, prio: n.filter(F.col("n_nationkey") % k == 0).select(low, F.lit(w).alias("weight"), F.concat(F.lit(p), name).alias("path"), F.lit(prio).alias("prio"))
    layers = part(2, "bold", "b/", 1).unionByName(part(3, "regular", "r/", 1)).unionByName(part(4, "bold", "own/", 2))
    return layers.unionByName(spark.createDataFrame(rows, "language string, weight string, path string, prio int"))


@query(f"WITH {_FONTS} SELECT language, weight, arg_max(path, prio) AS path FROM fonts GROUP BY language, weight")
def load_fonts(spark: SparkSession, d: str) -> DataFrame:
    """The specification's fonts over the preset's, by language and weight."""
    return L.layered_lookup(_fonts(spark, d), ["language", "weight"], "path", "prio")


_WANT = "(SELECT c_custkey, lower(n_name) || CASE c_custkey % 3 WHEN 0 THEN '-xx' ELSE '' END AS language, CASE c_custkey % 2 WHEN 0 THEN 'bold' ELSE 'regular' END AS weight, CASE WHEN c_custkey % 7 = 0 THEN 'mine/' || c_name END AS own FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    c, n = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "nation"))
    k = F.col("c_custkey")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.concat(F.lower("n_name"), F.when(k % 3 == 0, F.lit("-xx")).otherwise(F.lit(""))).alias("language"), F.when(k % 2 == 0, F.lit("bold")).otherwise(F.lit("regular")).alias("weight"), F.when(k % 7 == 0, F.concat(F.lit("mine/"), F.col("c_name"))).alias("own")
    )


def font_paths(wanted: DataFrame, fonts: DataFrame) -> DataFrame:
    """The element's own path, else the font of its language, its base language or the default, at its weight."""
    for i, lang in enumerate((F.col("language"), S.base_language(F.col("language")), F.lit("default"))):
        level = fonts.select(F.col("language").alias(f"__l{i}"), F.col("weight").alias(f"__w{i}"), F.col("path").alias(f"__p{i}"))
        wanted = wanted.join(level, (lang == F.col(f"__l{i}")) & (F.col("weight") == F.col(f"__w{i}")), "left")
    return wanted.withColumn("path", F.coalesce("own", "__p0", "__p1", "__p2")).drop(*[f"__{c}{i}" for c in "lwp" for i in range(3)])


_PATHS = f"""{_FONTS}, f AS (SELECT language, weight, arg_max(path, prio) AS path FROM fonts GROUP BY language, weight),
got AS (SELECT c_custkey, coalesce(own, a.path, b.path, z.path) AS path FROM {_WANT} w LEFT JOIN f a ON a.language = w.language AND a.weight = w.weight LEFT JOIN f b ON b.language = split_part(w.language, '-', 1) AND b.weight = w.weight LEFT JOIN f z ON z.language = 'default' AND z.weight = w.weight)"""


@query(f"WITH {_PATHS} SELECT c_custkey, path FROM got")
def font_fallback(spark: SparkSession, d: str) -> DataFrame:
    return font_paths(_wanted(spark, d), load_fonts(spark, d)).select("c_custkey", "path")


@query(f"WITH {_PATHS} SELECT path, count(*) AS uses FROM got WHERE path NOT IN (SELECT 'b/' || n_name FROM nation) GROUP BY path")
def font_exists(spark: SparkSession, d: str) -> DataFrame:
    """Chosen fonts that are not in the listing, with their uses."""
    listing = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("b/"), "n_name").alias("path"))
    return font_fallback(spark, d).join(listing, "path", "left_anti").groupBy("path").agg(F.count("*").alias("uses"))


@query("""WITH layers AS (SELECT c_custkey, 'k' || CAST(s AS VARCHAR) AS asset, 'default/' || CAST(s AS VARCHAR) AS path, 0 AS prio FROM customer CROSS JOIN range(3) r(s)
  UNION ALL SELECT c_custkey, 'k0', 'region/' || r_name, 1 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey % 2 = 0
  UNION ALL SELECT c_custkey, 'k1', 'nation/' || n_name, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 3 = 0
  UNION ALL SELECT c_custkey, 'k' || CAST(c_custkey % 4 AS VARCHAR), 'own/' || c_name, 3 FROM customer WHERE c_custkey % 5 = 0)
SELECT c_custkey, asset, arg_max(path, prio) AS path FROM layers GROUP BY c_custkey, asset""")
def asset_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Assets of a variant from the default, its region, its nation and itself, the last winning."""
    c, n, r = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "nation", "region"))
    full = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    entry = lambda on, key, path, prio: F.when(on, F.struct(key.alias("asset"), path.alias("path"), F.lit(prio).alias("prio")))
    k = F.col("c_custkey")
    layers = F.array(
        *[entry(F.lit(True), F.lit(f"k{i}"), F.lit(f"default/{i}"), 0) for i in range(3)],
        entry(F.col("r_regionkey") % 2 == 0, F.lit("k0"), F.concat(F.lit("region/"), "r_name"), 1),
        entry(F.col("n_nationkey") % 3 == 0, F.lit("k1"), F.concat(F.lit("nation/"), "n_name"), 2),
        entry(k % 5 == 0, F.concat(F.lit("k"), (k % 4).cast("string")), F.concat(F.lit("own/"), "c_name"), 3),
    )
    return L.layered_lookup(full.select("c_custkey", F.inline(F.filter(layers, lambda e: e.isNotNull()))), ["c_custkey", "asset"], "path", "prio")

"""Queries over the layout rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gantrel.operators import rules as R
from gantrel.sources.spec import load_spec
from gantrel.sources.tables import projection, with_projections

from .registry import query

W = with_projections
KEYS = ["template", "variant"]

# Metrics: an ink box is missing where k is divisible by 11, a safe box where it is by 13; every 17th variant, from the
# fifth on, has none at all. The rules are those of the specification below, the same for every template.
_QA = {
    "alignment_groups": [
        {"roles": ["0", "1", "2"], "tolerance": 200},
        {"roles": ["3", "4"], "edge": "center_x", "tolerance": 120},
        {"roles": ["7", "5", "6"], "edge": "bottom", "metric": "safe_box", "tolerance": 150},
    ],
    "spacing": [{"from": "0", "to": "1", "min": 8}, {"roles": ["2", "3"], "axis": "x", "min_gap": 12}, ["4", "5"]],
    "non_overlap": [["2", "3"], {"roles": ["4", "5"], "metric": "safe_box"}],
    "obstacle_clearance": [{"roles": ["0", "1", "2", "3"], "padding": 4}, {"roles": ["6"], "metric": "safe_box", "obstacles": ["o1", "gone"]}],
    "containment": [{"roles": ["0", "1", "2", "3", "7"], "tolerance": 2}, "4"],
    "elements": {"5": {"containment_tolerance": 6}},
}
_R = """rules(ord, kind, roles, metric, edge, axis, amount, padding, names) AS (VALUES (0, 'alignment', ['0', '1', '2'], 'ink_box', 'left', 'y', 200.0::DOUBLE, 0, NULL), (1, 'alignment', ['3', '4'], 'ink_box', 'center_x', 'y', 120, 0, NULL),
  (2, 'alignment', ['7', '5', '6'], 'safe_box', 'bottom', 'y', 150, 0, NULL), (3, 'spacing', ['0', '1'], 'ink_box', 'left', 'y', 8, 0, NULL), (4, 'spacing', ['2', '3'], 'ink_box', 'left', 'x', 12, 0, NULL), (5, 'spacing', ['4', '5'], 'ink_box', 'left', 'y', 0, 0, NULL),
  (6, 'non_overlap', ['2', '3'], 'ink_box', 'left', 'y', 0, 0, NULL), (7, 'non_overlap', ['4', '5'], 'safe_box', 'left', 'y', 0, 0, NULL), (8, 'obstacle_clearance', ['0', '1', '2', '3'], 'ink_box', 'left', 'y', 0, 4, NULL), (9, 'obstacle_clearance', ['6'], 'safe_box', 'left', 'y', 0, 0, ['o1', 'gone']),
  (10, 'containment', ['0', '1', '2', '3', '7'], 'ink_box', 'left', 'y', 2, 0, NULL), (11, 'containment', ['4'], 'ink_box', 'left', 'y', 0, 0, NULL), (12, 'containment', ['5'], 'ink_box', 'left', 'y', 6, 0, NULL))"""
_M = """mm AS (SELECT template, variant, CAST(role AS VARCHAR) AS role, 'ink_box' AS metric, x, y, w, h FROM boxes WHERE k % 11 <> 0 AND variant % 17 <> 5
  UNION ALL SELECT template, variant, CAST(role AS VARCHAR), 'safe_box', x - 4, y - 3, w + 8, h + 6 FROM boxes WHERE k % 13 <> 0 AND variant % 17 <> 5),
pics AS (SELECT DISTINCT template, variant FROM boxes), cfg AS (SELECT template, variant, CAST(role AS VARCHAR) AS role, x + 5 AS x, y + 1 AS y, w - 3 AS w, h + 9 AS h FROM boxes WHERE role % 4 <> 3),
ob AS (SELECT template, name, x, y, w, h, nullif(pad, 0) AS pad FROM obstacles),
mem AS (SELECT *, unnest(roles) AS role, unnest(range(len(roles))) AS i FROM pics CROSS JOIN rules WHERE variant % 17 <> 5),
mb AS (SELECT mem.*, mm.x, mm.y, mm.w, mm.h, array_to_string(roles, ',') AS joined FROM mem LEFT JOIN mm ON mm.template = mem.template AND mm.variant = mem.variant AND mm.role = mem.role AND mm.metric = mem.metric),
al AS (SELECT template, variant, ord, any_value(joined) AS joined, any_value(edge) AS edge, any_value(amount) AS amount, any_value(metric) AS metric, list(CASE edge WHEN 'left' THEN x WHEN 'center_x' THEN x + w / 2 ELSE y + h END::DOUBLE ORDER BY i) AS vs, bool_and(x IS NOT NULL) AS whole FROM mb WHERE kind = 'alignment' GROUP BY template, variant, ord),
pb AS (SELECT a.template, a.variant, a.kind, a.joined, a.metric, a.axis, a.amount, CASE a.axis WHEN 'y' THEN b.y - a.y - a.h ELSE b.x - a.x - a.w END AS gap, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS ox, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS oy
  FROM mb a JOIN mb b ON a.template = b.template AND a.variant = b.variant AND a.ord = b.ord AND a.i = 0 AND b.i = 1 WHERE a.kind IN ('spacing', 'non_overlap') AND a.x IS NOT NULL AND b.x IS NOT NULL),
nm AS (SELECT mb.*, unnest(coalesce(names, (SELECT list(o.name) FROM ob o WHERE o.template = mb.template))) AS name FROM mb WHERE kind = 'obstacle_clearance' AND mb.x IS NOT NULL),
oc AS (SELECT nm.*, o.x IS NULL AS gone, coalesce(o.pad, CAST(nm.padding AS BIGINT)) AS p, least(nm.x + nm.w, o.x + o.w + p) - greatest(nm.x, o.x - p) AS ox, least(nm.y + nm.h, o.y + o.h + p) - greatest(nm.y, o.y - p) AS oy FROM nm LEFT JOIN ob o ON o.template = nm.template AND o.name = nm.name),
ct AS (SELECT mb.*, s.x IS NULL AND c.x IS NULL AS gone, coalesce(s.x, c.x) AS sx, coalesce(s.y, c.y) AS sy, CASE WHEN s.x IS NULL THEN c.w ELSE s.w END AS sw, CASE WHEN s.x IS NULL THEN c.h ELSE s.h END AS sh, [greatest(0, sx - mb.x), greatest(0, sy - mb.y), greatest(0, mb.x + mb.w - sx - sw), greatest(0, mb.y + mb.h - sy - sh)] AS ov
  FROM mb LEFT JOIN mm s ON s.template = mb.template AND s.variant = mb.variant AND s.role = mb.role AND s.metric = 'safe_box' LEFT JOIN cfg c ON c.template = mb.template AND c.variant = mb.variant AND c.role = mb.role WHERE kind = 'containment' AND mb.x IS NOT NULL)"""
_D = "CAST({} AS VARCHAR)"
_RULES = {
    "alignment": """SELECT template, variant, 'alignment' AS rule, joined AS roles, '{"edge":"' || edge || '","values":[' || array_to_string(list_transform(vs, lambda v: CAST(v AS VARCHAR)), ',') || '],"spread":' || CAST(list_max(vs) - list_min(vs) AS VARCHAR) || '}' AS actual,
        '{"tolerance":' || CAST(amount AS VARCHAR) || ',"metric":"' || metric || '"}' AS expected FROM al WHERE whole AND list_max(vs) - list_min(vs) > amount""",
    "spacing": """SELECT template, variant, 'spacing' AS rule, joined AS roles, '{"axis":"' || axis || '","gap":' || CAST(gap AS VARCHAR) || '}' AS actual, '{"min":' || CAST(amount AS VARCHAR) || ',"metric":"' || metric || '"}' AS expected FROM pb WHERE kind = 'spacing' AND gap < amount""",
    "non_overlap": """SELECT template, variant, 'non_overlap' AS rule, joined AS roles, '{"overlap":[' || CAST(ox AS VARCHAR) || ',' || CAST(oy AS VARCHAR) || '],"area":' || CAST(ox * oy AS VARCHAR) || '}' AS actual, '{"area":0,"metric":"' || metric || '"}' AS expected FROM pb WHERE kind = 'non_overlap' AND ox > 0 AND oy > 0""",
    "obstacle_clearance": """SELECT template, variant, CASE WHEN gone THEN 'obstacle_clearance.missing_obstacle' ELSE 'obstacle_clearance' END AS rule, role || ',obstacle:' || name AS roles, CASE WHEN NOT gone THEN '{"overlap":[' || CAST(ox AS VARCHAR) || ',' || CAST(oy AS VARCHAR) || '],"area":' || CAST(ox * oy AS VARCHAR) || '}' END AS actual,
        CASE WHEN gone THEN 'configured obstacle box' ELSE '{"area":0,"padding":' || CAST(p AS VARCHAR) || ',"metric":"' || metric || '"}' END AS expected FROM oc WHERE gone OR (ox > 0 AND oy > 0)""",
    "containment": """SELECT template, variant, CASE WHEN gone THEN 'containment.missing_safe_box' ELSE 'containment' END AS rule, role AS roles, CASE WHEN NOT gone THEN '{"overflow":[' || array_to_string(list_transform(ov, lambda v: CAST(v AS VARCHAR)), ',') || ']}' END AS actual,
        CASE WHEN gone THEN 'safe_box or configured element box' ELSE '{"safe_box":[' || CAST(sx AS VARCHAR) || ',' || CAST(sy AS VARCHAR) || ',' || CAST(sw AS VARCHAR) || ',' || CAST(sh AS VARCHAR) || '],"tolerance":' || CAST(amount AS VARCHAR) || '}' END AS expected FROM ct WHERE gone OR list_max(ov) > amount""",
    "missing": """SELECT template, variant, kind || '.missing_metric' AS rule, role AS roles, CAST(NULL AS VARCHAR) AS actual, metric AS expected FROM mb WHERE x IS NULL""",
    "bare": """SELECT template, variant, 'missing_render_metrics' AS rule, '' AS roles, CAST(NULL AS VARCHAR) AS actual, 'report' AS expected FROM pics WHERE variant % 17 = 5""",
}
_LAYOUT = ", ".join(f"l{i} AS ({v})" for i, v in enumerate(_RULES.values()))
_LAYOUT_ALL = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(len(_RULES)))


def _oracle(tail: str) -> str:
    return W(f"WITH {_R}, {_M}, {tail}", "boxes", "obstacles")


def _rule_sql(where: str) -> str:
    return _oracle(f"{_LAYOUT} SELECT *, 'error' AS severity FROM ({_LAYOUT_ALL}) u WHERE {where}")


def _rules(spark: SparkSession, d: str) -> DataFrame:
    templates = [r.template for r in projection(spark, d, "templates").collect()]  # as many as the specification has
    return load_spec(spark, {"templates": {t: {"qa": _QA} for t in templates}}).rules


def _pictures(spark: SparkSession, d: str) -> DataFrame:
    """One row a picture: its measured boxes, its configured boxes and the obstacles of its template."""
    boxes = projection(spark, d, "boxes").withColumn("role", F.col("role").cast("string"))
    k, shown = F.col("k"), F.col("variant") % 17 != 5
    box = lambda on, name, *c: F.when(shown & on, F.struct(F.concat(F.col("role"), F.lit(f".{name}")).alias("key"), F.struct(*[v.alias(n) for n, v in zip("xywh", c)]).alias("box")))
    x, y, w, h = (F.col(c) for c in "xywh")
    entries = F.filter(F.array(box(k % 11 != 0, "ink_box", x, y, w, h), box(k % 13 != 0, "safe_box", x - 4, y - 3, w + 8, h + 6)), lambda e: e.isNotNull())
    own = F.when(F.col("role").cast("int") % 4 != 3, F.struct(F.col("role").alias("key"), F.struct((x + 5).alias("x"), (y + 1).alias("y"), (w - 3).alias("w"), (h + 9).alias("h")).alias("box")))
    pics = boxes.groupBy(*KEYS).agg(F.flatten(F.collect_list(entries)).alias("e"), F.collect_list(own).alias("c"))
    pics = pics.select(*KEYS, F.when(F.col("variant") % 17 != 5, F.map_from_entries("e")).alias("boxes"), F.map_from_entries("c").alias("configured"))
    fixed = projection(spark, d, "obstacles").select("template", "name", "x", "y", "w", "h", F.nullif(F.col("pad"), F.lit(0)).alias("pad"))
    named = fixed.groupBy("template").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("x", "y", "w", "h", "pad")))).alias("obstacles"))
    return pics.join(named, "template", "left").withColumn("obstacles", F.coalesce("obstacles", F.expr("map()").cast("map<string,struct<x:bigint,y:bigint,w:bigint,h:bigint,pad:bigint>>")))


def _judged(spark: SparkSession, d: str, where: str) -> DataFrame:
    return R.judge(_pictures(spark, d), _rules(spark, d), KEYS).filter(where)


@query(_rule_sql("rule = 'alignment'"))
def qa_alignment(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d, "rule = 'alignment'")


@query(_rule_sql("rule = 'spacing'"))
def qa_spacing(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d, "rule = 'spacing'")


@query(_rule_sql("rule = 'non_overlap'"))
def qa_non_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d, "rule = 'non_overlap'")


@query(_rule_sql("starts_with(rule, 'obstacle_clearance')"))
def qa_obstacle_clearance(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d, "startswith(rule, 'obstacle_clearance')")


@query(_rule_sql("starts_with(rule, 'containment')"))
def qa_containment(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d, "startswith(rule, 'containment')")


@query(_rule_sql("ends_with(rule, '.missing_metric') OR rule = 'missing_render_metrics'"))
def qa_missing_metric(spark: SparkSession, d: str) -> DataFrame:
    """What every kind of rule misses, and pictures without any metrics."""
    return _judged(spark, d, "endswith(rule, '.missing_metric') OR rule = 'missing_render_metrics'")


_TY = """ty AS (SELECT template, variant, CAST(role AS VARCHAR) AS role, k, CASE WHEN k % 3 = 0 THEN 20 END AS min_font_size, CASE WHEN k % 2 = 0 THEN 0.5 END AS min_font_scale, CASE WHEN k % 5 = 0 THEN 0.8 END AS max_height_density, 2 AS max_lines, CASE WHEN k % 4 = 0 THEN 6 END AS max_content_center_offset,
  CASE WHEN k % 7 > 0 THEN 10 + k % 30 END AS font_size, 10 + k % 40 AS max_font_size, CASE WHEN k % 6 > 2 THEN (k % 10) / 10.0 END AS font_scale, CASE WHEN k % 9 > 0 THEN (k % 12) / 10.0 END AS height_density, CASE WHEN k % 8 > 3 THEN k % 5 END AS line_count, CASE WHEN k % 8 > 1 THEN k % 4 END AS n_lines, CASE WHEN k % 10 > 0 THEN k % 17 - 8 END AS center_offset FROM boxes),
tv AS (SELECT *, coalesce(line_count, n_lines) AS lc, coalesce(font_scale, CAST(font_size AS DOUBLE) / max_font_size) AS fs FROM ty)"""


def _limit(limit: str, metric: str, value: str, broken: str) -> str:
    return f"""SELECT template, variant, k, role, 'typography.{limit}' || CASE WHEN {value} IS NULL THEN '.missing_metric' ELSE '' END AS rule, CAST(CASE WHEN {value} IS NOT NULL THEN round(CAST({value} AS DOUBLE), 4) END AS VARCHAR) AS actual,
  CASE WHEN {value} IS NULL THEN '{metric}' ELSE CAST(CAST({limit} AS DOUBLE) AS VARCHAR) END AS expected FROM tv WHERE {limit} IS NOT NULL AND ({value} IS NULL OR {broken})"""


_TYPOGRAPHY = " UNION ALL ".join(
    [
        _limit("min_font_size", "font_size", "font_size", "font_size < min_font_size"),
        _limit("min_font_scale", "font_scale", "fs", "fs < min_font_scale"),
        _limit("max_height_density", "height_density", "height_density", "height_density > max_height_density"),
        _limit("max_lines", "line_count", "lc", "lc > max_lines"),
        _limit("max_content_center_offset", "center_offset", "center_offset", "abs(center_offset) > max_content_center_offset"),
    ]
)


@query(W(f"WITH {_TY} SELECT k, rule, actual, expected FROM ({_TYPOGRAPHY}) u", "boxes"))
def qa_typography(spark: SparkSession, d: str) -> DataFrame:
    return _typography(spark, d).select("k", "rule", "actual", "expected")


def _typography(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    when = lambda on, v: F.when(on, v)
    rows = projection(spark, d, "boxes").select(
        *KEYS, F.col("role").cast("string").alias("role"), "k", when(k % 3 == 0, F.lit(20)).alias("min_font_size"), when(k % 2 == 0, F.lit(0.5)).alias("min_font_scale"), when(k % 5 == 0, F.lit(0.8)).alias("max_height_density"), F.lit(2).alias("max_lines"),
        when(k % 4 == 0, F.lit(6)).alias("max_content_center_offset"), when(k % 7 > 0, 10 + k % 30).alias("font_size"), (10 + k % 40).alias("max_font_size"), when(k % 6 > 2, (k % 10) / F.lit(10.0)).alias("font_scale"),
        when(k % 9 > 0, (k % 12) / F.lit(10.0)).alias("height_density"), when(k % 8 > 3, k % 5).alias("line_count"), when(k % 8 > 1, F.array_repeat(F.lit("l"), (k % 4).cast("int"))).alias("lines"), when(k % 10 > 0, k % 17 - 8).alias("center_offset"),
    )
    return R.typography(rows, [*KEYS, "role", "k"])


_EVERY = f"vi AS (SELECT *, 'error' AS severity FROM ({_LAYOUT_ALL}) u UNION ALL SELECT template, variant, rule, role, actual, expected, 'error' FROM ({_TYPOGRAPHY}) t)"


def violations_sql(tail: str) -> str:
    return _oracle(f"{_LAYOUT}, {_TY}, {_EVERY} {tail}")


@query(violations_sql("SELECT template, variant, rule, roles, actual, expected, severity FROM vi"))
def qa_violations(spark: SparkSession, d: str) -> DataFrame:
    """All rules' violations as one bag: layout, missing metrics and typography."""
    layout = R.judge(_pictures(spark, d), _rules(spark, d), KEYS)
    return layout.unionByName(_typography(spark, d).drop("k").withColumnRenamed("role", "roles").withColumn("severity", F.lit("error")))


@query(violations_sql("SELECT CAST(variant AS VARCHAR) || ':' || template || ':' || rule || ':' || roles AS line, count(*) AS n FROM vi WHERE severity = 'error' GROUP BY 1"))
def qa_error_lines(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws(":", F.col("variant").cast("string"), "template", "rule", "roles")
    return qa_violations(spark, d).filter("severity = 'error'").groupBy(line.alias("line")).agg(F.count("*").alias("n"))


@query(violations_sql("SELECT rule, count(*) AS violations, count(*) FILTER (WHERE severity = 'error') AS errors, count(DISTINCT template || '/' || CAST(variant AS VARCHAR)) AS pictures, (SELECT count(*) FROM pics) AS checked FROM vi GROUP BY rule"))
def qa_summary(spark: SparkSession, d: str) -> DataFrame:
    """Violations, errors among them and pictures of each rule, beside the number of pictures that were checked."""
    pictures = F.countDistinct(F.concat_ws("/", "template", F.col("variant").cast("string")))
    found = qa_violations(spark, d).groupBy("rule").agg(F.count("*").alias("violations"), F.count_if(F.col("severity") == "error").alias("errors"), pictures.alias("pictures"))
    checked = projection(spark, d, "boxes").select(*KEYS).distinct().agg(F.count("*").alias("checked"))
    return found.join(F.broadcast(checked), F.lit(True))


@query(W("SELECT k, CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN 'typography.forbid_unnecessary_wrap.missing_metric' ELSE 'typography.unnecessary_wrap' END AS rule FROM boxes WHERE k % 5 = 0 OR k % 7 = 0 OR (k % 4 > 1 AND k % 3 > 0)", "boxes"))
def qa_unnecessary_wrap(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    rule = R.unnecessary_wrap(F.when(k % 5 != 0, k % 4), F.when(k % 7 != 0, k % 3 > 0))
    return projection(spark, d, "boxes").select("k", rule.alias("rule")).filter("rule is not null")


_DL = "dl AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.split("text", "\n").alias("lines"))


@query(f"WITH {_DL} SELECT doc_id, CAST(length(lines[-1]) AS BIGINT) AS last, CAST(list_max(list_transform(lines, lambda s: length(s))) AS BIGINT) AS widest FROM dl WHERE len(lines) > 1 AND length(lines[-1]) < 0.25 * list_max(list_transform(lines, lambda s: length(s)))")
def qa_short_last_line(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).select("doc_id", F.transform("lines", F.length).alias("widths"))
    return rows.filter(R.short_last_line(F.col("widths"), F.lit(0.25))).select("doc_id", F.element_at("widths", -1).cast("long").alias("last"), F.array_max("widths").cast("long").alias("widest"))


_SP = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _squeezed(text: str) -> str:
    return f"regexp_replace({text}, '{_SP}+', '', 'g')"




@query(f"""WITH {_DL}, t AS (SELECT doc_id, list_transform(lines, lambda s: {_squeezed('s')}) AS sq, unnest(list_transform(range(1, len(lines)), lambda i: lines[i][-6:] || left(lines[i + 1], 6))) AS term, unnest(range(1, len(lines))) AS i FROM dl WHERE len(lines) > 1)
SELECT doc_id, i - 1 AS i, term FROM t WHERE {_squeezed('term')} <> '' AND contains(array_to_string(sq, ''), {_squeezed('term')}) AND len(list_filter(sq, lambda s: contains(s, {_squeezed('term')}))) = 0""")
def qa_preserve_term(spark: SparkSession, d: str) -> DataFrame:
    """Terms over any line break that no single line holds."""
    over = F.transform(F.sequence(F.lit(1), F.size("lines") - 1), lambda i: F.struct((i - 1).cast("long").alias("i"), F.concat(F.substring(F.element_at("lines", i), F.greatest(F.lit(1), F.length(F.element_at("lines", i)) - 5), F.lit(6)), F.substring(F.element_at("lines", i + 1), F.lit(1), F.lit(6))).alias("term")))
    rows = _lines(spark, d).filter(F.size("lines") > 1).select("doc_id", F.transform("lines", R.squeezed).alias("sq"), over.alias("terms"))
    split = R.split_terms(F.col("sq"), F.transform("terms", lambda t: t["term"]))
    lost = rows.select("doc_id", "terms", split.alias("lost"))
    return lost.select("doc_id", F.inline(F.filter("terms", lambda t: F.array_contains(F.col("lost"), t["term"]))))


@query(f"""WITH {_DL}, e AS (SELECT doc_id, regexp_replace(unnest(lines), '^{_SP}+|{_SP}+$', '', 'g') AS line, generate_subscripts(lines, 1) - 1 AS i FROM dl)
SELECT doc_id, CAST(i AS BIGINT) AS i, 'start' AS kind FROM e WHERE starts_with(line, 'The') OR starts_with(line, 'Die') UNION ALL SELECT doc_id, CAST(i AS BIGINT), 'end' FROM e WHERE ends_with(line, 'e.') OR ends_with(line, ',')""")
def qa_forbidden_edges(spark: SparkSession, d: str) -> DataFrame:
    hits = R.forbidden_edges(F.col("lines"), ["The", "Die"], ["e.", ","])
    return _lines(spark, d).select("doc_id", F.inline(hits)).withColumn("i", F.col("i").cast("long"))


_SHOWN = "m AS (SELECT template, variant, role, x FROM boxes WHERE k % 11 <> 0)"


@query(W(f"WITH {_SHOWN} SELECT template, variant, list_sort(list(CAST(role AS VARCHAR))) AS roles FROM m WHERE role % 3 <> 2 GROUP BY template, variant", "boxes"))
def qa_rule_expand(spark: SparkSession, d: str) -> DataFrame:
    """A rule that is just on applies to all text roles with metrics; every third role is an image."""
    text = projection(spark, d, "boxes").filter("k % 11 <> 0 and role % 3 <> 2")
    return text.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.col("role").cast("string"))).alias("roles"))


@query(W(f"WITH {_SHOWN} SELECT template, variant, CAST(role AS VARCHAR) AS role, x FROM m", "boxes"))
def metrics_explode(spark: SparkSession, d: str) -> DataFrame:
    """Report rows with a map of metrics back to one row a metric."""
    shown = projection(spark, d, "boxes").filter("k % 11 <> 0")
    report = shown.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct(F.col("role").cast("string"), "x"))).alias("metrics"))
    return report.select(*KEYS, F.explode("metrics").alias("role", "x"))


@query(W("SELECT template, variant, k FROM boxes WHERE w <> 100 + k % 3 OR h <> 16 + k % 80", "boxes"))
def size_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Outputs whose size is not the expected canvas."""
    k = F.col("k")
    return projection(spark, d, "boxes").filter((F.col("w") != 100 + k % 3) | (F.col("h") != 16 + k % 80)).select(*KEYS, "k")


@query(W("""WITH a AS (SELECT image, count(*) AS frames, list(duration_ms ORDER BY frame) AS durations, CAST(image % 4 AS BIGINT) AS loop FROM frames GROUP BY image),
e AS (SELECT *, CASE WHEN image % 3 = 0 THEN 9 END AS ef, CASE WHEN image % 4 = 1 THEN 0 WHEN image % 8 = 2 THEN 2 END AS el, CASE WHEN image % 5 = 0 THEN list_transform(durations, lambda x: 20) WHEN image % 5 = 1 THEN durations END AS ed FROM a WHERE image % 2 = 0 OR image % 7 = 0)
SELECT image, 'frames' AS error, CAST(frames AS VARCHAR) AS actual FROM e WHERE frames <> ef UNION ALL SELECT image, 'loop', CAST(loop AS VARCHAR) FROM e WHERE loop <> el
UNION ALL SELECT image, 'durations', '[' || array_to_string(list_transform(durations, lambda x: CAST(x AS VARCHAR)), ',') || ']' FROM e WHERE durations <> ed""", "frames"))
def animation_check(spark: SparkSession, d: str) -> DataFrame:
    """Errors of animations, of those configured, by frame count, loop and all durations; absent expectations pass."""
    a = projection(spark, d, "frames").groupBy("image").agg(F.count("*").alias("frames"), F.array_sort(F.collect_list(F.struct("frame", "duration_ms"))).alias("f"))
    i, durations = F.col("image"), F.col("f.duration_ms")
    a = a.select("image", "frames", durations.alias("durations"), (i % 4).alias("loop")).filter((i % 2 == 0) | (i % 7 == 0))
    expected = {"frames": F.when(i % 3 == 0, F.lit(9)), "loop": F.when(i % 4 == 1, F.lit(0)).when(i % 8 == 2, F.lit(2)), "durations": F.when(i % 5 == 0, F.transform("durations", lambda _: F.lit(20).cast("long"))).when(i % 5 == 1, F.col("durations"))}
    shown = {"frames": F.col("frames").cast("string"), "loop": F.col("loop").cast("string"), "durations": F.to_json("durations")}
    errors = [F.when(F.col(n) != e, F.struct(F.lit(n).alias("error"), shown[n].alias("actual"))) for n, e in expected.items()]
    return a.select("image", F.inline(F.filter(F.array(*errors), lambda e: e.isNotNull())))

"""Layout rules over measured boxes. Every rule returns rows (keys, rule, roles, actual, expected, severity): roles are
joined by commas, actual and expected are JSON texts, null where nothing was measured.

All boxes of a picture are gathered into one map, bounded by the specification, and all its rules are judged on that one
row: a picture is shuffled once, however many rules there are. Rules are data: a specification-sized table, broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gantrel.functions.scalar import SPACES, strip

#: Rule rows: ``roles`` in order, the ``metric`` that is judged, ``amount`` the tolerance or least gap, ``padding`` where
#: an obstacle has none of its own, ``names`` of obstacles (null: all of the picture's).
RULES = "template string, ord int, kind string, roles array<string>, metric string, edge string, axis string, amount double, padding double, names array<string>"
_FOUND = "array<struct<rule:string,roles:string,actual:string,expected:string>>"
#: Rule rows are broadcast up to this many; a specification has a few for each template.
RULE_ROWS = 100_000


def pictures(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, boxes): measured boxes (keys, role, metric, x, y, w, h) as one map for each picture, by ``role.metric``."""
    box = F.struct(*[F.col(c).cast("long").alias(c) for c in "xywh"])
    entry = F.struct(F.concat_ws(".", F.col("role").cast("string"), "metric").alias("key"), box.alias("box"))
    return metrics.filter("x is not null").groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("boxes"))


def _hit(rule: Column | str, roles: Column, actual: Column | None, expected: Column) -> Column:
    name = F.lit(rule) if isinstance(rule, str) else rule
    return F.struct(name.alias("rule"), roles.cast("string").alias("roles"), (F.lit(None) if actual is None else actual).cast("string").alias("actual"), expected.cast("string").alias("expected"))


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def overlap(al: Column, ar: Column, bl: Column, br: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(ar, br) - F.greatest(al, bl))


def _box(role: Column) -> Column:
    return F.try_element_at(F.col("boxes"), F.concat_ws(".", role, F.col("metric")))


def _alignment() -> Column:
    def edge(b: Column) -> Column:
        at = {"left": b["x"], "right": b["x"] + b["w"], "center_x": b["x"] + b["w"] / 2, "top": b["y"], "bottom": b["y"] + b["h"], "center_y": b["y"] + b["h"] / 2}
        out = F.when(F.lit(False), F.lit(0.0))
        for name, value in at.items():
            out = out.when(F.col("edge") == name, value.cast("double"))
        return out.otherwise(F.raise_error(F.concat(F.lit("unknown edge: "), F.col("edge"))).cast("double"))

    values = F.transform("roles", lambda r: edge(_box(r)))
    spread = F.array_max(values) - F.array_min(values)
    whole = (F.size("roles") > 1) & F.forall("roles", lambda r: _box(r).isNotNull())
    return F.when(whole & (spread > F.col("amount")), F.array(_hit("alignment", F.array_join("roles", ","), _json(edge=F.col("edge"), values=values, spread=spread), _json(tolerance=F.col("amount"), metric=F.col("metric")))))


def _pair(judge) -> Column:
    a, b = _box(F.try_element_at(F.col("roles"), F.lit(1))), _box(F.try_element_at(F.col("roles"), F.lit(2)))
    return F.when((F.size("roles") == 2) & a.isNotNull() & b.isNotNull(), judge(a, b, F.array_join("roles", ",")))


def _spacing(a: Column, b: Column, roles: Column) -> Column:
    axis = F.when(F.col("axis").isin("x", "y"), F.col("axis")).otherwise(F.raise_error(F.concat(F.lit("unknown axis: "), F.col("axis"))).cast("string"))
    gap = F.when(axis == "y", b["y"] - a["y"] - a["h"]).otherwise(b["x"] - a["x"] - a["w"])
    return F.when(gap < F.col("amount"), F.array(_hit("spacing", roles, _json(axis=F.col("axis"), gap=gap), _json(min=F.col("amount"), metric=F.col("metric")))))


def _non_overlap(a: Column, b: Column, roles: Column) -> Column:
    across, down = (overlap(a[at], a[at] + a[n], b[at], b[at] + b[n]) for at, n in (("x", "w"), ("y", "h")))
    return F.when((across > 0) & (down > 0), F.array(_hit("non_overlap", roles, _json(overlap=F.array(across, down), area=across * down), _json(area=F.lit(0), metric=F.col("metric")))))


def _obstacles() -> Column:
    names = F.coalesce("names", F.array_sort(F.map_keys("obstacles")), F.array().cast("array<string>"))

    def met(role: Column, name: Column) -> Column:
        a, o = _box(role), F.try_element_at(F.col("obstacles"), name)
        pad = F.coalesce(o["pad"], F.col("padding").cast("long"), F.lit(0))
        across, down = (overlap(a[at], a[at] + a[n], o[at] - pad, o[at] + o[n] + pad) for at, n in (("x", "w"), ("y", "h")))
        roles = F.concat(role, F.lit(",obstacle:"), name)
        return F.when(o.isNull(), _hit("obstacle_clearance.missing_obstacle", roles, None, F.lit("configured obstacle box"))).when(
            (across > 0) & (down > 0), _hit("obstacle_clearance", roles, _json(overlap=F.array(across, down), area=across * down), _json(area=F.lit(0), padding=pad, metric=F.col("metric")))
        )

    present = F.filter("roles", lambda r: _box(r).isNotNull())
    return F.filter(F.flatten(F.transform(present, lambda r: F.transform(names, lambda n: met(r, n)))), lambda h: h.isNotNull())


def _containment() -> Column:
    def out(role: Column) -> Column:
        a = _box(role)
        s = F.coalesce(F.try_element_at(F.col("boxes"), F.concat(role, F.lit(".safe_box"))), F.try_element_at(F.col("configured"), role))
        over = F.array(*[F.greatest(F.lit(0).cast("long"), v) for v in (s["x"] - a["x"], s["y"] - a["y"], a["x"] + a["w"] - s["x"] - s["w"], a["y"] + a["h"] - s["y"] - s["h"])])
        return F.when(s.isNull(), _hit("containment.missing_safe_box", role, None, F.lit("safe_box or configured element box"))).when(
            F.array_max(over) > F.col("amount"), _hit("containment", role, _json(overflow=over), _json(safe_box=F.array(*[s[c] for c in "xywh"]), tolerance=F.col("amount")))
        )

    present = F.filter("roles", lambda r: _box(r).isNotNull())
    return F.filter(F.transform(present, out), lambda h: h.isNotNull())


def judge(pics: DataFrame, rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Violations of ``rules`` (``RULES``) by pictures (keys, boxes, obstacles, configured), where ``obstacles`` maps names
    to (x, y, w, h, pad) and ``configured`` roles to the boxes given by the specification. Missing metrics are reported
    for each role; a picture without any metrics, its ``boxes`` null, is reported as a whole."""
    bare = pics.filter("boxes is null").select(*keys, F.lit("missing_render_metrics").alias("rule"), F.lit("").alias("roles"), F.lit(None).cast("string").alias("actual"), F.lit("report").alias("expected"))
    rules = F.broadcast(rules) if rules.count() <= RULE_ROWS else rules
    rows = pics.filter("boxes is not null").join(rules, "template")
    lost = F.transform(F.filter("roles", lambda r: _box(r).isNull()), lambda r: _hit(F.concat(F.col("kind"), F.lit(".missing_metric")), r, None, F.col("metric")))
    kind = F.col("kind")
    found = F.when(kind == "alignment", _alignment()).when(kind == "spacing", _pair(_spacing)).when(kind == "non_overlap", _pair(_non_overlap)).when(kind == "obstacle_clearance", _obstacles()).when(kind == "containment", _containment())
    hits = F.concat(lost.cast(_FOUND), F.coalesce(found.cast(_FOUND), F.array().cast(_FOUND)))
    return rows.select(*keys, F.inline(hits)).unionByName(bare).withColumn("severity", F.lit("error"))


#: limit name, metric name, whether the limit is a minimum.
LIMITS = (("min_font_size", "font_size", True), ("min_font_scale", "font_scale", True), ("max_height_density", "height_density", False), ("max_lines", "line_count", False), ("max_content_center_offset", "center_offset", False))


def typography(metrics: DataFrame, ident: Sequence[str]) -> DataFrame:
    """Rows with limit and metric columns, one violation for each limit broken or without its metric. The line count
    falls back on the lines, the font scale on the sizes; values are reported to four places."""
    lines = F.coalesce(F.col("line_count"), F.when(F.col("lines").isNotNull(), F.size("lines")))
    scale = F.coalesce(F.col("font_scale"), F.when(F.col("max_font_size") > 0, F.col("font_size") / F.col("max_font_size")))
    value = {"line_count": lines, "font_scale": scale}
    checks = []
    for limit, metric, least in LIMITS:
        v = value.get(metric, F.col(metric)).cast("double")
        broken = (v < F.col(limit)) if least else ((F.abs(v) if metric == "center_offset" else v) > F.col(limit))
        hit = F.when(v.isNull(), _hit(f"typography.{limit}.missing_metric", F.lit(""), None, F.lit(metric))).when(broken, _hit(f"typography.{limit}", F.lit(""), F.round(v, 4), F.col(limit).cast("double")))
        checks.append(F.when(F.col(limit).isNotNull(), hit))
    hits = metrics.select(*ident, F.inline(F.filter(F.array(*checks), lambda c: c.isNotNull())))
    return hits.drop("roles")


def unnecessary_wrap(lines: Column, single: Column) -> Column:
    return F.when(lines.isNull() | single.isNull(), F.lit("typography.forbid_unnecessary_wrap.missing_metric")).when((lines > 1) & single, F.lit("typography.unnecessary_wrap"))


def short_last_line(widths: Column, ratio: Column) -> Column:
    """Whether the last of several lines is below the given share of the widest."""
    return (F.size(widths) > 1) & (F.element_at(widths, -1) < ratio * F.array_max(widths))


def squeezed(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACES}+", "")


def split_terms(lines: Column, terms: Column) -> Column:
    """Those of the terms that stand in the joined lines but in no single one, white space aside. ``lines`` are without
    white space already (``squeezed``)."""
    joined = F.array_join(lines, "")
    return F.filter(terms, lambda t: (squeezed(t) != "") & F.contains(joined, squeezed(t)) & ~F.exists(lines, lambda s: F.contains(s, squeezed(t))))


def forbidden_edges(lines: Column, starts: Sequence[str], ends: Sequence[str]) -> Column:
    """Array of (index, kind) of lines that, white space at their ends aside, start or end with something forbidden."""
    hits = F.flatten(
        F.transform(
            F.transform(lines, strip),
            lambda s, i: F.array(
                F.when(F.exists(F.array(*map(F.lit, starts)), lambda p: F.startswith(s, p)), F.struct(i.alias("i"), F.lit("start").alias("kind"))),
                F.when(F.exists(F.array(*map(F.lit, ends)), lambda p: F.endswith(s, p)), F.struct(i.alias("i"), F.lit("end").alias("kind"))),
            ),
        )
    )
    return F.filter(hits, lambda h: h.isNotNull())

"""Scalar rules of layout and naming as Column builders; all run inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that strip and split treat as white space.
SPACES = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def language_key(c: Column) -> Column:
    return F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit("-"))


def base_language(c: Column) -> Column:
    return F.substring_index(c, "-", 1)


def is_rtl(c: Column) -> Column:
    """Whether any character lies in the Hebrew to Arabic range."""
    return c.rlike(r"[\x{0590}-\x{08FF}]")


def resolved_direction(direction: Column, text: Column) -> Column:
    wanted = F.coalesce(direction, F.lit("auto"))
    return (
        F.when(wanted == "auto", F.when(is_rtl(text), F.lit("rtl")).otherwise(F.lit("ltr")))
        .when(wanted.isin("ltr", "rtl"), wanted)
        .otherwise(F.raise_error(F.concat(F.lit("unknown direction: "), wanted)).cast("string"))
    )


def physical_alignment(physical: Column, align: Column, direction: Column) -> Column:
    """The physical side wins; else ``force-left`` is left, and left turns right in right-to-left text."""
    wanted = F.coalesce(align, F.lit("left"))
    return F.coalesce(
        physical,
        F.when(wanted == "force-left", F.lit("left")).when((direction == "rtl") & (wanted == "left"), F.lit("right")).otherwise(wanted),
    )


def resolve_path(path: Column, base: str, bundle: str, prefix: str = "@skill/") -> Column:
    return (
        F.when(path.startswith(prefix), F.concat(F.lit(bundle + "/"), F.substring(path, F.lit(len(prefix) + 1), F.length(path))))
        .when(path.startswith("/"), path)
        .otherwise(F.concat(F.lit(base + "/"), path))
    )


def first_truthy(*options: Column) -> Column:
    """The first option that is neither null nor empty."""
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options])


def variant_identifier(ident: Column, language: Column) -> Column:
    return first_truthy(ident, language, F.lit("default"))


def edge_value(edge: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Coordinate of one of the six edges that QA rules know."""
    sides = {"left": x, "right": x + w, "top": y, "bottom": y + h, "center_x": x + w / 2, "center_y": y + h / 2}
    out = F.when(F.lit(False), F.lit(0.0))
    for name, value in sides.items():
        out = out.when(edge == name, value.cast("double"))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown edge: "), edge)).cast("double"))


def padded_box(x: Column, y: Column, w: Column, h: Column, pad: Sequence[int], width: int, height: int) -> list[Column]:
    """x, y, w, h of a box grown by left, top, right, bottom and kept on the canvas."""
    left, top, right, bottom = pad
    x0, y0 = F.greatest(F.lit(0), x - left), F.greatest(F.lit(0), y - top)
    return [x0, y0, F.least(F.lit(width), x + w + right) - x0, F.least(F.lit(height), y + h + bottom) - y0]


def infer_alignment(x: Column, w: Column, total: Column) -> Column:
    """Center if both margins differ by no more than 4 or 6 percent of the width; else the side of the smaller one."""
    right = total - x - w
    return F.when(F.abs(x - right) <= F.greatest(F.lit(4.0), total * F.lit(0.06)), F.lit("center")).when(x < right, F.lit("left")).otherwise(F.lit("right"))


def fit_scale(mode: Column, sw: Column, sh: Column, bw: Column, bh: Column) -> list[Column]:
    """Width, height and offsets of a source in a box under contain, cover or stretch; sizes round half to even."""
    rx, ry = bw / sw, bh / sh
    scale = F.when(mode == "cover", F.greatest(rx, ry)).otherwise(F.least(rx, ry))
    w = F.when(mode == "stretch", bw).otherwise(F.greatest(F.lit(1), F.bround(sw * scale).cast("long")))
    h = F.when(mode == "stretch", bh).otherwise(F.greatest(F.lit(1), F.bround(sh * scale).cast("long")))
    return [w.cast("long"), h.cast("long"), F.floor((bw - w) / 2).cast("long"), F.floor((bh - h) / 2).cast("long")]


def hex_color(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02X%02X%02X", r.cast("int"), g.cast("int"), b.cast("int"))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACES}+|{SPACES}+$", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.regexp_extract(F.lower(F.element_at(F.split(path, "/"), -1)), r"[^.](\.[^.]+)$", 1)


def is_bold(path: Column) -> Column:
    return F.lower(stem(path)).rlike("bold|black|heavy|semibold")


KINDS = {
    "image": (".png", ".jpg", ".jpeg", ".gif", ".webp", ".tif", ".tiff"),
    "font": (".ttf", ".otf", ".ttc", ".woff", ".woff2"),
    "spreadsheet": (".xlsx", ".xls", ".csv", ".tsv"),
    "vector": (".svg",),
}


def asset_kind(path: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for kind, names in KINDS.items():
        out = out.when(suffix(path).isin(*names), F.lit(kind))
    return out.otherwise(F.lit("other"))


def safe_output(path: Column) -> Column:
    """Whether a path is relative and never climbs."""
    return ~path.startswith("/") & ~F.exists(F.split(path, "/"), lambda p: p == "..") & (path != "")


def element_text(rows: DataFrame, language: Column) -> DataFrame:
    """Rows (fixed, vals, value_key, copy_key, role) with the stripped ``text`` of each element and its ``language``;
    elements without any text are left out. An empty fixed text counts as none, and it is English."""
    key = F.coalesce("value_key", "copy_key", "role")
    text = strip(F.coalesce(F.nullif(F.col("fixed"), F.lit("")), F.try_element_at("vals", key), F.lit("")))
    own = F.when(F.col("fixed") != "", F.lit("en")).otherwise(language)
    return rows.withColumns({"text": text, "language": own}).filter("text <> ''")

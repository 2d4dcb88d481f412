"""Queries over text segmentation, wrapping, fitting and placement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gantrel.functions import text as T
from gantrel.sources.tables import projection, with_projections

from .registry import query

W = with_projections
_P = r"'(?s)((?:\x{200D}+[^\x{200D}]?|[^\x{200D}])(?:\p{M}|\x{200D}+[^\x{200D}]?)*)'"
_MARKS = [("thai", "กิบุคู้"), ("zwj", "a‍bc"), ("combining", "éöx"), ("variation", "☀️a"), ("empty", "")]
_V = "(VALUES " + ", ".join(f"('{n}', '{t}')" for n, t in _MARKS) + ") AS s(name, text)"
_TEXTS = f"SELECT CAST(doc_id AS VARCHAR) AS name, text FROM documents UNION ALL SELECT name, text FROM {_V}"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """All whole documents, and some texts of joining signs."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("name"), "text")
    return docs.unionByName(spark.createDataFrame(_MARKS, "name string, text string"))


@query(f"SELECT name, CAST(len(c) AS BIGINT) AS n, c[1] AS first, c[-1] AS last, md5(array_to_string(c, '|')) AS cuts FROM (SELECT name, regexp_extract_all(text, {_P}, 1) AS c FROM ({_TEXTS}) t) u")
def grapheme_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d).withColumn("c", T.clusters(F.col("text")))
    return rows.select("name", F.size("c").cast("long").alias("n"), F.try_element_at("c", F.lit(1)).alias("first"), F.try_element_at("c", F.lit(-1)).alias("last"), F.md5(F.array_join("c", "|").cast("binary")).alias("cuts"))


_SPACES = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_BREAKS = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
_WORDS = r"list_filter(string_split_regex({}, '[\t-\r\x{{1C}}-\x{{20}}\x{{85}}\x{{A0}}]+'), lambda w: w <> '')"


def _parts(source: str) -> str:
    """The source's rows with each paragraph of their text as ``line``, numbered."""
    return f"SELECT *, unnest(CASE WHEN len(ps) > 1 AND ps[-1] = '' THEN list_slice(ps, 1, len(ps) - 1) ELSE ps END) AS line, unnest(range(CASE WHEN len(ps) > 1 AND ps[-1] = '' THEN len(ps) - 1 ELSE len(ps) END)) AS i FROM (SELECT *, string_split_regex(text, '{_BREAKS}') AS ps FROM ({source}) t0) t1"



def _width(u: str) -> str:
    return rf"(CASE WHEN regexp_matches({u}, '[\p{{M}}\x{{200D}}]') THEN len(regexp_extract_all({u}, {_P}, 1)) ELSE length({u}) END)"


def _wrapped(words: str, n: str) -> str:
    """Greedy lines of a list of words, as one text."""
    fold = f"list_reduce(list_transform({words}, lambda u0: {{'done': '', 'line': u0}}), lambda a, b: CASE WHEN {_width(chr(40) + 'a.line || chr(32) || b.line' + chr(41))} <= {n} THEN {{'done': a.done, 'line': a.line || ' ' || b.line}} ELSE {{'done': a.done || a.line || chr(10), 'line': b.line}} END)"
    return f"(CASE WHEN len({words}) = 0 THEN '' ELSE {fold}.done || {fold}.line END)"


def _clustered(c: str, n: str) -> str:
    """Greedy lines of a list of clusters, as one text."""
    trim = lambda x: f"regexp_replace({x}, '{_SPACES}+$', '')"
    opens = f"regexp_replace(b.line, '^{_SPACES}+', '')"
    fold = f"list_reduce(list_transform(CASE WHEN len({c}) = 0 THEN [''] ELSE {c} END, lambda u0: {{'done': '', 'line': u0, 'wide': 1}}), lambda a, b: CASE WHEN a.wide + 1 <= {n} THEN {{'done': a.done, 'line': a.line || b.line, 'wide': a.wide + 1}} ELSE {{'done': a.done || {trim('a.line')} || chr(10), 'line': {opens}, 'wide': CASE WHEN {opens} = '' THEN 0 ELSE 1 END}} END)"
    return f"(SELECT CASE WHEN len({c}) = 0 THEN '' ELSE f.done || {trim('f.line')} END FROM (SELECT {fold} AS f) q)"


@query(f"SELECT name, i, {_wrapped('w', '40')} AS wrapped FROM (SELECT name, i, {_WORDS.format('line')} AS w FROM ({_parts(_TEXTS)}) t) u")
def wrap_units(spark: SparkSession, d: str) -> DataFrame:
    """Every paragraph wrapped by words at 40."""
    lines = _texts(spark, d).select("name", F.posexplode(T.paragraphs(F.col("text"))).alias("i", "line"))
    return lines.select("name", F.col("i").cast("long").alias("i"), F.array_join(T.wrap_words(F.col("line"), F.lit(40)), "\n").alias("wrapped"))


_MODE = "CASE length(name) % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'word' WHEN 2 THEN 'grapheme' ELSE 'auto' END"


@query(f"""SELECT name, i, mode, CASE WHEN mode = 'manual' THEN line WHEN mode = 'word' OR (mode = 'auto' AND len(w) > 1 AND len(list_filter(w, lambda x: {_width('x')} > 12)) = 0) THEN {_wrapped('w', '12')}
ELSE {_clustered('c', '12')} END AS wrapped FROM (SELECT name, i, line, {_WORDS.format('line')} AS w, regexp_extract_all(line, {_P}, 1) AS c, {_MODE} AS mode FROM ({_parts(_TEXTS)}) t) u""")
def wrap_paragraph(spark: SparkSession, d: str) -> DataFrame:
    """Every paragraph under one of four modes at 12."""
    lines = _texts(spark, d).select("name", F.expr(_MODE).alias("mode"), F.posexplode(T.paragraphs(F.col("text"))).alias("i", "line"))
    return lines.select("name", F.col("i").cast("long").alias("i"), "mode", F.array_join(T.wrap_paragraph(F.col("line"), F.lit(12), F.col("mode")), "\n").alias("wrapped"))


@query(f"SELECT name, CAST(sum(len(ls)) AS BIGINT) AS n, CAST(max(list_max(list_transform(ls, lambda s: {_width('s')}))) AS BIGINT) AS widest FROM (SELECT name, string_split({_wrapped('w', '60')}, chr(10)) AS ls FROM (SELECT name, {_WORDS.format('line')} AS w FROM ({_parts(_TEXTS)}) t) u) v GROUP BY name")
def wrap_text(spark: SparkSession, d: str) -> DataFrame:
    """Number and width of the lines of whole documents at 60. Paragraphs are rows, so a long document is wrapped by many
    tasks and only its line widths come together."""
    lines = _texts(spark, d).select("name", F.explode(T.paragraphs(F.col("text"))).alias("line"))
    wrapped = lines.select("name", T.wrap_words(F.col("line"), F.lit(60)).alias("w"))
    return wrapped.groupBy("name").agg(F.sum(F.size("w")).cast("long").alias("n"), F.max(F.array_max(F.transform("w", T.width))).cast("long").alias("widest"))


@query(f"SELECT name, CAST({_width('text')} AS BIGINT) AS width, CAST(7 * {_width('text')} AS BIGINT) AS pixels FROM ({_TEXTS}) t")
def text_width(spark: SparkSession, d: str) -> DataFrame:
    """Width of whole texts under the width model, and at a font size of 14, half of which a cluster is wide."""
    return _texts(spark, d).select("name", T.width(F.col("text")).cast("long").alias("width"), (7 * T.width(F.col("text"))).cast("long").alias("pixels"))


_FIT_TEXT = "c_mktsegment || CASE WHEN c_custkey % 5 = 0 THEN chr(10) ELSE ' ' END || c_name || CASE WHEN c_custkey % 7 = 0 THEN ' é' || chr(769) || ' ' || chr(769) || 'x' ELSE '' END || repeat(' word', CAST(c_custkey % 9 AS INTEGER))"
_FIT_MODE = "CASE c_custkey % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'word' WHEN 2 THEN 'grapheme' ELSE 'manual' END"


@query(f"""WITH c AS (SELECT c_custkey AS k, {_FIT_TEXT} AS text, {_FIT_MODE} AS mode, CASE WHEN c_custkey % 3 = 0 THEN 18 END AS single FROM customer),
z AS (SELECT CAST(range AS BIGINT) AS z, CAST(floor(480 / range) AS BIGINT) AS lim FROM range(12, 41)),
p AS (SELECT k, mode, line, i, list_transform({_WORDS.format('line')}, lambda x: {{'n': 1, 'wide': {_width('x')}, 'joined': {_width("(' ' || x)")}, 'ok': true}}) AS w, list_transform(regexp_extract_all(line, {_P}, 1), lambda x: {{'n': 1, 'wide': 1, 'blank': regexp_matches(x, '^{_SPACES}+$')}}) AS c, {_width('line')} AS whole FROM ({_parts('SELECT * FROM c')}) t),
g AS (SELECT k, z, i, CASE WHEN mode = 'manual' THEN {{'n': 1, 'ok': whole <= lim}}
  WHEN mode = 'word' OR (mode = 'auto' AND len(w) > 1 AND len(list_filter(w, lambda x: x.wide > lim)) = 0) THEN
    (SELECT {{'n': coalesce(f.n, 1), 'ok': len(list_filter(w, lambda x: x.wide > lim)) = 0}} FROM (SELECT CASE WHEN len(w) > 0 THEN list_reduce(w, lambda a, b: CASE WHEN a.wide + b.joined <= lim THEN {{'n': a.n, 'wide': a.wide + b.joined, 'joined': b.joined, 'ok': a.ok}} ELSE {{'n': a.n + 1, 'wide': b.wide, 'joined': b.joined, 'ok': a.ok}} END) END AS f) q)
  ELSE (SELECT {{'n': coalesce(f.n, 1), 'ok': lim >= 1}} FROM (SELECT CASE WHEN len(c) > 0 THEN list_reduce(c, lambda a, b: CASE WHEN a.wide + 1 <= lim THEN {{'n': a.n, 'wide': a.wide + 1, 'blank': b.blank}} ELSE {{'n': a.n + 1, 'wide': CASE WHEN b.blank THEN 0 ELSE 1 END, 'blank': b.blank}} END) END AS f) q) END AS r FROM p CROSS JOIN z),
fit AS (SELECT k, z, CAST(sum(r.n) AS BIGINT) AS n FROM g GROUP BY k, z HAVING bool_and(r.ok) AND sum(r.n) <= 3 AND sum(r.n) * z * 112 <= 100 * 90),
best AS (SELECT k, max(z) AS z, arg_max(n, z) AS n FROM fit GROUP BY k),
one AS (SELECT k, (SELECT max(z.z) FROM z WHERE z.z >= single AND {_width('text')} * z.z <= 480 AND z.z * 112 <= 9000) AS z FROM c WHERE single IS NOT NULL AND NOT contains(text, chr(10)))
SELECT c.k AS c_custkey, coalesce(one.z, best.z) AS size, CASE WHEN one.z IS NOT NULL THEN 1 ELSE best.n END AS lines, CASE WHEN one.z IS NOT NULL THEN 'single_line_preferred' WHEN best.n > 1 THEN 'wrapped' WHEN best.n = 1 THEN 'single_line' END AS fit_mode
FROM c LEFT JOIN one ON one.k = c.k LEFT JOIN best ON best.k = c.k""")
def fit_text(spark: SparkSession, d: str) -> DataFrame:
    """Size, lines and way of fitting, under all wrap modes, with line ends and with a preference for one line.
    Customers are few bytes and much work, so they are dealt over all tasks, whatever files and row groups they lie in."""
    mark = F.lit(chr(769))
    text = F.concat("c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, F.lit("\n")).otherwise(F.lit(" ")), "c_name", F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit(" é"), mark, F.lit(" "), mark, F.lit("x"))).otherwise(F.lit("")), F.repeat(F.lit(" word"), (F.col("c_custkey") % 9).cast("int")))
    single = F.when(F.col("c_custkey") % 3 == 0, F.lit(18))
    fit = T.fit_size(text, 240, 90, 12, 40, 3, F.expr(_FIT_MODE), single)
    rows = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_mktsegment", "c_name").repartition("c_custkey").select("c_custkey", fit.alias("f"))
    return rows.select("c_custkey", F.col("f.size").cast("long").alias("size"), F.col("f.lines").cast("long").alias("lines"), "f.fit_mode")


@query(W("SELECT k, (10 + k % 30) / (10.0 + k % 40) AS font_scale, CAST(round_even(1000 * (1 + k % 3) * (10 + k % 30) / (1.0 * h), 0) AS BIGINT) AS density, (10 + k % 12) * 6 <= w AS single_line_possible FROM boxes", "boxes"))
def text_metrics(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    size = 10 + k % 30
    return projection(spark, d, "boxes").select("k", (size / (10.0 + k % 40)).alias("font_scale"), F.bround(1000 * (1 + k % 3) * size / (1.0 * F.col("h"))).cast("long").alias("density"), ((10 + k % 12) * 6 <= F.col("w")).alias("single_line_possible"))


_LINES = "SELECT k, i, x, y, w, h, 1 + k % 3 AS n, 40 + (k * 7 + i * 13) % 60 AS lw, 12 + (k + i) % 8 AS lh FROM boxes CROSS JOIN (SELECT CAST(range AS BIGINT) AS i FROM range(3)) r WHERE i < 1 + k % 3"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    rows = projection(spark, d, "boxes").withColumn("n", 1 + F.col("k") % 3).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    return rows.select("k", "i", "x", "y", "w", "h", "n", (40 + (F.col("k") * 7 + F.col("i") * 13) % 60).alias("lw"), (12 + (F.col("k") + F.col("i")) % 8).alias("lh"))


@query(W(f"""SELECT k, i, CAST(CASE k % 3 WHEN 0 THEN x WHEN 1 THEN x + w - lw ELSE round_even(x + (w - lw) / 2, 0) END AS BIGINT) AS lx,
CAST(round_even(y + (h - (sum(lh) OVER (PARTITION BY k) + 4 * (n - 1))) / 2, 0) AS BIGINT) + CAST(coalesce(sum(lh + 4) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ly FROM ({_LINES}) t""", "boxes"))
def line_layout(spark: SparkSession, d: str) -> DataFrame:
    """Places of lines inside their box, by alignment, centered in height."""
    w = Window.partitionBy("k")
    total = F.sum("lh").over(w) + 4 * (F.col("n") - 1)
    before = F.sum(F.col("lh") + 4).over(w.orderBy("i")) - F.col("lh") - 4
    side = F.when(F.col("k") % 3 == 0, F.col("x").cast("double")).when(F.col("k") % 3 == 1, (F.col("x") + F.col("w") - F.col("lw")).cast("double")).otherwise(F.bround(F.col("x") + (F.col("w") - F.col("lw")) / 2))
    return _lines(spark, d).select("k", "i", side.cast("long").alias("lx"), (F.bround(F.col("y") + (F.col("h") - total) / 2).cast("long") + before).alias("ly"))


@query(W(f"SELECT k, min(x + i) AS x, min(y + i * 20) AS y, max(x + i + lw) - min(x + i) AS w, max(y + i * 20 + lh) - min(y + i * 20) AS h FROM ({_LINES}) t GROUP BY k", "boxes"))
def ink_box(spark: SparkSession, d: str) -> DataFrame:
    """Union of the boxes of a text's lines."""
    x, y = F.col("x") + F.col("i"), F.col("y") + F.col("i") * 20
    g = _lines(spark, d).groupBy("k").agg(F.min(x).alias("x"), F.min(y).alias("y"), F.max(x + F.col("lw")).alias("r"), F.max(y + F.col("lh")).alias("b"))
    return g.select("k", "x", "y", (F.col("r") - F.col("x")).alias("w"), (F.col("b") - F.col("y")).alias("h"))


@query(W(f"SELECT k, CAST(round(10000 * median(g) / (10 + k % 30), 0) AS BIGINT) AS pitch FROM (SELECT k, y - lag(y) OVER (PARTITION BY k ORDER BY i) AS g FROM (SELECT k, i, y + i * 20 + (k * (i + 1)) % 5 AS y FROM ({_LINES}) t) u) v WHERE g IS NOT NULL GROUP BY k", "boxes"))
def line_pitch(spark: SparkSession, d: str) -> DataFrame:
    """Median distance of line tops over the font size, in ten-thousandths."""
    top = F.col("y") + F.col("i") * 20 + (F.col("k") * (F.col("i") + 1)) % 5
    gaps = _lines(spark, d).withColumn("top", top).withColumn("g", F.col("top") - F.lag("top").over(Window.partitionBy("k").orderBy("i"))).filter("g is not null")
    return gaps.groupBy("k").agg(F.percentile("g", F.lit(0.5)).alias("m")).select("k", F.round(10000 * F.col("m") / (10 + F.col("k") % 30)).cast("long").alias("pitch"))


@query(W("""SELECT k, side, CAST(gx AS BIGINT) AS gx, CAST(CASE side WHEN 'left' THEN gx ELSE gx + tw + 8 END AS BIGINT) AS icon_x, CAST(CASE side WHEN 'left' THEN gx + iw + 8 ELSE gx END AS BIGINT) AS text_x FROM (
SELECT *, CASE k % 3 WHEN 0 THEN x WHEN 1 THEN x + w - (iw + 8 + tw) ELSE round_even(x + (w - (iw + 8 + tw)) / 2, 0) END AS gx FROM (SELECT *, 12 + k % 9 AS iw, 20 + k % 50 AS tw, CASE WHEN k % 4 = 0 THEN 'left' WHEN k % 4 = 1 THEN 'right' WHEN (k % 4 = 2) = (k % 5 = 0) THEN 'right' ELSE 'left' END AS side FROM boxes) a) b""", "boxes"))
def icon_text_layout(spark: SparkSession, d: str) -> DataFrame:
    """Icon and text as one aligned group; logical sides turn with the direction (right-to-left where k is a multiple of 5)."""
    k = F.col("k")
    rows = projection(spark, d, "boxes").withColumns({"iw": 12 + k % 9, "tw": 20 + k % 50})
    given, rtl = F.element_at(F.array(*map(F.lit, ("left", "right", "start", "end"))), (k % 4 + 1).cast("int")), k % 5 == 0
    side = F.when(given == "start", F.when(rtl, F.lit("right")).otherwise(F.lit("left"))).when(given == "end", F.when(rtl, F.lit("left")).otherwise(F.lit("right"))).otherwise(given)
    group = F.col("iw") + 8 + F.col("tw")
    gx = F.when(k % 3 == 0, F.col("x").cast("double")).when(k % 3 == 1, (F.col("x") + F.col("w") - group).cast("double")).otherwise(F.bround(F.col("x") + (F.col("w") - group) / 2)).cast("long")
    rows = rows.withColumns({"side": side, "gx": gx})
    left = F.col("side") == "left"
    return rows.select("k", "side", "gx", F.when(left, F.col("gx")).otherwise(F.col("gx") + F.col("tw") + 8).alias("icon_x"), F.when(left, F.col("gx") + F.col("iw") + 8).otherwise(F.col("gx")).alias("text_x"))


@query(W("""SELECT k, CASE WHEN with_arrow IS NOT NULL AND with_arrow >= 24 THEN with_arrow ELSE coalesce(plain, with_arrow) END AS size, with_arrow IS NOT NULL AND with_arrow >= 24 AS arrow, CASE WHEN with_arrow IS NOT NULL AND with_arrow >= 24 THEN arrow_w ELSE 0 END AS arrow_w FROM (
SELECT k, arrow_w, (SELECT max(z) FROM (SELECT CAST(range AS BIGINT) AS z FROM range(12, 41)) r WHERE n * z <= 2 * (w - 2 * pad - reserve) AND z * 112 <= 100 * h) AS with_arrow, (SELECT max(z) FROM (SELECT CAST(range AS BIGINT) AS z FROM range(12, 41)) r WHERE n * z <= 2 * (w - 2 * pad) AND z * 112 <= 100 * h) AS plain FROM (
SELECT *, greatest(8, CAST(round_even(0.45 * reserve, 0) AS BIGINT)) AS arrow_w FROM (SELECT k, w, h, 3 + k % 6 AS n, CAST(round_even(0.36 * h, 0) AS BIGINT) AS pad, CAST(round_even(0.52 * h, 0) AS BIGINT) AS reserve FROM boxes) a) b) c""", "boxes"))
def button_layout(spark: SparkSession, d: str) -> DataFrame:
    """Largest label size with room for the arrow, else without one when that is too small or none fits; if only the size
    with the arrow fits, it stays but the arrow goes."""
    k, w, h = F.col("k"), F.col("w"), F.col("h")
    rows = projection(spark, d, "boxes").select("k", "w", "h", (3 + k % 6).alias("n"), F.bround(0.36 * h).cast("long").alias("pad"), F.bround(0.52 * h).cast("long").alias("reserve"))
    largest = lambda room: (lambda s: F.when(s >= 12, s))(F.least(F.lit(40), F.floor(2 * room / F.col("n")), F.floor(100 * h / 112)).cast("long"))
    rows = rows.withColumns({"with_arrow": largest(w - 2 * F.col("pad") - F.col("reserve")), "plain": largest(w - 2 * F.col("pad"))})
    keep = F.coalesce(F.col("with_arrow") >= 24, F.lit(False))
    arrow = F.greatest(F.lit(8), F.bround(0.45 * F.col("reserve")).cast("long"))
    return rows.select("k", F.when(keep, F.col("with_arrow")).otherwise(F.coalesce("plain", "with_arrow")).alias("size"), keep.alias("arrow"), F.when(keep, arrow).otherwise(F.lit(0)).cast("long").alias("arrow_w"))

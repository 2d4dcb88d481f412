"""Segmentation, wrapping and fitting of text as higher-order functions. Widths come from a model: by default one unit
a cluster, times the font size where one is given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import SPACES

#: A base character with its combining marks, variation selectors and what joiners attach.
CLUSTER = r"(?s)((?:\x{200D}+[^\x{200D}]?|[^\x{200D}])(?:\p{M}|\x{200D}+[^\x{200D}]?)*)"
#: What ends a line.
BREAKS = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def clusters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CLUSTER), F.lit(1))


#: The characters of SPACES.
_SPACES = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Signs that make a cluster of more than one character.
JOINING = r"[\p{M}\x{200D}]"


def width(text: Column) -> Column:
    """Number of clusters; their characters are only taken apart where some join."""
    return F.when(F.rlike(text, F.lit(JOINING)), F.size(clusters(text))).otherwise(F.length(text))


#: What parts words.
GAPS = r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[^{GAPS}]+"), F.lit(0))


def spaced(text: Column) -> Column:
    """The words of the text, with one space between them; most texts have no other gaps and are left as they are."""
    other = F.contains(text, F.lit("  ")) | F.contains(text, F.lit("\xa0")) | F.rlike(text, F.lit(r"\p{Cc}"))
    return F.trim(F.when(other, F.regexp_replace(text, f"[{GAPS}]+", " ")).otherwise(text))


def paragraphs(text: Column) -> Column:
    """Lines of the text; a final line end opens no further one, and an empty text is one empty line."""
    other = F.rlike(text, F.lit(r"[\r\x0B\x0C\x1C-\x1E\x85]")) | F.contains(text, F.lit("\u2028")) | F.contains(text, F.lit("\u2029"))
    split = F.when(other, F.split(text, BREAKS)).otherwise(F.split(text, "\n"))
    return once(split, lambda parts: F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def wrap(units: Column, limit: Column, glue: str) -> Column:
    """Greedy lines of the units, joined by ``glue``; a unit wider than the limit has a line to itself. A line with its
    next unit is measured as a whole, as a mark at the start of a unit joins the glue before it."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("line"))

    def step(acc: Column, unit: Column) -> Column:
        longer = F.concat(acc["line"], F.lit(glue), unit)
        fits = acc["line"].isNotNull() & (width(longer) <= limit)
        return F.when(fits, F.struct(acc["done"].alias("done"), longer.alias("line"))).otherwise(F.struct(F.when(acc["line"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["line"]))).alias("done"), unit.alias("line")))

    return F.aggregate(units, empty, step, lambda acc: F.when(acc["line"].isNull(), F.array(F.lit(""))).otherwise(F.concat(acc["done"], F.array(acc["line"]))))


#: What joins the cluster before it, but for spaces; a space that does, after a joiner; and what starts a cluster.
_JOINED, _JOINED_SPACE, _STARTS = r"(?:[\p{M}\x{200D}]|(?<=\x{200D})[^\x{200D} ])*+", r"(?<=\x{200D}) ", r"(?<!\x{200D})[^\p{M}\x{200D}]"
#: Widest lines of joining signs that are matched, as a match goes as deep into the stack as its line has clusters.
DEEPEST = 256


def wrap_words(text: Column, limit: Column) -> Column:
    """Lines of the words as ``wrap`` has them with a space as glue, matched one after the other."""
    return once(spaced(text), lambda t: _wrap_spaced(t, limit))


def _wrap_spaced(t: Column, limit: Column) -> Column:
    number = lambda n: F.greatest(n, F.lit(0)).cast("string")
    plain = F.concat(F.lit("(?s)(.{1,"), number(limit), F.lit("}(?![^ ])|[^ ]++) ?"))
    joining = F.concat(F.lit(f"(?s)([^ ]{_JOINED}(?:(?:{_JOINED_SPACE}{_JOINED})*{_STARTS}{_JOINED}){{0,"), number(limit - 1), F.lit(f"}}(?:{_JOINED_SPACE}{_JOINED})*(?![^ ])|[^ ]++) ?"))
    lines = lambda pattern: F.regexp_extract_all(t, pattern, F.lit(1))
    joins = F.rlike(t, F.lit(JOINING))
    return F.when(t == "", F.array(F.lit(""))).when((limit >= 1) & ~joins, lines(plain)).when((limit >= 1) & (limit <= DEEPEST), lines(joining)).otherwise(wrap(words(t), limit, " "))


def wrap_clusters(text: Column, limit: Column) -> Column:
    """Greedy lines by cluster; a line neither starts nor ends with white space, but for the start of the first. A cluster
    of white space that would open a line is dropped and takes no room; of any other its leading white space is. At a limit
    below one each cluster has a line to itself, after an empty one."""
    cluster = r"(?:[^\p{M}\x{200D}](?![\p{M}\x{200D}])|(?:\x{200D}++[^\x{200D}]?+|[^\x{200D}])(?:\p{M}|\x{200D}++[^\x{200D}]?+)*+)"
    number = F.greatest(limit, F.lit(1)).cast("string")
    plain = F.concat(F.lit(f"(?s)(?:(?!\\A){SPACES}|(?=.))(.{{0,"), number, F.lit("})"))
    joining = F.concat(F.lit(f"(?s)(?:(?!\\A){SPACES}(?!{JOINING})|(?=.)(?:(?!\\A){SPACES}(?={JOINING}))?)({cluster}{{0,"), number, F.lit("}+)"))
    cut = F.when(F.rlike(text, F.lit(JOINING)), F.regexp_extract_all(text, joining, F.lit(1))).otherwise(F.regexp_extract_all(text, plain, F.lit(1)))
    lines = F.when(text == "", F.array(F.lit(""))).otherwise(F.transform(cut, ends_trimmed))
    return F.when(limit >= 1, lines).otherwise(F.concat(F.array(F.lit("")), F.transform(clusters(text), lambda c: ends_trimmed(F.regexp_replace(c, f"^{SPACES}+", "")))))


def ends_trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(_SPACES))


def by_words(t: Column, limit: Column, mode: Column) -> Column:
    """Whether a paragraph of these words, one space between them, is wrapped by word; auto does if there are several and
    each fits."""
    longer = F.concat(F.lit("(?<![^ ])[^ ]{"), (F.greatest(limit, F.lit(0)) + 1).cast("string"), F.lit("}"))
    fits = F.when(F.rlike(t, F.lit(JOINING)), F.forall(words(t), lambda x: width(x) <= limit)).otherwise(~F.rlike(t, longer))
    return (mode == "word") | ((mode == "auto") & F.contains(t, F.lit(" ")) & fits)


def wrap_paragraph(text: Column, limit: Column, mode: Column) -> Column:
    """Lines under manual, word, grapheme or auto."""
    wrapped = once(spaced(text), lambda t: F.when(by_words(t, limit, mode), _wrap_spaced(t, limit)).otherwise(wrap_clusters(text, limit)))
    return F.when(mode == "manual", F.array(text)).when(mode == "grapheme", wrap_clusters(text, limit)).otherwise(wrapped)


def wrap_text(text: Column, limit: Column, mode: Column) -> Column:
    """Lines of all paragraphs; an empty one is one empty line."""
    return F.flatten(F.transform(paragraphs(text), lambda p: F.when(p == "", F.array(F.lit(""))).otherwise(wrap_paragraph(p, limit, mode))))


def fit_size(text: Column, box_w: int, box_h: int, low: int, high: int, max_lines: int, mode: Column | None = None, single_low: Column | None = None) -> Column:
    """(size, lines, fit_mode) of the largest font size from ``high`` down whose text keeps to the box: a cluster is half
    the size wide, a line 1.12 of it high. Where ``single_low`` is not null and the text has no line end, sizes down to it
    are first tried on one line, unwrapped. All paragraphs are wrapped as ``mode`` says (auto by default). Null if no size
    fits. The text is taken apart once, and lines are counted once for all sizes of one limit, up to ``max_lines``."""
    mode = F.lit("auto") if mode is None else mode
    limits: dict[int, list[int]] = {}
    for size in range(high, low - 1, -1):
        limits.setdefault(2 * box_w // size, []).append(size)
    tries = F.array(*[F.struct(F.lit(limit).alias("limit"), F.lit(sizes[0]).alias("high"), F.lit(sizes[-1]).alias("low")) for limit, sizes in limits.items()])

    def measured(p: Column) -> Column:
        """Words with their own width and that behind a space, their widest and their sum, clusters and the whole width."""
        joins = F.rlike(p, F.lit(JOINING))
        wide = F.when(joins, F.transform(words(p), lambda w: F.struct(width(w).alias("own"), width(F.concat(F.lit(" "), w)).alias("joined")))).otherwise(F.transform(words(p), lambda w: F.struct(F.length(w).alias("own"), (F.length(w) + 1).alias("joined"))))
        parts = once(F.when(mode.isin("word", "auto"), wide), lambda w: F.struct(w.alias("words"), F.coalesce(F.array_max(w["own"]), F.lit(0)).alias("widest"), F.aggregate(w["joined"], F.lit(0), lambda a, x: a + x).alias("total")))
        return F.struct(parts.alias("by_word"), F.when(mode.isin("word", "manual"), F.lit(None)).otherwise(clusters(p)).alias("clusters"), width(p).alias("whole"))

    def folded(p: Column, limit: Column) -> Column:
        """Lines by word, none wider than the limit; of more text than ``max_lines`` hold, any greater number."""

        def step(acc: Column, w: Column) -> Column:
            return F.when((acc["n"] > 0) & (acc["wide"] + w["joined"] <= limit), F.struct(acc["n"].alias("n"), (acc["wide"] + w["joined"]).alias("wide"))).otherwise(F.struct((acc["n"] + 1).alias("n"), w["own"].alias("wide")))

        n = F.aggregate(p["words"], F.struct(F.lit(0).alias("n"), F.lit(0).alias("wide")), step, lambda acc: F.greatest(acc["n"], F.lit(1)))
        return F.when(p["total"] > max_lines * (limit + 1), F.lit(max_lines + 1)).otherwise(n)

    def clustered(units: Column, limit: Column) -> Column:
        """Lines by cluster, from each line's start to the next; white space at such a start takes no room."""

        def step(acc: Column, _: Column) -> Column:
            blank = F.when(F.rlike(F.get(units, acc["at"]), F.lit(f"^{SPACES}+$")), F.lit(1)).otherwise(F.lit(0))
            return F.when(acc["at"] >= F.size(units), acc).otherwise(F.struct((acc["n"] + 1).alias("n"), (acc["at"] + limit + blank).alias("at")))

        start = F.struct(F.lit(1).alias("n"), limit.alias("at"))
        turns = F.sequence(F.lit(1), F.least(F.lit(max_lines), F.floor(F.size(units) / limit)).cast("int"))
        return F.when(F.size(units) <= limit, F.lit(1)).otherwise(F.aggregate(turns, start, step, lambda acc: acc["n"]))

    def lines(p: Column, limit: Column) -> Column:
        """Number of the paragraph's lines, null if one of them is wider than the limit."""
        by_word = (mode == "word") | ((mode == "auto") & (F.size(p["by_word"]["words"]) > 1) & (p["by_word"]["widest"] <= limit))
        return F.when(mode == "manual", F.when(p["whole"] <= limit, F.lit(1))).when(by_word, F.when(p["by_word"]["widest"] <= limit, folded(p["by_word"], limit))).otherwise(F.when(limit >= 1, clustered(p["clusters"], limit)))

    def tried(parts: Column, t: Column) -> Column:
        """The largest size of one limit that keeps to the box, null if none does."""
        n = F.aggregate(parts, F.lit(0), lambda acc, p: F.when(acc <= max_lines, acc + lines(p, t["limit"])))
        return once(n, lambda n: once(F.least(t["high"], F.floor(F.lit(100 * box_h) / (112 * n)).cast("int")), lambda z: F.when((n <= max_lines) & (z >= t["low"]), F.struct(z.alias("size"), n.alias("lines"), F.when(n > 1, F.lit("wrapped")).otherwise(F.lit("single_line")).alias("fit_mode")))))

    nothing = F.lit(None).cast("struct<size:int,lines:int,fit_mode:string>")
    found = once(F.transform(paragraphs(text), measured), lambda parts: F.aggregate(tries, nothing, lambda acc, t: F.when(acc.isNotNull(), acc).otherwise(tried(parts, t))))
    if single_low is None:
        return found
    widest = F.least(F.lit(high), F.floor(F.lit(100 * box_h) / 112).cast("int"))
    single = once(width(text), lambda w: F.when(w > 0, F.least(widest, F.floor(F.lit(2 * box_w) / w).cast("int"))).otherwise(widest))
    on_one = F.when(single_low.isNotNull() & ~F.contains(text, F.lit("\n")), once(single, lambda z: F.when(z >= F.greatest(single_low, F.lit(low)), F.struct(z.alias("size"), F.lit(1).alias("lines"), F.lit("single_line_preferred").alias("fit_mode")))))
    return F.coalesce(on_one, found)


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once for each row, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)

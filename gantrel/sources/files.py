"""File sources: recursive inventories, report files and images, through Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gantrel.functions.scalar import asset_kind, suffix

from .images import probed

REPORT = "variant string, language string, template string, input string, output string, status string, metrics map<string,struct<box:array<double>,safe_box:array<double>,ink_box:array<double>,line_boxes:array<array<int>>,lines:array<string>,font_size:int,max_font_size:int,line_count:int,font_scale:double,height_density:double,content_center_offset_x:double,single_line_possible:boolean>>"


#: Suffixes of image inputs.
IMAGES = ("png", "jpg", "jpeg", "gif", "webp", "tif", "tiff")


def inventory(spark: SparkSession, root: str, algorithm: str = "sha256", glob: str | None = None) -> DataFrame:
    """One row a file under ``root``: path, relative, suffix, bytes, modified, digest and kind; of files with an image's
    suffix also ``header`` (``images.PROBE``), whose error column names damaged ones, and its format, width and height.
    Contents are hashed and probed where they are read."""
    if algorithm not in ("sha256", "sha1"):
        raise ValueError(f"unknown algorithm: {algorithm}")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    digest = F.sha2("content", 256) if algorithm == "sha256" else F.sha1("content")
    relative = F.substring_index(F.col("path"), _base(root), -1)
    kind = asset_kind(relative)
    named = files.select("path", relative.alias("relative"), suffix(relative).alias("suffix"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), digest.alias(algorithm), kind.alias("kind"), probed(F.when(kind == "image", F.col("content"))).alias("p"))
    header = F.when(F.col("kind") == "image", F.col("p"))
    return named.withColumn("header", header).drop("p").withColumns({c: F.col(f"header.{c}") for c in ("format", "width", "height")})


def _base(root: str) -> str:
    """The folder as it stands in the paths of its files."""
    return root.split(":", 1)[-1].lstrip("/").rstrip("/") + "/"


def image_inputs(spark: SparkSession, root: str, suffixes: tuple[str, ...] = IMAGES) -> DataFrame:
    """(path, relative) of the files under ``root`` with one of the suffixes, in either case; contents are not read."""
    either = ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{either}}}").load(root)
    return found.select("path", F.substring_index(F.col("path"), _base(root), -1).alias("relative"))


def copy_plan(found: DataFrame, existing: DataFrame, budget: int, overwrite: bool = False) -> DataFrame:
    """(path, relative, copied, reason): which files go through unchanged. Those of ``budget`` bytes or more need work, and
    one whose output is among ``existing`` (relative) stays where it is unless it may be overwritten."""
    there = existing.select("relative", F.lit(True).alias("__there")).distinct()
    rows = found.join(there, "relative", "left")
    reason = F.when(F.col("bytes") >= budget, F.lit("over budget")).when(F.col("__there") & F.lit(not overwrite), F.lit("output exists"))
    return rows.select("path", "relative", reason.isNull().alias("copied"), reason.alias("reason"))


def read_report(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON array of report rows, or with ``lines`` what ``write_report`` gives, with a fixed schema."""
    return spark.read.schema(REPORT).option("multiLine", not lines).json(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def paired(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files of two listings (relative, ...) by equal file name."""
    name = F.element_at(F.split("relative", "/"), -1)
    a, b = (df.select(name.alias("name"), F.col("relative").alias(side)) for df, side in ((before, "before"), (after, "after")))
    return a.join(b, "name")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images under a folder in long form: origin, y, x, r, g, b, a. Other files give no rows."""
    px = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select("image.*")
    at = F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i")
    byte = lambda k: F.conv(F.hex(F.substring(F.col("data"), (F.col("i") * F.col("nChannels") + k + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    rows = px.select("origin", "width", "nChannels", "data", at)
    gray = F.col("nChannels") == 1
    return rows.select("origin", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).cast("int").alias("x"), F.when(gray, byte(0)).otherwise(byte(2)).alias("r"), F.when(gray, byte(0)).otherwise(byte(1)).alias("g"), byte(0).alias("b"), F.when(F.col("nChannels") == 4, byte(3)).otherwise(F.lit(255)).alias("a"))

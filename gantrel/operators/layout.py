"""Layout resolution as joins: overrides, alignment groups, obstacles, free segments. Box columns are x, y, w, h."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Most rows of a side that a specification gives.
SPECIFICATION_ROWS = 100_000


def specification_sized(side: DataFrame) -> DataFrame:
    """A side that pairs with all rows of another, marked for broadcast once it has been counted; more rows than a
    specification has are an error, as no plan would carry their pairs."""
    n = side.count()
    if n > SPECIFICATION_ROWS:
        raise ValueError(f"{n} rows are no specification")
    return F.broadcast(side)


def overlay(base: DataFrame, patch: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Shallow override: where the patch says ``has_<field>``, its value wins, null included."""
    renamed = patch.select(*keys, *[F.col(f"has_{f}") for f in fields], *[F.col(f).alias(f"__{f}") for f in fields])
    merged = base.join(renamed, list(keys), "left")
    for f in fields:
        merged = merged.withColumn(f, F.when(F.coalesce(F.col(f"has_{f}"), F.lit(False)), F.col(f"__{f}")).otherwise(F.col(f)))
    return merged.drop(*[f"__{f}" for f in fields], *[f"has_{f}" for f in fields])


def resolve_obstacles(base: DataFrame, patch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer overlay of obstacles: a patch marked ``deleted`` removes, other patches replace field by field where
    they have one, and unknown names are added."""
    fields = [c for c in base.columns if c not in keys]
    both = base.join(patch.select(*keys, "deleted", *[F.col(f).alias(f"__{f}") for f in fields]), list(keys), "full_outer")
    return both.filter(~F.coalesce("deleted", F.lit(False))).select(*keys, *[F.coalesce(f"__{f}", f).alias(f) for f in fields])


def align_groups(elements: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Move the members of enabled groups to their group's edge. ``members`` has one row a member: keys, role, edge,
    anchor_role or position, enabled. Anchors are read before any group moves, so groups never chain."""
    anchors = elements.select(*keys, F.col("role").alias("anchor_role"), F.col("x").alias("__ax"), F.col("w").alias("__aw"))
    placed = members.filter(F.coalesce("enabled", F.lit(True))).join(anchors, [*keys, "anchor_role"], "left")
    at = F.when(F.col("edge") == "right", F.col("__ax") + F.col("__aw")).when(F.col("edge") == "center", F.col("__ax") + F.col("__aw") / 2).otherwise(F.col("__ax"))
    placed = placed.select(*keys, "role", "edge", F.coalesce(F.col("position").cast("double"), at.cast("double")).alias("__at"))
    moved = F.when(F.col("edge") == "right", F.col("__at") - F.col("w")).when(F.col("edge") == "center", F.col("__at") - F.col("w") / 2).otherwise(F.col("__at"))
    joined = elements.join(placed, [*keys, "role"], "left")
    return joined.withColumn("x", F.coalesce(moved, F.col("x").cast("double"))).drop("edge", "__at")


def group_errors(elements: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, role, error) of members that no element has, roles in several groups, unknown edges, groups without or
    with two anchors and anchors without a box; empty for a sound specification."""
    enabled = members.filter(F.coalesce("enabled", F.lit(True)))
    known = elements.select(*keys, "role")
    unknown = enabled.join(known, [*keys, "role"], "left_anti").select(*keys, "role", F.lit("unknown member").alias("error"))
    twice = enabled.groupBy(*keys, "role").agg(F.count("*").alias("n")).filter("n > 1").select(*keys, "role", F.lit("in several groups").alias("error"))
    edge = enabled.filter(~F.col("edge").isin("left", "center", "right")).select(*keys, "role", F.lit("unsupported edge").alias("error"))
    anchor = enabled.filter(F.col("position").isNull() == F.col("anchor_role").isNull()).select(*keys, "role", F.lit("one of position and anchor").alias("error"))
    lost = enabled.filter(F.col("anchor_role").isNotNull()).join(known.withColumnRenamed("role", "anchor_role"), [*keys, "anchor_role"], "left_anti").select(*keys, "role", F.lit("anchor without box").alias("error"))
    return unknown.unionByName(twice).unionByName(edge).unionByName(anchor).unionByName(lost)


def subtract_cuts(left: Column, right: Column, cuts: Column) -> Column:
    """The parts of [left, right] that the cuts (array of struct lo, hi) leave, each at least 1 long, in order."""
    start = F.array(F.struct(left.cast("double").alias("lo"), right.cast("double").alias("hi")))

    def step(segments: Column, cut: Column) -> Column:
        pieces = F.transform(
            segments,
            lambda s: F.when((cut["hi"] <= s["lo"]) | (cut["lo"] >= s["hi"]), F.array(s)).otherwise(
                F.filter(
                    F.array(F.struct(s["lo"].alias("lo"), F.least(cut["lo"], s["hi"]).alias("hi")), F.struct(F.greatest(cut["hi"], s["lo"]).alias("lo"), s["hi"].alias("hi"))),
                    lambda p: p["hi"] > p["lo"],
                )
            ),
        )
        return F.filter(F.flatten(pieces), lambda s: s["hi"] - s["lo"] >= 1)

    return F.aggregate(cuts, start, step)


def widest_segment(segments: Column, anchor: Column) -> Column:
    """Of the segments that hold the anchor, else of all, the widest; ties to the midpoint next to it, then the first."""
    holding = F.filter(segments, lambda s: (s["lo"] <= anchor) & (s["hi"] >= anchor))
    pool = F.when(F.size(holding) > 0, holding).otherwise(segments)
    keyed = F.transform(pool, lambda s, i: F.struct((s["hi"] - s["lo"]).alias("w"), (-F.abs((s["lo"] + s["hi"]) / 2 - anchor)).alias("d"), (-i).alias("i"), s["lo"].alias("lo"), s["hi"].alias("hi")))
    return F.array_max(keyed)


def flow_segments(elements: DataFrame, obstacles: DataFrame, keys: Sequence[str], flow_left: Column, flow_right: Column, anchor: Column) -> DataFrame:
    """Each element with the widest free part of its flow region, null where obstacles leave none. Obstacles (with pad)
    count where their padded band meets the element's; cuts are few for each element, so they are gathered in an array."""
    cuts = obstacles.select(*keys, F.struct((F.col("x") - F.col("pad")).cast("double").alias("lo"), (F.col("x") + F.col("w") + F.col("pad")).cast("double").alias("hi"), (F.col("y") - F.col("pad")).alias("top"), (F.col("y") + F.col("h") + F.col("pad")).alias("bottom"), "name").alias("o"))
    by_key = cuts.groupBy(*keys).agg(F.array_sort(F.collect_list("o")).alias("all"))
    joined = elements.join(by_key, list(keys), "left")
    met = F.filter(F.coalesce("all", F.array().cast("array<struct<lo:double,hi:double,top:bigint,bottom:bigint,name:string>>")), lambda o: ~((o["bottom"] <= F.col("y")) | (o["top"] >= F.col("y") + F.col("h"))))
    return joined.withColumn("segment", widest_segment(subtract_cuts(flow_left, flow_right, met), anchor)).drop("all")


def z_order(elements: DataFrame, keys: Sequence[str], z: str = "z", ord_: str = "ord") -> DataFrame:
    return elements.withColumn("draw", F.row_number().over(Window.partitionBy(*keys).orderBy(F.coalesce(F.col(z), F.lit(0)), F.col(ord_))))


def layered_lookup(layers: DataFrame, key: Sequence[str], value: str, priority: str) -> DataFrame:
    """The value of the highest priority for each key, as a pre-aggregated maximum."""
    return layers.groupBy(*key).agg(F.max_by(value, priority).alias(value))

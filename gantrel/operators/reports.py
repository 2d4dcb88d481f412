"""Keyed reports and inventories: upsert, coverage, differences, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_reports(base: DataFrame, update: DataFrame, keys: Sequence[str], metric: str = "metric", status: str = "status") -> DataFrame:
    """Update rows replace base rows of their key in place, but a skipped row without a metric keeps the old one; new
    keys follow in the update's order. Both have ``ord``; the result's ``ord`` counts from 1."""
    fields = [c for c in base.columns if c not in (*keys, "ord", metric)]
    renamed = update.select(*keys, F.lit(True).alias("__new"), F.col("ord").alias("__ord"), F.col(metric).alias("__metric"), *[F.col(f).alias(f"__{f}") for f in fields])
    both = base.withColumn("__old", F.lit(True)).join(renamed, list(keys), "full_outer")
    keep = F.col("__new") & (F.col(f"__{status}") == "skipped") & F.col("__metric").isNull()
    picked = {f: F.when(F.col("__new"), F.col(f"__{f}")).otherwise(F.col(f)) for f in fields}
    value = F.when(F.col("__new") & ~F.coalesce(keep, F.lit(False)), F.col("__metric")).otherwise(F.col(metric))
    return both.select(*keys, *[c.alias(f) for f, c in picked.items()], value.alias(metric), F.struct(F.col("__old").isNull().alias("added"), F.coalesce("ord", "__ord").alias("at")).alias("place"))


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def last_wins(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key, as a pre-aggregated maximum instead of a window."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def coverage(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are missing or unexpected."""
    e, a = expected.select(*keys).distinct(), actual.select(*keys).distinct()
    return e.join(a, list(keys), "left_anti").withColumn("state", F.lit("missing")).unionByName(a.join(e, list(keys), "left_anti").withColumn("state", F.lit("unexpected")))


def inventory_diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """state of every path: added, removed, changed or unchanged, hashes compared null-safely."""
    both = before.select(key, F.col(digest).alias("__b"), F.lit(True).alias("__in_b")).join(after.select(key, F.col(digest).alias("__a"), F.lit(True).alias("__in_a")), key, "full_outer")
    state = F.when(F.col("__in_b").isNull(), F.lit("added")).when(F.col("__in_a").isNull(), F.lit("removed")).when(F.col("__b").eqNullSafe(F.col("__a")), F.lit("unchanged")).otherwise(F.lit("changed"))
    return both.select(key, state.alias("state"))


def collisions(rows: DataFrame, output: Column, order: str, existing: DataFrame | None = None) -> DataFrame:
    """Rows, with their ``output`` and an ``error``, whose output an earlier row also writes or that is among ``existing``
    (output). Only the first row of each output is looked up, so many rows of one output meet in no task."""
    named = rows.withColumn("output", output)
    first = named.groupBy("output").agg(F.min(order).alias("__first"))
    there = (existing.select("output").distinct() if existing is not None else rows.select(F.lit(None).cast("string").alias("output")).limit(0)).withColumn("__there", F.lit(True))
    met = named.join(first.join(there, "output", "left"), "output")
    error = F.when(F.col(order) > F.col("__first"), F.lit("two inputs")).when(F.col("__there"), F.lit("output exists"))
    return met.withColumn("error", error).filter("error is not null").drop("__first", "__there")


def running_offset(size: Column, order: Sequence[str], partition: Sequence[str] = ()) -> Column:
    return F.sum(size).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - size


def overlay_elements(elements: DataFrame, types: set[str], roles: set[str] | None = None) -> DataFrame:
    """Enabled elements (role, type, enabled, box) that have a box, of the given types and, if any are given, roles."""
    wanted = F.coalesce("enabled", F.lit(True)) & F.col("box").isNotNull() & F.coalesce("type", F.lit("text")).isin(*types)
    return elements.filter(wanted & F.col("role").isin(*roles) if roles else wanted)

"""Constrained choices: highest feasible value, first fit, decision tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def highest_feasible(low: int, high: int, feasible: Callable[[Column], Column]) -> Column:
    """Largest integer that passes, by bisection as the size grows with it; null if not even the lowest does."""
    start = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"), F.lit(None).cast("int").alias("best"))
    steps = F.sequence(F.lit(1), F.lit((high - low + 1).bit_length()))

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        ok, live = feasible(mid), acc["lo"] <= acc["hi"]
        return F.struct(F.when(live & ok, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(live & ~ok, mid - 1).otherwise(acc["hi"]).alias("hi"), F.when(live & ok, mid).otherwise(acc["best"]).alias("best"))

    return F.aggregate(steps, start, step, lambda acc: acc["best"])


def first_fit(ladder: Sequence[int], low: int, high: int, feasible: Callable[[Column], Column]) -> Column:
    """The largest rung, clamped to the range, that passes."""
    rungs = sorted({max(low, min(high, r)) for r in ladder}, reverse=True)
    return F.try_element_at(F.filter(F.array(*map(F.lit, rungs)), feasible), F.lit(1))

"""Hooks into the element loop: Python callables given by the user, never paths to execute.

``before_frame`` and ``after_frame`` take the elements' DataFrame and give another. ``draw_element`` takes a row as a dict
(role, type, spec and the picture's context) and gives metrics, or None to leave the element to the built-in drawers; it
runs in Arrow batches, for every type, before the type is looked at."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from types import ModuleType
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = "map<string,string>"


class Hooks(NamedTuple):
    before_frame: Callable[[DataFrame], DataFrame] | None = None
    draw_element: Callable[[dict[str, Any]], dict[str, Any] | None] | None = None
    after_frame: Callable[[DataFrame], DataFrame] | None = None


def load_hooks(source: ModuleType | dict[str, Any] | None) -> Hooks:
    """The hooks that a module or a dict has; what is absent or cannot be called is left out."""
    get = (lambda n: None) if source is None else source.get if isinstance(source, dict) else lambda n: getattr(source, n, None)
    return Hooks(*[f if callable(f := get(n)) else None for n in Hooks._fields])


def _custom(draw: Callable[[dict[str, Any]], dict[str, Any] | None], columns: list[str]) -> Callable[..., Column]:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            got = [draw(row) for row in batch.to_pylist()]
            yield pa.array([None if m is None else [(k, json.dumps(v)) for k, v in m.items()] for m in got], pa.map_(pa.string(), pa.string()))

    return F.arrow_udf(run, METRICS)(F.struct(*columns))


def draw_elements(elements: DataFrame, hooks: Hooks, drawers: dict[str, Column], context: list[str]) -> DataFrame:
    """``elements`` (context, role, type, ...) with ``metrics``: what the hook gives, else the drawer of the type as a map
    column. A type without a drawer raises. Elements that nothing draws, their metrics null, are left out."""
    rows = hooks.before_frame(elements) if hooks.before_frame else elements
    built_in = F.when(F.lit(False), F.lit(None).cast(METRICS))
    for kind, metrics in drawers.items():
        built_in = built_in.when(F.col("type") == kind, metrics.cast(METRICS))
    built_in = built_in.otherwise(F.raise_error(F.concat(F.lit("unsupported element type: "), F.col("type"))).cast(METRICS))
    if hooks.draw_element:
        named = [c for c in rows.columns if c in {*context, "role", "type", "spec", "x", "y", "w", "h"}]
        rows = rows.withColumn("__custom", _custom(hooks.draw_element, named))
        rows = rows.withColumn("metrics", F.when(F.col("__custom").isNotNull(), F.col("__custom")).otherwise(built_in)).drop("__custom")
    else:
        rows = rows.withColumn("metrics", built_in)
    drawn = rows.filter("metrics is not null")
    return hooks.after_frame(drawn) if hooks.after_frame else drawn

"""Grid algorithms that relational operators cannot state, over one bounded image at a time in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label(mask: np.ndarray) -> np.ndarray:
    """8-connected components of a boolean grid, numbered from 1 in reading order of their first pixel: run-length
    labels joined by union-find."""
    height, width = mask.shape
    parent: list[int] = [0]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    labels = np.zeros((height, width), np.int64)
    before: list[tuple[int, int, int]] = []
    for y in range(height):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], mask[y].astype(np.int8), [0]))))
        runs = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            mine = 0
            for pa, pb, pl in before:
                if pa <= b and pb >= a:  # also diagonal
                    r = root(pl)
                    if mine and r != mine:
                        parent[max(r, mine)] = min(r, mine)
                    mine = min(r, mine) if mine else r
            if not mine:
                mine = len(parent)
                parent.append(mine)
            labels[y, a:b] = mine
            runs.append((a, b, mine))
        before = runs
    flat = np.array([root(i) for i in range(len(parent))])
    _, dense = np.unique(flat, return_inverse=True)
    return dense[labels]


def components(pixels: DataFrame, key: str, on: str, min_area: int = 1) -> DataFrame:
    """(key, x, y, w, h, area) of the components of each image, by (y, x). All boxes are found in one pass over the labels."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((int(pdf.y.max()) + 1, int(pdf.x.max()) + 1), bool)
        grid[pdf.y.to_numpy(), pdf.x.to_numpy()] = pdf[on].to_numpy().astype(bool)
        y, x = np.nonzero(grid)
        which = label(grid)[y, x] - 1
        n = int(which.max(initial=-1)) + 1
        low, high = np.full((2, n), np.iinfo(np.int64).max), np.full((2, n), -1)
        for i, at in enumerate((x, y)):
            np.minimum.at(low[i], which, at)
            np.maximum.at(high[i], which, at)
        area = np.bincount(which, minlength=n)
        out = pd.DataFrame({key: pdf[key].iloc[0], "x": low[0], "y": low[1], "w": high[0] - low[0] + 1, "h": high[1] - low[1] + 1, "area": area})
        return out[out.area >= min_area].sort_values(["y", "x"])

    return pixels.select(key, "y", "x", on).groupBy(key).applyInPandas(run, f"{key} bigint, x bigint, y bigint, w bigint, h bigint, area bigint")


def on_grids(pixels: DataFrame, key: str, value: str, out: Sequence[str], f: Callable[[np.ndarray], Sequence[np.ndarray]]) -> DataFrame:
    """(key, y, x, out): what ``f`` makes of the dense grid of each image, one image at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((int(pdf.y.max()) + 1, int(pdf.x.max()) + 1), np.int64)
        grid[pdf.y.to_numpy(), pdf.x.to_numpy()] = pdf[value].to_numpy()
        made = f(grid)
        y, x = np.mgrid[0 : made[0].shape[0], 0 : made[0].shape[1]]
        return pd.DataFrame({key: pdf[key].iloc[0], "y": y.ravel(), "x": x.ravel(), **{n: m.ravel() for n, m in zip(out, made)}})

    schema = f"{key} bigint, y bigint, x bigint, " + ", ".join(f"{n} bigint" for n in out)
    return pixels.select(key, "y", "x", value).groupBy(key).applyInPandas(run, schema)


def median_kernel(height: int, width: int) -> int:
    """An odd size that grows with the shorter side, 9 at least."""
    return max(9, min(height, width) // 8 | 1)


def median_background(pixels: DataFrame, key: str, value: str) -> DataFrame:
    """The median of each pixel's surroundings, as wide as ``median_kernel`` says, edges repeated; and the contrast to it."""

    def run(grid: np.ndarray) -> Sequence[np.ndarray]:
        r = median_kernel(*grid.shape) // 2
        windows = np.lib.stride_tricks.sliding_window_view(np.pad(grid, r, mode="edge"), (2 * r + 1, 2 * r + 1))
        middle = np.stack([np.median(row.reshape(len(row), -1), axis=1) for row in windows]).astype(np.int64)
        return middle, np.abs(grid - middle)

    return on_grids(pixels, key, value, ("background", "contrast"), run)


def expand_and_feather(mask: DataFrame, key: str, value: str, expand: int, passes: int) -> DataFrame:
    """The mask grown by ``expand`` pixels all around, and that smoothed so many times by the 3x3 binomial kernel."""

    def run(grid: np.ndarray) -> Sequence[np.ndarray]:
        grown = np.lib.stride_tricks.sliding_window_view(np.pad(grid, expand, mode="edge"), (2 * expand + 1, 2 * expand + 1)).max(axis=(2, 3))
        soft = grown.astype(float)
        for _ in range(passes):
            p = np.pad(soft, 1, mode="edge")
            p = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
            soft = (p[:-2] + 2 * p[1:-1] + p[2:]) / 16
        return grown, np.rint(soft).astype(np.int64)

    return on_grids(mask, key, value, ("expanded", "feathered"), run)


def morphology(pixels: DataFrame, key: str, value: str, steps: Sequence[tuple[str, int, int]]) -> DataFrame:
    """The values after each of the steps, ("dilate" or "erode", width, height), by running maxima or minima over rows, then
    columns, anchored at half the size; what lies outside counts for neither. An image is shuffled once for all steps."""

    def slide(grid: np.ndarray, size: int, f: Callable) -> np.ndarray:
        out, before = grid.copy(), size // 2
        for i in range(-before, size - before):
            if i < 0:
                out[:, -i:] = f(out[:, -i:], grid[:, :i])
            elif i > 0:
                out[:, :-i] = f(out[:, :-i], grid[:, i:])
        return out

    def run(grid: np.ndarray) -> Sequence[np.ndarray]:
        for kind, width, height in steps:
            f = np.maximum if kind == "dilate" else np.minimum
            grid = slide(slide(grid, width, f).T, height, f).T
        return (grid,)

    return on_grids(pixels, key, value, (value,), run)


def distance_squared(on: np.ndarray) -> np.ndarray:
    """Squared distance of every pixel that is on to the nearest that is off, -1 where there is none: two passes along
    columns, then sideways as far as any pixel can still come nearer."""
    far = 1 << 40
    down = np.where(on, far, 0).astype(np.int64)
    up = down.copy()
    for y in range(1, len(on)):
        down[y] = np.minimum(down[y], down[y - 1] + 1)
        up[-1 - y] = np.minimum(up[-1 - y], up[-y] + 1)
    straight = np.minimum(np.minimum(down, up), 1 << 20) ** 2
    best, r = straight.copy(), 1
    while r < on.shape[1] and r * r < best.max():
        best[:, r:] = np.minimum(best[:, r:], straight[:, :-r] + r * r)
        best[:, :-r] = np.minimum(best[:, :-r], straight[:, r:] + r * r)
        r += 1
    return np.where(best >= 1 << 40, -1, best)


def inverse_warp(pixels: DataFrame, key: str, value: str, matrix: Sequence[Sequence[float]], size: tuple[int, int]) -> DataFrame:
    """Every pixel of a target of ``size`` (width, height) from the source pixel that ``matrix`` takes it to, 0 outside."""
    m = np.array(matrix, float).reshape(3, 3)

    def run(grid: np.ndarray) -> Sequence[np.ndarray]:
        y, x = np.mgrid[0 : size[1], 0 : size[0]]
        u, v, w = (m[i, 0] * x + m[i, 1] * y + m[i, 2] for i in range(3))
        with np.errstate(divide="ignore", invalid="ignore"):
            sx, sy = np.floor(u / w), np.floor(v / w)
        ok = (sx >= 0) & (sy >= 0) & (sx < grid.shape[1]) & (sy < grid.shape[0])
        out = np.zeros(x.shape, np.int64)
        out[ok] = grid[sy[ok].astype(int), sx[ok].astype(int)]
        return (out,)

    return on_grids(pixels, key, value, ("v",), run)


def quadratic_fit(sums: Sequence[Sequence[float]], right: Sequence[float]) -> list[float]:
    """Coefficients of 1, x, y, xx, xy, yy from the normal equations, whose sums Spark has aggregated."""
    return np.linalg.lstsq(np.array(sums, float), np.array(right, float), rcond=None)[0].tolist()


def homography(source: Sequence[tuple[float, float]], target: Sequence[tuple[float, float]]) -> np.ndarray:
    """3x3 matrix that takes four points to four others."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1.0).reshape(3, 3)


def full_quad(width: float, height: float) -> list[tuple[float, float]]:
    """The corners of a canvas, clockwise from the origin."""
    return [(0.0, 0.0), (width, 0.0), (width, height), (0.0, height)]


def matrix_3x3(value: object) -> np.ndarray:
    """Nine numbers in any nesting as a matrix."""
    flat = np.array(value, float).ravel()
    if flat.size != 9 or not np.isfinite(flat).all():
        raise ValueError("a matrix has nine finite numbers")
    return flat.reshape(3, 3)


def quad_matrix(width: Column, height: Column, corners: Column) -> Column:
    """The nine numbers of the matrix that takes the full quad to four corners, an array of four points; null where the
    corners are not four points or lie so that no matrix does."""

    def solve(w: pd.Series, h: pd.Series, quads: pd.Series) -> pd.Series:
        out = []
        for width, height, quad in zip(w, h, quads):
            points = [] if quad is None else [tuple(p) for p in quad if p is not None and len(p) == 2]
            try:
                out.append(homography(full_quad(width, height), points).ravel().tolist() if len(points) == 4 else None)
            except np.linalg.LinAlgError:
                out.append(None)
        return pd.Series(out)

    return F.pandas_udf(solve, "array<double>")(width, height, corners)


def kmeans_rows(values: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Centers of k clusters on a line, best of all contiguous splits (exact for one dimension), in order."""
    order = np.argsort(values, kind="stable")
    v, w = values[order].astype(float), weights[order].astype(float)
    cw, cs, cq = (np.concatenate(([0.0], np.cumsum(a))) for a in (w, w * v, w * v * v))
    cost = lambda a, b: cq[b] - cq[a] - (cs[b] - cs[a]) ** 2 / max(cw[b] - cw[a], 1e-12)
    n, k = len(v), min(k, len(v))
    best = np.full((k + 1, n + 1), np.inf)
    cut = np.zeros((k + 1, n + 1), int)
    best[0, 0] = 0
    for j in range(1, k + 1):
        for b in range(j, n + 1):
            options = [best[j - 1, a] + cost(a, b) for a in range(j - 1, b)]
            cut[j, b] = j - 1 + int(np.argmin(options))
            best[j, b] = min(options)
    out, b = [], n
    for j in range(k, 0, -1):
        a = cut[j, b]
        out.append((cs[b] - cs[a]) / (cw[b] - cw[a]))
        b = a
    return np.array(out[::-1])

"""Neighbourhood operators: smoothed block pooling, majority-style label blur, Gaussian blur, Hann weights."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import RasterMeta, bands_of
from .grid import in_tiles, tile_side, tile_window

#: Gaussian kernels up to this radius are written out and compiled; longer ones walk an array.
COMPILED_RADIUS = 12


def _shares(p: str, r: int, blocks: int) -> Column:
    """The blocks that a pixel's 3-wide mean touches along an axis, with the number of mean positions in each."""
    block = f"CAST({p} div {r} AS INT)"
    before, after = f"{p} % {r} = 0 AND {p} > 0", f"{p} % {r} = {r - 1} AND {p} + 1 < {blocks * r}"
    own = f"named_struct('b', {block}, 'w', 3 - IF({p} % {r} = 0, 1, 0) - IF({p} % {r} = {r - 1}, 1, 0))"
    last, following = f"named_struct('b', {block} - 1, 'w', 1)", f"named_struct('b', {block} + 1, 'w', 1)"
    each = f"CASE WHEN {before} AND {after} THEN array({own}, {last}, {following}) WHEN {before} THEN array({own}, {last}) WHEN {after} THEN array({own}, {following}) ELSE array({own}) END"
    return F.explode(F.expr(each))


def pool(pixels: DataFrame, meta: RasterMeta, r: int, keys: list[str] | None = None) -> DataFrame:
    """Blocks of r x r: the mean over the block of the 3 x 3 mean, zeros beyond the raster counting in both.

    Each pixel goes straight to the blocks that its mean positions fall into (one for inner pixels), with the number of
    positions as its weight, so that one partial aggregation and one shuffle of block sums do it. Integer bands give
    exact numerators n; f = n / (9 r r).
    """
    if r < 1:
        raise ValueError("the block side must be positive")
    bands = bands_of(pixels)
    rows, cols = -(-meta.height // r), -(-meta.width // r)
    near = pixels.select(*(keys or []), "x", _shares("y", r, rows).alias("__y"), *bands).select(*(keys or []), "__y", _shares("x", r, cols).alias("__x"), *bands)
    weight = F.col("__y.w") * F.col("__x.w")
    sums = near.groupBy(*(keys or []), F.col("__y.b").alias("blk_y"), F.col("__x.b").alias("blk_x")).agg(*[F.sum(F.col(b) * weight).alias(f"n{b[1:]}") for b in bands])
    return sums.withColumns({f"f{b[1:]}": F.col(f"n{b[1:]}").cast("double") / F.lit(float(9 * r * r)) for b in bands})


def box_smooth(pixels: DataFrame, meta: RasterMeta, keys: list[str] | None = None) -> DataFrame:
    """The 3 x 3 mean of each band, zeros beyond the raster: pooling with blocks of one pixel."""
    return pool(pixels, meta, 1, keys).withColumnsRenamed({"blk_y": "y", "blk_x": "x"})


def _box_sums(plane: np.ndarray, p: int) -> np.ndarray:
    """Sums over (2p + 1) x (2p + 1) cells, edges repeated: differences of running sums, whatever p."""
    for axis in (1, 0):
        ends = [(0, 0), (0, 0)]
        ends[axis] = (p + 1, p)
        run = np.cumsum(np.pad(plane, ends, "edge"), axis=axis)
        n = plane.shape[axis]
        plane = run[:, 2 * p + 1 :] - run[:, :n] if axis else run[2 * p + 1 :] - run[:n]
    return plane


def blur_labels(labels: DataFrame, meta: RasterMeta, kernel: int = 3, iterations: int = 1, classes: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Each cell's class with the highest box-smoothed share, ties to the lowest class.

    Shares of a class are smoothed ``iterations`` times without rounding, edges repeated. An even kernel grows by one; a
    kernel of one or less changes nothing. Counts are exact integers (doubles where 64 bits can't hold them). Only classes
    below ``classes`` (all, if not given) count; a cell without any in reach, as where all labels are null, gets null.
    Cells go once to tiles with a halo as wide as the smoothing reaches: one shuffle of narrow rows whatever the kernel,
    iterations and classes, and a task holds a tile and one class at a time.
    """
    keys = keys or []
    if kernel <= 1 or iterations < 1:
        return labels
    kernel += kernel % 2 == 0
    p = kernel // 2
    halo = p * iterations
    side = tile_side(halo)
    exact = np.int64 if kernel ** (2 * iterations) < 2**63 else np.float64

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(pdf["__ty"].iloc[0]), int(pdf["__tx"].iloc[0])
        y0, x0, y1, x1 = tile_window(ty, tx, meta, side, halo)
        y, x = pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0
        image = np.full((y1 - y0, x1 - x0), -1, np.int32)
        image[y, x] = pdf["label"].fillna(-1)
        most, won = np.zeros(image.shape, exact), np.full(image.shape, -1, np.int32)
        for k in np.unique(image):
            if k < 0 or classes is not None and k >= classes:
                continue
            count = (image == k).astype(exact)
            for _ in range(iterations):
                count = _box_sums(count, p)
            more = count > most
            most[more], won[more] = count[more], k
        core = (pdf["y"] // side == ty) & (pdf["x"] // side == tx)
        found = pd.Series(won[y, x], pdf.index)
        return pdf.assign(label=found.astype("Int32").where(found >= 0))[core][[*keys, "y", "x", "label"]]

    cells = labels.select(*keys, "y", "x", F.col("label").cast("int").alias("label"))
    kinds = ", ".join(f"`{c}` {kind}" for c, kind in cells.dtypes)
    return in_tiles(cells, meta, side, halo).groupBy(*keys, "__ty", "__tx").applyInPandas(smooth, kinds)


def gaussian_weights(sigma: float) -> list[float]:
    """The normalised kernel; its radius is three sigma, rounded, one at least."""
    radius = max(1, round(3 * sigma))
    raw = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    total = math.fsum(raw)
    return [w / total for w in raw]


def gaussian_plane(plane: np.ndarray, weights: list[float]) -> np.ndarray:
    """One plane blurred along x, then y, edges mirrored; the sums of ``gaussian_blur`` in its order."""
    radius = len(weights) // 2
    for axis in (1, 0):
        ends, n = [(0, 0), (0, 0)], plane.shape[axis]
        ends[axis] = (radius, radius)
        wide, plane = np.pad(plane, ends, "reflect"), np.zeros_like(plane)
        for d, w in enumerate(weights):
            plane += w * (wide[:, d : d + n] if axis else wide[d : d + n])
    return plane


def gaussian_blur(df: DataFrame, meta: RasterMeta, sigma: float, values: list[str], keys: list[str] | None = None) -> DataFrame:
    """Separable Gaussian blur of dense columns, edges mirrored; sigma of zero or less changes nothing.

    Each line gets its mirrored ends as extra rows and one window; the two passes are the two shuffles.
    """
    if sigma <= 0:
        return df
    weights = gaussian_weights(sigma)
    radius = len(weights) // 2
    if radius >= meta.height or radius >= meta.width:
        raise ValueError(f"a mirror of {radius} cells needs a raster longer than that on both axes")
    taps = F.array(*[F.lit(w) for w in weights])

    def along(table: DataFrame, axis: str, other: str, length: int) -> DataFrame:
        c = axis
        low, high = f"{c} BETWEEN 1 AND {radius}", f"{c} BETWEEN {length - 1 - radius} AND {length - 2}"
        left, right = f"-{c}", f"{2 * (length - 1)} - {c}"
        copies = f"CASE WHEN {low} AND {high} THEN array({c}, {left}, {right}) WHEN {low} THEN array({c}, {left}) WHEN {high} THEN array({c}, {right}) ELSE array({c}) END"
        rest = [n for n in table.columns if n != axis]
        wide = table.select(*rest, F.explode(F.expr(copies)).alias(axis))
        line = Window.partitionBy(*(keys or []), other).orderBy(axis)

        def mix(v: str) -> Column:
            if radius > COMPILED_RADIUS:
                return F.aggregate(F.zip_with(F.collect_list(v).over(line.rowsBetween(-radius, radius)), taps, lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
            total = F.lit(0.0)
            for d, w in zip(range(-radius, radius + 1), weights):
                total = total + w * (F.lag(v, -d).over(line) if d < 0 else F.lead(v, d).over(line) if d else F.col(v))
            return total

        mixed = {v: mix(v) for v in values}
        return wide.withColumns(mixed).where(f"{axis} >= 0 AND {axis} < {length}").select(*table.columns)

    start = df.withColumns({v: F.col(v).cast("double") for v in values})
    return along(along(start, "x", "y", meta.width), "y", "x", meta.height)


def hann(i: Column, n: int) -> Column:
    """The Hann window of n points at i; one where n is one or less."""
    return F.lit(1.0) if n <= 1 else 0.5 - 0.5 * F.cos(2 * math.pi * i / (n - 1))


def weight_mask(y: Column, x: Column, size: int) -> Column:
    """The outer product of two Hann windows, scaled so that its largest entry is one."""
    if size <= 1:
        return F.lit(1.0)
    top = max(0.5 - 0.5 * math.cos(2 * math.pi * i / (size - 1)) for i in range(size))
    if top <= 0:  # two points, both at the ends
        raise ValueError("a Hann window of this size has no weight")
    return hann(y, size) * hann(x, size) / (top * top)

"""Chunk results blended by Hann weights, and label harmonisation between chunks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import RasterMeta, bands_of, grid
from ..store import settled
from .focal import gaussian_plane, gaussian_weights, weight_mask
from .grid import chunk_windows, in_tiles, in_windows, tile_side, tile_window

#: Colour distance within which a chunk's label takes over a known prototype (fixed value).
PALETTE = 24.0
#: Rows (chunk, label, target) that are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 500_000


def weighted_scores(chunked: DataFrame, size: int, classes: int) -> DataFrame:
    """(y, x, k, score, weight): sums over chunks of one-hot labels, or given scores, times the chunk's Hann mask.

    ``chunked`` has y, x, y0, x0 of its window, and label or scores (array of doubles). One partial aggregation.
    """
    mask = weight_mask(F.col("y") - F.col("y0"), F.col("x") - F.col("x0"), size)
    hot = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: (k == F.col("label")).cast("double")) if "label" in chunked.columns else F.col("scores")
    rows = chunked.select("y", "x", mask.alias("m"), F.posexplode(hot).alias("k", "s"))
    return rows.groupBy("y", "x", "k").agg(F.sum(F.col("s") * F.col("m")).alias("score"), F.sum("m").alias("weight"))


def blend_sigma(size: int, scale: float = 1.0) -> float:
    """The blur of blended scores."""
    return max(1.0, min(size / 10.0 * max(0.1, scale), 32.0))


def _decided(rows: DataFrame, meta: RasterMeta, sigma: float, planes: Callable) -> DataFrame:
    """(y, x, label) of the whole raster: in each tile, the class whose blurred score has the highest share of its blurred weight.

    Rows (y, x, ...) go to tiles with the blur's halo in one shuffle; ``planes`` gives (class, score, weight) planes of a
    tile's rows one class after the other, so a task holds one tile and a few planes. Ties go to the lowest class.
    """
    weights = gaussian_weights(sigma)
    halo = len(weights) // 2
    if halo >= meta.height or halo >= meta.width:
        raise ValueError(f"a mirror of {halo} cells needs a raster longer than that on both axes")
    side = tile_side(halo)
    tall, wide = -(-meta.height // side), -(-meta.width // side)
    # a row for each tile, so that tiles which no chunk reaches are decided as well
    every = grid(rows.sparkSession, tall, wide).select(F.col("y").alias("__ty"), F.col("x").alias("__tx"))
    dealt = in_tiles(rows, meta, side, halo).unionByName(every, allowMissingColumns=True)

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(pdf["__ty"].iloc[0]), int(pdf["__tx"].iloc[0])
        y0, x0, y1, x1 = tile_window(ty, tx, meta, side, halo)
        pdf = pdf[pdf["y"].notna()]
        cells = (pdf["y"].to_numpy(np.int64) - y0) * (x1 - x0) + pdf["x"].to_numpy(np.int64) - x0
        best, won = np.full((y1 - y0, x1 - x0), -np.inf), np.zeros((y1 - y0, x1 - x0), np.int32)
        known, soft = None, None
        for k, score, weight in planes(pdf, cells, best.shape):
            if weight is not known:  # classes may share one plane of weights
                known, soft = weight, np.maximum(gaussian_plane(weight, weights), 1e-6)
            share = gaussian_plane(score, weights) / soft
            more = share > best
            best[more], won[more] = share[more], k
        core = won[ty * side - y0 : (ty + 1) * side - y0, tx * side - x0 : (tx + 1) * side - x0]
        y, x = np.indices(core.shape, dtype=np.int32)
        return pd.DataFrame({"y": (y + ty * side).ravel(), "x": (x + tx * side).ravel(), "label": core.ravel()})

    return dealt.groupBy("__ty", "__tx").applyInPandas(decide, "y int, x int, label int")


def _plane(cells: np.ndarray, values: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Values summed by cell, smaller ones first, so that the order of rows doesn't show."""
    order = np.argsort(values, kind="stable")
    return np.bincount(cells[order], values[order], shape[0] * shape[1]).reshape(shape).astype(float)  # without rows it counts in integers


def finalize(scores: DataFrame, meta: RasterMeta, size: int, classes: int, scale: float = 1.0) -> DataFrame:
    """Labels of scores (y, x, k, score, weight): scores and weights blurred, their ratio's highest class, ties to the lowest.

    Cells and classes without a row have score and weight zero; the whole raster gets labels.
    """

    def planes(pdf: pd.DataFrame, cells: np.ndarray, shape: tuple[int, int]):
        k, score, weight = pdf["k"].to_numpy(), pdf["score"].fillna(0.0).to_numpy(float), pdf["weight"].fillna(0.0).to_numpy(float)
        for c in range(classes):
            of = k == c
            yield c, _plane(cells[of], score[of], shape), _plane(cells[of], weight[of], shape)

    return _decided(scores.select("y", "x", "k", "score", "weight"), meta, blend_sigma(size, scale), planes)


def blended_labels(chunked: DataFrame, meta: RasterMeta, size: int, classes: int, scale: float = 1.0) -> DataFrame:
    """``finalize`` of the weighted scores of chunk labels (y, x, y0, x0, label), without a row for each class and cell:
    labels with their Hann weights go straight to the tiles and are summed there."""

    def planes(pdf: pd.DataFrame, cells: np.ndarray, shape: tuple[int, int]):
        label, mask = pdf["label"].to_numpy(), pdf["m"].to_numpy(float)
        weight = _plane(cells, mask, shape)
        for c in range(classes):
            of = label == c
            yield c, _plane(cells[of], mask[of], shape), weight

    mask = weight_mask(F.col("y") - F.col("y0"), F.col("x") - F.col("x0"), size)
    return _decided(chunked.select("y", "x", "label", mask.alias("m")), meta, blend_sigma(size, scale), planes)


def match_labels(vectors: DataFrame, classes: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, chunk, label, target): each chunk's labels matched to running prototypes, chunk by chunk in order.

    ``vectors`` (chunk, label, vec) has the mean of each label in each chunk: a few rows a chunk, so that the sequential
    part sees no pixels. A label takes the nearest unused prototype within PALETTE, else an index that none has yet, else
    any unused one, else the nearest.
    """
    keys = keys or []
    table = vectors if keys else vectors.withColumn("__all", F.lit(0))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        seen, known, rows = np.zeros(classes, np.int64), [None] * classes, []
        for chunk, part in pdf.sort_values(["chunk", "label"]).groupby("chunk", sort=True):
            used: set[int] = set()
            for label, vec in zip(part["label"], part["vec"]):
                vec = np.asarray(vec, np.float64)
                gaps = {i: float(np.linalg.norm(known[i] - vec)) for i in range(classes) if seen[i] and i not in used}
                near = min(gaps, key=lambda i: (gaps[i], i), default=None)
                target = near if near is not None and gaps[near] <= PALETTE else None
                if target is None:
                    free = [i for i in range(classes) if i not in used]
                    target = next((i for i in free if not seen[i]), free[0] if free else near)
                if target is None:
                    target = int(label)
                else:
                    used.add(target)
                    known[target] = vec if not seen[target] else (known[target] * seen[target] + vec) / (seen[target] + 1)
                    seen[target] += 1
                rows.append((*[pdf[c].iloc[0] for c in keys], int(chunk), int(label), int(target)))
        return pd.DataFrame(rows, columns=[*keys, "chunk", "label", "target"])

    kinds = ", ".join([*[f"`{c}` {dict(vectors.dtypes)[c]}" for c in keys], "chunk int", "label int", "target int"])
    return table.groupBy(*(keys or ["__all"])).applyInPandas(fold, kinds)


def harmonize(chunked: DataFrame, classes: int) -> DataFrame:
    """``chunked`` (chunk, y, x, bands, label) with labels that mean the same in every chunk."""
    bands = bands_of(chunked)
    means = chunked.groupBy("chunk", "label").agg(F.array(*[F.avg(b) for b in bands]).alias("vec"))
    matched = settled(match_labels(means, classes))  # counted before it is broadcast: it grows with the number of chunks
    small = matched.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return chunked.join(F.broadcast(matched) if small else matched, ["chunk", "label"]).withColumn("label", F.col("target")).drop("target")


def process_in_chunks(pixels: DataFrame, meta: RasterMeta, size: int, stride: int, classes: int, infer: Callable[[np.ndarray], np.ndarray], harmonized: bool = True, scale: float = 1.0) -> DataFrame:
    """Labels of a function over image chunks (bands, h, w) -> (h, w), blended; one call where the raster fits a chunk."""
    bands = bands_of(pixels)
    whole = meta.height <= size and meta.width <= size
    windows = chunk_windows(pixels.sparkSession, meta.height, meta.width, size, stride)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = pdf["y0"].iloc[0], pdf["x0"].iloc[0]
        image = np.zeros((len(bands), pdf["y1"].iloc[0] - y0, pdf["x1"].iloc[0] - x0), np.float64)
        for n, b in enumerate(bands):
            image[n, pdf["y"] - y0, pdf["x"] - x0] = pdf[b]
        found = infer(image)
        found = found.get("labels") if isinstance(found, dict) else found[0] if isinstance(found, (tuple, list)) and len(found) == 2 else found
        if found is None:
            raise ValueError("the function gave no labels")
        return pdf[["chunk", "y", "x", "y0", "x0", *bands]].assign(label=np.asarray(found)[pdf["y"] - y0, pdf["x"] - x0].astype(np.int32))

    kinds = ", ".join(["chunk int", "y int", "x int", "y0 int", "x0 int", *[f"{b} {dict(pixels.dtypes)[b]}" for b in bands], "label int"])
    chunked = in_windows(pixels, windows, size).groupBy("chunk").applyInPandas(run, kinds)
    if whole:
        return chunked.select("y", "x", "label")
    if harmonized:
        chunked = harmonize(chunked, classes)
    return blended_labels(chunked, meta, size, classes, scale)

"""Segmentation from pixels to labels: one lazy plan whose only driver state is the centres."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import BlurConfig, checked_segments
from ..operators import cluster, focal, nearest, refine, resample, tiles
from ..operators.grid import block_windows, cells_of, in_windows, stitch, with_halo
from ..schema import RasterMeta, bands_of, features_of, grid
from ..store import settled


class Canceled(RuntimeError):
    """The caller asked to stop."""


class CancelToken:
    """Asks a run to stop: running jobs are interrupted by their tag, and none starts after."""

    def __init__(self) -> None:
        self.tag, self._asked = f"segmentation-{uuid.uuid4().hex}", threading.Event()

    def cancel(self, spark: SparkSession) -> None:
        self._asked.set()
        spark.interruptTag(self.tag)

    @property
    def canceled(self) -> bool:
        return self._asked.is_set()

    def check(self) -> None:
        if self.canceled:
            raise Canceled("segmentation was canceled")


def tell(callback: Callable[[str], None] | None, message: str) -> None:
    """Pass a message on; a failing callback stops nothing."""
    if callback is not None:
        try:
            callback(message)
        except Exception:
            pass


@dataclass
class Segmentation:
    """Labels of pixels and of blocks, and the centres in the labels' order."""

    labels: DataFrame
    blocks: DataFrame
    centers: list[list[float]]


def segment(
    pixels: DataFrame,
    meta: RasterMeta,
    k: int = 8,
    r: int = 16,
    centers: list[list[float]] | None = None,
    scale: float = 1.0,
    seed: int = 0,
    blur: BlurConfig | None = None,
    backend: str = "lloyd",
    strict: bool = False,
    status: Callable[[str], None] | None = None,
    token: CancelToken | None = None,
) -> Segmentation:
    """Pool, fit on a bounded sample unless centres are given, assign, order by brightness, upsample, blur.

    Centres are fitted once for the whole raster and written into the plan, so blocks are assigned without a shuffle.
    """
    k, token, spark = checked_segments(k), token or CancelToken(), pixels.sparkSession
    spark.addTag(token.tag)
    try:
        token.check()
        rows, cols = -(-meta.height // r), -(-meta.width // r)
        blocks = focal.pool(pixels, meta, r)
        if centers is None:
            tell(status, f"Fitting {k} centres on at most {min(rows * cols, cluster.sample_cap(scale))} blocks (0%)")
            centers = cluster.fit_centers(blocks, rows, cols, k, r, scale, seed, backend, token.check)
        else:
            centers = cluster.by_brightness(centers)
        token.check()
        labelled = nearest.assign(blocks, centers, features_of(blocks), strict).select("blk_y", "blk_x", "label")
        labels = resample.upsample(labelled, meta, r)
        if blur is not None and blur.kernel_size > 1:
            tell(status, f"Smoothing labels with a kernel of {blur.kernel_size} pixels (90%)")
            labels = focal.blur_labels(labels, meta, blur.kernel_size, blur.iterations, len(centers))
        return Segmentation(labels, labelled, centers)
    except Canceled:
        raise
    except Exception as broken:
        if token.canceled:
            raise Canceled("segmentation was canceled") from broken
        raise
    finally:
        spark.removeTag(token.tag)


def segment_in_chunks(pixels: DataFrame, meta: RasterMeta, centers: list[list[float]], r: int, chunk_size: int) -> DataFrame:
    """Block labels written chunk by chunk, the last chunk winning where they overlap.

    Blocks are pooled over the whole raster, so chunks agree and no seam can show; the stitch is there for results that
    do come by chunk. (blk_y, blk_x, label, chunk)
    """
    blocks = focal.pool(pixels, meta, r)
    labelled = nearest.assign(blocks, centers, features_of(blocks)).select("blk_y", "blk_x", "label")
    cover = cells_of(block_windows(pixels.sparkSession, meta.height, meta.width, r, chunk_size), "blk_y", "blk_x").select("chunk", "blk_y", "blk_x")
    return stitch(labelled.join(cover, ["blk_y", "blk_x"]), "label", ["blk_y", "blk_x"])


def segment_displaced(pixels: DataFrame, meta: RasterMeta, centers: list[list[float]], r: int, chunk_size: int, halo: int = 3) -> DataFrame:
    """Block labels as a chunk loop gives them that pools each chunk from the first pixel of its halo. (blk_y, blk_x, label)

    For comparison with such results only. Chunks away from the top or left edge are displaced by the halo, chunks give
    blocks for their size less two halos, and blocks that no chunk gives are labelled zero. Chunks are a key of the pooling,
    so all of them are pooled at once.
    """
    rows, cols = -(-meta.height // r), -(-meta.width // r)
    windows = block_windows(pixels.sparkSession, meta.height, meta.width, r, chunk_size)
    cores = windows.select("chunk", F.col("y0").alias("by"), F.col("x0").alias("bx"), *[(F.col(c) * r).alias(c) for c in ("y0", "x0")], F.least(F.col("y1") * r, F.lit(meta.height)).alias("y1"), F.least(F.col("x1") * r, F.lit(meta.width)).alias("x1"))
    grown = with_halo(cores, halo, meta.height, meta.width)

    def given(low: str, high: str, first: str, most: int):
        size = F.col(high) - F.col(low)
        core = F.when(size > 2 * halo, size - 2 * halo).otherwise(size)
        return F.least(F.ceil(core / r).cast("int"), most - F.col(first))

    read = grown.select("chunk", "by", "bx", F.col("hy0").alias("y0"), F.col("hx0").alias("x0"), F.col("hy1").alias("y1"), F.col("hx1").alias("x1"), given("hy0", "hy1", "by", rows).alias("ny"), given("hx0", "hx1", "bx", cols).alias("nx"))
    local = in_windows(pixels, read, chunk_size).select("chunk", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), *bands_of(pixels))
    blocks = focal.pool(local, RasterMeta(meta.height + 2 * halo + r, meta.width + 2 * halo + r, meta.bands), r, ["chunk"])
    labelled = nearest.assign(blocks, centers, features_of(blocks)).join(read.select("chunk", "by", "bx", "ny", "nx"), "chunk").where("blk_y < ny AND blk_x < nx")
    written = stitch(labelled.select("chunk", (F.col("blk_y") + F.col("by")).alias("blk_y"), (F.col("blk_x") + F.col("bx")).alias("blk_x"), "label"), "label", ["blk_y", "blk_x"])
    every = grid(pixels.sparkSession, rows, cols).select(F.col("y").alias("blk_y"), F.col("x").alias("blk_x"))
    return every.join(written, ["blk_y", "blk_x"], "left").select("blk_y", "blk_x", F.coalesce("label", F.lit(0)).alias("label"))


def segment_latent(
    pixels: DataFrame,
    meta: RasterMeta,
    loader: Callable,
    dims: int,
    k: int = 8,
    t: int = 32,
    latent_per_tile: int = 4,
    centers: list[list[float]] | None = None,
    require_centers: bool = False,
    config: dict | None = None,
    orient: bool = True,
    seed: int = 0,
) -> Segmentation:
    """Segmentation in a model's latent space: tiles, model, K-Means, neighbour refinement, upsampling, tile rotation."""
    if require_centers and centers is None:
        raise RuntimeError("centres are required")
    cut = tiles.tile(pixels, t)
    latent = settled(tiles.latent_grid(cut, loader, t, meta.bands, dims))
    high, wide = -(-meta.height // t) * latent_per_tile, -(-meta.width // t) * latent_per_tile
    cells = latent.select(F.col("y").alias("blk_y"), F.col("x").alias("blk_x"), "vec", *[F.element_at("vec", d + 1).alias(f"f{d}") for d in range(dims)])
    if centers is None:
        centers = cluster.fit_centers(cells.drop("vec"), high, wide, checked_segments(k), None, seed=seed)
    seeds = nearest.assign(cells, centers, [f"f{d}" for d in range(dims)]).select(F.col("blk_y").alias("y"), F.col("blk_x").alias("x"), "label", "vec")
    small = RasterMeta(high, wide, 1)
    refined = refine.refine(seeds, small, centers, config).select("y", "x", "label")
    padded = RasterMeta(-(-meta.height // t) * t, -(-meta.width // t) * t, 1)
    labels = resample.nearest_resize(refined, small, padded, ["label"]).where(f"y < {meta.height} AND x < {meta.width}")
    if orient:
        labels = tiles.turn_tiles(labels, tiles.orientation_plan(labels, t, meta), t, meta)
    return Segmentation(labels, refined.withColumnsRenamed({"y": "blk_y", "x": "blk_x"}), centers)

"""The data model: rasters as tables of pixels, blocks, centres and labels.

pixels   keys..., y int, x int, b0..bN (bigint or double)        one row for each pixel
blocks   keys..., blk_y int, blk_x int, n0..nN, f0..fN            pooled descriptors, n exact numerators
centers  a list of lists of doubles on the driver, k of them
labels   keys..., y int, x int, label int                         or blk_y, blk_x for blocks

``keys`` name the raster (for instance raster_id) where a table holds several of one size; every operator takes them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RasterMeta:
    """Size and georeference of a raster; ``transform`` is (x0, dx, 0, y0, 0, dy)."""

    height: int
    width: int
    bands: int = 3
    transform: tuple[float, ...] | None = None
    epsg: int | None = None

    @staticmethod
    def from_extent(height: int, width: int, bands: int, extent: tuple[float, float, float, float], epsg: int | None) -> RasterMeta:
        """North-up georeference of (xmin, ymin, xmax, ymax)."""
        xmin, ymin, xmax, ymax = extent
        return RasterMeta(height, width, bands, (xmin, (xmax - xmin) / width, 0.0, ymax, 0.0, -(ymax - ymin) / height), epsg)

    @staticmethod
    def of(pixels: DataFrame, transform: tuple[float, ...] | None = None, epsg: int | None = None) -> RasterMeta:
        """Measured from a dense pixel table."""
        r = pixels.agg(F.max("y"), F.max("x")).first()
        return RasterMeta((r[0] if r[0] is not None else -1) + 1, (r[1] if r[1] is not None else -1) + 1, len(bands_of(pixels)), transform, epsg)


def bands_of(pixels: DataFrame) -> list[str]:
    """The band columns b0, b1, ... in order; at least one is needed."""
    bands = sorted((c for c in pixels.columns if c[:1] == "b" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    if not bands:
        raise ValueError("a pixel table needs band columns b0, b1, ...")
    return bands


def features_of(blocks: DataFrame) -> list[str]:
    """The feature columns f0, f1, ... in order."""
    return sorted((c for c in blocks.columns if c[:1] == "f" and c[1:].isdigit()), key=lambda c: int(c[1:]))


def grid(spark, height: int, width: int) -> DataFrame:
    """(y, x) of a dense grid, made in parallel."""
    return spark.range(height * width).select(F.expr(f"CAST(id div {max(width, 1)} AS INT) AS y"), F.expr(f"CAST(id % {max(width, 1)} AS INT) AS x"))

"""Resampling: block labels to pixels, nearest and bilinear resizing, one-hot planes, zonal means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import RasterMeta, bands_of, grid


def upsample(labels: DataFrame, meta: RasterMeta, r: int, keys: list[str] | None = None, value: str = "label") -> DataFrame:
    """Each block's value on its r x r pixels, cut at the raster's edge: generated from the blocks, without a join."""
    side = lambda c, n: F.explode(F.expr(f"sequence(CAST({c} * {r} AS INT), CAST(least({c} * {r} + {r}, {n}) - 1 AS INT))"))
    inside = labels.where(f"blk_y * {r} < {meta.height} AND blk_x * {r} < {meta.width}")
    return inside.select(*(keys or []), side("blk_y", meta.height).alias("y"), "blk_x", value).select(*(keys or []), "y", side("blk_x", meta.width).alias("x"), value)


def nearest_resize(df: DataFrame, old: RasterMeta, new: RasterMeta, values: list[str], keys: list[str] | None = None) -> DataFrame:
    """Cell (y, x) of the new grid takes floor(y h / H), floor(x w / W): each old cell generates the new ones that take it."""

    def side(c: str, small: int, big: int):
        reached = lambda i: f"CAST((CAST({i} AS BIGINT) * {big} + {small - 1}) div {small} AS INT)"  # noqa: E731  exact ceiling
        first, last = reached(c), f"{reached(f'({c} + 1)')} - 1"
        return F.explode(F.expr(f"IF({last} >= {first}, sequence({first}, {last}), array())"))

    rows = df.select(*(keys or []), side("y", old.height, new.height).alias("__y"), "x", *values)
    return rows.select(*(keys or []), F.col("__y").alias("y"), side("x", old.width, new.width).alias("x"), *values)


def bilinear_resize(df: DataFrame, old: RasterMeta, new: RasterMeta, values: list[str]) -> DataFrame:
    """Bilinear values with cell centres aligned: source (y + 0.5) h / H - 0.5, from zero, corners repeated."""
    spark = df.sparkSession
    at = lambda c, small, big: F.greatest(F.lit(0.0), (F.col(c) + 0.5) * (small / big) - 0.5)

    def sides(c: str, small: int, big: int):
        low = F.least(F.floor(at(c, small, big)).cast("int"), F.lit(small - 1))
        part = at(c, small, big) - low
        return F.explode(F.array(F.struct(low.alias("i"), (1 - part).alias("w")), F.struct(F.least(low + 1, F.lit(small - 1)).alias("i"), part.alias("w"))))

    cells = grid(spark, new.height, new.width).withColumn("__a", sides("y", old.height, new.height)).withColumn("__b", sides("x", old.width, new.width))
    wanted = cells.select(F.col("y").alias("__y"), F.col("x").alias("__x"), F.col("__a.i").alias("y"), F.col("__b.i").alias("x"), (F.col("__a.w") * F.col("__b.w")).alias("__w"))
    mixed = wanted.join(df.select("y", "x", *values), ["y", "x"]).groupBy("__y", "__x").agg(*[F.sum(F.col("__w") * F.col(v)).alias(v) for v in values])
    return mixed.withColumnsRenamed({"__y": "y", "__x": "x"})


def one_hot(labels: DataFrame, classes: int) -> DataFrame:
    """(..., k, v): a plane for each class, labels held to the classes there are."""
    held = F.greatest(F.lit(0), F.least(F.col("label"), F.lit(classes - 1)))
    rows = labels.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    return rows.withColumn("v", (held == F.col("k")).cast("int")).drop("label")


def zonal_means(pixels: DataFrame, zone: str = "label", keys: list[str] | None = None) -> DataFrame:
    """Count, and sum and mean of each band, by zone."""
    bands = bands_of(pixels)
    sums = pixels.groupBy(*(keys or []), zone).agg(F.count(F.lit(1)).alias("cnt"), *[F.sum(b).alias(f"sum_{b}") for b in bands])
    return sums.withColumns({f"mean_{b}": F.col(f"sum_{b}").cast("double") / F.col("cnt") for b in bands})

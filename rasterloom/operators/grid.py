"""Block grids, chunk windows and halos: pure arithmetic on columns, windows as small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RasterMeta


def padding(length: Column | str, r: int | Column) -> Column:
    """Pixels that fill the last block of an axis."""
    length = F.col(length) if isinstance(length, str) else length
    return F.pmod(r - length % r, F.lit(r) if isinstance(r, int) else r)


def blocks_along(length: Column | str, r: int | Column) -> Column:
    """Blocks along an axis, the last one padded."""
    length = F.col(length) if isinstance(length, str) else length
    return ((length + padding(length, r)) / r).cast("int")


def block_grid(df: DataFrame, height: str = "height", width: str = "width", r: str = "r") -> DataFrame:
    """Adds blocks_h, blocks_w, pad_h, pad_w."""
    side = F.col(r)
    return df.withColumns({"blocks_h": blocks_along(height, side), "blocks_w": blocks_along(width, side), "pad_h": padding(height, side).cast("int"), "pad_w": padding(width, side).cast("int")})


def starts_along(length: str, size: str, stride: str) -> str:
    """SQL for the sorted starts of chunks along an axis: one of 0 if it fits, else by stride, with a last one at the end."""
    return f"""CASE WHEN {length} <= {size} THEN array(0) ELSE array_sort(array_distinct(concat(
        sequence(0, greatest(1, {length} - {size}) - 1, {stride}), array({length} - {size})))) END"""


def chunk_starts(df: DataFrame, length: str = "length", size: str = "size", stride: str = "stride") -> DataFrame:
    """A row for each start of the chunks along an axis, in column start."""
    return df.withColumn("start", F.explode(F.expr(starts_along(f"CAST({length} AS INT)", f"CAST({size} AS INT)", f"CAST({stride} AS INT)"))))


def chunk_windows(spark: SparkSession, height: int, width: int, size: int, stride: int, size_x: int | None = None, stride_x: int | None = None) -> DataFrame:
    """(chunk, y0, x0, y1, x1): windows numbered row by row. ``size_x`` and ``stride_x`` where the x axis has its own."""
    axis = lambda length, s, step: F.expr(starts_along(str(length), str(s), str(step)))
    size_x, stride_x = size_x or size, stride_x or stride
    rows = spark.range(1).select(F.posexplode(axis(height, size, stride)).alias("row", "y0"), axis(width, size_x, stride_x).alias("xs"))
    both = rows.select("row", "y0", F.size("xs").alias("columns"), F.posexplode("xs").alias("column", "x0"))
    number = F.col("row") * F.col("columns") + F.col("column")
    return both.select(number.alias("chunk"), "y0", "x0", F.least(F.col("y0") + size, F.lit(height)).alias("y1"), F.least(F.col("x0") + size_x, F.lit(width)).alias("x1"))


def block_windows(spark: SparkSession, height: int, width: int, r: int, chunk_size: int | None = None, overlap: int = 1) -> DataFrame:
    """Chunk windows in blocks: as many whole blocks as fit a chunk, neighbours ``overlap`` blocks over each other."""
    rows, cols = -(-height // r), -(-width // r)
    side = max(1, rows if chunk_size is None else chunk_size // r)
    tall, wide = min(side, rows) or side, min(min(side, rows) or side, cols) or side
    return chunk_windows(spark, rows, cols, tall, max(1, tall - overlap), wide, max(1, wide - overlap))


def with_halo(windows: DataFrame, halo: int, height: int, width: int) -> DataFrame:
    """Adds the window grown by ``halo`` within the raster (hy0, hx0, hy1, hx1) and how much it grew on each side."""
    grown = windows.withColumns({"hy0": F.greatest(F.lit(0), F.col("y0") - halo), "hx0": F.greatest(F.lit(0), F.col("x0") - halo), "hy1": F.least(F.lit(height), F.col("y1") + halo), "hx1": F.least(F.lit(width), F.col("x1") + halo)})
    return grown.withColumns({"top": F.col("y0") - F.col("hy0"), "left": F.col("x0") - F.col("hx0"), "bottom": F.col("hy1") - F.col("y1"), "right": F.col("hx1") - F.col("x1")})


def crop_halo(result: DataFrame) -> DataFrame:
    """Only the rows (y, x) inside their window's core (y0, x0, y1, x1)."""
    if missing := {"y", "x", "y0", "x0", "y1", "x1"} - set(result.columns):
        raise ValueError(f"cropping needs columns {sorted(missing)}")
    return result.where("y >= y0 AND y < y1 AND x >= x0 AND x < x1")


def cells_of(windows: DataFrame, y: str = "y", x: str = "x") -> DataFrame:
    """A row for each cell of each window; generated, not joined."""
    rows = windows.withColumn(y, F.explode(F.expr("sequence(y0, y1 - 1)")))
    return rows.withColumn(x, F.explode(F.expr("sequence(x0, x1 - 1)")))


def in_windows(pixels: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """Pixels with each window that holds them: an equi-join on buckets of ``size``, then the exact range."""
    spread = windows.withColumn("__by", F.explode(F.expr(f"sequence(y0 div {size}, (y1 - 1) div {size})"))).withColumn("__bx", F.explode(F.expr(f"sequence(x0 div {size}, (x1 - 1) div {size})")))
    dealt = pixels.withColumns({"__by": F.expr(f"y div {size}"), "__bx": F.expr(f"x div {size}")})
    return dealt.join(spread, ["__by", "__bx"]).where("y >= y0 AND y < y1 AND x >= x0 AND x < x1").drop("__by", "__bx")


def tile_side(halo: int) -> int:
    """A side of square tiles at which a halo at most doubles the cells (2.25 times at the widest halos)."""
    return max(256, 4 * halo)


def in_tiles(cells: DataFrame, meta: RasterMeta, side: int, halo: int) -> DataFrame:
    """Rows (y, x, ...) with each tile (__ty, __tx) of a square grid whose core, grown by ``halo``, holds them: no join, no shuffle."""
    out = cells
    for tile, axis, length in (("__ty", "y", meta.height), ("__tx", "x", meta.width)):
        out = out.withColumn(tile, F.explode(F.expr(f"sequence(greatest(0, {axis} - {halo}) div {side}, least({length - 1}, {axis} + {halo}) div {side})").cast("array<int>")))
    return out


def tile_window(ty: int, tx: int, meta: RasterMeta, side: int, halo: int) -> tuple[int, int, int, int]:
    """(y0, x0, y1, x1) of a tile's grown core within the raster."""
    return max(0, ty * side - halo), max(0, tx * side - halo), min(meta.height, (ty + 1) * side + halo), min(meta.width, (tx + 1) * side + halo)


def stitch(chunked: DataFrame, value: str, cell: list[str], chunk: str = "chunk", keys: list[str] | None = None) -> DataFrame:
    """The value of the last chunk that wrote each cell."""
    return chunked.groupBy(*(keys or []), *cell).agg(F.max_by(value, chunk).alias(value), F.max(chunk).alias(chunk))

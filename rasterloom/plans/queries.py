"""The registered queries of the raster engine, each beside the SQL that it is held against.

Inputs are rasters made from the star schema (sources.tables). Numbers that both engines must agree on are integers, or
doubles rounded in the last step.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import config, layers, progress
from ..operators import blend, cluster, focal, grid, nearest, refine, resample, sampling, tiles
from ..schema import RasterMeta, features_of
from ..sources import raster, tables
from ..store import new_folder
from ..streaming import assign as stream
from . import pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CENTERS = [[60.0, 100.0, 140.0], [120.0, 128.0, 120.0], [140.0, 120.0, 60.0], [128.0, 90.0, 128.0]]
R = 8


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if there is one."""

    def held(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return held


def rounded(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


# pooling


def pool_sql(r: int, px: str = tables.ORDERS_SQL) -> str:
    """CTEs px, sz and bl: every pixel sent to the nine centres whose mean holds it."""
    return f"""{px}, sz AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM px),
      off AS (SELECT unnest([-1, 0, 1]) AS d),
      sm AS (SELECT y + a.d AS ty, x + b.d AS tx, b0, b1, b2 FROM px, off a, off b, sz
        WHERE y + a.d BETWEEN 0 AND ((h + {r - 1}) // {r}) * {r} - 1 AND x + b.d BETWEEN 0 AND ((w + {r - 1}) // {r}) * {r} - 1),
      bn AS (SELECT CAST(ty // {r} AS INTEGER) AS blk_y, CAST(tx // {r} AS INTEGER) AS blk_x, CAST(sum(b0) AS BIGINT) AS n0,
        CAST(sum(b1) AS BIGINT) AS n1, CAST(sum(b2) AS BIGINT) AS n2 FROM sm GROUP BY 1, 2),
      bl AS (SELECT *, CAST(n0 AS DOUBLE) / CAST({9 * r * r} AS DOUBLE) AS f0, CAST(n1 AS DOUBLE) / CAST({9 * r * r} AS DOUBLE) AS f1,
        CAST(n2 AS DOUBLE) / CAST({9 * r * r} AS DOUBLE) AS f2 FROM bn)"""


def _pool(r: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        px, meta = tables.orders_raster(spark, sf_dir)
        return focal.pool(px, meta, r)

    run.__name__ = f"pool_r{r}"
    return query(f"WITH {pool_sql(r)} SELECT * FROM bl")(run)


for _r in (4, 8, 16):
    _pool(_r)


@query(f"WITH {pool_sql(16, tables.EVENTS_SQL)} SELECT * FROM bl")
def pool_padding_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, meta = tables.events_raster(spark, sf_dir)
    return focal.pool(px, meta, 16)


@query(f"WITH {pool_sql(1)} SELECT blk_y AS y, blk_x AS x, n0, n1, n2, f0, f1, f2 FROM bl")
def box_smooth3(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, meta = tables.orders_raster(spark, sf_dir)
    return focal.box_smooth(px, meta)


# assignment


def distance_sql(center: list[float]) -> str:
    return " + ".join(f"(f{n} - CAST({c!r} AS DOUBLE)) * (f{n} - CAST({c!r} AS DOUBLE))" for n, c in enumerate(center))


def assign_sql(centers: list[list[float]]) -> str:
    """CTE asg: the nearest centre of each block, ties to the lowest."""
    each = " UNION ALL ".join(f"SELECT blk_y, blk_x, {k} AS k, {distance_sql(c)} AS d FROM bl" for k, c in enumerate(centers))
    return f"al AS ({each}), asg AS (SELECT blk_y, blk_x, CAST(k AS INTEGER) AS label, d FROM al QUALIFY row_number() OVER (PARTITION BY blk_y, blk_x ORDER BY d, k) = 1)"


def _assigned(spark: SparkSession, sf_dir: str, centers: list[list[float]]) -> DataFrame:
    px, meta = tables.orders_raster(spark, sf_dir)
    blocks = focal.pool(px, meta, R)
    return nearest.assign(blocks, centers, features_of(blocks), strict=True).select("blk_y", "blk_x", "label", F.round("dist2", 6).alias("dist2"))


@query(f"WITH {pool_sql(R)}, {assign_sql(CENTERS)} SELECT blk_y, blk_x, label, round(d, 6) AS dist2 FROM asg")
def assign_fixed_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir, CENTERS)


TIES = [CENTERS[1], CENTERS[0], CENTERS[0], CENTERS[1]]


@query(f"WITH {pool_sql(R)}, {assign_sql(TIES)} SELECT blk_y, blk_x, label, round(d, 6) AS dist2 FROM asg")
def assign_tie_lowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir, TIES)


MANY = [[float(k * 37 % 256), float(k * 91 % 256), float(k * 53 % 256)] for k in range(80)]


@query(f"WITH {pool_sql(R)}, {assign_sql(MANY)} SELECT blk_y, blk_x, label, round(d, 6) AS dist2 FROM asg")
def assign_many_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir, MANY)


BRIGHT = cluster.by_brightness(CENTERS)
UP_SQL = f"""lab AS (SELECT px.y, px.x, asg.label FROM px JOIN asg ON px.y // {R} = asg.blk_y AND px.x // {R} = asg.blk_x)"""


@query(f"WITH {pool_sql(R)}, {assign_sql(BRIGHT)}, {UP_SQL} SELECT label, count(*) AS pixels, CAST(sum(y) AS BIGINT) AS sum_y, CAST(sum(x) AS BIGINT) AS sum_x FROM lab GROUP BY label")
def segment_fixed_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, meta = tables.orders_raster(spark, sf_dir)
    found = pipeline.segment(px, meta, len(CENTERS), R, centers=CENTERS)
    return found.labels.groupBy("label").agg(F.count(F.lit(1)).alias("pixels"), F.sum("y").alias("sum_y"), F.sum("x").alias("sum_x"))


@query(f"WITH {pool_sql(R)}, {assign_sql(BRIGHT)}, {UP_SQL} SELECT y, x, label FROM lab")
def upsample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, meta = tables.orders_raster(spark, sf_dir)
    return pipeline.segment(px, meta, len(CENTERS), R, centers=CENTERS).labels


@query(f"WITH {pool_sql(R)}, {assign_sql(CENTERS)} SELECT label, count(*) AS blocks FROM asg GROUP BY label")
def label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir, CENTERS).groupBy("label").agg(F.count(F.lit(1)).alias("blocks"))


# clustering


def blur_ctes(kernel: int, passes: int) -> str:
    """CTEs from lb (y, x, label) and sz to the shares of the classes, the last one v and the number of passes."""
    p = kernel // 2
    cte = f"bo AS (SELECT unnest(range({-p}, {p + 1})) AS d), ks AS (SELECT DISTINCT label AS k FROM lb), v0 AS (SELECT y, x, k, CAST(label = k AS BIGINT) AS v FROM lb, ks)"
    for n in range(passes):
        cte += f""", h{n} AS (SELECT v.y, v.x, v.k, CAST(sum(o.v) AS BIGINT) AS v FROM v{n} v, bo, sz JOIN v{n} o ON o.y = v.y AND o.k = v.k AND o.x = least(greatest(v.x + d, 0), w - 1) GROUP BY 1, 2, 3),
          v{n + 1} AS (SELECT v.y, v.x, v.k, CAST(sum(o.v) AS BIGINT) AS v FROM h{n} v, bo, sz JOIN h{n} o ON o.x = v.x AND o.k = v.k AND o.y = least(greatest(v.y + d, 0), h - 1) GROUP BY 1, 2, 3)"""
    return cte


def won_sql(passes: int) -> str:
    return f"SELECT y, x, k AS label FROM v{passes} QUALIFY row_number() OVER (PARTITION BY y, x ORDER BY v DESC, k) = 1"


def lloyd_ctes(steps: int, k: int = 4) -> str:
    """The first k blocks in hash order, then unrolled iterations with exact integer sums; ``c`` of the last is the result."""
    fit = f"""ini AS (SELECT f0, f1, f2, min((CAST(blk_y AS BIGINT) * 73856093 + CAST(blk_x AS BIGINT) * 19349663) % 1000003 * 1000000000000 + blk_y * 1000000 + blk_x) AS place FROM bl GROUP BY 1, 2, 3),
      c0 AS (SELECT CAST(row_number() OVER (ORDER BY place) - 1 AS INTEGER) AS k, f0 AS c0, f1 AS c1, f2 AS c2 FROM ini QUALIFY row_number() OVER (ORDER BY place) <= {k})"""
    for s in range(steps):
        fit += f""", a{s} AS (SELECT bl.*, c.k, (f0 - c0) * (f0 - c0) + (f1 - c1) * (f1 - c1) + (f2 - c2) * (f2 - c2) AS d FROM bl, c{s} c
          QUALIFY row_number() OVER (PARTITION BY blk_y, blk_x ORDER BY d, c.k) = 1),
        c{s + 1} AS (SELECT k, {", ".join(f"CAST(CAST(sum(n{i}) AS BIGINT) AS DOUBLE) / CAST(count(*) * {9 * R * R} AS DOUBLE) AS c{i}" for i in range(3))} FROM a{s} GROUP BY k)"""
    return fit


def lloyd_sql(steps: int) -> str:
    return f"WITH {pool_sql(R)}, {lloyd_ctes(steps)} SELECT k, round(c0, 6) AS c0, round(c1, 6) AS c1, round(c2, 6) AS c2 FROM c{steps}"


def _lloyd(steps: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        px, meta = tables.orders_raster(spark, sf_dir)
        found = cluster.lloyd(focal.pool(px, meta, R), 4, R, max_iterations=steps, tolerance=-1.0)
        return spark.createDataFrame([(k, *[round(v, 6) for v in c]) for k, c in enumerate(found)], "k int, c0 double, c1 double, c2 double")

    run.__name__ = f"lloyd_{steps}"
    return query(lloyd_sql(steps))(run)


for _n in (1, 2, 3):
    _lloyd(_n)


@query(f"WITH c AS (SELECT unnest([{', '.join(str(k) for k in range(80))}]) AS k), m AS (SELECT k, ((k * 37 % 256) + (k * 91 % 256) + (k * 53 % 256)) / 3.0::DOUBLE AS mean FROM c) SELECT k::INTEGER AS k, (row_number() OVER (ORDER BY mean, k) - 1)::INTEGER AS rank FROM m")
def brightness_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(cluster.brightness_ranks(MANY))), "k int, rank int")


@query(f"""WITH {pool_sql(R)}, {lloyd_ctes(cluster.MAX_ITERATIONS)},
  fc AS (SELECT CAST(row_number() OVER (ORDER BY (c0 + c1 + c2) / 3.0::DOUBLE, k) - 1 AS INTEGER) AS k, c0, c1, c2 FROM c{cluster.MAX_ITERATIONS}),
  asg AS (SELECT blk_y, blk_x, fc.k AS label FROM bl, fc QUALIFY row_number() OVER (PARTITION BY blk_y, blk_x ORDER BY (f0 - c0) * (f0 - c0) + (f1 - c1) * (f1 - c1) + (f2 - c2) * (f2 - c2), fc.k) = 1),
  lb AS (SELECT px.y, px.x, asg.label FROM px JOIN asg ON px.y // {R} = asg.blk_y AND px.x // {R} = asg.blk_x), {blur_ctes(5, 1)} {won_sql(1)}""")
def segment_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted, assigned, upsampled and blurred; the SQL takes every iteration that a fit may have, and as the fit's sample
    it takes all blocks, which are fewer than the sample's bound up to sf0.1."""
    px, meta = tables.orders_raster(spark, sf_dir)
    return pipeline.segment(px, meta, 4, R, blur=config.BlurConfig(5, 1)).labels


@query(f"WITH {pool_sql(R)} SELECT blk_y, blk_x, true AS nearest, true AS dark_first FROM bl")
def ml_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark ML starts at random, so the SQL holds what any start must give: every block has the label of the nearest of the
    centres, which are in order of brightness."""
    px, meta = tables.orders_raster(spark, sf_dir)
    found = pipeline.segment(px, meta, 4, R, backend="ml")
    blocks = focal.pool(px, meta, R)
    gaps = F.array(*[sum(((F.col(f"f{n}") - c) * (F.col(f"f{n}") - c) for n, c in enumerate(center)), F.lit(0.0)) for center in found.centers])
    near = F.element_at(gaps, F.col("label") + 1) <= F.array_min(gaps) + 1e-9
    means = [sum(c) / len(c) for c in found.centers]
    return found.blocks.join(blocks, ["blk_y", "blk_x"]).select("blk_y", "blk_x", near.alias("nearest"), F.lit(means == sorted(means)).alias("dark_first"))


# sampling


SAMPLE = 60


@query(f"""WITH {pool_sql(R)}, n AS (SELECT max(blk_y) + 1 AS h, max(blk_x) + 1 AS w FROM bl),
  s AS (SELECT CASE WHEN h * w <= {SAMPLE} THEN 1 ELSE greatest(1, CAST(floor(sqrt(CAST(h * w AS DOUBLE) / {SAMPLE})) AS INTEGER)) END AS step FROM n)
  SELECT blk_y, blk_x FROM bl, s WHERE blk_y % step = 0 AND blk_x % step = 0
  ORDER BY (CAST(blk_y AS BIGINT) * 73856093 + CAST(blk_x AS BIGINT) * 19349663) % 1000003, blk_y, blk_x LIMIT {SAMPLE}""")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, meta = tables.orders_raster(spark, sf_dir)
    return sampling.sample_blocks(focal.pool(px, meta, R), -(-meta.height // R), -(-meta.width // R), SAMPLE).select("blk_y", "blk_x")


@query("""WITH c AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM embeddings GROUP BY label),
  q AS (SELECT label, greatest(1, CAST(floor(CAST(n AS DOUBLE) / CAST(total AS DOUBLE) * 100) AS INTEGER)) AS quota FROM c)
  SELECT vec_id AS id, e.label FROM embeddings e JOIN q USING (label)
  QUALIFY row_number() OVER (PARTITION BY e.label ORDER BY (vec_id * 73856093) % 1000003, vec_id) <= any_value(quota) OVER (PARTITION BY e.label)""")
def stratified_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return sampling.stratified_sample(rows, 100)


# grids and windows


@query("""WITH g AS (SELECT CAST(p_partkey % 700 + 1 AS INTEGER) AS height, CAST(p_size * 7 + 1 AS INTEGER) AS width, CAST(p_partkey % 16 + 1 AS INTEGER) AS r FROM part)
  SELECT height, width, r, CAST((height + r - 1) // r AS INTEGER) AS blocks_h, CAST((width + r - 1) // r AS INTEGER) AS blocks_w, CAST((r - height % r) % r AS INTEGER) AS pad_h, CAST((r - width % r) % r AS INTEGER) AS pad_w FROM g""")
def block_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tables.read(spark, sf_dir, "part").select((F.col("p_partkey") % 700 + 1).cast("int").alias("height"), (F.col("p_size") * 7 + 1).cast("int").alias("width"), (F.col("p_partkey") % 16 + 1).cast("int").alias("r"))
    return grid.block_grid(sizes)


AXES_SQL = "SELECT DISTINCT CAST(p_partkey % 900 + 1 AS INTEGER) AS length, CAST(p_size * 4 AS INTEGER) AS size, CAST(p_size * 3 AS INTEGER) AS stride FROM part"
STARTS_SQL = "SELECT DISTINCT length, size, stride, CAST(start AS INTEGER) AS start FROM (SELECT *, unnest(CASE WHEN length <= size THEN [0] ELSE list_concat(range(0, greatest(1, length - size), stride), [length - size]) END) AS start FROM ax)"


def _axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "part").select((F.col("p_partkey") % 900 + 1).cast("int").alias("length"), (F.col("p_size") * 4).cast("int").alias("size"), (F.col("p_size") * 3).cast("int").alias("stride")).distinct()


@query(f"WITH ax AS ({AXES_SQL}) {STARTS_SQL}")
def chunk_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.chunk_starts(_axes(spark, sf_dir))


def windows_sql(size: int, stride: int, over: str = "sz") -> str:
    starts = lambda n: f"CASE WHEN {n} <= {size} THEN [0] ELSE list_distinct(list_concat(range(0, greatest(1, {n} - {size}), {stride}), [{n} - {size}])) END"
    return f"""ys AS (SELECT unnest({starts("h")}) AS y0 FROM {over}), xs AS (SELECT unnest({starts("w")}) AS x0 FROM {over}),
      win AS (SELECT CAST(row_number() OVER (ORDER BY y0, x0) - 1 AS INTEGER) AS chunk, CAST(y0 AS INTEGER) AS y0, CAST(x0 AS INTEGER) AS x0,
        CAST(least(y0 + {size}, h) AS INTEGER) AS y1, CAST(least(x0 + {size}, w) AS INTEGER) AS x1 FROM ys, xs, {over})"""


SIZE_SQL = f"{tables.ORDERS_SQL}, sz AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM px)"


@query(f"""WITH {SIZE_SQL}, {windows_sql(64, 48)}, g AS (SELECT win.*, CAST(greatest(0, y0 - 3) AS INTEGER) AS hy0, CAST(greatest(0, x0 - 3) AS INTEGER) AS hx0, CAST(least(h, y1 + 3) AS INTEGER) AS hy1, CAST(least(w, x1 + 3) AS INTEGER) AS hx1 FROM win, sz)
  SELECT *, y0 - hy0 AS top, x0 - hx0 AS "left", hy1 - y1 AS bottom, hx1 - x1 AS "right" FROM g""")
def halo_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, meta = tables.orders_raster(spark, sf_dir)
    return grid.with_halo(grid.chunk_windows(spark, meta.height, meta.width, 64, 48), 3, meta.height, meta.width)


@query(f"""WITH {SIZE_SQL}, {windows_sql(64, 48)}, h AS (SELECT win.*, px.y, px.x, px.b0 FROM win, sz, px WHERE y BETWEEN greatest(0, y0 - 3) AND least(h, y1 + 3) - 1 AND x BETWEEN greatest(0, x0 - 3) AND least(w, x1 + 3) - 1)
  SELECT chunk, count(*) AS cells, CAST(sum(b0) AS BIGINT) AS total FROM h WHERE y >= y0 AND y < y1 AND x >= x0 AND x < x1 GROUP BY chunk""")
def halo_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, meta = tables.orders_raster(spark, sf_dir)
    grown = grid.with_halo(grid.chunk_windows(spark, meta.height, meta.width, 64, 48), 3, meta.height, meta.width)
    wide = grown.select("chunk", F.col("y0").alias("cy0"), F.col("x0").alias("cx0"), F.col("y1").alias("cy1"), F.col("x1").alias("cx1"), F.col("hy0").alias("y0"), F.col("hx0").alias("x0"), F.col("hy1").alias("y1"), F.col("hx1").alias("x1"))
    held = grid.in_windows(px, wide, 64).drop("y0", "x0", "y1", "x1").withColumnsRenamed({"cy0": "y0", "cx0": "x0", "cy1": "y1", "cx1": "x1"})
    return grid.crop_halo(held).groupBy("chunk").agg(F.count(F.lit(1)).alias("cells"), F.sum("b0").alias("total"))


@query(f"""WITH {pool_sql(R)}, {assign_sql(BRIGHT)}, bz AS (SELECT max(blk_y) + 1 AS h, max(blk_x) + 1 AS w FROM bl),
  sd AS (SELECT h, w, least(8, h) AS th, least(least(8, h), w) AS tw FROM bz),
  ys AS (SELECT unnest(CASE WHEN h <= th THEN [0] ELSE list_distinct(list_concat(range(0, greatest(1, h - th), greatest(1, th - 1)), [h - th])) END) AS y0 FROM sd),
  xs AS (SELECT unnest(CASE WHEN w <= tw THEN [0] ELSE list_distinct(list_concat(range(0, greatest(1, w - tw), greatest(1, tw - 1)), [w - tw])) END) AS x0 FROM sd),
  win AS (SELECT CAST(row_number() OVER (ORDER BY y0, x0) - 1 AS INTEGER) AS chunk, y0, x0, least(y0 + th, h) AS y1, least(x0 + tw, w) AS x1 FROM ys, xs, sd)
  SELECT blk_y, blk_x, max(label) AS label, max(chunk) AS chunk FROM asg JOIN win ON blk_y >= y0 AND blk_y < y1 AND blk_x >= x0 AND blk_x < x1 GROUP BY 1, 2""")
def chunk_coverage_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, meta = tables.orders_raster(spark, sf_dir)
    return pipeline.segment_in_chunks(px, meta, BRIGHT, R, 8 * R)


BLOCK_WINDOWS_SQL = f"""{tables.ORDERS_SQL}, sz AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM px), bz AS (SELECT (h + {R - 1}) // {R} AS bh, (w + {R - 1}) // {R} AS bw FROM sz),
  sd AS (SELECT bh, bw, least(8, bh) AS th, least(least(8, bh), bw) AS tw FROM bz),
  ys AS (SELECT unnest(CASE WHEN bh <= th THEN [0] ELSE list_distinct(list_concat(range(0, greatest(1, bh - th), greatest(1, th - 1)), [bh - th])) END) AS y0 FROM sd),
  xs AS (SELECT unnest(CASE WHEN bw <= tw THEN [0] ELSE list_distinct(list_concat(range(0, greatest(1, bw - tw), greatest(1, tw - 1)), [bw - tw])) END) AS x0 FROM sd),
  wn AS (SELECT row_number() OVER (ORDER BY y0, x0) - 1 AS chunk, y0, x0, greatest(0, y0 * {R} - 3) AS hy0, greatest(0, x0 * {R} - 3) AS hx0,
    least(h, least(least(y0 + th, bh) * {R}, h) + 3) AS hy1, least(w, least(least(x0 + tw, bw) * {R}, w) + 3) AS hx1, bh, bw FROM ys, xs, sd, sz),
  cw AS (SELECT *, least(((CASE WHEN hy1 - hy0 > 6 THEN hy1 - hy0 - 6 ELSE hy1 - hy0 END) + {R - 1}) // {R}, bh - y0) AS ny, least(((CASE WHEN hx1 - hx0 > 6 THEN hx1 - hx0 - 6 ELSE hx1 - hx0 END) + {R - 1}) // {R}, bw - x0) AS nx FROM wn)"""


@query(f"""WITH {BLOCK_WINDOWS_SQL}, off AS (SELECT unnest([-1, 0, 1]) AS d),
  sm AS (SELECT chunk, y0, x0, y - hy0 + a.d AS ty, x - hx0 + b.d AS tx, b0, b1, b2 FROM px JOIN cw ON y >= hy0 AND y < hy1 AND x >= hx0 AND x < hx1, off a, off b
    WHERE y - hy0 + a.d BETWEEN 0 AND ny * {R} - 1 AND x - hx0 + b.d BETWEEN 0 AND nx * {R} - 1),
  gr AS (SELECT chunk, y0 + ty // {R} AS blk_y, x0 + tx // {R} AS blk_x, {", ".join(f"CAST(CAST(sum(b{n}) AS BIGINT) AS DOUBLE) / CAST({9 * R * R} AS DOUBLE) AS f{n}" for n in range(3))} FROM sm GROUP BY 1, 2, 3),
  bl AS (SELECT * FROM gr QUALIFY row_number() OVER (PARTITION BY blk_y, blk_x ORDER BY chunk DESC) = 1), {assign_sql(BRIGHT)},
  ev AS (SELECT a.y AS blk_y, b.x AS blk_x FROM (SELECT unnest(range(bh)) AS y FROM bz) a, (SELECT unnest(range(bw)) AS x FROM bz) b)
  SELECT CAST(ev.blk_y AS INTEGER) AS blk_y, CAST(ev.blk_x AS INTEGER) AS blk_x, coalesce(label, 0) AS label FROM ev LEFT JOIN asg USING (blk_y, blk_x)""")
def chunk_displaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, meta = tables.orders_raster(spark, sf_dir)
    return pipeline.segment_displaced(px, meta, BRIGHT, R, 8 * R)


# labels, planes and zones


LABELS_SQL = f"{tables.ORDERS_SQL}, lb AS (SELECT y, x, CAST((b0 // 16 + b1 // 64) % 4 AS INTEGER) AS label FROM px)"


def _labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, RasterMeta]:
    px, meta = tables.orders_raster(spark, sf_dir)
    return px.select("y", "x", F.expr("CAST((b0 div 16 + b1 div 64) % 4 AS INT) AS label")), meta


@query(f"WITH {LABELS_SQL}, k AS (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS k) SELECT y, x, k, CAST(least(label, 2) = k AS INTEGER) AS v FROM lb, k")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.one_hot(_labels(spark, sf_dir)[0], 3)


@query(f"""WITH {tables.ORDERS_SQL} SELECT b1 // 64 AS label, count(*) AS cnt, {", ".join(f"CAST(sum(b{n}) AS BIGINT) AS sum_b{n}, round(CAST(CAST(sum(b{n}) AS BIGINT) AS DOUBLE) / count(*), 6) AS mean_b{n}" for n in range(3))} FROM px GROUP BY 1""")
def zonal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, _ = tables.orders_raster(spark, sf_dir)
    return rounded(resample.zonal_means(px.withColumn("label", F.expr("b1 div 64"))), ["mean_b0", "mean_b1", "mean_b2"])


def blur_sql(kernel: int, passes: int) -> str:
    return f"WITH {LABELS_SQL}, sz AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM px), {blur_ctes(kernel, passes)} {won_sql(passes)}"


def _blur(name: str, kernel: int, passes: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        labels, meta = _labels(spark, sf_dir)
        return focal.blur_labels(labels, meta, kernel, passes)

    run.__name__ = name
    return query(blur_sql(kernel, passes))(run)


_blur("blur_k3", 3, 1)
_blur("blur_k5", 5, 1)
_blur("blur_k5_x2", 5, 2)
_blur("blur_k21_x2", 21, 2)


def _mirror(v: str, n: str) -> str:
    return f"CASE WHEN {v} < 0 THEN -({v}) WHEN {v} >= {n} THEN 2 * ({n} - 1) - ({v}) ELSE {v} END"


@query(f"""WITH {tables.ORDERS_SQL}, sz AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM px), rw AS (SELECT d, exp(-(d * d) / 2.0::DOUBLE) AS g FROM (SELECT unnest(range(-3, 4)) AS d)),
  wt AS (SELECT d, g / (SELECT sum(g) FROM rw) AS g FROM rw),
  a AS (SELECT v.y, v.x, sum(o.b0 * g) AS v FROM px v, wt, sz JOIN px o ON o.y = v.y AND o.x = {_mirror("v.x + d", "w")} GROUP BY 1, 2)
  SELECT v.y, v.x, round(sum(o.v * g), 6) AS v FROM a v, wt, sz JOIN a o ON o.x = v.x AND o.y = {_mirror("v.y + d", "h")} GROUP BY 1, 2""")
def gaussian_s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, meta = tables.orders_raster(spark, sf_dir)
    return rounded(focal.gaussian_blur(px.select("y", "x", F.col("b0").alias("v")), meta, 1.0, ["v"]), ["v"])


@query("""WITH w AS (SELECT i, 0.5 - 0.5 * cos(2 * pi() * i / 31) AS h FROM (SELECT unnest(range(32)) AS i)), m AS (SELECT max(h) AS t FROM w)
  SELECT CAST(a.i AS INTEGER) AS y, CAST(b.i AS INTEGER) AS x, round(a.h * b.h / (t * t), 9) AS weight FROM w a, w b, m""")
def hann_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..schema import grid as cells

    return cells(spark, 32, 32).withColumn("weight", F.round(focal.weight_mask(F.col("y"), F.col("x"), 32), 9))


HANN_SQL = "(0.5 - 0.5 * cos(2 * pi() * ({i}) / 31))"


@query(f"""WITH {LABELS_SQL}, sz AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM px), {windows_sql(32, 24)}, t AS (SELECT max({HANN_SQL.format(i="i")}) AS t FROM (SELECT unnest(range(32)) AS i)),
  c AS (SELECT y, x, label, {HANN_SQL.format(i="y - y0")} * {HANN_SQL.format(i="x - x0")} / (t * t) AS m FROM lb JOIN win ON y >= y0 AND y < y1 AND x >= x0 AND x < x1, t),
  k AS (SELECT CAST(unnest(range(4)) AS INTEGER) AS k) SELECT y, x, k, round(sum(CASE WHEN label = k THEN m ELSE 0 END), 6) AS score, round(sum(m), 6) AS weight FROM c, k GROUP BY 1, 2, 3""")
def weighted_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, meta = _labels(spark, sf_dir)
    chunked = grid.in_windows(labels, grid.chunk_windows(spark, meta.height, meta.width, 32, 24), 32)
    return rounded(blend.weighted_scores(chunked, 32, 4), ["score", "weight"])


def _bands(image: np.ndarray) -> np.ndarray:
    return (image.mean(0) // 64).astype(np.int64)


def harmonize_ctes(classes: int = 4) -> str:
    """From cl (chunk, y, x, b0, b1, b2, label) to hl (chunk, y, x, label): labels matched to running prototypes, one mean a step."""
    one = lambda value, otherwise: f"list_transform(range(0, {classes}), lambda j: CASE WHEN j = target THEN {value} ELSE {otherwise} END)"
    mean = "list_transform([1, 2, 3], lambda i: CASE WHEN seen[j + 1] = 0 THEN vec[i] ELSE (known[j + 1][i] * seen[j + 1] + vec[i]) / (seen[j + 1] + 1) END)"
    return f"""mv AS (SELECT chunk, label, [avg(b0), avg(b1), avg(b2)] AS vec FROM cl GROUP BY 1, 2),
      it AS (SELECT *, row_number() OVER (ORDER BY chunk, label) AS n FROM mv),
      rc AS (WITH RECURSIVE st AS (
        SELECT CAST(0 AS BIGINT) AS n, -1 AS chunk, -1 AS label, list_transform(range(0, {classes}), lambda j: CAST(0 AS BIGINT)) AS seen, list_transform(range(0, {classes}), lambda j: [0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE]) AS known, CAST([] AS BIGINT[]) AS used, CAST(-1 AS BIGINT) AS target
        UNION ALL
        SELECT n, chunk, label, {one("seen[j + 1] + 1", "seen[j + 1]")}, {one(mean, "known[j + 1]")}, list_append(used, target), target FROM (
          SELECT *, coalesce(CASE WHEN list_min(gaps) <= {blend.PALETTE} THEN list_position(gaps, list_min(gaps)) - 1 END,
            list_filter(range(0, {classes}), lambda j: NOT list_contains(used, j) AND seen[j + 1] = 0)[1], list_filter(range(0, {classes}), lambda j: NOT list_contains(used, j))[1]) AS target FROM (
          SELECT *, list_transform(range(0, {classes}), lambda j: CASE WHEN seen[j + 1] > 0 AND NOT list_contains(used, j) THEN sqrt((known[j + 1][1] - vec[1]) ** 2 + (known[j + 1][2] - vec[2]) ** 2 + (known[j + 1][3] - vec[3]) ** 2) END) AS gaps FROM (
          SELECT it.n, it.chunk, it.label, it.vec, seen, known, CASE WHEN it.chunk = st.chunk THEN used ELSE CAST([] AS BIGINT[]) END AS used FROM st JOIN it ON it.n = st.n + 1))))
        SELECT chunk, label, target FROM st WHERE n > 0),
      hl AS (SELECT cl.chunk, y, x, CAST(target AS INTEGER) AS label FROM cl JOIN rc USING (chunk, label))"""


def _gauss_ctes(sigma: float, radius: int, values: tuple[str, ...], keys: str = "k") -> str:
    """From bs (y, x, k, values) to gb, both axes blurred with mirrored ends."""
    sums = lambda of: ", ".join(f"sum(o.{v} * g) AS {v}" for v in values)
    return f"""rw AS (SELECT d, exp(-(d * d) / ({2 * sigma * sigma})::DOUBLE) AS g FROM (SELECT unnest(range({-radius}, {radius + 1})) AS d)), wt AS (SELECT d, g / (SELECT sum(g) FROM rw) AS g FROM rw),
      ga AS (SELECT v.y, v.x, v.{keys}, {sums("o")} FROM bs v, wt, sz JOIN bs o ON o.y = v.y AND o.{keys} = v.{keys} AND o.x = {_mirror("v.x + d", "w")} GROUP BY 1, 2, 3),
      gb AS (SELECT v.y, v.x, v.{keys}, {sums("o")} FROM ga v, wt, sz JOIN ga o ON o.x = v.x AND o.{keys} = v.{keys} AND o.y = {_mirror("v.y + d", "h")} GROUP BY 1, 2, 3)"""


HANN40 = "(0.5 - 0.5 * cos(2 * pi() * ({i}) / 39))"


@query(f"""WITH {SIZE_SQL}, {windows_sql(40, 30)}, cl AS (SELECT chunk, y, x, b0, b1, b2, CAST(floor((b0 + b1 + b2) / 3.0::DOUBLE / 64) AS INTEGER) AS label FROM px JOIN win ON y >= y0 AND y < y1 AND x >= x0 AND x < x1),
  {harmonize_ctes()}, t AS (SELECT max({HANN40.format(i="i")}) AS t FROM (SELECT unnest(range(40)) AS i)),
  c AS (SELECT y, x, label, {HANN40.format(i="y - y0")} * {HANN40.format(i="x - x0")} / (t * t) AS m FROM hl JOIN win USING (chunk), t), k AS (SELECT CAST(unnest(range(4)) AS INTEGER) AS k),
  bs AS (SELECT y, x, k, sum(CASE WHEN label = k THEN m ELSE 0 END) AS score, sum(m) AS weight FROM c, k GROUP BY 1, 2, 3), {_gauss_ctes(4.0, 12, ("score", "weight"))}
  SELECT y, x, k AS label FROM gb QUALIFY row_number() OVER (PARTITION BY y, x ORDER BY round(score / greatest(weight, 1e-6), 9) DESC, k) = 1""")
def chunk_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, meta = tables.orders_raster(spark, sf_dir)
    return blend.process_in_chunks(px, meta, 40, 30, 4, _bands)


@query(f"""WITH {SIZE_SQL}, {windows_sql(40, 30)}, cl AS (SELECT chunk, y, x, b0, b1, b2, CAST((b0 // 64 + chunk) % 4 AS INTEGER) AS label FROM px JOIN win ON y >= y0 AND y < y1 AND x >= x0 AND x < x1),
  {harmonize_ctes()} SELECT chunk, y, x, label FROM hl""")
def harmonize(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, meta = tables.orders_raster(spark, sf_dir)
    chunked = grid.in_windows(px, grid.chunk_windows(spark, meta.height, meta.width, 40, 30), 40).withColumn("label", F.expr("CAST((b0 div 64 + chunk) % 4 AS INT)"))
    return blend.harmonize(chunked, 4).select("chunk", "y", "x", "label")


# neighbours and refinement


@query("""WITH d AS (SELECT q.vec_id AS id, r.vec_id AS neighbour, list_sum(list_transform(list_zip(q.embedding, r.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS d FROM embeddings q, embeddings r)
  SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY d, neighbour) AS INTEGER) AS rank, neighbour, round(d, 6) AS dist2 FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, neighbour) <= 3""")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read(spark, sf_dir, "embeddings")
    return rounded(nearest.knn(rows, rows, 3, "vec_id", "embedding"), ["dist2"])


LATENT_CENTERS = [[round(0.25 * np.cos(k + 0.7 * d), 3) for d in range(64)] for k in range(4)]


def posterior_sql(where: str = "label % 4") -> str:
    """CTE po: half the softmax of negative distances over a temperature of two, half the seed label."""
    each = " UNION ALL ".join(f"SELECT vec_id, {k} AS k, -list_sum(list_transform(list_zip(embedding, [{', '.join(map(repr, map(float, c)))}]), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) / 2.0::DOUBLE AS lg FROM embeddings" for k, c in enumerate(LATENT_CENTERS))
    return f"""lg AS ({each}), ex AS (SELECT vec_id, k, exp(lg - max(lg) OVER (PARTITION BY vec_id)) AS e FROM lg),
      po AS (SELECT vec_id AS id, k, 0.5::DOUBLE * e / greatest(sum(e) OVER (PARTITION BY vec_id), 1e-8) + 0.5::DOUBLE * CAST({where} = k AS INTEGER) AS p FROM ex JOIN embeddings USING (vec_id))"""


@query(f"WITH {posterior_sql()} SELECT id, {', '.join(f'round(max(p) FILTER (k = {k}), 6) AS p{k}' for k in range(4))} FROM po GROUP BY id")
def softmax_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 4).alias("label"), F.col("embedding").alias("vec"))
    return rounded(refine.posteriors(rows, LATENT_CENTERS, 2.0).select("id", "p0", "p1", "p2", "p3"), ["p0", "p1", "p2", "p3"])


def refine_sql(passes: int) -> str:
    cte = f"""{posterior_sql()}, sz AS (SELECT max(vec_id // {tables.LATENT}) + 1 AS h FROM embeddings),
      pl AS (SELECT vec_id AS id, list_concat(list_transform(embedding, lambda v: v::DOUBLE), [(-1.0::DOUBLE + 2.0::DOUBLE * (vec_id // {tables.LATENT}) / (h - 1)) * 0.08::DOUBLE, (-1.0::DOUBLE + 2.0::DOUBLE * (vec_id % {tables.LATENT}) / {tables.LATENT - 1}) * 0.08::DOUBLE]) AS v FROM embeddings, sz),
      ed AS (SELECT q.id, r.id AS nb, list_sum(list_transform(list_zip(q.v, r.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM pl q, pl r QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY d, nb) <= 12),
      p0 AS (SELECT id, k, p FROM po)"""
    for n in range(passes):
        cte += f", m{n} AS (SELECT ed.id, k, avg(p) AS p FROM ed JOIN p{n} ON p{n}.id = ed.nb GROUP BY 1, 2), p{n + 1} AS (SELECT p{n}.id, p{n}.k, 0.35::DOUBLE * p{n}.p + 0.65::DOUBLE * m{n}.p AS p FROM p{n} JOIN m{n} USING (id, k))"
    return f"WITH {cte} SELECT CAST(id // {tables.LATENT} AS INTEGER) AS y, CAST(id % {tables.LATENT} AS INTEGER) AS x, CAST(arg_min(k, (-p, k)) AS INTEGER) AS label, {', '.join(f'round(max(p) FILTER (k = {k}), 6) AS p{k}' for k in range(4))} FROM p{passes} GROUP BY id"


def _refine(passes: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cells, meta = tables.latent_cells(spark, sf_dir)
        return rounded(refine.refine(cells, meta, LATENT_CENTERS, {"iterations": passes}), ["p0", "p1", "p2", "p3"])

    run.__name__ = f"refine_{passes}"
    return query(refine_sql(passes))(run)


_refine(1)
_refine(2)


def _apart(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def refine_ctes(tag: str, source: str, neighbours: int = 12, passes: int = 2, centers: list | None = None) -> str:
    """CTEs from ``source`` (y, x, h, w, label, vec) to fin<tag> (y, x, label); centres are numbers, or the CTE ctr (k, vec)."""
    each = f"SELECT * FROM (VALUES {', '.join(f'({k}, {[float(v) for v in c]}::DOUBLE[])' for k, c in enumerate(centers))}) v(k, vec)" if centers else "SELECT k, vec FROM ctr"
    line = lambda c, n: f"(CASE WHEN {n} <= 1 THEN -1.0::DOUBLE ELSE -1.0::DOUBLE + 2.0::DOUBLE * {c} / ({n} - 1) END) * 0.08::DOUBLE"
    cte = f"""cc{tag} AS ({each}), ce{tag} AS (SELECT y * w + x AS id, y, x, h, w, label, list_transform(vec, lambda v: v::DOUBLE) AS vec FROM {source}),
      lg{tag} AS (SELECT id, c.k, label, -{_apart("e.vec", "c.vec")} / 2.0::DOUBLE AS lg FROM ce{tag} e, cc{tag} c),
      ex{tag} AS (SELECT *, exp(lg - max(lg) OVER (PARTITION BY id)) AS e FROM lg{tag}),
      p{tag}_0 AS (SELECT id, k, 0.5::DOUBLE * e / greatest(sum(e) OVER (PARTITION BY id), 1e-8) + 0.5::DOUBLE * CAST(label = k AS INTEGER) AS p FROM ex{tag}),
      pl{tag} AS (SELECT id, list_concat(vec, [{line("y", "h")}, {line("x", "w")}]) AS v FROM ce{tag}),
      ed{tag} AS (SELECT q.id, r.id AS nb, {_apart("q.v", "r.v")} AS d FROM pl{tag} q, pl{tag} r QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY d, nb) <= {neighbours})"""
    for n in range(passes):
        cte += f""", m{tag}_{n} AS (SELECT e.id, k, avg(p) AS p FROM ed{tag} e JOIN p{tag}_{n} o ON o.id = e.nb GROUP BY 1, 2),
          p{tag}_{n + 1} AS (SELECT o.id, o.k, 0.35::DOUBLE * o.p + 0.65::DOUBLE * m.p AS p FROM p{tag}_{n} o JOIN m{tag}_{n} m USING (id, k))"""
    return cte + f", fin{tag} AS (SELECT y, x, CAST(arg_min(k, (-p, k)) AS INTEGER) AS label FROM p{tag}_{passes} JOIN ce{tag} USING (id) GROUP BY 1, 2)"


def coarser_ctes(tag: str, scale: int) -> str:
    """CTEs from vs (y, x, vec), sz and lb<tag> to sm<tag>: vectors resized bilinearly by ``scale``, labels by the nearest."""
    at = lambda c, small, big: f"greatest(0.0::DOUBLE, ({c} + 0.5::DOUBLE) * (CAST({small} AS DOUBLE) / {big}) - 0.5)"
    pick = lambda y, x: f"JOIN vs v{y}{x} ON v{y}{x}.y = {'least(y0 + 1, h - 1)' if y else 'y0'} AND v{y}{x}.x = {'least(x0 + 1, w - 1)' if x else 'x0'}"
    mixed = "list_transform(range(1, len(v00.vec) + 1), lambda i: (1 - fy) * (1 - fx) * v00.vec[i] + (1 - fy) * fx * v01.vec[i] + fy * (1 - fx) * v10.vec[i] + fy * fx * v11.vec[i])"
    return f"""sg{tag} AS (SELECT h, w, greatest(1, h // {scale}) AS nh, greatest(1, w // {scale}) AS nw FROM sz),
      gr{tag} AS (SELECT *, {at("y", "h", "nh")} AS sy, {at("x", "w", "nw")} AS sx FROM (SELECT unnest(range(nh)) AS y, h, w, nh, nw FROM sg{tag}) JOIN (SELECT unnest(range(nw)) AS x FROM sg{tag}) ON true),
      co{tag} AS (SELECT *, sy - y0 AS fy, sx - x0 AS fx FROM (SELECT *, least(CAST(floor(sy) AS INTEGER), h - 1) AS y0, least(CAST(floor(sx) AS INTEGER), w - 1) AS x0 FROM gr{tag})),
      sm{tag} AS (SELECT g.y, g.x, nh AS h, nw AS w, l.label, {mixed} AS vec FROM co{tag} g {pick(0, 0)} {pick(0, 1)} {pick(1, 0)} {pick(1, 1)} JOIN lb{tag} l ON l.y = g.y * h // nh AND l.x = g.x * w // nw)"""


def finer_cte(tag: str, to: str) -> str:
    """CTE lb<to>: the labels of fin<tag> on the whole grid."""
    return f"lb{to} AS (SELECT v.y, v.x, f.label FROM vs v, sg{tag} s JOIN fin{tag} f ON f.y = v.y * nh // h AND f.x = v.x * nw // w)"


@query(f"""WITH sz AS (SELECT max(vec_id // {tables.LATENT}) + 1 AS h, {tables.LATENT} AS w FROM embeddings),
  vs AS (SELECT vec_id // {tables.LATENT} AS y, vec_id % {tables.LATENT} AS x, list_transform(embedding, lambda v: v::DOUBLE) AS vec FROM embeddings), lba AS (SELECT vec_id // {tables.LATENT} AS y, vec_id % {tables.LATENT} AS x, label % 4 AS label FROM embeddings),
  {coarser_ctes("a", 4)}, {refine_ctes("a", "sma", centers=LATENT_CENTERS)}, {finer_cte("a", "b")}, {coarser_ctes("b", 2)}, {refine_ctes("b", "smb", centers=LATENT_CENTERS)}, {finer_cte("b", "c")},
  fu AS (SELECT vs.y, vs.x, h, w, label, vec FROM vs JOIN lbc USING (y, x), sz), {refine_ctes("c", "fu", centers=LATENT_CENTERS)} SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, label FROM finc""")
def refine_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, meta = tables.latent_cells(spark, sf_dir)
    return refine.refine(cells, meta, LATENT_CENTERS, {"hierarchy_factor": 2, "hierarchy_passes": 3, "neighbors": None}).select("y", "x", "label")


# resampling


@query(f"""WITH {SIZE_SQL}, g AS (SELECT a.y, b.x FROM (SELECT unnest(range(40)) AS y) a, (SELECT unnest(range(33)) AS x) b)
  SELECT CAST(g.y AS INTEGER) AS y, CAST(g.x AS INTEGER) AS x, b0, b2 FROM g, sz JOIN px ON px.y = g.y * h // 40 AND px.x = g.x * w // 33""")
def nearest_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, meta = tables.orders_raster(spark, sf_dir)
    return resample.nearest_resize(px, meta, RasterMeta(40, 33), ["b0", "b2"])


@query(f"""WITH {SIZE_SQL}, g AS (SELECT a.y, b.x, greatest(0.0::DOUBLE, (a.y + 0.5::DOUBLE) * (CAST(h AS DOUBLE) / 40) - 0.5) AS sy, greatest(0.0::DOUBLE, (b.x + 0.5::DOUBLE) * (CAST(w AS DOUBLE) / 170) - 0.5) AS sx, h, w FROM (SELECT unnest(range(40)) AS y) a, (SELECT unnest(range(170)) AS x) b, sz),
  c AS (SELECT y, x, least(CAST(floor(sy) AS INTEGER), h - 1) AS y0, least(CAST(floor(sx) AS INTEGER), w - 1) AS x0, sy, sx, h, w FROM g),
  n AS (SELECT y, x, y0 AS py, x0 AS px_, (1 - (sy - y0)) * (1 - (sx - x0)) AS wt FROM c UNION ALL SELECT y, x, least(y0 + 1, h - 1), x0, (sy - y0) * (1 - (sx - x0)) FROM c
    UNION ALL SELECT y, x, y0, least(x0 + 1, w - 1), (1 - (sy - y0)) * (sx - x0) FROM c UNION ALL SELECT y, x, least(y0 + 1, h - 1), least(x0 + 1, w - 1), (sy - y0) * (sx - x0) FROM c)
  SELECT CAST(n.y AS INTEGER) AS y, CAST(n.x AS INTEGER) AS x, round(sum(wt * b0), 6) AS b0 FROM n JOIN px ON px.y = py AND px.x = px_ GROUP BY 1, 2""")
def bilinear_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, meta = tables.orders_raster(spark, sf_dir)
    return rounded(resample.bilinear_resize(px, meta, RasterMeta(40, 170), ["b0"]), ["b0"])


# tiles


@query(f"""WITH {SIZE_SQL}, g AS (SELECT CAST(y // 16 AS INTEGER) AS ty, CAST(x // 16 AS INTEGER) AS tx, y % 16 * 16 + x % 16 AS i, b0, b2 FROM px)
  SELECT ty, tx, 256 AS cells, CAST(sum(b0 * (i + 1)) AS BIGINT) AS digest0, CAST(sum(b2 * (i + 1)) AS BIGINT) AS digest2 FROM g GROUP BY 1, 2""")
def tile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, _ = tables.orders_raster(spark, sf_dir)
    digest = lambda b: F.expr(f"CAST(aggregate(transform(data[{b}], (v, i) -> v * (i + 1)), 0D, (s, v) -> s + v) AS BIGINT) AS digest{b}")
    return tiles.tile(px, 16).select("ty", "tx", F.size(F.col("data")[0]).alias("cells"), digest(0), digest(2))


@query(f"WITH {tables.ORDERS_SQL} SELECT y, x, CAST(b0 AS DOUBLE) AS b0, CAST(b1 AS DOUBLE) AS b1, CAST(b2 AS DOUBLE) AS b2 FROM px")
def tile_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, meta = tables.orders_raster(spark, sf_dir)
    return tiles.untile(tiles.tile(px, 16), 16, meta)


@query(f"""WITH {SIZE_SQL}, g AS (SELECT y, x, b0, y // 16 AS ty, x // 16 AS tx, y % 16 AS i, x % 16 AS j, CASE WHEN least(16, h - y // 16 * 16) = least(16, w - x // 16 * 16) THEN (y // 16 + x // 16) % 4 ELSE 0 END AS k, least(16, h - y // 16 * 16) - 1 AS l FROM px, sz)
  SELECT CAST(ty * 16 + CASE k WHEN 1 THEN l - j WHEN 2 THEN l - i WHEN 3 THEN j ELSE i END AS INTEGER) AS y, CAST(tx * 16 + CASE k WHEN 1 THEN i WHEN 2 THEN l - j WHEN 3 THEN l - i ELSE j END AS INTEGER) AS x, b0 FROM g""")
def rotate_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, meta = tables.orders_raster(spark, sf_dir)
    plan = px.select(F.expr("CAST(y div 16 AS INT) AS ty"), F.expr("CAST(x div 16 AS INT) AS tx")).distinct().withColumn("turns", (F.col("ty") + F.col("tx")) % 4)
    return tiles.turn_tiles(px.select("y", "x", "b0"), plan, 16, meta)


def orient_ctes(t: int) -> str:
    """From lb (y, x, label) and sz to tn (ty, tx, turns): tiles turned in order, the state being the turned ends of the
    tiles before, the row above and the column before."""
    cell = lambda k: {0: "c[i * n + j + 1]", 1: "c[j * n + n - i]", 2: "c[(n - 1 - i) * n + n - j]", 3: "c[(n - 1 - j) * n + i + 1]"}[k]
    line = lambda k, i, j: f"list_transform(range(0, n), lambda q: {cell(k).replace('i', '(' + i + ')').replace('j', '(' + j + ')')})"
    turned = lambda name, i, j: f"{', '.join(f'{line(k, i, j)} AS {name}{k}' for k in range(4))}"
    even = lambda a, b: f"len(list_filter(range(1, n + 1), lambda q: {a}[q] = {b}[q])) / n::DOUBLE"
    score = lambda k: f"(CASE WHEN ty > 0 THEN {even(f'top{k}', 'up')} ELSE 0 END + CASE WHEN tx > 0 THEN {even(f'lef{k}', 'bef')} ELSE 0 END)"
    return f"""tl AS (SELECT y // {t} AS ty, x // {t} AS tx, list(label ORDER BY y, x) AS c, max(y % {t}) + 1 AS n, max(x % {t}) + 1 AS nx FROM lb GROUP BY 1, 2),
      te AS (SELECT ty, tx, n, nx, c, row_number() OVER (ORDER BY ty, tx) AS place, {turned("top", "0", "q")}, {turned("lef", "q", "0")}, {turned("bot", "n - 1", "q")}, {turned("rig", "q", "n - 1")} FROM tl WHERE n = nx),
      tb AS (SELECT tl.ty, tl.tx, tl.n, tl.nx, tl.n = tl.nx AS square, row_number() OVER (ORDER BY tl.ty, tl.tx) AS place, te.* EXCLUDE (ty, tx, n, nx, place),
        list_transform(range(0, tl.nx), lambda q: tl.c[(tl.n - 1) * tl.nx + q + 1]) AS bott, list_transform(range(0, tl.n), lambda q: tl.c[q * tl.nx + tl.nx]) AS rigt FROM tl LEFT JOIN te USING (ty, tx)),
      tn AS (WITH RECURSIVE st AS (
        SELECT CAST(0 AS BIGINT) AS place, CAST(-1 AS BIGINT) AS ty, CAST(-1 AS BIGINT) AS tx, 0 AS turns, MAP {{}}::MAP(BIGINT, INTEGER[]) AS above, CAST([] AS INTEGER[]) AS before
        UNION ALL
        SELECT place, ty, tx, turns, map_from_entries(list_concat(list_filter(map_entries(above), lambda e: e.key <> tx), [{{'key': tx, 'value': CASE turns WHEN 1 THEN bot1 WHEN 2 THEN bot2 WHEN 3 THEN bot3 ELSE bott END}}])),
          CASE turns WHEN 1 THEN rig1 WHEN 2 THEN rig2 WHEN 3 THEN rig3 ELSE rigt END FROM (
          SELECT *, CASE WHEN NOT square OR {t} = 1 THEN 0 ELSE (SELECT CASE WHEN b > 0 AND s[b + 1] >= {tiles.ALIGNED} AND s[b + 1] - s[1] >= {tiles.BETTER} THEN b ELSE 0 END FROM (SELECT s, list_reduce([1, 2, 3], lambda a, k: CASE WHEN s[k + 1] > s[a + 1] + 1e-6 THEN k ELSE a END, 0) AS b)) END AS turns FROM (
          SELECT *, CASE WHEN square THEN [{', '.join(score(k) for k in range(4))}] END AS s FROM (
          SELECT tb.*, above, above[tb.tx] AS up, before AS bef FROM st JOIN tb ON tb.place = st.place + 1))))
        SELECT CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, turns FROM st WHERE place > 0)"""


def turned_sql(t: int, of: str = "lb") -> str:
    return f"""SELECT CAST(ty * {t} + CASE k WHEN 1 THEN l - j WHEN 2 THEN l - i WHEN 3 THEN j ELSE i END AS INTEGER) AS y, CAST(tx * {t} + CASE k WHEN 1 THEN i WHEN 2 THEN l - j WHEN 3 THEN l - i ELSE j END AS INTEGER) AS x, label
      FROM (SELECT b.y // {t} AS ty, b.x // {t} AS tx, b.y % {t} AS i, b.x % {t} AS j, label, turns AS k, least({t}, h - b.y // {t} * {t}) - 1 AS l FROM {of} b, sz JOIN tn ON tn.ty = b.y // {t} AND tn.tx = b.x // {t})"""


@query(f"WITH {LABELS_SQL}, sz AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM px), {orient_ctes(4)} {turned_sql(4)}")
def auto_orient(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, meta = _labels(spark, sf_dir)
    return tiles.turn_tiles(labels, tiles.orientation_plan(labels, 4, meta), 4, meta)


def settling_ctes(k: int = 4) -> str:
    """From bl (blk_y, blk_x, f0, f1, f2) to ctr (k, vec), darkest first: iterations until no centre moves by more than the
    tolerance; once that is so, the later ones change nothing."""
    cte = f"""ini AS (SELECT f0, f1, f2, min((blk_y * 73856093 + blk_x * 19349663) % 1000003 * 1000000000000 + blk_y * 1000000 + blk_x) AS place FROM bl GROUP BY 1, 2, 3),
      c0 AS (SELECT CAST(row_number() OVER (ORDER BY place) - 1 AS INTEGER) AS k, f0 AS c0, f1 AS c1, f2 AS c2, false AS still FROM ini QUALIFY row_number() OVER (ORDER BY place) <= {k})"""
    for n in range(cluster.MAX_ITERATIONS):
        cte += f""", a{n} AS (SELECT bl.*, c.k FROM bl, c{n} c QUALIFY row_number() OVER (PARTITION BY blk_y, blk_x ORDER BY (f0 - c0) ** 2 + (f1 - c1) ** 2 + (f2 - c2) ** 2, c.k) = 1),
          g{n} AS (SELECT k, avg(f0) AS m0, avg(f1) AS m1, avg(f2) AS m2 FROM a{n} GROUP BY k),
          c{n + 1} AS (SELECT k, CASE WHEN still THEN c0 ELSE m0 END AS c0, CASE WHEN still THEN c1 ELSE m1 END AS c1, CASE WHEN still THEN c2 ELSE m2 END AS c2,
            still OR max(sqrt((m0 - c0) ** 2 + (m1 - c1) ** 2 + (m2 - c2) ** 2)) OVER () <= {cluster.TOLERANCE} AS still FROM c{n} JOIN g{n} USING (k))"""
    return cte + f", ctr AS (SELECT CAST(row_number() OVER (ORDER BY (c0 + c1 + c2) / 3, k) - 1 AS INTEGER) AS k, [c0, c1, c2] AS vec FROM c{cluster.MAX_ITERATIONS})"


class MeanModel:
    """Stands for a network: each quarter of a tile's side gives a cell with the bands' means."""

    def forward(self, x: np.ndarray) -> tuple[None, np.ndarray]:
        n, c, h, w = x.shape
        return None, x.reshape(n, c, 4, h // 4, 4, w // 4).mean((3, 5))


@query(f"""WITH {SIZE_SQL}, cz AS (SELECT (h + 15) // 16 * 4 AS ch, (w + 15) // 16 * 4 AS cw FROM sz),
  bl AS (SELECT q.y AS blk_y, q.x AS blk_x, coalesce(f0, 0) AS f0, coalesce(f1, 0) AS f1, coalesce(f2, 0) AS f2 FROM (SELECT a.y, b.x FROM (SELECT unnest(range(ch)) AS y FROM cz) a, (SELECT unnest(range(cw)) AS x FROM cz) b) q
    LEFT JOIN (SELECT y // 4 AS y, x // 4 AS x, {", ".join(f"CAST(sum(b{n}) AS BIGINT) / 4080.0::DOUBLE AS f{n}" for n in range(3))} FROM px GROUP BY 1, 2) m USING (y, x)),
  {settling_ctes()}, sd AS (SELECT blk_y AS y, blk_x AS x, ch AS h, cw AS w, c.k AS label, [f0, f1, f2] AS vec FROM bl, cz, ctr c
    QUALIFY row_number() OVER (PARTITION BY blk_y, blk_x ORDER BY (f0 - c.vec[1]) ** 2 + (f1 - c.vec[2]) ** 2 + (f2 - c.vec[3]) ** 2, c.k) = 1),
  {refine_ctes("r", "sd", 6)}, lb AS (SELECT px.y, px.x, label FROM px JOIN finr f ON f.y = px.y // 4 AND f.x = px.x // 4), {orient_ctes(16)} {turned_sql(16)}""")
def latent_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, meta = tables.orders_raster(spark, sf_dir)
    return pipeline.segment_latent(px, meta, MeanModel, 3, 4, 16, config={"neighbors": 6}).labels


# layers, progress, settings


LAYERS_SQL = """ly AS (SELECT 'L' || c_custkey AS layer_id, c_name AS name, CASE c_custkey % 4 WHEN 0 THEN 'VectorLayer' WHEN 3 THEN 'PluginLayer' ELSE 'RasterLayer' END AS layer_type,
  CASE c_custkey % 7 WHEN 0 THEN 'gdal' WHEN 1 THEN 'GDAL' WHEN 2 THEN 'wms' WHEN 3 THEN 'ogr' WHEN 4 THEN 'XYZ' WHEN 5 THEN 'gdal' END AS provider_name,
  CASE c_custkey % 5 WHEN 0 THEN '/data/' || c_name || '.TIF|layername=a' WHEN 1 THEN 'https://example.org/' || c_custkey || '.tif' WHEN 2 THEN '/data/a.b/img.tiff' WHEN 3 THEN '/VSICURL/x.png' END AS source_path,
  CAST(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 3 END AS INTEGER) AS band_count FROM customer)"""
FILE_SQL = "coalesce(lower(provider_name) = 'gdal' AND band_count = 3 AND regexp_matches(lower(split_part(source_path, '|', 1)), '[^/]\\.tiff?$'), false)"
RENDER_SQL = "coalesce(lower(provider_name) IN ('wms', 'wmts', 'wcs', 'arcgismapserver', 'arcgisfeatureserver', 'wfs', 'xyz', 'vectortile', 'mbtiles') OR (provider_name IS NOT NULL AND layer_type = 'VectorLayer') OR (lower(provider_name) = 'gdal' AND regexp_matches(lower(source_path), '^(/vsicurl/|https?://)')), false)"


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda n, *values: F.element_at(F.array(*[v if not isinstance(v, str | type(None)) else F.lit(v) for v in values]), (F.col("c_custkey") % n).cast("int") + 1)
    key, name = F.col("c_custkey"), F.col("c_name")
    return tables.read(spark, sf_dir, "customer").select(
        F.concat(F.lit("L"), key).alias("layer_id"),
        name.alias("name"),
        pick(4, "VectorLayer", "RasterLayer", "RasterLayer", "PluginLayer").alias("layer_type"),
        pick(7, "gdal", "GDAL", "wms", "ogr", "XYZ", "gdal", None).alias("provider_name"),
        pick(5, F.concat(F.lit("/data/"), name, F.lit(".TIF|layername=a")), F.concat(F.lit("https://example.org/"), key, F.lit(".tif")), "/data/a.b/img.tiff", "/VSICURL/x.png", None).alias("source_path"),
        F.when(key % 3 == 0, 1).otherwise(3).alias("band_count"),
    )


@query(f"WITH {LAYERS_SQL} SELECT layer_id, {FILE_SQL} AS file_raster, {RENDER_SQL} AS renderable FROM ly")
def layer_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layers(spark, sf_dir).select("layer_id", layers.is_file_raster().alias("file_raster"), layers.is_renderable().alias("renderable"))


@query(f"WITH {LAYERS_SQL} SELECT layer_id, name, layer_type FROM ly WHERE layer_type IN ('RasterLayer', 'VectorLayer') ORDER BY lower(name), layer_id")
def layer_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.listed(_layers(spark, sf_dir)).select("layer_id", "name", "layer_type")


@query(f"WITH {LAYERS_SQL}, nf AS (SELECT * FROM ly WHERE NOT {FILE_SQL}) SELECT layer_id, name FROM nf WHERE {RENDER_SQL} AND layer_type IN ('RasterLayer', 'VectorLayer') ORDER BY lower(name), layer_id LIMIT 1")
def rendering_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _layers(spark, sf_dir)
    return layers.rendering_candidate(rows.where(~layers.is_file_raster())).select("layer_id", "name")


#: By the supplier's key: small numbers, metres of a web map, small degrees, and numbers beyond decimal notation.
_SCALES = "CASE s_suppkey % 5 WHEN 1 THEN -13627665.27::DOUBLE WHEN 2 THEN 0.0001::DOUBLE WHEN 3 THEN 1e17::DOUBLE WHEN 4 THEN 0.000003::DOUBLE ELSE 0.5::DOUBLE END"


@query(f"""WITH e AS (SELECT 'S' || s_suppkey AS layer_id, s_suppkey::DOUBLE * {_SCALES} AS xmin, s_suppkey::DOUBLE * 0.25::DOUBLE AS ymin, s_suppkey + 10.5::DOUBLE AS xmax, (s_suppkey + 20) * 12345.678::DOUBLE AS ymax, CASE WHEN s_suppkey % 3 = 0 THEN 'EPSG:' || (4326 + s_suppkey % 2) WHEN s_suppkey % 3 = 1 THEN '' END AS crs FROM supplier),
  t AS (SELECT *, concat_ws(',', xmin::VARCHAR, xmax::VARCHAR, ymin::VARCHAR, ymax::VARCHAR) AS p FROM e)
  SELECT layer_id, CASE WHEN length(coalesce(crs, '')) > 0 THEN p || ' [' || crs || ']' ELSE p END AS extent, layer_id AS layers, 1.0::DOUBLE AS map_units_per_pixel, '' AS output FROM t""")
def extent_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, scale = F.col("s_suppkey"), F.expr(_SCALES.replace("::DOUBLE", "D"))
    rows = tables.read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), key).alias("layer_id"), (key * scale).alias("xmin"), (key * 0.25).alias("ymin"), (key + 10.5).alias("xmax"), ((key + 20) * 12345.678).alias("ymax"), F.when(key % 3 == 0, F.concat(F.lit("EPSG:"), 4326 + key % 2)).when(key % 3 == 1, F.lit("")).alias("crs"))
    return layers.render_params(rows).withColumn("layers", F.concat_ws(",", "layers"))


@query(f"""WITH {LAYERS_SQL} SELECT * FROM (SELECT 'id' AS asked, layer_id, name FROM ly WHERE layer_id = 'L7' UNION ALL (SELECT 'name', layer_id, name FROM ly WHERE name = (SELECT min(c_name) FROM customer) ORDER BY layer_id LIMIT 1) UNION ALL SELECT 'neither', layer_id, name FROM ly WHERE layer_id = 'no such')""")
def find_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _layers(spark, sf_dir)
    name = tables.read(spark, sf_dir, "customer").agg(F.min("c_name")).first()[0]
    found = {"id": layers.find_layer(rows, layer_id="L7"), "name": layers.find_layer(rows, name=name), "neither": layers.find_layer(rows, layer_id="no such")}
    first, *rest = [df.select(F.lit(asked).alias("asked"), "layer_id", "name") for asked, df in found.items()]
    for df in rest:
        first = first.unionByName(df)
    return first


LOG_SQL = """lg AS (SELECT event_id AS seq, user_id AS run, CASE event_id % 3 WHEN 0 THEN 'general' WHEN 1 THEN 'worker' ELSE 'debug' END AS category,
  CASE event_id % 8 WHEN 0 THEN 'Prepare input ' || (event_id % 130) || ' %' WHEN 1 THEN 'Step ' || (event_id % 7) || ' / ' || (event_id % 9) || ' of kNN' WHEN 2 THEN 'Smoothing ' || (event_id % 101) || '% done'
    WHEN 3 THEN 'no number here' WHEN 4 THEN 'Chunk plan step ' || (event_id % 5) || '/4' WHEN 5 THEN 'Rendering 99%' WHEN 6 THEN 'queue 3%' ELSE 'chunk ' || (event_id % 11) || '/11 (' || (event_id % 100) || '%)' END AS message FROM events),
  tk AS (SELECT *, regexp_extract(message, '(\\d{1,3})\\s*%', 1) AS pc, regexp_extract(message, '(?i)step\\s+(\\d+)\\s*/\\s*(\\d+)', 1) AS sa, regexp_extract(message, '(?i)step\\s+(\\d+)\\s*/\\s*(\\d+)', 2) AS so FROM lg),
  pa AS (SELECT *, CAST(CASE WHEN pc <> '' THEN least(CAST(pc AS INTEGER), 100) WHEN so <> '' AND TRY_CAST(so AS DOUBLE) > 0 THEN round_even(least(1.0, CAST(sa AS DOUBLE) / CAST(so AS DOUBLE)) * 100, 0) END AS INTEGER) AS percent FROM tk),
  st AS (SELECT seq, run, category, message, percent, CASE WHEN percent IS NULL THEN NULL WHEN lower(message) LIKE '%latent%' OR lower(message) LIKE '%knn%' THEN 'latent' WHEN lower(message) LIKE '%smooth%' OR lower(message) LIKE '%blur%' THEN 'smooth'
    WHEN lower(message) LIKE '%render%' THEN 'render' WHEN lower(message) LIKE '%prepare%' THEN 'prepare' WHEN lower(message) LIKE '%chunk%' AND lower(message) LIKE '%plan%' THEN 'chunk_plan' WHEN lower(message) LIKE '%queue%' THEN 'queue' ELSE 'inference' END AS stage FROM pa)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    message = F.when(n % 8 == 0, say("Prepare input ", n % 130, " %")).when(n % 8 == 1, say("Step ", n % 7, " / ", n % 9, " of kNN")).when(n % 8 == 2, say("Smoothing ", n % 101, "% done")).when(n % 8 == 3, F.lit("no number here")).when(n % 8 == 4, say("Chunk plan step ", n % 5, "/4")).when(n % 8 == 5, F.lit("Rendering 99%")).when(n % 8 == 6, F.lit("queue 3%")).otherwise(say("chunk ", n % 11, "/11 (", n % 100, "%)"))
    return tables.read(spark, sf_dir, "events").select(n.alias("seq"), F.col("user_id").alias("run"), F.when(n % 3 == 0, "general").when(n % 3 == 1, "worker").otherwise("debug").alias("category"), message.alias("message"))


@query(f"WITH {LOG_SQL} SELECT seq, stage, percent FROM st")
def progress_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("seq", progress.stage().alias("stage"), progress.percent().alias("percent"))


_PARTS = " ".join(f"WHEN '{s}' THEN {a!r}::DOUBLE + {b - a!r}::DOUBLE * percent / 100.0::DOUBLE" for s, (a, b) in progress.STAGES.items())


@query(f"WITH {LOG_SQL} SELECT seq, run, stage, percent, round(max(CASE stage {_PARTS} END) OVER (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING), 6) AS overall FROM st")
def overall_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(progress.timeline(_log(spark, sf_dir)).select("seq", "run", "stage", "percent", "overall"), ["overall"])


@query(f"WITH {LOG_SQL} SELECT seq, message FROM lg WHERE category = 'general' OR (category = 'worker' AND regexp_matches(message, '\\b\\d+\\s*/\\s*\\d+\\b')) ORDER BY seq DESC LIMIT 50")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.log_tail(_log(spark, sf_dir)).select("seq", "message")


@query("""WITH b AS (SELECT * FROM (VALUES (0, 5, 1), (1, 11, 1), (2, 21, 2)) v(level, kernel, iterations)), r AS (SELECT * FROM (VALUES ('low', 16), ('medium', 8), ('high', 4)) v(resolution, side))
  SELECT level::INTEGER AS level, resolution, (greatest(3, (kernel * side // 4) | 1))::INTEGER AS kernel, iterations::INTEGER AS iterations FROM b, r""")
def blur_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, name, found.kernel_size, found.iterations) for n in config.BLURS for name in config.RESOLUTIONS if (found := config.blur_config(n, name))]
    return spark.createDataFrame(rows, "level int, resolution string, kernel int, iterations int")


@query("""WITH m AS (SELECT s_suppkey AS id, s_suppkey * 50000000000 AS free FROM supplier), c AS (SELECT unnest([1, 3, 64]) AS bands)
  SELECT id, bands::INTEGER AS bands, greatest(128, least(512, floor(sqrt(greatest(CAST(floor(free * 0.01::DOUBLE) AS BIGINT), 67108864) // (bands * 32)))::INTEGER))::INTEGER AS chunk_size FROM m, c""")
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    adaptive = config.AdaptiveConfig()
    keys = [r["s_suppkey"] for r in tables.read(spark, sf_dir, "supplier").select("s_suppkey").collect()]
    return spark.createDataFrame([(k, b, adaptive.plan(b, k * 50_000_000_000).chunk_size) for k in keys for b in (1, 3, 64)], "id long, bands int, chunk_size int")


# files and streams


@query(f"WITH {tables.ORDERS_SQL} SELECT y, x, b0, b1, b2 FROM px")
def tiff_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, meta = tables.orders_raster(spark, sf_dir)
    full = RasterMeta.from_extent(meta.height, meta.width, 3, (0.0, 0.0, float(meta.width), float(meta.height)), 32633)
    path = raster.write_raster(px, full, new_folder(spark, "rasters"), "orders")
    return raster.read_tiff(spark, path, 3).select("y", "x", *[F.col(f"b{n}").cast("bigint").alias(f"b{n}") for n in range(3)])


@query(f"WITH {pool_sql(R)}, {assign_sql(BRIGHT)} SELECT blk_y, blk_x, label FROM asg")
def stream_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, meta = tables.orders_raster(spark, sf_dir)
    base = new_folder(spark, "stream")
    blocks = focal.pool(px, meta, R)
    blocks.repartition(4).write.parquet(f"{base}/in")
    stream.start(stream.read_blocks(spark, f"{base}/in", blocks.schema, 1), BRIGHT, f"{base}/out", f"{base}/state").awaitTermination()
    return stream.latest(spark, f"{base}/out")

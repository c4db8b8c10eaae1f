"""Dense rasters and other inputs made from the star schema's tables, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RasterMeta

WIDE, NARROW, LATENT = 100, 50, 25

ORDERS_SQL = f"""px AS (SELECT CAST(o_orderkey // {WIDE} AS INTEGER) AS y, CAST(o_orderkey % {WIDE} AS INTEGER) AS x,
  CAST(floor(o_totalprice) AS BIGINT) % 256 AS b0, o_custkey % 256 AS b1, (CAST(floor(o_totalprice) AS BIGINT) * 7) % 256 AS b2 FROM orders)"""
EVENTS_SQL = f"""px AS (SELECT CAST(event_id // {NARROW} AS INTEGER) AS y, CAST(event_id % {NARROW} AS INTEGER) AS x,
  CAST(floor(abs(coalesce("value", 0))) AS BIGINT) % 256 AS b0, coalesce(user_id, 0) % 256 AS b1, CAST(length(coalesce(event_type, '')) * 16 AS BIGINT) AS b2 FROM events)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_raster(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, RasterMeta]:
    """Three integer bands, WIDE pixels a row."""
    price = F.floor("o_totalprice").cast("bigint")
    rows = read(spark, sf_dir, "orders").select(F.expr(f"CAST(o_orderkey div {WIDE} AS INT)").alias("y"), (F.col("o_orderkey") % WIDE).cast("int").alias("x"), (price % 256).alias("b0"), (F.col("o_custkey") % 256).alias("b1"), (price * 7 % 256).alias("b2"))
    return rows, RasterMeta.of(rows)


def events_raster(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, RasterMeta]:
    """Three integer bands, NARROW pixels a row."""
    rows = read(spark, sf_dir, "events").select(F.expr(f"CAST(event_id div {NARROW} AS INT)").alias("y"), (F.col("event_id") % NARROW).cast("int").alias("x"), (F.floor(F.abs(F.coalesce("value", F.lit(0.0)))).cast("bigint") % 256).alias("b0"), (F.coalesce("user_id", F.lit(0)) % 256).alias("b1"), (F.length(F.coalesce("event_type", F.lit(""))) * 16).cast("bigint").alias("b2"))
    return rows, RasterMeta.of(rows)


def latent_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, RasterMeta]:
    """(y, x, label, vec) of the embeddings, LATENT cells a row, labels held to 0..3."""
    rows = read(spark, sf_dir, "embeddings").select(F.expr(f"CAST(vec_id div {LATENT} AS INT)").alias("y"), (F.col("vec_id") % LATENT).cast("int").alias("x"), (F.col("label") % 4).alias("label"), F.col("embedding").alias("vec"))
    size = rows.agg(F.max("y").alias("y")).first()["y"]
    return rows, RasterMeta(size + 1, LATENT, 1)

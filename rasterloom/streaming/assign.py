"""Streams of block files labelled with frozen centres, the last write of a block winning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.nearest import assign
from ..schema import features_of


def read_blocks(spark: SparkSession, path: str, schema, files_at_once: int = 16) -> DataFrame:
    """A stream of block rows from Parquet files as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def label_stream(blocks: DataFrame, centers: list[list[float]]) -> DataFrame:
    """Stateless: each block's nearest centre, as in a batch."""
    return assign(blocks, centers, features_of(blocks)).select("blk_y", "blk_x", "label")


def start(blocks: DataFrame, centers: list[list[float]], out: str, checkpoint: str) -> StreamingQuery:
    """Append every batch's labels under its number. A repeated batch replaces its own folder, so results hold exactly once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return label_stream(blocks, centers).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The last label written for each block."""
    rows = spark.read.parquet(f"{out}/*")
    return rows.groupBy("blk_y", "blk_x").agg(F.max_by("label", "batch").alias("label"))

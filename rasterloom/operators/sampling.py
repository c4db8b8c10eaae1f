"""Deterministic samples: a stride grid of blocks, and quotas by class."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cell_hash(y: Column | str, x: Column | str, seed: int = 0) -> Column:
    """An integer hash of a cell that any SQL engine computes alike."""
    y, x = (F.col(c) if isinstance(c, str) else c for c in (y, x))
    return (y.cast("long") * 73856093 + x.cast("long") * 19349663 + seed * 83492791) % 1000003


def sample_blocks(blocks: DataFrame, rows: int, cols: int, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` blocks: all if they fit, else those on a stride grid, the first ones by hash."""
    total = rows * cols
    if total <= most:
        return blocks
    stride = max(1, int(math.sqrt(total / most)))
    on_grid = blocks.where(f"blk_y % {stride} = 0 AND blk_x % {stride} = 0")
    if (-(-rows // stride)) * (-(-cols // stride)) <= most:
        return on_grid
    return on_grid.orderBy(cell_hash("blk_y", "blk_x", seed), "blk_y", "blk_x").limit(most)


def quotas(counts: dict[int, int], most: int) -> dict[int, int]:
    """How many of each class: its share of ``most``, one at least, lowered in turn until they fit (if one each does)."""
    total = sum(counts.values())
    given = {c: max(1, int(n / total * most)) for c, n in sorted(counts.items())}
    while (over := sum(given.values()) - most) > 0 and max(given.values()) > 1:
        for c in [c for c in given if given[c] > 1][:over]:
            given[c] -= 1
    return {c: min(n, counts[c]) for c, n in given.items()}


def stratified_sample(df: DataFrame, most: int, label: str = "label", id_col: str = "id", seed: int = 0) -> DataFrame:
    """At most ``most`` rows, by class in proportion; all of them if they fit. Order within a class is by a hash of the id.

    The largest quota prunes each task's rows before the shuffle (window group limit). Null labels are passed over.
    """
    counts = {r[label]: r["n"] for r in df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(counts.values()) <= most:
        return df.where(F.col(label).isNotNull())
    quota = quotas(counts, most)
    order = (F.col(id_col).cast("long") * 73856093 + seed * 83492791) % 1000003
    ranked = df.where(F.col(label).isNotNull()).withColumn("__n", F.row_number().over(Window.partitionBy(label).orderBy(order, id_col))).where(F.col("__n") <= max(quota.values()))
    allowed = F.create_map(*[F.lit(v) for pair in quota.items() for v in pair])[F.col(label)]
    return ranked.where(F.col("__n") <= allowed).drop("__n")

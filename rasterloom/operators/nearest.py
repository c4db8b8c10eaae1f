"""Distances to centres, nearest centre, exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Up to so many centres are written out as one expression; more are walked through as an array.
LITERAL_CENTERS = 64
#: Reference rows sent to the workers at once, and distances held at once.
BLOCK_ROWS, TILE_PAIRS = 120_000, 4_000_000


def squared_distance(features: list[str], center: list[float], strict: bool = False) -> Column:
    """Squared distance of feature columns to one centre, channel by channel; ``strict`` fails on a NaN or infinity."""
    total = None
    for f, c in zip(features, center):
        d = F.col(f).cast("double") - F.lit(float(c))
        total = d * d if total is None else total + d * d
    if strict:
        broken = F.isnan(total) | (total == float("inf"))
        total = F.when(broken, F.raise_error(F.lit("a distance is not finite")).cast("double")).otherwise(total)
    return total


def nearest_center(features: list[str], centers: list[list[float]], strict: bool = False) -> Column:
    """struct(d, k) of the nearest centre, ties to the lowest index: no join, no shuffle."""
    if not centers:
        raise ValueError("there is no centre")
    if len(centers) <= LITERAL_CENTERS:
        each = [F.struct(squared_distance(features, c, strict).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centers)]
        return F.least(*each) if len(each) > 1 else each[0]
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*[F.lit(float(v)) for v in c]).alias("c")) for k, c in enumerate(centers)])
    point = F.array(*[F.col(f).cast("double") for f in features])
    gap = lambda c: F.aggregate(F.zip_with(point, c["c"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    found = F.array_min(F.transform(table, lambda c: F.struct(gap(c).alias("d"), c["k"].alias("k"))))
    if strict:
        found = F.when(F.isnan(found["d"]) | (found["d"] == float("inf")), F.raise_error(F.lit("a distance is not finite")).cast("struct<d: double, k: int>")).otherwise(found)
    return found


def assign(blocks: DataFrame, centers: list[list[float]], features: list[str], strict: bool = False) -> DataFrame:
    """Adds label (int) and dist2 (double) of the nearest centre."""
    return blocks.withColumn("__near", nearest_center(features, centers, strict)).withColumns({"label": F.col("__near.k"), "dist2": F.col("__near.d")}).drop("__near")


def nearest_rows(asks: np.ndarray, names: np.ndarray, points: np.ndarray, k: int) -> list[list[dict]]:
    """The k nearest of ``points``, whose ``names`` ascend, for each ask, nearest first and ties to the smaller name."""
    sizes, step, tops = (points**2).sum(1), max(1, TILE_PAIRS // len(points)), []
    for at in range(0, len(asks), step):
        part = asks[at : at + step]
        # one matrix product finds all that rounding may put among the k best, and those are measured exactly
        own = (part**2).sum(1)[:, None]
        rough = own + sizes[None, :] - 2 * (part @ points.T)
        bound = np.partition(rough, min(k, len(points)) - 1, 1)[:, min(k, len(points)) - 1 : min(k, len(points))]
        bound = bound + 1e-9 * (own + sizes.max() + 1)
        for ask, row, most in zip(part, rough, bound):
            near = np.flatnonzero(row <= most)
            gaps = ((points[near] - ask) ** 2).sum(1)
            tops.append([{"dist2": float(gaps[j]), "neighbour": int(names[near[j]])} for j in np.argsort(gaps, kind="stable")[:k]])
    return tops


def _met(k: int):
    """Rows of cells, each cell's references before its queries: the k best of each query in each cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, ids, vecs, names, points = None, [], [], None, None
        for pdf in batches:
            for key, part in pdf.groupby(["ask_block", "block"], sort=False):
                if key != cell:
                    cell, ids, vecs, names, points = key, [], [], None, None
                known, asks = part[~part["asks"]], part[part["asks"]]
                if len(known):
                    ids.append(known["id"].to_numpy(np.int64))
                    vecs.append(np.array(known["vec"].tolist(), np.float64))
                if len(asks) and ids:
                    if names is None:
                        names, points = np.concatenate(ids), np.concatenate(vecs)
                        order = np.argsort(names, kind="stable")
                        names, points = names[order], points[order]
                    yield pd.DataFrame({"id": asks["id"], "top": nearest_rows(np.array(asks["vec"].tolist(), np.float64), names, points, k)})

    return run


def knn(queries: DataFrame, refs: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(id, rank, neighbour, dist2): the k nearest reference rows of each query by squared distance, ties to the smaller id.

    A query that is also a reference row is its own neighbour. k is held to the number of references; k of zero or less
    gives no rows. Up to BLOCK_ROWS counted references are broadcast. More are never gathered: blocks of references meet
    blocks of queries by an exchange, and each query's lists, one a block, are merged. Rows with a null id or vector take no
    part. Vectors must have one length.
    """
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("top", T.ArrayType(T.StructType([T.StructField("dist2", T.DoubleType()), T.StructField("neighbour", T.LongType())])))])
    ready = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    asked, known = ready(queries), ready(refs)
    spark = queries.sparkSession
    n = known.count() if k > 0 else 0
    if not n:
        return spark.createDataFrame([], "id long, rank int, neighbour long, dist2 double")
    if n <= BLOCK_ROWS:
        rows = sorted(known.collect(), key=lambda r: r["id"])
        shared = spark.sparkContext.broadcast((np.array([r["id"] for r in rows], np.int64), np.array([r["vec"] for r in rows], np.float64)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, points = shared.value
            for pdf in batches:
                yield pd.DataFrame({"id": pdf["id"], "top": nearest_rows(np.array(pdf["vec"].tolist(), np.float64), names, points, k) if len(pdf) else []})

        found = asked.mapInPandas(run, schema)
    else:
        blocks, ask_blocks = -(-n // BLOCK_ROWS), max(1, -(-asked.count() // BLOCK_ROWS))
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        own = lambda m: F.expr(f"CAST(pmod(xxhash64(id), {m}) AS INT)")
        cells = known.select(every(ask_blocks).alias("ask_block"), own(blocks).alias("block"), F.lit(False).alias("asks"), "id", "vec").unionByName(asked.select(own(ask_blocks).alias("ask_block"), every(blocks).alias("block"), F.lit(True).alias("asks"), "id", "vec"))
        cells = cells.repartition(blocks * ask_blocks, "ask_block", "block").sortWithinPartitions("ask_block", "block", "asks")
        found = cells.mapInPandas(_met(k), schema).groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
    return found.select("id", F.posexplode("top").alias("at", "hit")).select("id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.neighbour").alias("neighbour"), F.col("hit.dist2").alias("dist2"))


def gather_mean(edges: DataFrame, values: DataFrame, columns: list[str], query: str = "id", to: str = "neighbour") -> DataFrame:
    """For each query the mean of its neighbours' values: one equi-join and one partial aggregation."""
    there = values.select(F.col("id").alias(to), *columns)
    return edges.join(there, to).groupBy(query).agg(*[F.avg(c).alias(c) for c in columns])

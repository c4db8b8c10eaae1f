"""Exact top-k by inner product: tiled matrix products of queries and shards, partial selection, tree merging.

Queries and candidates are dealt into blocks by a hash of their id. A cell pairs one block of queries with one shard of
candidates of the same length; it holds its queries as a matrix, reads its candidates tile by tile, multiplies, and
keeps the k best of each query. Cells' lists are then merged by a tree of fixed fan-in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Sums below this are exact in double precision, where BLAS multiplies.
EXACT = 2**53
#: Scores end here, and below it products fit into 64 bits.
LARGEST = 2**63 - 3
LISTS = "query_id long, shard int, top array<struct<loss: long, vec_id: long>>"


def quantised(x: str, scale: int = 64) -> str:
    """SQL for floor(scale * v) of each component as double, at most 9.2e18 either way; null where a component is null or not finite."""
    ok = f"{x} IS NOT NULL AND NOT exists({x}, v -> v IS NULL OR isnan(v) OR abs(v) = double('infinity'))"
    held = f"greatest(-9.2e18D, least(9.2e18D, floor({scale} * CAST(v AS DOUBLE))))"
    return f"CASE WHEN {ok} THEN transform({x}, v -> CAST({held} AS BIGINT)) END"


def _select(best: tuple, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple:
    """The k smallest (loss, id) of ``best`` and a tile's scores for each query."""
    loss, held = np.concatenate([best[0], -scores], 1), np.concatenate([best[1], np.broadcast_to(ids, scores.shape)], 1)
    if loss.shape[1] > k:
        bound = np.partition(loss, k - 1, 1)[:, k - 1 : k]
        for row in np.flatnonzero((loss <= bound).sum(1) > k):  # ties at the bound go to the smaller ids
            at = np.flatnonzero(loss[row] == bound[row])
            spare = (loss[row] <= bound[row]).sum() - k
            loss[row, at[np.argsort(held[row, at], kind="stable")[len(at) - spare :]]] = np.iinfo(np.int64).max
        keep = np.argpartition(loss, k - 1, 1)[:, :k]
        loss, held = np.take_along_axis(loss, keep, 1), np.take_along_axis(held, keep, 1)
    return loss, held


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: by BLAS in doubles where they surely fit, else in 64-bit integers; one that 64 bits may not
    hold is computed without a bound and ends at the largest or smallest long but one."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    size = lambda m: [max(int(r.max(initial=0)), -int(r.min(initial=0))) for r in m]
    left, right = size(a), size(b)
    most = max(left, default=0) * max(right, default=0) * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < LARGEST:
        return a @ b.T
    out = np.zeros((len(a), len(b)), np.int64)
    calm = [np.array([n * max(other, default=0) * a.shape[1] < LARGEST for n in own], bool) for own, other in ((left, right), (right, left))]
    out[calm[0]] = a[calm[0]] @ b.T
    out[:, calm[1]] = a @ b[calm[1]].T
    for i, j in zip(*np.nonzero(~calm[0][:, None] & ~calm[1][None, :])):
        out[i, j] = max(-LARGEST, min(LARGEST, sum(x * y for x, y in zip(a[i].tolist(), b[j].tolist()))))
    return out


def _cells(k: int, tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, best, rows = None, [], None, []

        def multiply():
            nonlocal best, rows
            if rows and best is not None:
                ids = np.array([r[0] for r in rows], np.int64)
                scores = _product(matrix, np.array([r[1] for r in rows], np.int64).reshape(len(rows), matrix.shape[1]))
                own = matrix_ids[:, None] == ids[None, :]
                loss = np.where(own, np.iinfo(np.int64).min + 1, scores)
                best = _select(best, loss, ids, k)
            rows = []

        def emit():
            multiply()
            if best is None:
                return None
            tops = []
            for loss, held in zip(*best):
                real = [(int(a), int(b)) for a, b in zip(loss, held) if a < np.iinfo(np.int64).max - 1]
                tops.append([{"loss": a, "vec_id": b} for a, b in sorted(real)])
            kind = pa.list_(pa.struct([("loss", pa.int64()), ("vec_id", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array(matrix_ids), pa.array([cell[2]] * len(matrix_ids), pa.int32()), pa.array(tops, kind)], names=["query_id", "shard", "top"])

        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            flat, ends = column("vec").values.to_numpy(zero_copy_only=False), column("vec").offsets.to_pylist()
            vectors = [flat[a:b] for a, b in zip(ends, ends[1:])]
            for dim, block, shard, asks, vec_id, vec in zip(*[column(c).to_pylist() for c in ("dim", "block", "shard", "asks", "vec_id")], vectors):
                if (dim, block, shard) != cell:
                    if cell is not None and (out := emit()) is not None:
                        yield out
                    cell, asked, best, rows = (dim, block, shard), [], None, []
                if asks:
                    asked.append((vec_id, vec))
                    continue
                if best is None and asked:
                    matrix_ids = np.array([a[0] for a in asked], np.int64)
                    matrix = np.array([a[1] for a in asked], np.int64).reshape(len(asked), dim)
                    best = (np.zeros((len(asked), 0), np.int64), np.zeros((len(asked), 0), np.int64))
                rows.append((vec_id, vec))
                if len(rows) >= tile:
                    multiply()
        if cell is not None and (out := emit()) is not None:
            yield out

    return run


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    block_rows: int = 16384,
    shard_rows: int = 16384,
    max_shards: int = 256,
    tile_rows: int = 256,
    fan_in: int = 16,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k highest integer inner products, ties to the smaller vec_id.

    Both tables have vec_id (long) and vec (array of long). Rows with a null id or vector, or a null component, take no
    part. Only vectors of the query's own length are compared with it, and none of the query's own vec_id. A vec_id that
    asks twice asks once, with its first vector in array order; a candidate row that occurs twice counts twice. Fewer
    candidates than k: all of them. An empty table: no rows.
    """
    usable = "vec_id IS NOT NULL AND vec IS NOT NULL AND NOT exists(vec, v -> v IS NULL)"
    rows = stored(vectors.select(F.col("vec_id").cast("long"), F.col("vec").cast("array<long>")).where(usable), "candidates")
    asks = stored(queries.select(F.col("vec_id").cast("long"), F.col("vec").cast("array<long>")).where(usable).groupBy("vec_id").agg(F.min("vec").alias("vec")), "queries")
    n, q = rows.count(), asks.count()
    blocks, shards = max(1, -(-q // block_rows)), max(1, min(max_shards, -(-n // shard_rows)))
    dim = F.size("vec").alias("dim")
    copies = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))  # noqa: E731  each block meets each shard once
    left = asks.select(dim, F.expr(f"CAST(pmod(xxhash64(vec_id), {blocks}) AS INT) AS block"), copies(shards).alias("shard"), F.lit(True).alias("asks"), "vec_id", "vec")
    right = rows.select(dim, copies(blocks).alias("block"), F.expr(f"CAST(pmod(xxhash64(vec_id), {shards}) AS INT) AS shard"), F.lit(False).alias("asks"), "vec_id", "vec")
    cells = left.unionByName(right).repartition(blocks * shards, "dim", "block", "shard")
    tops = cells.sortWithinPartitions("dim", "block", "shard", F.desc("asks")).mapInArrow(_cells(k, tile_rows), LISTS)
    while shards > 1:  # each level merges fan_in lists of k
        shards = -(-shards // fan_in)
        tops = tops.groupBy("query_id", F.expr(f"shard div {fan_in} AS shard")).agg(F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
    out = tops.select("query_id", F.posexplode("top").alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.loss")).alias("score"))

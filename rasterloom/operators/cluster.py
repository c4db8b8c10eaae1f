"""K-Means: Lloyd iterations as aggregations, brightness order, and Spark ML as another backend."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import features_of
from .nearest import assign
from .sampling import cell_hash, sample_blocks

#: The fit's sample: rows at scale one and the range of scales; iterations and tolerance (fixed values).
SAMPLE_ROWS, SCALES, MAX_ITERATIONS, TOLERANCE = 20_000, (0.3, 2.0), 25, 1e-4


def sample_cap(scale: float) -> int:
    """Rows that a fit may sample."""
    return max(200, round(SAMPLE_ROWS * min(max(scale, SCALES[0]), SCALES[1])))


def initial_centers(blocks: DataFrame, k: int, seed: int = 0, ids: tuple[str, str] = ("blk_y", "blk_x")) -> list[list[float]]:
    """The first k distinct descriptors in hash order; repeated ones only if there are too few."""
    if k < 1:
        raise ValueError("the number of segments must be positive")
    features = features_of(blocks)
    keyed = blocks.select(*features, F.struct(cell_hash(*ids, seed).alias("h"), *ids).alias("place"))
    distinct = keyed.groupBy(*features).agg(F.min("place").alias("place")).orderBy("place").limit(k).collect()
    if len(distinct) < k:
        rows = keyed.orderBy("place").limit(2 * k).collect()
        if len(rows) < k:
            raise ValueError(f"{k} segments need as many descriptors; there are {len(rows)}")
        chosen = {tuple(r["place"]) for r in distinct}
        distinct += [r for r in rows if tuple(r["place"]) not in chosen][: k - len(distinct)]
    return [[float(r[f]) for f in features] for r in distinct]


def lloyd_step(blocks: DataFrame, centers: list[list[float]], r: int | None = None, ids: tuple[str, str] = ("blk_y", "blk_x")) -> list[list[float]]:
    """Centres after one iteration. With ``r``, means come from the exact numerators n of pooled blocks.

    Each empty cluster takes one of the points farthest from their centres.
    """
    features = features_of(blocks)
    exact = r is not None and all(f"n{f[1:]}" in blocks.columns for f in features)
    columns = [f"n{f[1:]}" for f in features] if exact else features
    labelled = assign(blocks, centers, features)
    rows = {x["label"]: x for x in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("cnt"), *[F.sum(c).alias(c) for c in columns]).collect()}
    empty = [k for k in range(len(centers)) if k not in rows]
    spare = labelled.orderBy(F.desc("dist2"), *ids).limit(len(empty)).collect() if empty else []
    new = []
    for k in range(len(centers)):
        if k in rows:
            by = float(rows[k]["cnt"] * (9 * r * r if exact else 1))
            new.append([float(rows[k][c]) / by for c in columns])
        else:
            point = spare.pop(0) if spare else None
            new.append([float(point[f]) for f in features] if point else list(centers[k]))
    return new


def lloyd(
    blocks: DataFrame,
    k: int,
    r: int | None = None,
    seed: int = 0,
    init: list[list[float]] | None = None,
    max_iterations: int = MAX_ITERATIONS,
    tolerance: float = TOLERANCE,
    check: Callable[[], None] = lambda: None,
    ids: tuple[str, str] = ("blk_y", "blk_x"),
) -> list[list[float]]:
    """Lloyd's algorithm: until no centre moves by more than ``tolerance``, or ``max_iterations``. ``check`` runs before each.

    Only the k centres come to the driver. The blocks are kept in memory and disk meanwhile; what an executor loses is
    recomputed.
    """
    blocks = blocks.persist()
    try:
        centers = init or initial_centers(blocks, k, seed, ids)
        for _ in range(max_iterations):
            check()
            new = lloyd_step(blocks, centers, r, ids)
            moved = max(math.dist(a, b) for a, b in zip(centers, new))
            centers = new
            if moved <= tolerance:
                break
        return centers
    finally:
        blocks.unpersist()


def lloyd_local(blocks: DataFrame, k: int, r: int | None = None, seed: int = 0, check: Callable[[], None] = lambda: None) -> list[list[float]]:
    """The same algorithm on a sample that fits the driver by its bound: the rows are fetched once, and no job runs by iteration."""
    features = features_of(blocks)
    exact = r is not None and all(f"n{f[1:]}" in blocks.columns for f in features)
    columns = [f"n{f[1:]}" for f in features] if exact else features
    table = blocks.select("blk_y", "blk_x", *features, *(columns if exact else [])).toPandas().sort_values(["blk_y", "blk_x"], kind="stable")
    if k < 1 or len(table) < k:
        raise ValueError(f"{k} segments need as many descriptors, one at least; there are {len(table)}")
    points, sums = table[features].to_numpy(np.float64), table[columns].to_numpy()
    places = (table["blk_y"].to_numpy(np.int64) * 73856093 + table["blk_x"].to_numpy(np.int64) * 19349663 + seed * 83492791) % 1000003
    order = np.argsort(places, kind="stable")
    _, first = np.unique(points[order], axis=0, return_index=True)
    chosen = np.sort(first)[:k]
    chosen = np.append(chosen, np.setdiff1d(np.arange(len(order)), chosen)[: k - len(chosen)])
    centers = points[order[chosen]]
    for _ in range(MAX_ITERATIONS):
        check()
        gaps = ((points[:, None, :] - centers[None, :, :]) ** 2).sum(2)
        label = gaps.argmin(1)
        spare = iter(np.argsort(-gaps.min(1), kind="stable"))
        new = np.array([sums[label == c].sum(0) / float((label == c).sum() * (9 * r * r if exact else 1)) if (label == c).any() else points[next(spare)] for c in range(k)])
        moved = np.sqrt(((new - centers) ** 2).sum(1)).max()
        centers = new
        if moved <= TOLERANCE:
            break
    return centers.tolist()


def fit_centers(blocks: DataFrame, rows: int, cols: int, k: int, r: int | None = None, scale: float = 1.0, seed: int = 0, backend: str = "lloyd", check: Callable[[], None] = lambda: None) -> list[list[float]]:
    """Centres fitted once on a bounded sample of a raster's blocks, darkest first."""
    sample = sample_blocks(blocks, rows, cols, sample_cap(scale), seed)
    centers = ml_kmeans(sample, k, seed) if backend == "ml" else lloyd_local(sample, k, r, seed, check)
    return by_brightness(centers)


def brightness_ranks(centers: list[list[float]]) -> list[int]:
    """Each centre's rank by its mean, dark first; ties in order."""
    order = sorted(range(len(centers)), key=lambda k: (sum(centers[k]) / len(centers[k]), k))
    return [order.index(k) for k in range(len(centers))]


def by_brightness(centers: list[list[float]]) -> list[list[float]]:
    """The centres in order of brightness, as their labels will be."""
    ranks = brightness_ranks(centers)
    return [centers[ranks.index(n)] for n in range(len(centers))]


def relabel(labels: DataFrame, mapping: list[int] | None) -> DataFrame:
    """Labels sent through a mapping; None changes nothing, and a label outside it is an error."""
    if mapping is None:
        return labels
    bad = (F.col("label") < 0) | (F.col("label") >= len(mapping))
    new = F.element_at(F.array(*[F.lit(m) for m in mapping]), F.col("label") + 1)
    return labels.withColumn("label", F.when(bad, F.raise_error(F.lit("a label is outside the mapping")).cast("int")).otherwise(new))


def normalize_labels(labels: DataFrame, centers: list[list[float]]) -> tuple[DataFrame, list[list[float]]]:
    """Labels and centres in order of brightness."""
    return relabel(labels, brightness_ranks(centers)), by_brightness(centers)


def ml_kmeans(blocks: DataFrame, k: int, seed: int = 0, max_iterations: int = MAX_ITERATIONS) -> list[list[float]]:
    """Centres by Spark ML; its start and its empty clusters differ from Lloyd's above."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=features_of(blocks), outputCol="features").transform(blocks)
    model = KMeans(k=k, seed=seed, maxIter=max_iterations, tol=TOLERANCE).fit(ready)
    return [list(map(float, c)) for c in model.clusterCenters()]

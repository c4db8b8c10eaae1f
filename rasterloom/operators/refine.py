"""Soft label refinement: posteriors mixed with those of the nearest neighbours in feature and place."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import RasterMeta
from ..store import settled
from .nearest import gather_mean, knn
from .resample import bilinear_resize, nearest_resize
from .sampling import stratified_sample


@dataclass(frozen=True)
class RefineConfig:
    """Defaults of the refinement (fixed values)."""

    enabled: bool = True
    neighbors: int = 12
    temperature: float = 2.0
    mix: float = 0.65
    iterations: int = 2
    spatial_weight: float = 0.08
    index_points: int = 120_000
    hierarchy_factor: int = 1
    hierarchy_passes: int = 1

    @staticmethod
    def merged(given: dict | None) -> RefineConfig:
        """The defaults with given entries; None keeps a default and unknown names are passed over."""
        known = RefineConfig.__dataclass_fields__
        return RefineConfig(**{k: v for k, v in (given or {}).items() if v is not None and k in known})


def softmax(logits: list, floor: float = 1e-8) -> list:
    """Columns of the softmax of logit columns, shifted by their largest."""
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    exps = [F.exp(x - top) for x in logits]
    total = exps[0]
    for e in exps[1:]:
        total = total + e
    return [e / F.greatest(total, F.lit(floor)) for e in exps]


def vector_distance(vec: str, center: list[float]):
    """Squared distance of an array column to a centre, component by component."""
    point = F.array(*[F.lit(float(v)) for v in center])
    return F.aggregate(F.zip_with(F.col(vec), point, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, v: s + v)


def posteriors(cells: DataFrame, centers: list[list[float]], temperature: float, vec: str = "vec") -> DataFrame:
    """Adds p0..pk: half the softmax of negative distances over the temperature, half the seed label's plane."""
    soft = softmax([-vector_distance(vec, c) / max(temperature, 1e-6) for c in centers])
    held = F.greatest(F.lit(0), F.least(F.col("label"), F.lit(len(centers) - 1)))
    return cells.withColumns({f"p{k}": 0.5 * p + 0.5 * (held == k).cast("double") for k, p in enumerate(soft)})


def placed(cells: DataFrame, meta: RasterMeta, weight: float) -> DataFrame:
    """Vectors with the weighted cell position, from -1 to 1 on each axis, at their end; the id numbers cells row by row."""
    line = lambda c, n: F.lit(-1.0) if n <= 1 else -1.0 + 2.0 * F.col(c) / (n - 1)
    longer = F.concat(F.col("vec").cast("array<double>"), F.array(line("y", meta.height) * weight, line("x", meta.width) * weight))
    return cells.select((F.col("y").cast("long") * meta.width + F.col("x")).alias("id"), "y", "x", "label", "vec", longer.alias("where"))


def refine_core(cells: DataFrame, meta: RasterMeta, centers: list[list[float]], cfg: RefineConfig) -> DataFrame:
    """(y, x, label, p0..pk) of one level: ``cells`` has y, x, vec and the seed label."""
    k = len(centers)
    names = [f"p{c}" for c in range(k)]
    seen = settled(placed(cells.withColumn("label", F.greatest(F.lit(0), F.least(F.col("label"), F.lit(k - 1)))), meta, cfg.spatial_weight))
    index = stratified_sample(seen, cfg.index_points)
    edges = settled(knn(seen, index, cfg.neighbors, "id", "where").select("id", "neighbour"))
    now = posteriors(seen, centers, cfg.temperature).select("id", *names)
    for _ in range(max(1, cfg.iterations)):
        now = settled(now)
        near = gather_mean(edges, now, names).select("id", *[F.col(c).alias(f"__{c}") for c in names])
        now = now.join(near, "id").select("id", *[((1.0 - cfg.mix) * F.col(c) + cfg.mix * F.col(f"__{c}")).alias(c) for c in names])
    best = F.least(*[F.struct((-F.col(c)).alias("v"), F.lit(n).alias("k")) for n, c in enumerate(names)]) if k > 1 else F.struct(F.lit(0.0).alias("v"), F.lit(0).alias("k"))
    return now.select((F.col("id") / meta.width).cast("int").alias("y"), (F.col("id") % meta.width).cast("int").alias("x"), best["k"].alias("label"), *names)


def refine(cells: DataFrame, meta: RasterMeta, centers: list[list[float]], config: dict | None = None) -> DataFrame:
    """Refined labels, coarse levels first where the hierarchy asks for them; disabled: the seed labels as they are."""
    cfg = RefineConfig.merged(config)
    if not cfg.enabled:
        return cells.select("y", "x", "label")
    factor, passes = max(1, cfg.hierarchy_factor), max(1, cfg.hierarchy_passes)
    dims = len(centers[0])
    for level in range(passes - 1, 0, -1) if factor > 1 else ():
        scale = factor * level
        if min(meta.height, meta.width) < scale:
            continue
        small = RasterMeta(max(1, meta.height // scale), max(1, meta.width // scale), 1)
        wide = cells.select("y", "x", *[F.element_at("vec", d + 1).cast("double").alias(f"v{d}") for d in range(dims)])
        vecs = bilinear_resize(wide, meta, small, [f"v{d}" for d in range(dims)]).select("y", "x", F.array(*[f"v{d}" for d in range(dims)]).alias("vec"))
        seeds = nearest_resize(cells, meta, small, ["label"])
        coarse = settled(refine_core(vecs.join(seeds, ["y", "x"]), small, centers, cfg))
        cells = cells.drop("label").join(nearest_resize(coarse, small, meta, ["label"]), ["y", "x"])
    return refine_core(cells, meta, centers, cfg)

"""Square tiles: cutting, reassembly, rotation that lines up neighbouring tiles, and model calls by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import RasterMeta, bands_of

#: A rotation must line up this well, and this much better than none (fixed values).
ALIGNED, BETTER = 0.6, 0.05
#: Bytes that a batch of tiles may take, before safety and prefetching share it (fixed value).
BATCH_BUDGET = 128 << 20


def tile(pixels: DataFrame, t: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, ty, tx, data): t x t tiles, each band's cells row by row, zeros beyond the raster."""
    bands = bands_of(pixels)
    place = (F.col("y") % t * t + F.col("x") % t).cast("int")
    held = pixels.groupBy(*(keys or []), F.expr(f"CAST(y div {t} AS INT) AS ty"), F.expr(f"CAST(x div {t} AS INT) AS tx")).agg(F.map_from_entries(F.collect_list(F.struct(place.alias("i"), F.struct(*bands).alias("v")))).alias("m"))
    plane = lambda b: F.transform(F.sequence(F.lit(0), F.lit(t * t - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i)[b].cast("double"), F.lit(0.0)))
    planes = [plane(b) for b in bands]
    return held.select(*(keys or []), "ty", "tx", F.array(*planes).alias("data"))


def untile(tiles: DataFrame, t: int, meta: RasterMeta, keys: list[str] | None = None) -> DataFrame:
    """Pixels of tiles, the padding cut off."""
    rows = tiles.select(*(keys or []), "ty", "tx", F.posexplode(F.arrays_zip(*[F.col("data")[b].alias(f"b{b}") for b in range(meta.bands)])).alias("i", "v"))
    cut = rows.select(*(keys or []), (F.col("ty") * t + F.floor(F.col("i") / t)).cast("int").alias("y"), (F.col("tx") * t + F.col("i") % t).cast("int").alias("x"), *[F.col("v")[f"b{b}"].alias(f"b{b}") for b in range(meta.bands)])
    return cut.where(f"y < {meta.height} AND x < {meta.width}")


def turned_edges(edges: tuple, turns: int) -> tuple:
    """(top, left, bottom, right) of a tile after quarter turns against the clock; rows run right and columns down."""
    for _ in range(turns):
        top, left, bottom, right = edges
        edges = (right, top[::-1], left, bottom[::-1])
    return edges


def choose_turn(edges: tuple, above: np.ndarray | None, before: np.ndarray | None) -> int:
    """Quarter turns that line a square tile up, by its edges, with the row above and the column before it."""
    scores = []
    for k in range(4):
        top, left, _, _ = turned_edges(edges, k)
        scores.append((float((top == above).mean()) if above is not None else 0.0) + (float((left == before).mean()) if before is not None else 0.0))
    best = 0
    for k in range(1, 4):
        if scores[k] > scores[best] + 1e-6:
            best = k
    return best if best and scores[best] >= ALIGNED and scores[best] - scores[0] >= BETTER else 0


def tile_edges(labels: DataFrame, t: int, meta: RasterMeta, keys: list[str] | None = None) -> DataFrame:
    """(keys, ty, tx, h, w, top, left, bottom, right): each tile's size and outer cells; its inside is dropped before the shuffle."""
    placed = labels.select(*(keys or []), F.expr(f"CAST(y div {t} AS INT) AS ty"), F.expr(f"CAST(x div {t} AS INT) AS tx"), (F.col("y") % t).cast("int").alias("i"), (F.col("x") % t).cast("int").alias("j"), F.col("label").cast("int").alias("label"))
    placed = placed.withColumns({"h": F.least(F.lit(t), F.lit(meta.height) - F.col("ty") * t), "w": F.least(F.lit(t), F.lit(meta.width) - F.col("tx") * t)})
    outer = placed.where("i = 0 OR j = 0 OR i = h - 1 OR j = w - 1")
    line = lambda along, where, name: F.transform(F.array_sort(F.collect_list(F.when(F.expr(where), F.struct(along, "label")))), lambda c: c["label"]).alias(name)
    return outer.groupBy(*(keys or []), "ty", "tx", "h", "w").agg(line("j", "i = 0", "top"), line("i", "j = 0", "left"), line("j", "i = h - 1", "bottom"), line("i", "j = w - 1", "right"))


def orientation_plan(labels: DataFrame, t: int, meta: RasterMeta, keys: list[str] | None = None) -> DataFrame:
    """(keys, ty, tx, turns): each tile turned to fit its already turned neighbours, row by row.

    A tile depends on the ones before it, so a raster is one group; rasters are done in parallel. The group has the tiles'
    edges alone, and the fold holds one row of tiles. Tiles that are cut by the edge and not square stay.
    """
    keys = keys or []
    edges = tile_edges(labels, t, meta, keys)
    table = edges if keys else edges.withColumn("__all", F.lit(0))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, below, before, last = [], {}, None, None
        pdf = pdf.sort_values(["ty", "tx"], kind="stable")
        for ty, tx, h, w, *sides in zip(*[pdf[c] for c in ("ty", "tx", "h", "w", "top", "left", "bottom", "right")]):
            own, turns = tuple(np.asarray(side) for side in sides), 0
            if t > 1 and h == w:
                turns = choose_turn(own, below.get(tx) if ty else None, before if tx and last == (ty, tx - 1) else None)
                own = turned_edges(own, turns)
            below[tx], before, last = own[2], own[3], (ty, tx)
            rows.append((*[pdf[c].iloc[0] for c in keys], ty, tx, turns))
        return pd.DataFrame(rows, columns=[*keys, "ty", "tx", "turns"])

    kinds = ", ".join([*[f"`{c}` {dict(labels.dtypes)[c]}" for c in keys], "ty int", "tx int", "turns int"])
    return table.groupBy(*(keys or ["__all"])).applyInPandas(plan, kinds)


def turn_tiles(df: DataFrame, plan: DataFrame, t: int, meta: RasterMeta, keys: list[str] | None = None) -> DataFrame:
    """Every cell moved by its tile's quarter turns: an equi-join with the plan and arithmetic on coordinates."""
    keys = keys or []
    at = df.withColumns({"ty": F.expr(f"CAST(y div {t} AS INT)"), "tx": F.expr(f"CAST(x div {t} AS INT)"), "__i": F.col("y") % t, "__j": F.col("x") % t}).join(plan, [*keys, "ty", "tx"])
    n = F.least(F.lit(t), meta.height - F.col("ty") * t)
    turns = F.when(n == F.least(F.lit(t), meta.width - F.col("tx") * t), F.col("turns")).otherwise(0)
    i, j, last = F.col("__i"), F.col("__j"), n - 1
    new_i = F.when(turns == 1, last - j).when(turns == 2, last - i).when(turns == 3, j).otherwise(i)
    new_j = F.when(turns == 1, i).when(turns == 2, last - j).when(turns == 3, last - i).otherwise(j)
    rest = [c for c in df.columns if c not in ("y", "x")]
    return at.select((F.col("ty") * t + new_i).cast("int").alias("y"), (F.col("tx") * t + new_j).cast("int").alias("x"), *rest)


def recommended_batch(bands: int, height: int, width: int, budget: int | None = None, safety: int = 8, depth: int = 2) -> int:
    """Tiles in a batch, so that it and those fetched ahead keep to their share of the budget."""
    size = max(1, bands) * max(1, height) * max(1, width) * 4
    return max(1, max(1, max(budget or BATCH_BUDGET, size) // max(1, safety)) // (size * (1 + max(1, depth))))


def load_model(model_or_loader):
    """The model, made by its loader where it isn't one; it must have ``forward``."""
    made = hasattr(model_or_loader, "forward") and not isinstance(model_or_loader, type)
    model = model_or_loader if made else model_or_loader() if callable(model_or_loader) else None
    if model is None:
        raise RuntimeError("the model could not be loaded")
    if hasattr(model, "eval"):
        model.eval()
    return model


def latent_grid(tiles: DataFrame, loader: Callable, t: int, bands: int, dims: int, divide: float = 255.0, batch: int | None = None) -> DataFrame:
    """(y, x, vec) of a model over tiles: ``forward(array(n, bands, t, t))`` gives (anything, latent(n, dims, h, w)).

    The loader runs once in each task. Cells of a tile's latent grid lie at (ty h + i, tx w + j).
    """
    size = batch or recommended_batch(bands, t, t)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model(loader)
        for pdf in batches:
            for at in range(0, len(pdf), size):
                part = pdf.iloc[at : at + size]
                x = np.array([[np.asarray(b, np.float32) for b in d] for d in part["data"]], np.float32).reshape(len(part), bands, t, t) / divide
                latent = np.asarray(model.forward(x)[1])
                n, d, h, w = latent.shape
                i, j = np.meshgrid(np.arange(h), np.arange(w), indexing="ij")
                yield pd.DataFrame({"y": (part["ty"].to_numpy()[:, None] * h + i.reshape(-1)).reshape(-1), "x": (part["tx"].to_numpy()[:, None] * w + j.reshape(-1)).reshape(-1), "vec": list(latent.transpose(0, 2, 3, 1).reshape(-1, d).astype(float))})

    return tiles.select("ty", "tx", "data").mapInPandas(run, "y int, x int, vec array<double>")

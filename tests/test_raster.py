"""Raster operators against NumPy on small images."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import config
from rasterloom.operators import blend, cluster, focal, grid, nearest, refine, resample, sampling, tiles
from rasterloom.plans import pipeline
from rasterloom.schema import RasterMeta, bands_of, features_of
from rasterloom.sources import raster


def image(bands, h, w, seed=0):
    return np.random.default_rng(seed).integers(0, 255, (bands, h, w)).astype(np.uint8)


def meta_of(a):
    return RasterMeta(a.shape[1], a.shape[2], a.shape[0])


def array_of(df, meta, value="label"):
    out = np.full((meta.height, meta.width), np.nan)
    for r in df.collect():
        assert np.isnan(out[r["y"], r["x"]])  # once each
        out[r["y"], r["x"]] = r[value]
    return out


def labels_df(spark, a):
    rows = [(int(y), int(x), int(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "y int, x int, label int").repartition(3)


def numpy_pool(a, r):
    c, h, w = a.shape
    big = np.zeros((c, -(-h // r) * r + 2, -(-w // r) * r + 2))
    big[:, 1 : h + 1, 1 : w + 1] = a
    mean = sum(big[:, 1 + dy : big.shape[1] - 1 + dy, 1 + dx : big.shape[2] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)) / 9
    return mean.reshape(c, mean.shape[1] // r, r, mean.shape[2] // r, r).mean((2, 4))


@pytest.mark.parametrize(("shape", "r"), [((3, 48, 32), 16), ((3, 21, 35), 4), ((1, 7, 9), 8), ((8, 6, 5), 2), ((2, 5, 4), 1)])
def test_pool(spark, shape, r):
    a = image(*shape)
    got = focal.pool(raster.from_array(spark, a), meta_of(a), r)
    want = numpy_pool(a, r)
    rows = got.collect()
    assert len(rows) == want.shape[1] * want.shape[2] and features_of(got) == [f"f{k}" for k in range(shape[0])]
    for row in rows:
        assert np.allclose([row[f"f{k}"] for k in range(shape[0])], want[:, row["blk_y"], row["blk_x"]])


def test_pool_of_several_rasters_does_not_mix(spark):
    a, b = image(1, 10, 10, 1), image(1, 10, 10, 2)
    both = raster.from_array(spark, a).withColumn("raster_id", F.lit("a")).union(raster.from_array(spark, b).withColumn("raster_id", F.lit("b")))
    got = {(r["raster_id"], r["blk_y"], r["blk_x"]): r["f0"] for r in focal.pool(both, meta_of(a), 4, ["raster_id"]).collect()}
    for name, x in (("a", a), ("b", b)):
        want = numpy_pool(x, 4)[0]
        assert all(np.isclose(got[name, i, j], want[i, j]) for i in range(3) for j in range(3))


def numpy_blur(labels, kernel, iterations):
    kernel += kernel % 2 == 0
    p = kernel // 2
    best, won = np.full(labels.shape, -1), labels.copy()
    for k in range(labels.max() + 1):
        v = (labels == k).astype(np.int64)
        for _ in range(iterations):
            wide = np.pad(v, p, mode="edge")
            v = sum(wide[dy : dy + labels.shape[0], dx : dx + labels.shape[1]] for dy in range(kernel) for dx in range(kernel))
        better = v > best
        won[better], best[better] = k, v[better]
    return won


@pytest.mark.parametrize(("h", "w", "classes", "kernel", "iterations"), [(12, 17, 4, 3, 1), (9, 8, 3, 4, 2), (6, 5, 2, 21, 2), (7, 9, 1, 3, 1), (10, 11, 20, 5, 1)])
def test_blur_labels(spark, h, w, classes, kernel, iterations):
    a = np.random.default_rng(h).integers(0, classes, (h, w))
    got = focal.blur_labels(labels_df(spark, a), RasterMeta(h, w, 1), kernel, iterations)
    assert (array_of(got, RasterMeta(h, w, 1)) == numpy_blur(a, kernel, iterations)).all()


@pytest.mark.parametrize(("kernel", "iterations"), [(3, 1), (9, 2), (65, 3)])
def test_blur_over_tiles(spark, kernel, iterations):
    """More than one tile along both axes, tiles cut short at the edges, two rasters in one table."""
    h, w = 300, 530
    a = np.kron(np.random.default_rng(3).integers(0, 5, (30, 53)), np.ones((10, 10), int))
    frame = pd.DataFrame({"y": np.repeat(np.arange(h), w), "x": np.tile(np.arange(w), h), "label": a.ravel()})
    df = spark.createDataFrame(frame).selectExpr("explode(array('a', 'b')) AS raster_id", "CAST(y AS INT) y", "CAST(x AS INT) x", "CAST(IF(raster_id = 'a', label, 4 - label) AS INT) AS label")
    got = focal.blur_labels(df, RasterMeta(h, w, 1), kernel, iterations, keys=["raster_id"]).toPandas()
    assert got.columns.tolist() == ["raster_id", "y", "x", "label"] and len(got) == 2 * h * w
    for name, image_ in (("a", a), ("b", 4 - a)):
        part = got[got["raster_id"] == name].sort_values(["y", "x"])
        assert (part["label"].to_numpy().reshape(h, w) == fast_blur(image_, kernel, iterations)).all()


def fast_blur(labels, kernel, iterations):
    p, counts = kernel // 2, []
    for k in range(labels.max() + 1):
        v = (labels == k).astype(np.int64)
        for _ in range(iterations):
            for axis in (0, 1):
                wide = np.pad(v, [(p, p) if i == axis else (0, 0) for i in (0, 1)], mode="edge")
                v = np.lib.stride_tricks.sliding_window_view(wide, kernel, axis).sum(-1)
        counts.append(v)
    return np.argmax(counts, 0)


def test_blur_of_nulls(spark):
    rows = [(y, x, None if x < 6 else 1) for y in range(3) for x in range(9)]
    df = spark.createDataFrame(rows, "y int, x int, label int")
    got = {(r["y"], r["x"]): r["label"] for r in focal.blur_labels(df, RasterMeta(3, 9, 1), 3, 1).collect()}
    assert got == {(y, x): 1 if x >= 5 else None for y in range(3) for x in range(9)}


def test_blur_guards(spark):
    df = labels_df(spark, np.zeros((2, 2), int))
    assert focal.blur_labels(df, RasterMeta(2, 2, 1), 1) is df
    assert focal.blur_labels(df.limit(0), RasterMeta(0, 0, 1), 3).count() == 0


def test_gaussian(spark):
    a = np.random.default_rng(1).random((3, 24, 20))
    sigma = 2.0
    taps = np.array(focal.gaussian_weights(sigma))
    n = len(taps) // 2
    wide = np.pad(a[0], n, mode="reflect")
    rows = sum(taps[k] * wide[:, k : k + 20] for k in range(2 * n + 1))
    want = sum(taps[k] * rows[k : k + 24] for k in range(2 * n + 1))
    got = focal.gaussian_blur(raster.from_array(spark, a), meta_of(a), sigma, ["b0", "b1", "b2"])
    assert np.allclose(array_of(got, meta_of(a), "b0"), want, atol=1e-12)
    assert focal.gaussian_blur(got, meta_of(a), 0, ["b0"]) is got
    with pytest.raises(ValueError):
        focal.gaussian_blur(got, RasterMeta(6, 20), sigma, ["b0"])


def test_weight_mask(spark):
    n = 9
    got = raster.from_array(spark, np.zeros((1, n, n))).withColumn("m", focal.weight_mask(F.col("y"), F.col("x"), n))
    want = np.outer(np.hanning(n), np.hanning(n))
    assert np.allclose(array_of(got, RasterMeta(n, n, 1), "m"), want / want.max())
    assert spark.range(1).select(focal.weight_mask(F.lit(0), F.lit(0), 1)).first()[0] == 1.0
    with pytest.raises(ValueError):
        focal.weight_mask(F.lit(0), F.lit(0), 2)


# grids


def test_block_grids(spark):
    rows = spark.createDataFrame([(64, 128, 16), (65, 130, 16), (1, 1, 4)], "height int, width int, r int")
    got = [(r["blocks_h"], r["blocks_w"], r["pad_h"], r["pad_w"]) for r in grid.block_grid(rows).collect()]
    assert sorted(got) == sorted([(4, 8, 0, 0), (5, 9, 15, 14), (1, 1, 3, 3)])


def py_starts(length, size, stride):
    if length <= size:
        return [0]
    return sorted({*range(0, max(1, length - size), stride), length - size})


def test_chunk_windows_cover_everything(spark):
    for h, w, size, stride in ((100, 37, 32, 24), (32, 32, 32, 1), (65, 10, 64, 64), (10, 90, 7, 3)):
        got = grid.chunk_windows(spark, h, w, size, stride).orderBy("chunk").collect()
        assert [(r["y0"], r["x0"]) for r in got] == [(y, x) for y in py_starts(h, size, stride) for x in py_starts(w, size, stride)]
        seen = np.zeros((h, w), bool)
        for r in got:
            seen[r["y0"] : r["y1"], r["x0"] : r["x1"]] = True
        assert seen.all() and [r["chunk"] for r in got] == list(range(len(got)))


def test_halo(spark):
    got = {r["chunk"]: r for r in grid.with_halo(grid.chunk_windows(spark, 100, 100, 50, 50), 3, 100, 100).collect()}
    first, last = got[0], got[3]
    assert (first["hy0"], first["hx1"], first["top"], first["left"], first["bottom"], first["right"]) == (0, 53, 0, 0, 3, 3)
    assert (last["hy0"], last["hy1"], last["top"], last["bottom"]) == (47, 100, 3, 0)
    with pytest.raises(ValueError):
        grid.crop_halo(spark.range(1))


def test_in_windows_finds_each_pixel_in_each_window(spark):
    px = raster.from_array(spark, image(1, 40, 33))
    windows = grid.chunk_windows(spark, 40, 33, 16, 11)
    want = sum((r["y1"] - r["y0"]) * (r["x1"] - r["x0"]) for r in windows.collect())
    assert grid.in_windows(px, windows, 16).count() == want == grid.cells_of(windows).count()


def test_stitch_keeps_the_last(spark):
    rows = spark.createDataFrame([(0, 0, 5, 1), (0, 0, 6, 3), (0, 0, 7, 2), (0, 1, 8, 0)], "y int, x int, label int, chunk int")
    assert {(r["x"], r["label"]) for r in grid.stitch(rows, "label", ["y", "x"]).collect()} == {(0, 6), (1, 8)}


# nearest


@pytest.mark.parametrize("k", [1, 3, 90])
def test_assign_is_argmin_with_ties_to_the_lowest(spark, k):
    luck = np.random.default_rng(k)
    points, centers = luck.integers(0, 9, (200, 4)), luck.integers(0, 9, (k, 4))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id int, f0 double, f1 double, f2 double, f3 double")
    want = ((points[:, None] - centers[None]) ** 2).sum(2)
    got = nearest.assign(df, centers.astype(float).tolist(), features_of(df), strict=True).collect()
    assert all(r["label"] == want[r["id"]].argmin() and r["dist2"] == want[r["id"]].min() for r in got)


@pytest.mark.parametrize("k", [2, 70])
def test_strict_distances(spark, k):
    df = spark.createDataFrame([(float("nan"),)], "f0 double")
    with pytest.raises(Exception, match="not finite"):
        nearest.assign(df, [[float(i)] for i in range(k)], ["f0"], strict=True).collect()
    with pytest.raises(ValueError):
        nearest.nearest_center(["f0"], [])


def test_knn(spark, monkeypatch):
    luck = np.random.default_rng(2)
    refs, asks = luck.integers(0, 5, (60, 3)), luck.integers(0, 5, (25, 3))
    table = lambda a: spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(a)] + [(None, [1.0, 1.0, 1.0]), (99, None)], "id long, vec array<double>")
    want = {}
    for i, v in enumerate(asks):
        gaps = ((refs - v) ** 2).sum(1)
        want |= {(i, n + 1): (j, float(gaps[j])) for n, j in enumerate(np.argsort(gaps, kind="stable")[:4].tolist())}
    for block in (nearest.BLOCK_ROWS, 13):
        monkeypatch.setattr(nearest, "BLOCK_ROWS", block)
        got = {(r["id"], r["rank"]): (r["neighbour"], r["dist2"]) for r in nearest.knn(table(asks), table(refs), 4).collect()}
        assert got == want
    assert nearest.knn(table(asks), table(refs), 0).count() == 0
    assert nearest.knn(table(asks[:1]), table(refs[:3]), 10).count() == 3


# clustering


def clouds(spark):
    rows = [(k, 0, float(-1 + 0.01 * k), -1.0) for k in range(8)] + [(k, 1, 3.0, float(3 + 0.01 * k)) for k in range(8)]
    return spark.createDataFrame(rows, "blk_y int, blk_x int, f0 double, f1 double")


@pytest.mark.parametrize("fit", [cluster.lloyd, cluster.lloyd_local])
def test_lloyd_finds_two_clouds(spark, fit):
    got = sorted(fit(clouds(spark), 2))
    assert np.allclose(got, [[-0.965, -1.0], [3.0, 3.035]])
    for bad in (0, 17):
        with pytest.raises(ValueError):
            fit(clouds(spark), bad)


def test_both_fits_agree_whatever_the_partitions(spark):
    a = image(3, 50, 61, 5)
    blocks = focal.pool(raster.from_array(spark, a), meta_of(a), 4)
    want = cluster.lloyd_local(blocks, 5, 4)
    assert np.allclose(cluster.lloyd(blocks.repartition(7), 5, 4), want) and np.allclose(cluster.lloyd(blocks.coalesce(1), 5, 4), want)


def test_empty_clusters_take_far_points(spark):
    df = clouds(spark)
    new = cluster.lloyd_step(df, [[0.0, 0.0], [900.0, 900.0], [800.0, 800.0]])
    assert len(new) == 3 and max(map(max, new)) < 4


def test_brightness_order(spark):
    centers = [[0.9, 0.9], [0.1, 0.1], [0.5, 0.5]]
    assert cluster.brightness_ranks(centers) == [2, 0, 1] and cluster.by_brightness(centers)[0] == [0.1, 0.1]
    df = labels_df(spark, np.array([[2, 0, 1], [1, 2, 0]]))
    got, order = cluster.normalize_labels(df, centers)
    assert (array_of(got, RasterMeta(2, 3, 1)) == [[1, 2, 0], [0, 1, 2]]).all() and order[2] == [0.9, 0.9]
    assert cluster.relabel(df, None) is df
    with pytest.raises(Exception, match="outside"):
        cluster.relabel(df, [0, 1]).collect()


def test_samples(spark):
    blocks = spark.createDataFrame([(y, x) for y in range(20) for x in range(30)], "blk_y int, blk_x int")
    assert sampling.sample_blocks(blocks, 20, 30, 600) is blocks
    got = sampling.sample_blocks(blocks, 20, 30, 50).collect()
    assert len(got) == 50 and all(r["blk_y"] % 3 == 0 and r["blk_x"] % 3 == 0 for r in got)
    assert [cluster.sample_cap(s) for s in (0.01, 1.0, 9.0)] == [6000, 20000, 40000]


def test_stratified(spark):
    rows = [(i, i % 3) for i in range(9)] + [(50, None)]
    df = spark.createDataFrame(rows, "id long, label int")
    got = sampling.stratified_sample(df, 6).collect()
    assert sorted(r["label"] for r in got) == [0, 0, 1, 1, 2, 2]
    assert sampling.stratified_sample(df, 9).count() == 9
    assert sampling.quotas({0: 98, 1: 1, 2: 1}, 10) == {0: 8, 1: 1, 2: 1} and sampling.quotas({0: 5, 1: 5, 2: 5}, 2) == {0: 1, 1: 1, 2: 1}


# resampling


def test_upsample_and_nearest(spark):
    a = np.arange(12).reshape(3, 4)
    blocks = labels_df(spark, a).withColumnsRenamed({"y": "blk_y", "x": "blk_x"})
    got = resample.upsample(blocks, RasterMeta(11, 13, 1), 4)
    assert (array_of(got, RasterMeta(11, 13, 1)) == np.repeat(np.repeat(a, 4, 0), 4, 1)[:11, :13]).all()
    for h, w in ((7, 9), (2, 3), (3, 4), (1, 1)):
        got = resample.nearest_resize(labels_df(spark, a), RasterMeta(3, 4, 1), RasterMeta(h, w, 1), ["label"])
        want = a[np.ix_(np.arange(h) * 3 // h, np.arange(w) * 4 // w)]
        assert (array_of(got, RasterMeta(h, w, 1)) == want).all()


def test_bilinear(spark):
    a = image(1, 5, 6)
    for h, w in ((9, 4), (5, 6), (1, 13)):
        ys, xs = (np.maximum(0, (np.arange(n) + 0.5) * m / n - 0.5) for n, m in ((h, 5), (w, 6)))
        y0, x0 = ys.astype(int), xs.astype(int)
        y1, x1 = np.minimum(y0 + 1, 4), np.minimum(x0 + 1, 5)
        fy, fx = (ys - y0)[:, None], (xs - x0)[None]
        z = a[0].astype(float)
        want = (1 - fy) * ((1 - fx) * z[np.ix_(y0, x0)] + fx * z[np.ix_(y0, x1)]) + fy * ((1 - fx) * z[np.ix_(y1, x0)] + fx * z[np.ix_(y1, x1)])
        got = resample.bilinear_resize(raster.from_array(spark, a), meta_of(a), RasterMeta(h, w, 1), ["b0"])
        assert np.allclose(array_of(got, RasterMeta(h, w, 1), "b0"), want)


def test_one_hot_and_zones(spark):
    got = {(r["y"], r["x"], r["k"]): r["v"] for r in resample.one_hot(labels_df(spark, np.array([[0, 1], [5, -1]])), 4).collect()}
    assert [k for k, v in sorted(got.items()) if v] == [(0, 0, 0), (0, 1, 1), (1, 0, 3), (1, 1, 0)]
    px = raster.from_array(spark, np.array([[[1.0, 3.0], [5.0, 9.0]]])).withColumn("label", F.col("y"))
    assert {(r["label"], r["cnt"], r["mean_b0"]) for r in resample.zonal_means(px).collect()} == {(0, 2, 2.0), (1, 2, 7.0)}


# refinement


def test_refinement_follows_its_formula(spark):
    luck = np.random.default_rng(3)
    h, w, k = 6, 7, 3
    vec, centers, seed = luck.random((h * w, 5)), luck.random((k, 5)), luck.integers(0, k, h * w)
    cells = spark.createDataFrame([(i // w, i % w, int(seed[i]), vec[i].tolist()) for i in range(h * w)], "y int, x int, label int, vec array<double>")
    logits = -((vec[:, None] - centers[None]) ** 2).sum(2) / 2.0
    soft = np.exp(logits - logits.max(1, keepdims=True))
    p = 0.5 * soft / soft.sum(1, keepdims=True) + 0.5 * np.eye(k)[seed]
    yy, xx = np.meshgrid(np.linspace(-1, 1, h), np.linspace(-1, 1, w), indexing="ij")
    where = np.concatenate([vec, 0.08 * np.stack([yy.ravel(), xx.ravel()], 1)], 1)
    near = np.argsort(((where[:, None] - where[None]) ** 2).sum(2), 1, kind="stable")[:, :4]
    for _ in range(2):
        p = 0.35 * p + 0.65 * p[near].mean(1)
    got = refine.refine(cells, RasterMeta(h, w, 1), centers.tolist(), {"neighbors": 4, "mix": None, "unknown": 1}).collect()
    for r in got:
        i = r["y"] * w + r["x"]
        assert np.allclose([r[f"p{c}"] for c in range(k)], p[i]) and r["label"] == p[i].argmax()
    assert refine.refine(cells, RasterMeta(h, w, 1), centers.tolist(), {"enabled": False}).columns == ["y", "x", "label"]


# tiles and chunks


def test_turns_equal_rot90(spark):
    a = np.arange(100).reshape(10, 10)
    plan = spark.createDataFrame([(i, j, (i * 3 + j) % 4) for i in range(3) for j in range(3)], "ty int, tx int, turns int")
    want = a.copy()
    for i in range(3):
        for j in range(3):
            t = a[i * 4 : i * 4 + 4, j * 4 : j * 4 + 4]
            want[i * 4 : i * 4 + 4, j * 4 : j * 4 + 4] = np.rot90(t, (i * 3 + j) % 4) if t.shape[0] == t.shape[1] else t
    assert (array_of(tiles.turn_tiles(labels_df(spark, a), plan, 4, RasterMeta(10, 10, 1)), RasterMeta(10, 10, 1)) == want).all()


def test_orientation_restores_a_turned_tile(spark):
    a = np.repeat(np.arange(12)[None], 8, 0) // 2
    turned = a.copy()
    turned[0:4, 4:8] = np.rot90(turned[0:4, 4:8])
    turned[:, 4:8] = np.where(np.arange(8)[:, None] < 4, turned[:, 4:8], a[:, 4:8])
    a2 = np.tile(np.arange(4)[:, None], (1, 8))  # rows line up across tiles
    broken = a2.copy()
    broken[:, 4:8] = np.rot90(a2[:, 4:8], 1)
    meta = RasterMeta(4, 8, 1)
    plan = tiles.orientation_plan(labels_df(spark, broken), 4, meta)
    assert {(r["tx"], r["turns"]) for r in plan.collect()} == {(0, 0), (1, 3)}
    assert (array_of(tiles.turn_tiles(labels_df(spark, broken), plan, 4, meta), meta) == a2).all()


def test_harmonized_labels_mean_the_same(spark):
    rows = [(0, 0, [10.0]), (0, 1, [200.0]), (1, 0, [198.0]), (1, 1, [12.0]), (2, 0, [100.0]), (2, 1, [11.0]), (2, 2, [101.0])]
    got = {(r["chunk"], r["label"]): r["target"] for r in blend.match_labels(spark.createDataFrame(rows, "chunk int, label int, vec array<double>"), 3).collect()}
    assert got == {(0, 0): 0, (0, 1): 1, (1, 0): 1, (1, 1): 0, (2, 0): 2, (2, 1): 0, (2, 2): 1}


def test_chunks_blend_into_one_map(spark):
    a = np.zeros((1, 64, 64), np.uint8)
    a[:, :, 32:] = 200
    px, meta = raster.from_array(spark, a), meta_of(a)
    split = lambda x: (x[0] > 100).astype(int)
    one = array_of(blend.process_in_chunks(px, meta, 64, 64, 2, split), meta)
    assert (one == (a[0] > 100)).all()
    many = array_of(blend.process_in_chunks(px, meta, 32, 24, 2, lambda x: {"labels": split(x)}, scale=0.1), meta)
    assert (many == one).mean() >= 0.95
    with pytest.raises(Exception, match="no labels"):
        blend.process_in_chunks(px, meta, 64, 64, 2, lambda x: {}).collect()


def test_finalize_over_tiles(spark):
    """Scores of several tiles against whole planes in NumPy; labels sent straight to the tiles give the same."""
    h, w, size, classes = 40, 600, 30, 3
    a = np.kron(np.random.default_rng(5).integers(0, classes, (8, 120)), np.ones((5, 5), int))
    meta = RasterMeta(h, w, 1)
    frame = pd.DataFrame({"y": np.repeat(np.arange(h), w), "x": np.tile(np.arange(w), h), "label": a.ravel()}).astype(np.int32)
    chunked = grid.in_windows(spark.createDataFrame(frame), grid.chunk_windows(spark, h, w, size, 20), size)
    scores = blend.weighted_scores(chunked, size, classes)
    planes = np.zeros((2, classes, h, w))
    for r in scores.collect():
        planes[:, r["k"], r["y"], r["x"]] = r["score"], r["weight"]
    taps = np.array(focal.gaussian_weights(blend.blend_sigma(size)))
    n = len(taps) // 2
    wide = np.pad(planes, [(0, 0), (0, 0), (n, n), (n, n)], mode="reflect")
    soft = sum(taps[i] * taps[j] * wide[:, :, i : i + h, j : j + w] for i in range(2 * n + 1) for j in range(2 * n + 1))
    share = soft[0] / np.maximum(soft[1], 1e-6)
    top = np.sort(share, 0)
    clear = top[-1] - top[-2] > 1e-9
    got = array_of(blend.finalize(scores, meta, size, classes), meta)
    assert clear.mean() > 0.99 and (got == share.argmax(0))[clear].all()
    assert (array_of(blend.blended_labels(chunked, meta, size, classes), meta) == got)[clear].all()
    half = array_of(blend.finalize(scores.where("x < 100"), meta, size, classes), meta)  # whole raster, zero where nothing is known
    assert (half[:, 300:] == 0).all() and (half[:, :60] == got[:, :60])[clear[:, :60]].all()


def test_batches():
    assert tiles.recommended_batch(3, 512, 512) == (128 << 20) // 8 // (3 * 512 * 512 * 4 * 3) and tiles.recommended_batch(0, 0, 0, 1) == 1
    with pytest.raises(RuntimeError):
        tiles.load_model(lambda: None)


# the whole


def test_segmentation(spark):
    a = np.full((3, 64, 64), 60, np.uint8)
    a[:, :, 32:] = 190
    px, meta = raster.from_array(spark, a), meta_of(a)
    said = []
    found = pipeline.segment(px, meta, 2, 8, centers=[[200.0] * 3, [50.0] * 3], status=said.append)
    assert (array_of(found.labels, meta) == (np.arange(64) >= 32)[None]).mean() > 0.95 and found.centers[0] == [50.0] * 3
    fitted = pipeline.segment(px, meta, 2, 8, blur=config.BlurConfig(3, 1))
    first, second = array_of(fitted.labels, meta), array_of(pipeline.segment(px, meta, 2, 8, blur=config.BlurConfig(3, 1)).labels, meta)
    assert (first == second).all() and first.min() == 0 and first.max() == 1
    for k in (0, 300, "x", ""):
        with pytest.raises(ValueError):
            pipeline.segment(px, meta, k, 8)


def test_chunked_labels_equal_the_single_pass(spark):
    ramp = np.broadcast_to(np.linspace(0, 200, 128), (3, 128, 128)).copy()
    px, meta = raster.from_array(spark, ramp), RasterMeta(128, 128)
    centers = [[float(v)] * 3 for v in (20, 80, 140, 190)]
    whole = {(r["blk_y"], r["blk_x"]): r["label"] for r in pipeline.segment(px, meta, 4, 8, centers=centers).blocks.collect()}
    chunked = {(r["blk_y"], r["blk_x"]): r["label"] for r in pipeline.segment_in_chunks(px, meta, centers, 8, 48).collect()}
    assert whole == chunked and len(whole) == 256


def test_cancel(spark):
    a = image(3, 16, 16)
    token = pipeline.CancelToken()
    token.cancel(spark)
    with pytest.raises(pipeline.Canceled):
        pipeline.segment(raster.from_array(spark, a), meta_of(a), 2, 8, token=token)
    pipeline.tell(lambda m: 1 / 0, "still fine")


class Edges:
    def forward(self, x):
        n, c, h, w = x.shape
        return None, x.reshape(n, c, 2, h // 2, 2, w // 2).mean((3, 5))


def test_latent_segmentation(spark):
    a = np.full((3, 32, 40), 30, np.uint8)
    a[:, :, 16:] = 220
    px, meta = raster.from_array(spark, a), meta_of(a)
    found = pipeline.segment_latent(px, meta, Edges, 3, 2, 16, 2, config={"neighbors": 3})
    got = array_of(found.labels, meta)
    assert (got[:, :16] == got[0, 0]).all() and got[0, 0] != got[0, 20]
    with pytest.raises(RuntimeError):
        pipeline.segment_latent(px, meta, Edges, 3, require_centers=True)


def test_bands(spark):
    assert bands_of(spark.createDataFrame([(1, 2, 3)], "b10 int, b2 int, blk int")) == ["b2", "b10"]
    with pytest.raises(ValueError):
        bands_of(spark.range(1))

"""Files, layers, messages, settings and streams."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import config, layers, progress
from rasterloom.schema import RasterMeta
from rasterloom.sources import raster, tiff
from rasterloom.streaming import assign as stream


def whole(data):
    header = tiff.read_header(data)
    out = np.zeros((header.bands, header.height, header.width), header.dtype)
    for y, x, block in tiff.read_blocks(data, header):
        out[:, y : y + block.shape[1], x : x + block.shape[2]] = block
    return header, out


@pytest.mark.parametrize("dtype", ["uint8", "int16", "uint32", "float32", "float64"])
@pytest.mark.parametrize("deflate", [True, False])
def test_tiff_round_trip(dtype, deflate):
    a = (np.random.default_rng(0).random((3, 21, 17)) * 100).astype(dtype)
    data = tiff.encode([a[:, k : k + 8] for k in range(0, 21, 8)], 8, (10.0, 0.5, 0.0, 90.0, 0.0, -0.25), 32633, deflate)
    header, got = whole(data)
    assert (got == a).all() and header.transform == (10.0, 0.5, 0.0, 90.0, 0.0, -0.25) and header.epsg == 32633
    assert [y for y, _, _ in tiff.read_blocks(data, header, 9, 16)] == [8]


def big_endian(width, height, blocks, extra):
    """A big-endian TIFF of bytes, its strips or tiles given."""
    tags = {256: (4, [width]), 257: (4, [height]), 258: (3, [8]), 262: (3, [1])} | extra
    at = [8 + sum(map(len, blocks[:k])) for k in range(len(blocks))]
    tiled = 322 in tags
    tags |= {324 if tiled else 273: (4, at), 325 if tiled else 279: (4, list(map(len, blocks)))}
    start = 8 + sum(map(len, blocks))
    out, tail, tail_at = b"", b"", start + 2 + 12 * len(tags) + 4
    for tag, (kind, values) in sorted(tags.items()):
        raw = struct.pack(f">{len(values)}{'H' if kind == 3 else 'I'}", *values)
        place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(">I", tail_at + len(tail))
        tail += raw if len(raw) > 4 else b""
        out += struct.pack(">HHI", tag, kind, len(values)) + place
    return b"MM\0*" + struct.pack(">I", start) + b"".join(blocks) + struct.pack(">H", len(tags)) + out + b"\0\0\0\0" + tail


def test_tiff_variants():
    a = np.random.default_rng(1).integers(0, 255, (5, 6)).astype(np.uint8)
    packed = b"".join(bytes([5]) + row.tobytes() for row in a)
    assert (whole(big_endian(6, 5, [packed], {259: (3, [32773]), 278: (4, [5])}))[1][0] == a).all()
    assert tiff._unpack_bits(bytes([254, 7, 128, 0, 9])) == bytes([7, 7, 7, 9])
    diff = np.diff(a, axis=1, prepend=0).astype(np.uint8)
    assert (whole(big_endian(6, 5, [zlib.compress(diff.tobytes())], {259: (3, [8]), 317: (3, [2]), 278: (4, [5])}))[1][0] == a).all()
    wide = np.zeros((16, 32), np.uint8)
    wide[:5, :20] = np.arange(100).reshape(5, 20)
    tiles = [wide[:, :16].tobytes(), wide[:, 16:].tobytes()]
    assert (whole(big_endian(20, 5, tiles, {259: (3, [1]), 322: (4, [16]), 323: (4, [16])}))[1][0] == wide[:5, :20]).all()
    planes = [np.full((5, 6), v, np.uint8).tobytes() for v in (1, 2)]
    got = whole(big_endian(6, 5, planes, {259: (3, [1]), 258: (3, [8, 8]), 277: (3, [2]), 284: (3, [2]), 278: (4, [5])}))[1]
    assert (got[0] == 1).all() and (got[1] == 2).all()
    for bad in (b"", b"PK\3\4....", b"II*\1aaaa"):
        with pytest.raises(ValueError):
            tiff.read_header(bad)


@pytest.mark.parametrize("dtype", ["uint8", "float32"])
def test_big_tiff_round_trip(dtype):
    a = (np.random.default_rng(4).random((3, 21, 17)) * 100).astype(dtype)
    data = tiff.encode([a[:, k : k + 8] for k in range(0, 21, 8)], 8, (10.0, 0.5, 0.0, 90.0, 0.0, -0.25), 32633, big=True)
    header, got = whole(data)
    assert data[:4] == b"II+\0" and (got == a).all() and header.transform == (10.0, 0.5, 0.0, 90.0, 0.0, -0.25) and header.epsg == 32633


def pack_lzw(data):
    """Plain LZW with the table's growth and code widths of the format."""
    codes, table, now = [(256, 9)], {bytes([b]): b for b in range(256)}, b""
    size = 258
    width = lambda n: 9 if n < 511 else 10 if n < 1023 else 11 if n < 2047 else 12
    for b in data:
        if now + bytes([b]) in table:
            now += bytes([b])
            continue
        codes.append((table[now], width(size - 1 if size > 258 else size)))
        table[now + bytes([b])] = size
        size += 1
        now = bytes([b])
        if size == 4094:
            codes += [(table[now], width(size - 1)), (256, 12)]
            table, size, now = {bytes([b]): b for b in range(256)}, 258, b""
    codes += ([(table[now], width(size - 1 if size > 258 else size))] if now else []) + [(257, width(size))]
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def test_lzw():
    luck = np.random.default_rng(5)
    for data in (b"", b"a", b"aaaa" * 50, luck.integers(0, 3, 3000).astype(np.uint8).tobytes(), luck.integers(0, 256, 9000).astype(np.uint8).tobytes()):
        assert tiff.unpack_lzw(pack_lzw(data)) == data


def test_a_filtered_scan_reads_few_bytes(spark, tmp_path, monkeypatch):
    image = np.random.default_rng(6).integers(0, 255, (3, 2048, 64)).astype(np.uint8)
    at = tmp_path / "tall.tif"
    at.write_bytes(tiff.encode([image[:, k : k + 64] for k in range(0, 2048, 64)], 64, deflate=False))
    read, real = [], raster.ranges

    def counted(path):
        fetch, close = real(path)
        return lambda a, n: read.append(n) or fetch(a, n), close

    monkeypatch.setattr(raster, "ranges", counted)
    reader = raster.GeoTiffReader(f"file://{at}", 64)
    assert sum(read) < 4096  # the header alone
    rows = sum(b.num_rows for b in reader.read(raster._Rows(640, 704)))
    assert rows == 64 * 64 and sum(read) < 4096 + 64 * 64 * 3 + 1
    spread = spark.createDataFrame([(0, 0, 7), (200, 3, 9)], "y int, x int, label int")  # strips without a pixel
    got = whole(raster.to_geotiff(spread, RasterMeta(260, 5, 1)))[1]
    assert got.sum() == 16 and got[0, 0, 0] == 7 and got[0, 200, 3] == 9


@pytest.fixture
def image():
    return np.random.default_rng(2).integers(0, 255, (3, 150, 20)).astype(np.uint8)


def pixels(df):
    return {(r["y"], r["x"]): (r["b0"], r["b1"], r["b2"]) for r in df.collect()}


def test_sources(spark, image, tmp_path):
    want = {(y, x): tuple(map(int, image[:, y, x])) for y in range(150) for x in range(20)}
    df = raster.from_array(spark, image)
    path = raster.write_raster(df, RasterMeta.from_extent(150, 20, 3, (0, 0, 20, 150), 4326), f"file://{tmp_path}", "out")
    assert pixels(raster.read_tiff(spark, path)) == want and pixels(raster.materialize(spark, path + "|layer=1")) == want
    assert raster.materialize(spark, df) is df and pixels(raster.materialize(spark, lambda: image)) == want
    raster.register(spark)
    source = spark.read.format("geotiff").option("rows", "64").load(str(tmp_path / "out.tif"))
    assert pixels(source) == want and source.rdd.getNumPartitions() == 3
    some = source.where("y >= 70 AND y < 90")
    assert pixels(some) == {k: v for k, v in want.items() if 70 <= k[0] < 90} and some.rdd.getNumPartitions() == 1
    for bad, kind in ((5, TypeError), (lambda: 5, TypeError), (str(tmp_path / "none*.tif"), Exception)):
        with pytest.raises(kind):
            raster.materialize(spark, bad).collect()


def test_sink_names(spark, tmp_path):
    labels = raster.from_array(spark, np.zeros((1, 3, 4), np.uint8)).withColumnRenamed("b0", "label")
    meta, folder = RasterMeta(3, 4, 1), f"file://{tmp_path}"
    names = [raster.write_raster(labels, meta, folder, "seg").rsplit("/", 1)[1] for _ in range(3)]
    assert names == ["seg.tif", "seg (2).tif", "seg (3).tif"]
    assert spark.read.parquet(raster.write_raster(labels, meta, folder, "seg", "parquet")).count() == 12


def test_channel_first():
    assert raster.channel_first(np.zeros((4, 5))).shape == (1, 4, 5)
    for shape in ((3,), (1, 2, 3, 4)):
        with pytest.raises(ValueError):
            raster.channel_first(np.zeros(shape))


LAYERS = [
    ("gdal", "/a/b.tif", 3, "RasterLayer", True, False),
    ("GDAL", "/a/B.TIFF|layername=x", 3, "RasterLayer", True, False),
    ("gdal", "/a/b.tif", 1, "RasterLayer", False, False),
    ("gdal", "/a/b.png", 3, "RasterLayer", False, False),
    ("gdal", "/a.tif/b", 3, "RasterLayer", False, False),
    ("gdal", "/a/.tif", 3, "RasterLayer", False, False),
    (None, "/a/b.tif", 3, "RasterLayer", False, False),
    ("gdal", None, 3, "RasterLayer", False, False),
    ("wms", "x", 0, "RasterLayer", False, True),
    ("ArcGisMapServer", None, 0, None, False, True),
    ("ogr", "x", 0, "VectorLayer", False, True),
    (None, "x", 0, "VectorLayer", False, False),
    ("gdal", "/VSICURL/http://x/y.tif", 3, "RasterLayer", True, True),
    ("gdal", "https://x/y.png", 3, "RasterLayer", False, True),
    ("memory", "x", 0, "RasterLayer", False, False),
]


def test_layer_predicates(spark):
    rows = [(f"L{k}", f"n{k}", t, p, s, b) for k, (p, s, b, t, _, _) in enumerate(LAYERS)]
    got = spark.createDataFrame(rows, layers.LAYER).select("layer_id", layers.is_file_raster().alias("a"), layers.is_renderable().alias("b")).collect()
    assert {r["layer_id"]: (r["a"], r["b"]) for r in got} == {f"L{k}": (a, b) for k, (*_, a, b) in enumerate(LAYERS)}


def test_layer_lists(spark):
    rows = [("1", "b", "VectorLayer", "ogr", "x", 0), ("2", "A", "RasterLayer", "wms", "x", 0), ("3", "c", "Other", "ogr", "x", 0)]
    df = spark.createDataFrame(rows, layers.LAYER)
    assert [r["name"] for r in layers.listed(df).collect()] == ["A", "b"]
    assert [r["layer_id"] for r in layers.rendering_candidate(df).collect()] == ["2"]
    ready = df.union(spark.createDataFrame([("4", "d", "RasterLayer", "gdal", "a.tif", 3)], layers.LAYER))
    assert layers.rendering_candidate(ready).count() == 0
    assert layers.find_layer(df, name="b").first()["layer_id"] == "1" and layers.find_layer(df, layer_id="3").count() == 1


def test_layer_metadata():
    class Layer:
        def dataProvider(self):
            return None

        def source(self):
            return "s"

        def bandCount(self):
            raise OSError

    assert layers.layer_metadata(Layer()) == {"layer_type": "Layer", "provider_name": None, "source_path": "s", "band_count": 0}
    assert layers.layer_metadata(object())["source_path"] is None
    assert layers.free_name("a", {"a", "a (2)"}) == "a (3)"


def test_extents(spark):
    rows = [("a", 1.0, 2.0, 3.0, 4.5, "EPSG:4326"), ("b", 1.0, 2.0, 3.0, 4.5, None)]
    got = layers.render_params(spark.createDataFrame(rows, "layer_id string, xmin double, ymin double, xmax double, ymax double, crs string")).collect()
    assert [r["extent"] for r in sorted(got)] == ["1.0,3.0,2.0,4.5 [EPSG:4326]", "1.0,3.0,2.0,4.5"]


def test_plain_numbers_have_the_shortest_digits(spark):
    bits = np.random.default_rng(0).integers(0, 2**64, 20_000, dtype=np.uint64).view(np.float64)
    xs = [1.1813e21, -1.1823e21, 2e23, 5e-324, 2.0**-44, 9007199254740993.0 * 1.1, 1e16, 9999999999999998.0, 1e-4, 9.999e-5, -0.0, float("inf"), float("nan"), *bits.tolist()]
    df = spark.createDataFrame([(k, x) for k, x in enumerate([*xs, None])], "k int, x double")
    got = [r["s"] for r in df.select("k", layers.plain_number("x").alias("s")).orderBy("k").collect()]
    assert got == [*map(repr, xs), None]


MESSAGES = [("Smoothing 50% done", "smooth", 50), ("kNN step 3/4", "latent", 75), ("Step 1 / 0", None, None), ("render 250 %", "render", 100), ("plan chunk 5%", "chunk_plan", 5), ("hello", None, None), (None, None, None), ("queue step 9/3", "queue", 100), ("7% x", "inference", 7), ("step 1/8 prepare", "prepare", 12)]


def test_messages(spark):
    df = spark.createDataFrame([(k, m) for k, (m, _, _) in enumerate(MESSAGES)], "seq int, message string")
    got = {r["seq"]: (r["stage"], r["percent"]) for r in df.select("seq", progress.stage().alias("stage"), progress.percent().alias("percent")).collect()}
    assert got == {k: (s, p) for k, (_, s, p) in enumerate(MESSAGES)}


def test_progress_never_falls(spark):
    rows = [("r", 1, "Prepare 50%"), ("r", 2, "Smoothing 10%"), ("r", 3, "Prepare 90%"), ("r", 4, "x"), ("s", 1, "x")]
    got = [r["overall"] for r in progress.timeline(spark.createDataFrame(rows, "run string, seq int, message string")).orderBy("run", "seq").collect()]
    assert got[:4] == pytest.approx([10.0, 90.7, 90.7, 90.7]) and got[4] is None


def test_log(spark):
    rows = [(k, c, m) for k, (c, m) in enumerate([("general", "a"), ("worker", "b"), ("worker", "3/4"), ("other", "1/2"), (None, "1/2"), ("worker", None)] * 40)]
    got = [r["seq"] for r in progress.log_tail(spark.createDataFrame(rows, "seq long, category string, message string")).collect()]
    assert got == [k for k in range(239, -1, -1) if k % 6 in (0, 2)][:50]


def test_settings():
    kernels = {(level, name): config.blur_config(level, name).kernel_size for level in range(3) for name in config.RESOLUTIONS}
    assert [kernels[level, "high"] for level in range(3)] == [5, 11, 21] and [kernels[level, "medium"] for level in range(3)] == [11, 23, 43] and [kernels[level, "low"] for level in range(3)] == [21, 45, 85]
    assert config.blur_config(enabled=False) is None and config.blur_config(9).iterations == 2 and config.block_side("nonsense") == 4
    plan = config.AdaptiveConfig().plan(3, 1 << 30)
    assert plan.chunk_size == 512 and plan.stride == 512 and plan.should_chunk(600, 10) and not plan.should_chunk(512, 512)
    with pytest.raises(ValueError):
        config.ChunkPlan(10, 10)
    low, high = config.AdaptiveSettings(2, 1), config.AdaptiveSettings(4, 3)
    adaptive = config.AdaptiveConfig({"gpu": low}, {"gpu": [(100, high), (10, low)]}, "gpu")
    assert adaptive.settings(500) == high and adaptive.settings(50) == low and adaptive.settings(1) == low and adaptive.settings() == low


def test_stream(spark, tmp_path):
    rows = [(y, x, float(10 * y)) for y in range(6) for x in range(2)]
    spark.createDataFrame(rows, "blk_y int, blk_x int, f0 double").repartition(3).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    go = lambda: stream.start(stream.read_blocks(spark, str(tmp_path / "in"), schema, 1), [[0.0], [50.0]], str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    go()
    spark.createDataFrame([(0, 0, 50.0)], "blk_y int, blk_x int, f0 double").write.mode("append").parquet(str(tmp_path / "in"))
    go()
    got = {(r["blk_y"], r["blk_x"]): r["label"] for r in stream.latest(spark, str(tmp_path / "out")).collect()}
    assert got == {(y, x): int(10 * y > 25) for y, x, _ in rows} | {(0, 0): 1}

"""Raster sources and sinks: files, arrays, loaders and tables to pixel tables, and label maps to GeoTIFF or Parquet."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.layers import free_name
from ..schema import RasterMeta, bands_of
from ..store import new_folder
from . import tiff

#: Rows of a strip that is written, and of a partition that is read.
STRIP_ROWS = 64


def channel_first(array: np.ndarray) -> np.ndarray:
    """(bands, height, width): a plane becomes one band; other ranks than two and three are an error."""
    if array.ndim == 2:
        array = array[None]
    if array.ndim != 3:
        raise ValueError("a raster has two or three dimensions")
    return np.ascontiguousarray(array)


def pixel_schema(bands: int, dtype: np.dtype) -> str:
    kind = "double" if dtype.kind == "f" else "bigint"
    return ", ".join(["y int", "x int", *[f"b{b} {kind}" for b in range(bands)]])


def _rows(y0: int, x0: int, block: np.ndarray) -> pd.DataFrame:
    bands, h, w = block.shape
    y, x = np.meshgrid(np.arange(y0, y0 + h, dtype=np.int32), np.arange(x0, x0 + w, dtype=np.int32), indexing="ij")
    kind = np.float64 if block.dtype.kind == "f" else np.int64
    return pd.DataFrame({"y": y.reshape(-1), "x": x.reshape(-1)} | {f"b{b}": block[b].reshape(-1).astype(kind) for b in range(bands)})


def from_array(spark: SparkSession, array: np.ndarray) -> DataFrame:
    """Pixels of an array that the driver holds."""
    array = channel_first(array)
    return spark.createDataFrame(_rows(0, 0, array), pixel_schema(array.shape[0], array.dtype))


def read_tiff(spark: SparkSession, path: str, bands: int | None = None) -> DataFrame:
    """(path, y, x, b0...) of all TIFF files under a path or glob, with ``bands`` bands each (by default the first file's).

    Files are read by Spark's binary reader, so any store will do; each is one row and must fit a task's memory. Large
    files on a file system are better read by strips with format "geotiff".
    """
    files = spark.read.format("binaryFile").load(path.split("|")[0])
    if bands is None:
        first = files.select("content").limit(1).collect()
        if not first:
            raise RuntimeError(f"no raster in {path}")
        bands = tiff.read_header(bytes(first[0]["content"])).bands
    schema = "path string, " + pixel_schema(bands, np.dtype("f8"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                header = tiff.read_header(content)
                for y, x, block in tiff.read_blocks(content, header):
                    rows = _rows(y, x, block.astype(np.float64))
                    rows.insert(0, "path", name)
                    yield rows

    return files.select("path", "content").mapInPandas(run, schema)


def materialize(spark: SparkSession, source: DataFrame | np.ndarray | str | Callable) -> DataFrame:
    """A pixel table from a table (as it is), an array, a path to a TIFF file, or a function that gives one of them."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, np.ndarray):
        return from_array(spark, source)
    if isinstance(source, str):
        return read_tiff(spark, source).drop("path")
    if callable(source):
        made = source()
        if not isinstance(made, (DataFrame, np.ndarray)):
            raise TypeError("the function must give a table or an array")
        return materialize(spark, made)
    raise TypeError("a raster is a table, an array, a path or a function")


class _Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


#: Schemes that Spark and Arrow name differently.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def ranges(path: str) -> tuple[tiff.Fetch, Callable[[], None]]:
    """What reads ranges of bytes of a file in any store that Arrow knows, and what closes it; a plain path is local."""
    scheme, mark, rest = path.partition(":")
    if mark and scheme in ("file",):
        system, place = fs.LocalFileSystem(), "/" + rest.lstrip("/")
    elif mark and len(scheme) > 1 and rest.startswith("//"):
        system, place = fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")
    else:
        system, place = fs.LocalFileSystem(), path
    handle = system.open_input_file(place)
    return lambda at, size: handle.read_at(size, at), handle.close


def header_of(path: str) -> tiff.Header:
    fetch, close = ranges(path)
    try:
        return tiff.read_header(fetch)
    finally:
        close()


class GeoTiffReader(DataSourceReader):
    """Reads a file by runs of rows: of the file the header once, and each partition only the strips or tiles that hold its rows."""

    def __init__(self, path: str, rows: int, bounds: tuple[int, int] | None = None):
        self.path, self.rows, self.bounds = path, rows, bounds
        self.header = header_of(path)

    def partitions(self) -> list[InputPartition]:
        first, last = self.bounds or (0, self.header.height)
        tall = self.header.block[0]
        step = -(-self.rows // tall) * tall
        return [_Rows(max(a, first), min(a + step, last)) for a in range(first // step * step, last, step)]

    def pushFilters(self, filters):
        """Bounds on y choose rows; Spark still applies every filter."""
        first, last = 0, self.header.height
        for f in filters:
            if getattr(f, "attribute", None) == ("y",) and isinstance(getattr(f, "value", None), int):
                kind = type(f).__name__
                if kind in ("GreaterThan", "GreaterThanOrEqual"):
                    first = max(first, f.value + (kind == "GreaterThan"))
                elif kind in ("LessThan", "LessThanOrEqual"):
                    last = min(last, f.value + (kind == "LessThanOrEqual"))
                elif kind == "EqualTo":
                    first, last = max(first, f.value), min(last, f.value + 1)
            yield f
        self.bounds = (min(first, last), last)

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        fetch, close = ranges(self.path)
        try:
            for y, x, block in tiff.read_blocks(fetch, self.header, partition.first, partition.last):
                a, b = max(y, partition.first), min(y + block.shape[1], partition.last)
                if a < b:
                    yield pa.RecordBatch.from_pandas(_rows(a, x, block[:, a - y : b - y]), preserve_index=False)
        finally:
            close()


class GeoTiff(DataSource):
    """spark.read.format("geotiff").load(path): pixels of one file, options rows (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def _path(self) -> str:
        return self.options["path"].split("|")[0]

    def schema(self) -> str:
        header = header_of(self._path())
        return pixel_schema(header.bands, header.dtype)

    def reader(self, schema) -> GeoTiffReader:
        return GeoTiffReader(self._path(), int(self.options.get("rows", 8 * STRIP_ROWS)))


def register(spark: SparkSession) -> None:
    """Make format "geotiff" known, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiff)


def strips(pixels: DataFrame, meta: RasterMeta, values: list[str], dtype: str = "uint8") -> DataFrame:
    """(strip, data): the deflated bytes of each run of STRIP_ROWS rows; a group has at most that many rows."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["strip"].iloc[0])
        image = np.zeros((len(values), min(STRIP_ROWS, meta.height - n * STRIP_ROWS), meta.width), dtype)
        for b, v in enumerate(values):
            image[b, pdf["y"] - n * STRIP_ROWS, pdf["x"]] = pdf[v]
        return pd.DataFrame({"strip": [n], "data": [tiff.pack_strip(image)]})

    rows = pixels.select("y", "x", *values, F.expr(f"CAST(y div {STRIP_ROWS} AS INT) AS strip"))
    return rows.groupBy("strip").applyInPandas(pack, "strip int, data binary")


def geotiff_parts(labels: DataFrame, meta: RasterMeta, values: list[str] | None = None, dtype: str = "uint8") -> Iterator[bytes]:
    """The bytes of a GeoTIFF in order. Executors pack and keep the strips; the driver learns their sizes, from which all
    offsets follow, and passes the strips on a partition at a time."""
    values = values or (["label"] if "label" in labels.columns else bands_of(labels))
    path = new_folder(labels.sparkSession, "strips")
    strips(labels, meta, values, dtype).repartitionByRange("strip").sortWithinPartitions("strip").write.parquet(path)
    packed = labels.sparkSession.read.schema("strip int, data binary").parquet(path)
    sizes = {r["strip"]: r["n"] for r in packed.select("strip", F.length("data").alias("n")).collect()}
    blank = {}
    for n in range(-(-meta.height // STRIP_ROWS)):  # rows without a pixel are zeros
        if n not in sizes:
            blank[n] = tiff.pack_strip(np.zeros((len(values), min(STRIP_ROWS, meta.height - n * STRIP_ROWS), meta.width), dtype))
            sizes[n] = len(blank[n])
    head, tail = tiff.layout([sizes[n] for n in sorted(sizes)], (len(values), meta.height, meta.width), np.dtype(dtype), min(STRIP_ROWS, meta.height), meta.transform, meta.epsg)
    yield head
    due = 0
    for row in packed.orderBy("strip").toLocalIterator():
        while due in blank:
            yield blank[due]
            due += 1
        yield bytes(row["data"])
        due = row["strip"] + 1
    yield from (blank[n] for n in sorted(blank) if n >= due)
    yield tail


def to_geotiff(labels: DataFrame, meta: RasterMeta, values: list[str] | None = None, dtype: str = "uint8") -> bytes:
    """A GeoTIFF of a raster that fits the driver."""
    return b"".join(geotiff_parts(labels, meta, values, dtype))


def write_raster(labels: DataFrame, meta: RasterMeta, folder: str, name: str, kind: str = "geotiff", values: list[str] | None = None) -> str:
    """Write a label map under a free name; return the path. Strips of a GeoTIFF pass through the driver one partition at a time."""
    spark = labels.sparkSession
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(place)
    ending = ".tif" if kind == "geotiff" else ".parquet"
    taken = {s.getPath().getName().removesuffix(ending) for s in system.listStatus(place) if s.getPath().getName().endswith(ending)}
    path = f"{folder.rstrip('/')}/{free_name(name, taken)}{ending}"
    if kind == "parquet":
        labels.withColumn("strip", F.expr(f"CAST(y div {STRIP_ROWS} AS INT)")).repartition("strip").sortWithinPartitions("y", "x").drop("strip").write.parquet(path)
    else:
        out = system.create(jvm.org.apache.hadoop.fs.Path(path))
        try:
            for part in geotiff_parts(labels, meta, values):
                out.write(bytearray(part))
        finally:
            out.close()
    return path

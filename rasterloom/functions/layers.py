"""Map layers as rows: which can be segmented, which can be rendered, and the parameters for rendering them."""

from __future__ import annotations

from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Providers of web and tile services; prefixes of remote sources; extensions of rasters (fixed values).
WEB_PROVIDERS = ("wms", "wmts", "wcs", "arcgismapserver", "arcgisfeatureserver", "wfs", "xyz", "vectortile", "mbtiles")
REMOTE = ("/vsicurl/", "http://", "https://")
RASTER_ENDINGS = (".tif", ".tiff")

LAYER = T.StructType([T.StructField("layer_id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("layer_type", T.StringType()), T.StructField("provider_name", T.StringType()), T.StructField("source_path", T.StringType()), T.StructField("band_count", T.IntegerType())])


def is_file_raster(provider: str = "provider_name", source: str = "source_path", bands: str = "band_count") -> Column:
    """A three-band GeoTIFF on file: options after a | don't count, nor does case; null is False."""
    path = F.lower(F.split(F.col(source), r"\|")[0])
    name = F.regexp_extract(path, r"([^/]*)$", 1)  # a dot that begins the name begins no ending
    ending = F.regexp_extract(name, r"^\.*[^.].*?(\.[^.]*)$", 1)
    return F.coalesce((F.lower(provider) == "gdal") & (F.col(bands) == 3) & ending.isin(*RASTER_ENDINGS), F.lit(False))


def is_renderable(layer_type: str = "layer_type", provider: str = "provider_name", source: str = "source_path") -> Column:
    """A layer that must be rendered first: a web service, a vector layer, or a remote raster; a null provider is False."""
    low, path = F.lower(provider), F.lower(source)
    remote = F.startswith(path, F.lit(REMOTE[0])) | F.startswith(path, F.lit(REMOTE[1])) | F.startswith(path, F.lit(REMOTE[2]))
    return F.when(F.col(provider).isNull(), False).otherwise(low.isin(*WEB_PROVIDERS) | F.coalesce(F.col(layer_type) == "VectorLayer", F.lit(False)) | ((low == "gdal") & F.coalesce(remote, F.lit(False))))


@F.arrow_udf(T.StringType())
def _shortest(x: pa.Array) -> pa.Array:
    return pa.array([None if v is None else repr(v) for v in x.to_pylist()], pa.string())


def plain_number(x: str) -> Column:
    """A double's shortest digits, in decimal notation from 1e-4 up to 1e16, else like 1.5e-05; before version 19, Java's own may be longer."""
    return _shortest(F.col(x).cast("double"))


def extent_string(xmin: str = "xmin", ymin: str = "ymin", xmax: str = "xmax", ymax: str = "ymax", crs: str = "crs") -> Column:
    """"xmin,xmax,ymin,ymax" in plain numbers, with " [crs]" where there is one: both x come first."""
    plain = F.concat_ws(",", *[plain_number(c) for c in (xmin, xmax, ymin, ymax)])
    return F.when(F.coalesce(F.length(crs), F.lit(0)) > 0, F.concat(plain, F.lit(" ["), F.col(crs), F.lit("]"))).otherwise(plain)


def render_params(layers: DataFrame, units_per_pixel: float = 1.0) -> DataFrame:
    """(layer_id, extent, layers, map_units_per_pixel, output) for layers that carry their extent."""
    return layers.select("layer_id", extent_string().alias("extent"), F.array("layer_id").alias("layers"), F.lit(float(units_per_pixel)).alias("map_units_per_pixel"), F.lit("").alias("output"))


def layer_metadata(layer: Any) -> dict[str, Any]:
    """A row's fields from any object with the usual methods: no provider gives None, a failing band count 0."""

    def asked(name: str) -> Any:
        method = getattr(layer, name, None)
        return method() if callable(method) else None

    provider = asked("dataProvider")
    try:
        bands = asked("bandCount") or 0
    except Exception:
        bands = 0
    return {"layer_type": type(layer).__name__, "provider_name": provider.name() if provider else None, "source_path": asked("source"), "band_count": bands}


def listed(layers: DataFrame) -> DataFrame:
    """Raster and vector layers by name, whatever its case."""
    return layers.where(F.col("layer_type").isin("RasterLayer", "VectorLayer")).orderBy(F.lower("name"), "layer_id")


def rendering_candidate(layers: DataFrame) -> DataFrame:
    """The first layer that could be rendered, if no layer can be segmented as it is; else no row."""
    ready = layers.where(is_file_raster()).select(F.lit(1).alias("ready")).limit(1)
    waiting = listed(layers.where(is_renderable()))
    return waiting.join(ready, F.lit(True), "left_anti").orderBy(F.lower("name"), "layer_id").limit(1)


def find_layer(layers: DataFrame, name: str | None = None, layer_id: str | None = None) -> DataFrame:
    """The layer with an id, or the first one with a name."""
    return layers.where(F.col("layer_id") == layer_id) if layer_id is not None else layers.where(F.col("name") == name).orderBy("layer_id").limit(1)


def free_name(wanted: str, taken: set[str]) -> str:
    """``wanted``, or it with " (2)", " (3)", ... where that is taken."""
    name, n = wanted, 2
    while name in taken:
        name, n = f"{wanted} ({n})", n + 1
    return name

"""Raster segmentation and focal analytics as DataFrame plans."""

from .schema import RasterMeta

__all__ = ["RasterMeta"]

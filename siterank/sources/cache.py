"""Raster layers loaded once and reused."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from siterank.sources.readers import raster_scan


class LayerCache:
    """Persisted scanlines per layer; only asked layers are read from the partitioned table."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path, self._loaded = spark, path, {}

    def load(self, layer: str) -> DataFrame:
        if layer not in self._loaded:
            rows = raster_scan(self._spark, self._path, [layer])
            self._loaded[layer] = rows.persist(StorageLevel.MEMORY_AND_DISK)
        return self._loaded[layer]

    def clear(self) -> None:
        for df in self._loaded.values():
            df.unpersist()
        self._loaded.clear()

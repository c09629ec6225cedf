"""Sampling stacks of raster layers at points.

Layers are scanline tables (layer, y, width, height, pixels). Pixels are never exploded
before the join: a point needs one scanline per layer.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from siterank.constants import LAYER_KEYS, LAYERS
from siterank.functions.geometry import inside, pixel_x, pixel_y
from siterank.functions.layers import layer_key, report_value
from siterank.session import BROADCAST_BYTES

# Most distinct positions that are broadcast to the scanlines of a large raster: 11 small rows each.
FEW_POINTS = 10_000

# Width of the pieces scanlines are cut into before a shuffle join.
TILE = 1024


def layer_sizes(scanlines: DataFrame) -> DataFrame:
    """(layer, width, height) per layer."""
    return scanlines.groupBy("layer").agg(F.max("width").alias("width"), F.max("height").alias("height"))


@dataclass(frozen=True)
class Stack:
    """Scanlines with the size of each layer, measured once (at most one row per layer)."""

    scanlines: DataFrame
    sizes: dict[str, tuple[int, int]]

    @classmethod
    def of(cls, scanlines: DataFrame, layers: Sequence[str] = LAYER_KEYS) -> Stack:
        wanted = scanlines.filter(F.col("layer").isin(*layers))
        rows = layer_sizes(wanted).collect()
        return cls(wanted, {r.layer: (r.width, r.height) for r in rows})

    def bytes(self, layers: Sequence[str]) -> int:
        """Upper bound of the bytes these layers take as floats."""
        return sum(h * (w * 4 + 64) for l, (w, h) in self.sizes.items() if l in layers)


def coregister(points: DataFrame, rasters: DataFrame | Stack, layers: Sequence[str] = LAYER_KEYS,
               key: str = "site_id", broadcast_bytes: int = BROADCAST_BYTES, few_points: int = FEW_POINTS) -> DataFrame:
    """Values of all ``layers`` at each point, wide; layers without a raster are null.

    Every row of ``points`` gets the values at its own position, whatever its ``key``. Rasters
    within ``broadcast_bytes`` go to every executor and no point is shuffled. For larger ones the
    distinct positions are looked up: up to ``few_points`` of them are sent to the scanlines,
    which are filtered where they lie; more are joined with tiles by a shuffle.
    """
    stack = rasters if isinstance(rasters, Stack) else Stack.of(rasters, layers)
    present = [l for l in layers if l in stack.sizes]
    if stack.bytes(present) <= broadcast_bytes:
        out = points
        for layer in present:
            out = _lookup_broadcast(out, stack.scanlines, layer, *stack.sizes[layer])
    else:
        tiled = stack.scanlines.filter(F.col("layer").isin(*present))
        out = _lookup_positions(points, tiled, present, stack.sizes, few_points)
    columns = [F.col(l) if l in present else F.lit(None).cast("float").alias(l) for l in layers]
    return out.select(*points.columns, *columns)


def _lookup_broadcast(points: DataFrame, scanlines: DataFrame, layer: str, width: int, height: int) -> DataFrame:
    lines = scanlines.filter(F.col("layer") == layer).select(F.col("y").alias("_y"), F.col("pixels").alias("_px"))
    x, y = pixel_x(F.col("lon"), F.lit(width)), pixel_y(F.col("lat"), F.lit(height))
    ok = inside(x, y, F.lit(width), F.lit(height))
    return (
        points.join(F.broadcast(lines), F.when(ok, y) == F.col("_y"), "left")
        .withColumn(layer, F.get(F.col("_px"), x.cast("int"))).drop("_y", "_px"))


def _lookup_positions(points, scanlines, present, sizes, few_points) -> DataFrame:
    """Look up distinct positions and join the values back on the position; a null position has none."""
    places = points.select("lat", "lon").where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).distinct()
    specs = []
    for layer in present:
        w, h = (F.lit(v) for v in sizes[layer])
        x, y = pixel_x(F.col("lon"), w), pixel_y(F.col("lat"), h)
        specs.append(F.when(inside(x, y, w, h), F.struct(F.lit(layer).alias("layer"), y.alias("y"), x.alias("x"))))
    asked = places.select("lat", "lon", F.explode(F.filter(F.array(*specs), lambda s: s.isNotNull())).alias("p")).select("lat", "lon", "p.*")
    few = few_points > 0 and not points.isStreaming and places.limit(few_points + 1).count() <= few_points
    found = _read_few(asked, scanlines) if few else _read_tiles(asked, scanlines)
    wide = found.groupBy("lat", "lon").pivot("layer", present).agg(F.max("value"))
    return points.join(wide, ["lat", "lon"], "left")


def _read_few(asked, scanlines) -> DataFrame:
    """Scanlines meet the broadcast positions before anything is shuffled."""
    return scanlines.select("layer", "y", "pixels").join(F.broadcast(asked), ["layer", "y"]).select(
        "lat", "lon", "layer", F.get("pixels", F.col("x").cast("int")).alias("value"))


def _read_tiles(asked, scanlines) -> DataFrame:
    """Shuffle join on (layer, y, tile); adaptive skew splitting divides crowded tiles."""
    last = F.floor((F.size("pixels") - 1) / TILE).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda t: F.slice("pixels", t * TILE + 1, F.lit(TILE)))
    tiles = scanlines.where(F.size("pixels") > 0).select("layer", "y", F.posexplode(cut).alias("tile", "_px")).withColumn(
        "tile", F.col("tile").cast("long"))
    wanted = asked.withColumn("tile", F.floor(F.col("x") / TILE)).withColumn("x", F.col("x") % TILE)
    return wanted.join(tiles, ["layer", "y", "tile"]).select(
        "lat", "lon", "layer", F.get("_px", F.col("x").cast("int")).alias("value"))


def sample_layer(points: DataFrame, rasters: DataFrame | Stack, layer: str, key: str = "site_id",
                 broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Value of one layer at each point, as ``value``; null off the raster."""
    out = coregister(points, rasters, [layer], key, broadcast_bytes)
    return out.withColumnRenamed(layer, "value")


def as_long(wide: DataFrame, layers: Sequence[str] = LAYER_KEYS, keep: Sequence[str] = ("site_id",)) -> DataFrame:
    """(keep..., layer, value): one row per point and layer, nulls included."""
    return wide.select(*keep, *layers).unpivot(
        [F.col(k) for k in keep], [F.col(l) for l in layers], "layer", "value")


def attach_metadata(long: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add name, unit and description to sampled values (the catalog has one row per layer)."""
    return long.join(F.broadcast(catalog), "layer", "left")


def long_to_wide(long: DataFrame, key: str = "site_id") -> DataFrame:
    """(key, name, value) rows to one record per key, fields found from display names."""
    return (long.withColumn("_field", layer_key(F.col("name")))
            .groupBy(key).pivot("_field", list(LAYER_KEYS)).agg(F.max("value")))


def report(wide: DataFrame, key: str = "site_id") -> DataFrame:
    """The text shown for a point: its position, then one line per layer."""
    lines = [F.concat(F.lit(f"{name}: "), report_value(F.col(layer), F.lit(unit)))
             for layer, name, _, unit, _ in LAYERS]
    return wide.select(key, F.concat_ws("; ", *lines).alias("report"))

"""Positions on the sphere and on raster grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from siterank.functions.numbers import hash_uniform


def pixel_x(lon: Column, width: Column) -> Column:
    return F.floor((lon + 180.0) / 360.0 * width)


def pixel_y(lat: Column, height: Column) -> Column:
    return F.floor((F.lit(90.0) - lat) / 180.0 * height)


def inside(x: Column, y: Column, width: Column, height: Column) -> Column:
    """True for pixels on the raster; null coordinates are outside."""
    return F.coalesce((x >= 0) & (x < width) & (y >= 0) & (y < height), F.lit(False))


def latlon_of(x: Column, y: Column, z: Column, radius: Column) -> tuple[Column, Column]:
    """(lat, lon) in degrees of a point on a sphere whose axis is y."""
    return F.degrees(F.asin(y / radius)), F.degrees(F.atan2(z, x))


def sphere_point(seed: int, key: Column, low: float = 25.0, high: float = 50.0) -> dict[str, Column]:
    """Uniform direction and a radius in [low, high), decided by hashes of ``key``."""
    radius = hash_uniform(f"{seed}r", key) * (high - low) + low
    theta = hash_uniform(f"{seed}u", key) * (2 * math.pi)
    cos_phi = hash_uniform(f"{seed}v", key) * 2.0 - 1.0
    sin_phi = F.sqrt(F.lit(1.0) - cos_phi * cos_phi)
    return {
        "x": radius * sin_phi * F.cos(theta),
        "y": radius * sin_phi * F.sin(theta),
        "z": radius * cos_phi,
        "radius": radius,
    }

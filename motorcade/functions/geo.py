"""Geospatial scalar functions as Column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius in metres, and the geohash alphabet.
EARTH_M = 6_371_000.0
EARTH_KM = 6371.0088
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance in the unit of the radius; degrees in."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2.0 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def metres(lat1, lon1, lat2, lon2, radius: float = EARTH_M):
    """The same for numbers or arrays of numbers."""
    p, q = np.radians(lat1), np.radians(lat2)
    a = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * radius * np.arcsin(np.sqrt(np.minimum(1.0, a)))


def _cells(x: Column, low: float, span: float, bits: int) -> Column:
    """Number of the half-open cell that x lies in, clamped to the grid."""
    n = F.floor((x - low) / span * float(1 << bits)).cast("bigint")
    return F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), n)).cast("bigint")


def geohash(lat: Column, lon: Column, precision: int) -> Column:
    """Geohash: bits of longitude and latitude cells take turns, longitude first, five to a letter."""
    total = 5 * precision
    lon_bits, lat_bits = (total + 1) // 2, total // 2
    x, y = _cells(lon, -180.0, 360.0, lon_bits), _cells(lat, -90.0, 180.0, lat_bits)
    return _letters(x, y, precision)


def let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def _letters(x: Column, y: Column, precision: int) -> Column:
    """Geohash of a grid cell."""
    lon_bits, lat_bits = (5 * precision + 1) // 2, 5 * precision // 2
    out = []
    for c in range(precision):
        index = F.lit(1).cast("bigint")
        for b in range(5 * c, 5 * c + 5):
            cell, left = (x, lon_bits - 1 - b // 2) if b % 2 == 0 else (y, lat_bits - 1 - b // 2)
            index = index + F.shiftright(cell, left).bitwiseAND(F.lit(1).cast("bigint")) * (16 >> (b - 5 * c))
        out.append(F.substr(F.lit(BASE32), index.cast("int"), F.lit(1)))
    return F.concat(*out)


def _grid_cell(code: Column) -> Column:
    """Struct of the column x and row y that a geohash names."""
    start = F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"), F.lit(0).alias("i"))

    def step(acc: Column, letter: Column) -> Column:
        def add(d: Column) -> Column:
            bit = lambda n: F.shiftright(d, n).bitwiseAND(F.lit(1).cast("bigint"))
            three, two = bit(4) * 4 + bit(2) * 2 + bit(0), bit(3) * 2 + bit(1)
            even = acc["i"] % 2 == 0
            return F.struct(
                F.when(even, acc["x"] * 8 + three).otherwise(acc["x"] * 4 + two).alias("x"),
                F.when(even, acc["y"] * 4 + two).otherwise(acc["y"] * 8 + three).alias("y"),
                (acc["i"] + 1).alias("i"),
            )

        return let((F.instr(F.lit(BASE32), letter) - 1).cast("bigint"), add)

    return F.aggregate(F.split(code, ""), start, step)


def geohash_decode(code: Column) -> Column:
    """Struct of centre and half errors: lat, lon, lat_err, lon_err."""

    def box(c: Column) -> Column:
        bits = F.length(code) * 5
        w, h = F.lit(360.0) / F.pow(F.lit(2.0), F.ceil(bits / 2)), F.lit(180.0) / F.pow(F.lit(2.0), F.floor(bits / 2))
        return F.struct(((c["y"] + 0.5) * h - 90.0).alias("lat"), ((c["x"] + 0.5) * w - 180.0).alias("lon"), (h / 2).alias("lat_err"), (w / 2).alias("lon_err"))

    return let(_grid_cell(code), box)


def geohash_neighbours(code: Column, precision: int) -> Column:
    """The 8 cells around one of this precision, sorted; cells beyond a pole or the date line stay at the edge."""
    right, top = (1 << (5 * precision + 1) // 2) - 1, (1 << 5 * precision // 2) - 1
    moves = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy])

    def near(c: Column) -> Column:
        inside = lambda v, top: F.greatest(F.lit(0), F.least(F.lit(top), v)).cast("bigint")
        moved = F.transform(moves, lambda m: F.struct(inside(c["x"] + m["dx"], right).alias("x"), inside(c["y"] + m["dy"], top).alias("y")))
        return F.array_sort(F.transform(moved, lambda m: _letters(m["x"], m["y"], precision)))

    return let(_grid_cell(code), near)


def cover_bbox(south: Column, west: Column, north: Column, east: Column, precision: int) -> Column:
    """Every cell of a precision that meets a box, from the grid's own rows and columns."""
    total = 5 * precision
    lon_bits, lat_bits = (total + 1) // 2, total // 2
    rows = F.sequence(_cells(south, -90.0, 180.0, lat_bits), _cells(north, -90.0, 180.0, lat_bits))
    cols = F.sequence(_cells(west, -180.0, 360.0, lon_bits), _cells(east, -180.0, 360.0, lon_bits))
    return F.flatten(F.transform(rows, lambda y: F.transform(cols, lambda x: _letters(x, y, precision))))


def zoom_precision(zoom: Column) -> Column:
    """Geohash precision for a map zoom."""
    return F.when(zoom <= 6, 3).when(zoom <= 9, 4).when(zoom <= 12, 5).otherwise(6)


def in_circle(lat: Column, lon: Column, clat: Column, clon: Column, radius_m: Column) -> Column:
    return haversine(lat, lon, clat, clon) <= radius_m


def in_polygon(lat: Column, lon: Column, ring: Column) -> Column:
    """Ray casting: whether an odd number of edges crosses the point's parallel to its east. ring: array of (lat, lon), closed by its first point.

    An edge's span of longitude is that of its coordinates as written, in decimals, since points may lie on the edge."""
    n = F.size(ring)

    def span(a: Column, b: Column) -> Column:
        exact = lambda x: x.try_cast("decimal(36,30)")
        return F.coalesce((exact(b) - exact(a)).cast("double"), b - a)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        return F.when(spans & (lon < span(a["lon"], b["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]), 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + crosses(i)) % 2 == 1


def degrees_for(metres: float) -> float:
    """Degrees of latitude that a distance spans."""
    return math.degrees(metres / EARTH_M)

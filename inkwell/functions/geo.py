"""Geographic and numeric scalar functions, as Columns (and plain Python for literals)."""

from __future__ import annotations

import math
import re
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = (1 << 32) - 1
TOLERANCE = 1e-6
_UNITS = {
    "inches": 0.0254, "inch": 0.0254, "in": 0.0254, "yards": 0.9144, "yard": 0.9144, "yd": 0.9144, "feet": 0.3048,
    "ft": 0.3048, "kilometers": 1000.0, "kilometer": 1000.0, "km": 1000.0, "nauticalmiles": 1852.0, "nm": 1852.0,
    "millimeters": 0.001, "millimeter": 0.001, "mm": 0.001, "centimeters": 0.01, "centimeter": 0.01, "cm": 0.01,
    "miles": 1609.344, "mile": 1609.344, "mi": 1609.344, "meters": 1.0, "meter": 1.0, "m": 1.0,
}


def parse_distance(text: str) -> float:
    """'100mi' to meters; a bare number is meters."""
    m = re.fullmatch(r"\s*([0-9.eE+-]+)\s*([a-z]*)\s*", text)
    if not m or (m[2] and m[2] not in _UNITS):
        raise ValueError(f"not a distance: {text!r}")
    return float(m[1]) * _UNITS.get(m[2], 1.0)


def convert_distance(meters: float, unit: str) -> float:
    return meters / _UNITS[unit]


def quantised(value: Column, span: int) -> Column:
    """A longitude (span 360) or latitude (180) as stored with 32 bits an axis."""
    half, scale = span / 2, STEPS / span
    return F.floor((value + half) * scale) / scale - half


def diameter_km(latitude: Column) -> Column:
    """Earth's diameter at a latitude in degrees, from a 1024-step table in closed form."""
    a, b = 6378137.0, 6356752.3142
    i = F.floor(F.abs(latitude) * (math.pi / 180) * (1024 / (math.pi / 2)) + 0.5)
    lat = i * math.pi / 2049
    c, s = F.cos(lat), F.sin(lat)
    one, two = (a * a * c) * (a * a * c), (b * b * s) * (b * b * s)
    three, four = (a * c) * (a * c), (b * s) * (b * s)
    return F.sqrt((one + two) / (three + four)) * 2 / 1000


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    rad = math.pi / 180
    x1, x2 = lat1 * rad, lat2 * rad
    h1 = (1 - F.cos(x1 - x2)) / 2
    h2 = (1 - F.cos((lon1 - lon2) * rad)) / 2
    h = h1 + F.cos(x1) * F.cos(x2) * h2
    return diameter_km((lat1 + lat2) / 2) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def in_box(lon: Column, lat: Column, left: float, top: float, right: float, bottom: float) -> Column:
    """Inside a box, edges included; a box whose right is left of its left crosses the dateline."""
    ok = (lat >= bottom - TOLERANCE) & (lat <= top + TOLERANCE)
    west, east = lon >= left - TOLERANCE, lon <= right + TOLERANCE
    return ok & ((west | east) if right < left else (west & east))


def box_around(lon: float, lat: float, meters: float) -> tuple[float, float, float, float]:
    """(left, top, right, bottom) of all points within a distance, with a little slack."""
    if not (-180 <= lon <= 180 and -90 <= lat <= 90):
        raise ValueError(f"not a point: {lon}, {lat}")
    r = (meters + 0.07) / 6356752.3142
    y = math.radians(lat)
    low, high = y - r, y + r
    if low <= -math.pi / 2 or high >= math.pi / 2:  # a pole lies within
        return -180.0, min(90.0, math.degrees(high)), 180.0, max(-90.0, math.degrees(low))
    d = math.degrees(math.asin(min(1.0, math.sin(r) / math.cos(y))))
    left, right = lon - d, lon + d
    return left + 360 * (left < -180), math.degrees(high), right - 360 * (right > 180), math.degrees(low)


def within_distance(lon: Column, lat: Column, center: tuple[float, float], meters: float) -> Column:
    """The box first: plain comparisons that a scan can use; then the exact distance."""
    qlon, qlat = quantised(lon, 360), quantised(lat, 180)
    exact = haversine_km(F.lit(center[0]), F.lit(center[1]), qlon, qlat) <= meters / 1000
    return in_box(lon, lat, *box_around(*center, meters)) & exact


def in_polygon(lon: Column, lat: Column, points: list[tuple[float, float]]) -> Column:
    """Even-odd ray casting over the literal vertices; a vertex itself is inside."""
    if len(points) < 3:
        raise ValueError("a polygon needs three points")
    inside, vertex = F.lit(False), F.lit(False)
    for (x1, y1), (x2, y2) in zip(points, [points[-1], *points[:-1]]):
        vertex |= (F.abs(lon - x1) <= TOLERANCE) & (F.abs(lat - y1) <= TOLERANCE)
        if y1 != y2:
            cross = ((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)
            inside = inside != cross
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return in_box(lon, lat, min(xs), max(ys), max(xs), min(ys)) & (inside | vertex)


def morton(lon: Column, lat: Column) -> Column:
    """The 64-bit interleaved hash of a point: a layout key that keeps neighbours together."""
    return _spread(F.floor((lon + 180) * (STEPS / 360)).cast("long")).bitwiseOR(
        F.shiftleft(_spread(F.floor((lat + 90) * (STEPS / 180)).cast("long")), 1)
    )


def _spread(v: Column) -> Column:
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash_encode(lon: float, lat: float, precision: int = 12) -> str:
    x, y, bits = [-180.0, 180.0], [-90.0, 90.0], 0
    for i in range(5 * precision):
        span, v = (y, lat) if i % 2 else (x, lon)
        mid = (span[0] + span[1]) / 2
        up = v >= mid
        span[0 if up else 1] = mid
        bits = bits << 1 | up
    return "".join(_BASE32[bits >> 5 * k & 31] for k in reversed(range(precision)))


def geohash_decode(text: str) -> tuple[float, float]:
    x, y = [-180.0, 180.0], [-90.0, 90.0]
    for i, b in enumerate(b for c in text for b in f"{_BASE32.index(c):05b}"):
        span = y if i % 2 else x
        span[0 if b == "1" else 1] = (span[0] + span[1]) / 2
    return sum(x) / 2, sum(y) / 2


def geohash(lon: Column, lat: Column, precision: int = 12) -> Column:
    """Geohash by Columns: bits of both axes, five at a time, longitude first."""
    n = 5 * precision
    nx, ny = (n + 1) // 2, n // 2
    ix = F.least(F.floor((lon + 180) / 360 * (1 << nx)), F.lit((1 << nx) - 1)).cast("long")
    iy = F.least(F.floor((lat + 90) / 180 * (1 << ny)), F.lit((1 << ny) - 1)).cast("long")
    chars = []
    for k in range(precision):
        code = F.lit(0)
        for b in range(5 * k, 5 * k + 5):
            axis, width = (iy, ny) if b % 2 else (ix, nx)
            bit = F.shiftright(axis, width - 1 - b // 2).bitwiseAND(F.lit(1))
            code = code * 2 + bit
        chars.append(F.substr(F.lit(_BASE32), (code + 1).cast("int"), F.lit(1)))
    return F.concat(*chars)


def parse_point(value) -> tuple[float, float] | None:
    """(lon, lat) of a pair, 'lat,lon', a geohash, or a mapping or object with lon/lng and lat."""
    if isinstance(value, str):
        if "," in value:
            lat, lon = map(float, value.split(","))
            return lon, lat
        return geohash_decode(value)
    if isinstance(value, (list, tuple)):
        return (float(value[0]), float(value[1])) if len(value) >= 2 else None
    get = value.get if isinstance(value, dict) else lambda k: getattr(value, k, None)
    lon = next((v for k in ("lon", "lng") if (v := get(k)) is not None), None)
    lat = get("lat")
    return None if lon is None or lat is None else (float(lon), float(lat))


def sortable_int(x: float) -> int:
    """The integer whose order is that of the doubles."""
    i = struct.unpack("<q", struct.pack("<d", x))[0]
    return i ^ 0x7FFFFFFFFFFFFFFF if i < 0 else i


def sortable_float(i: int) -> float:
    return struct.unpack("<d", struct.pack("<q", i ^ 0x7FFFFFFFFFFFFFFF if i < 0 else i))[0]


def prefix_coded(value: int, shift: int = 0) -> bytes:
    """An integer without its lowest `shift` bits as bytes in the same order, seven bits each."""
    if not 0 <= shift < 64:
        raise ValueError("shift must be 0 to 63")
    n = (63 - shift) // 7 + 1
    v = ((value + (1 << 63)) & ((1 << 64) - 1)) >> shift
    return bytes([0x20 + shift]) + bytes(v >> 7 * k & 0x7F for k in reversed(range(n)))


def prefix_decoded(data: bytes) -> tuple[int, int]:
    """(value, shift) of a prefix-coded term."""
    shift = data[0] - 0x20
    if not 0 <= shift < 64 or len(data) != (63 - shift) // 7 + 2:
        raise ValueError("not prefix coded")
    v = 0
    for b in data[1:]:
        v = v << 7 | b
    return (v << shift) - (1 << 63), shift


def interleave(x: int, y: int) -> int:
    return sum((x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1 for k in range(32))


def deinterleave(v: int) -> tuple[int, int]:
    return sum((v >> 2 * k & 1) << k for k in range(32)), sum((v >> 2 * k + 1 & 1) << k for k in range(32))

"""Positions as columns: distances, windows, tiles, and measures of coordinate arrays.

Coordinates are arrays of structs with lon and lat. Nothing is wrapped at the antimeridian.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000
NANO = 1_000_000_000


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def nano(degrees: Column) -> Column:
    return (degrees * float(NANO)).cast("long")


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Whole metres, truncated."""
    r = math.pi / 180
    dp, dl = (lat2 - lat1) * F.lit(r) / 2, (lon2 - lon1) * F.lit(r) / 2
    a = F.sin(dp) * F.sin(dp) + F.cos(lat1 * F.lit(r)) * F.cos(lat2 * F.lit(r)) * F.sin(dl) * F.sin(dl)
    return (F.lit(float(EARTH_M)) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))).cast("int")


@dataclass(frozen=True)
class Window:
    """Inclusive bounds in degrees."""

    min_lat: float
    max_lat: float
    min_lon: float
    max_lon: float

    @staticmethod
    def around(lat: float, lon: float, radius_m: int) -> Window:
        """The window that a radius needs at least; a precise test follows it."""
        up, right = radius_m / 111_000, radius_m / (6_367_000 * math.cos(math.radians(lat)) * math.pi / 180)
        return Window(lat - up, lat + up, lon - right, lon + right)

    def holds(self, lat: Column, lon: Column) -> Column:
        """Plain comparisons with constants, which reach the Parquet scan."""
        return lat.between(self.min_lat, self.max_lat) & lon.between(self.min_lon, self.max_lon)

    def overlaps(self, env: Column) -> Column:
        return (env["max_lat"] >= self.min_lat) & (env["min_lat"] <= self.max_lat) & (env["max_lon"] >= self.min_lon) & (env["min_lon"] <= self.max_lon)


def within_radius(lat: Column, lon: Column, centre_lat: float, centre_lon: float, radius_m: int) -> Column:
    window = Window.around(centre_lat, centre_lon, radius_m)
    return window.holds(lat, lon) & (haversine_m(lat, lon, F.lit(centre_lat), F.lit(centre_lon)) <= radius_m)


def round5(x: Column) -> Column:
    return F.floor(x * 100000.0 + 0.5) / 100000.0


def tile_xy(lon: Column, lat: Column, zoom: int | Column) -> tuple[Column, Column]:
    """Column and row of the map tile at the zoom."""
    n = F.pow(F.lit(2.0), F.lit(zoom) if isinstance(zoom, int) else zoom)
    r = lat * F.lit(math.pi / 180)
    y = (1.0 - F.ln(F.tan(r) + 1.0 / F.cos(r)) / F.lit(math.pi)) / 2.0 * n
    return ((lon + 180.0) / 360.0 * n).cast("int"), y.cast("int")


# --- arrays of coordinates ---------------------------------------------------------------------------------------


def shape_of(coords: Column) -> Column:
    """point, polygon (closed, four or more) or line."""
    first, last = F.get(coords, 0), F.get(coords, F.size(coords) - 1)
    closed = (first["lon"] == last["lon"]) & (first["lat"] == last["lat"])
    return F.when(F.size(coords) == 1, "point").when((F.size(coords) >= 4) & closed, "polygon").when(F.size(coords) > 1, "line")


def envelope(coords: Column) -> Column:
    lon, lat = F.transform(coords, lambda c: c["lon"]), F.transform(coords, lambda c: c["lat"])
    return F.struct(F.array_min(lat).alias("min_lat"), F.array_max(lat).alias("max_lat"), F.array_min(lon).alias("min_lon"), F.array_max(lon).alias("max_lon"))


def _segments(coords: Column) -> Column:
    n = F.size(coords)
    pair = lambda a, b: F.struct(a["lon"].alias("x1"), a["lat"].alias("y1"), b["lon"].alias("x2"), b["lat"].alias("y2"))
    return F.zip_with(F.slice(coords, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(coords, F.lit(2), F.greatest(n - 1, F.lit(0))), pair)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _length(s: Column) -> Column:
    return F.sqrt((s["x2"] - s["x1"]) * (s["x2"] - s["x1"]) + (s["y2"] - s["y1"]) * (s["y2"] - s["y1"]))


def _point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def line_midpoint(coords: Column) -> Column:
    """The point at half of the length; the first vertex of a line without length."""
    seg = _segments(coords)
    return let(_total(F.transform(seg, _length)) / 2, lambda half: _at_length(coords, seg, half))


def _at_length(coords: Column, seg: Column, half: Column) -> Column:
    start = F.struct(F.lit(0.0).alias("gone"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"))

    def step(a: Column, s: Column) -> Column:
        n = _length(s)
        here = a["lon"].isNull() & (n > 0) & (a["gone"] + n >= half)
        t = (half - a["gone"]) / n
        return F.struct((a["gone"] + n).alias("gone"), F.when(here, s["x1"] + (s["x2"] - s["x1"]) * t).otherwise(a["lon"]).alias("lon"), F.when(here, s["y1"] + (s["y2"] - s["y1"]) * t).otherwise(a["lat"]).alias("lat"))

    first = F.get(coords, 0)
    return let(F.aggregate(seg, start, step), lambda found: _point(F.coalesce(found["lon"], first["lon"]), F.coalesce(found["lat"], first["lat"])))


def line_centroid(coords: Column) -> Column:
    """Mean of the segments' midpoints by length; the first vertex of a line without length."""
    seg, first = _segments(coords), F.get(coords, 0)
    zero = F.lit(0.0)
    add = lambda t, s: F.struct((t["n"] + _length(s)).alias("n"), (t["x"] + _length(s) * (s["x1"] + s["x2"]) / 2).alias("x"), (t["y"] + _length(s) * (s["y1"] + s["y2"]) / 2).alias("y"))
    sums = F.aggregate(seg, F.struct(zero.alias("n"), zero.alias("x"), zero.alias("y")), add)
    return let(sums, lambda t: F.when(t["n"] > 0, _point(t["x"] / t["n"], t["y"] / t["n"])).otherwise(_point(first["lon"], first["lat"])))


def ring_centroid(coords: Column) -> Column:
    """Area centroid of a closed ring, relative to its first vertex; a ring without area is taken as a line."""
    first = F.get(coords, 0)
    seg = F.transform(_segments(coords), lambda s: F.struct((s["x1"] - first["lon"]).alias("x1"), (s["y1"] - first["lat"]).alias("y1"), (s["x2"] - first["lon"]).alias("x2"), (s["y2"] - first["lat"]).alias("y2")))

    def add(t: Column, s: Column) -> Column:
        cross = s["x1"] * s["y2"] - s["x2"] * s["y1"]
        return F.struct((t["twice"] + cross).alias("twice"), (t["x"] + (s["x1"] + s["x2"]) * cross).alias("x"), (t["y"] + (s["y1"] + s["y2"]) * cross).alias("y"))

    sums = F.aggregate(seg, F.struct(F.lit(0.0).alias("twice"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), add)
    centre = lambda t: _point(first["lon"] + t["x"] / (3 * t["twice"]), first["lat"] + t["y"] / (3 * t["twice"]))
    return let(sums, lambda t: F.when(F.abs(t["twice"]) > 1e-15, centre(t)).otherwise(line_centroid(coords)))


def ring_holds(coords: Column, lon: Column, lat: Column) -> Column:
    """Whether a closed ring holds the point (crossings to the right are odd)."""

    def crosses(s: Column) -> Column:
        spans = (s["y1"] > lat) != (s["y2"] > lat)
        return F.when(spans & (lon < s["x1"] + (lat - s["y1"]) * (s["x2"] - s["x1"]) / F.when(spans, s["y2"] - s["y1"])), 1).otherwise(0)

    return F.aggregate(F.transform(_segments(coords), crosses), F.lit(0), lambda a, x: a + x) % 2 == 1


def ring_inner_point(coords: Column) -> Column:
    """A point inside a ring: the middle of the widest stretch within it on the horizontal half way between two vertex heights."""
    heights = F.array_sort(F.array_distinct(F.transform(coords, lambda c: c["lat"])))
    middle = F.size(heights) / 2
    at = F.greatest(F.floor(middle).cast("int"), F.lit(1))
    middle_y = (F.get(heights, at - 1) + F.coalesce(F.get(heights, at), F.get(heights, at - 1))) / 2
    return let(middle_y, lambda y: _on_height(coords, y))


def _on_height(coords: Column, y: Column) -> Column:
    return _on_height_of(_segments(coords), F.get(coords, 0), y)


def _on_height_of(segments: Column, first: Column, y: Column) -> Column:
    """The middle of the widest stretch between the segments' odd and even crossings of a height; else the first position."""
    hits = F.array_sort(F.filter(F.transform(segments, lambda s: F.when((s["y1"] > y) != (s["y2"] > y), s["x1"] + (y - s["y1"]) * (s["x2"] - s["x1"]) / F.when(s["y2"] != s["y1"], s["y2"] - s["y1"]))), lambda x: x.isNotNull()))

    def widest(h: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(h) - 2, F.lit(0))), lambda i: (i % 2 == 0) & (i + 1 < F.size(h)))
        return F.array_max(F.transform(starts, lambda i: F.struct((F.get(h, i + 1) - F.get(h, i)).alias("w"), ((F.get(h, i + 1) + F.get(h, i)) / 2).alias("x"))))

    return let(let(hits, widest), lambda w: F.when(w["x"].isNotNull(), _point(w["x"], y)).otherwise(_point(first["lon"], first["lat"])))


def representative_point(coords: Column) -> Column:
    """The point itself; half way along a line; the centroid of a polygon if it is inside, else a point that is."""
    kind = shape_of(coords)
    ring = let(ring_centroid(coords), lambda c: F.when(ring_holds(coords, c["lon"], c["lat"]), c).otherwise(ring_inner_point(coords)))
    return F.when(kind == "point", F.get(coords, 0)).when(kind == "polygon", ring).when(kind == "line", line_midpoint(coords))


def centroid(coords: Column) -> Column:
    kind = shape_of(coords)
    return F.when(kind == "point", F.get(coords, 0)).when(kind == "polygon", ring_centroid(coords)).when(kind == "line", line_centroid(coords))


def planar_distance_m(coords: Column, lat: float, lon: float) -> Column:
    """Metres from a centre to the shape in an equirectangular projection around it; 0 inside a polygon."""
    ky = EARTH_M * math.pi / 180
    kx = ky * math.cos(math.radians(lat))
    flat = F.transform(coords, lambda c: F.struct(((c["lon"] - lon) * kx).alias("lon"), ((c["lat"] - lat) * ky).alias("lat")))

    def distance(s: Column) -> Column:
        dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
        n = dx * dx + dy * dy
        t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(s["x1"] * dx + s["y1"] * dy) / F.when(n > 0, n)))).otherwise(0.0)
        x, y = s["x1"] + t * dx, s["y1"] + t * dy
        return F.sqrt(x * x + y * y)

    one = F.get(flat, 0)
    near = F.when(F.size(coords) == 1, F.sqrt(one["lon"] * one["lon"] + one["lat"] * one["lat"])).otherwise(F.array_min(F.transform(_segments(flat), distance)))
    return F.when((shape_of(coords) == "polygon") & ring_holds(coords, F.lit(lon), F.lit(lat)), 0.0).otherwise(near)


def near_shape(coords: Column, lat: float, lon: float, radius_m: int) -> Column:
    """Any vertex within the radius, or the envelope in its window and the shape within the radius."""
    window = Window.around(lat, lon, radius_m)
    vertex = F.exists(coords, lambda c: window.holds(c["lat"], c["lon"]) & (haversine_m(c["lat"], c["lon"], F.lit(lat), F.lit(lon)) <= radius_m))
    return vertex | (window.overlaps(envelope(coords)) & (planar_distance_m(coords, lat, lon) <= radius_m))

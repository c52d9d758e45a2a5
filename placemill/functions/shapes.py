"""Shapes of several parts as columns: a kind (point, line, polygon) and parts (hole, coords), as tiles and relations have them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemill.config import Params
from placemill.functions import geo
from placemill.functions.frames import once, opened
from placemill.operators import filters


def positions(parts: Column) -> Column:
    return F.flatten(F.transform(parts, lambda p: p["coords"]))


def _segments(parts: Column) -> Column:
    """The segments of every part, in one array."""
    return F.flatten(F.transform(parts, lambda p: geo._segments(p["coords"])))


def length(coords: Column) -> Column:
    return geo._total(F.transform(geo._segments(coords), geo._length))


def holds(parts: Column, lon: Column, lat: Column) -> Column:
    """Whether rings hold the point: crossings to the right are odd, over outer rings and holes alike."""

    def crosses(s: Column) -> Column:
        spans = (s["y1"] > lat) != (s["y2"] > lat)
        return F.when(spans & (lon < s["x1"] + (lat - s["y1"]) * (s["x2"] - s["x1"]) / F.when(spans, s["y2"] - s["y1"])), 1).otherwise(0)

    return F.aggregate(F.transform(_segments(parts), crosses), F.lit(0), lambda a, x: a + x) % 2 == 1


def distance_m(kind: Column, parts: Column, lat: float, lon: float) -> Column:
    """Metres from a centre to the nearest part, in an equirectangular projection around it; 0 inside a polygon and outside its holes."""
    ky = geo.EARTH_M * math.pi / 180
    kx = ky * math.cos(math.radians(lat))

    def from_segment(s: Column) -> Column:
        x1, y1 = (s["x1"] - lon) * kx, (s["y1"] - lat) * ky
        dx, dy = (s["x2"] - s["x1"]) * kx, (s["y2"] - s["y1"]) * ky
        n = dx * dx + dy * dy
        t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(x1 * dx + y1 * dy) / F.when(n > 0, n)))).otherwise(0.0)
        return F.sqrt((x1 + t * dx) * (x1 + t * dx) + (y1 + t * dy) * (y1 + t * dy))

    from_point = lambda c: F.sqrt((c["lon"] - lon) * kx * (c["lon"] - lon) * kx + (c["lat"] - lat) * ky * (c["lat"] - lat) * ky)
    edge = F.array_min(F.transform(_segments(parts), from_segment))
    points = F.array_min(F.transform(positions(parts), from_point))
    return F.when((kind == "polygon") & holds(parts, F.lit(lon), F.lit(lat)), 0.0).when(kind == "point", points).otherwise(F.coalesce(edge, points))


def coarse(kind: Column, parts: Column, p: Params) -> Column:
    """A point by itself, several points by any of them, other shapes by their envelope."""
    if not (p.has_radius or p.has_box):
        return F.lit(True)
    window = geo.Window(p.min_lat, p.max_lat, p.min_lon, p.max_lon) if p.has_box else geo.Window.around(p.lat, p.lon, p.radius_m)
    any_ = F.exists(positions(parts), lambda c: filters.spatial_point(c["lat"], c["lon"], p))
    return F.when(kind == "point", any_).otherwise(window.overlaps(geo.envelope(positions(parts))))


def precise(kind: Column, parts: Column, p: Params) -> Column:
    """What passed the coarse test and isn't one point: by its distance for a radius; a box asks for no more than the envelope."""
    if not p.has_radius:
        return F.lit(True)
    return ((kind == "point") & (F.size(parts) == 1)) | (distance_m(kind, parts, p.lat, p.lon) <= p.radius_m)


def centroid(parts: Column) -> Column:
    """Area centroid of polygons: outer rings count, holes count against them, however they turn."""
    origin = F.get(F.get(parts, 0)["coords"], 0)
    zero = F.lit(0.0)

    def of_ring(p: Column) -> Column:
        def add(t: Column, s: Column) -> Column:
            x1, y1, x2, y2 = s["x1"] - origin["lon"], s["y1"] - origin["lat"], s["x2"] - origin["lon"], s["y2"] - origin["lat"]
            cross = x1 * y2 - x2 * y1
            return F.struct((t["twice"] + cross).alias("twice"), (t["x"] + (x1 + x2) * cross).alias("x"), (t["y"] + (y1 + y2) * cross).alias("y"))

        sums = F.aggregate(geo._segments(p["coords"]), F.struct(zero.alias("twice"), zero.alias("x"), zero.alias("y")), add)
        return geo.let(sums, lambda t: geo.let(F.signum(t["twice"]) * F.when(p["hole"], -1.0).otherwise(1.0), lambda sign: F.struct((t["twice"] * sign).alias("twice"), (t["x"] * sign).alias("x"), (t["y"] * sign).alias("y"))))

    all_ = F.aggregate(F.transform(parts, of_ring), F.struct(zero.alias("twice"), zero.alias("x"), zero.alias("y")), lambda t, r: F.struct(*[(t[k] + r[k]).alias(k) for k in ("twice", "x", "y")]))
    return geo.let(all_, lambda t: F.when(F.abs(t["twice"]) > 1e-15, geo._point(origin["lon"] + t["x"] / (3 * t["twice"]), origin["lat"] + t["y"] / (3 * t["twice"]))).otherwise(geo._point(origin["lon"], origin["lat"])))


def inner_point(parts: Column) -> Column:
    """A point in polygons: the middle of the widest stretch within them on the horizontal half way between two vertex heights."""
    heights = F.array_sort(F.array_distinct(F.transform(positions(parts), lambda c: c["lat"])))
    at = F.greatest(F.floor(F.size(heights) / 2).cast("int"), F.lit(1))
    y = (F.get(heights, at - 1) + F.coalesce(F.get(heights, at), F.get(heights, at - 1))) / 2
    return geo.let(y, lambda y: geo._on_height_of(_segments(parts), F.get(positions(parts), 0), y))


def located(df: DataFrame) -> DataFrame:
    """Adds lon and lat, the representative point of kind and parts: of several points the nearest to their mean, half way along the
    longest line, of polygons the centroid if they hold it, else a point that they hold. In steps, as geometry.locate."""
    kind, parts = F.col("kind"), F.col("parts")
    at = positions(parts)
    mean = F.when(kind == "point", F.struct((geo._total(F.transform(at, lambda c: c["lon"])) / F.size(at)).alias("lon"), (geo._total(F.transform(at, lambda c: c["lat"])) / F.size(at)).alias("lat")))
    out = opened(df, mean, "_mx", "_my")
    far = lambda c: (c["lon"] - F.col("_mx")) * (c["lon"] - F.col("_mx")) + (c["lat"] - F.col("_my")) * (c["lat"] - F.col("_my"))
    nearest = F.array_min(F.transform(at, lambda c, i: F.struct(far(c).alias("d"), i.alias("i"), c.alias("c"))))
    lengths = F.transform(parts, lambda p: length(p["coords"]))
    out = opened(out, F.when(kind == "point", nearest["c"]), "_px", "_py")
    out = once(out, _longest=F.when(kind == "line", F.get(parts, (F.array_position(lengths, F.array_max(lengths)) - 1).cast("int"))["coords"]))
    out = opened(out, F.when(kind == "line", geo.line_midpoint(F.col("_longest"))), "_lx", "_ly")
    out = opened(out, F.when(kind == "polygon", centroid(parts)), "_cx", "_cy")
    out = once(out, _in=F.when(kind == "polygon", holds(parts, F.col("_cx"), F.col("_cy"))))
    out = opened(out, F.when(~F.col("_in"), inner_point(parts)), "_ix", "_iy")
    lon, lat = (F.coalesce(F.col("_px" if i == 0 else "_py"), F.col("_lx" if i == 0 else "_ly"), F.col("_ix" if i == 0 else "_iy"), F.col("_cx" if i == 0 else "_cy")) for i in (0, 1))
    own = [c for c in df.columns if c not in ("lon", "lat")]
    return out.select(*own, lon.alias("lon"), lat.alias("lat"))

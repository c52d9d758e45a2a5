"""From nodes, ways and relations to located objects. All lookups are joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placemill.functions import geo
from placemill.functions.frames import once, opened

MODES = ("geopoint", "geopoint-centroid", "geoshape-bbox", "geoshape-simplified", "geoshape-full", "no-geo")
COORDS = T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))


def required_nodes(way_nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct ids of nodes that ways lack coordinates of, or that are members of relations."""
    return way_nodes.filter("lon = 0 and lat = 0").select("ref").union(members.filter("type = 'node'").select("ref")).distinct()


def way_coords(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, coords: a way's points in order, its own coordinates or the node's; unresolved ones are left out, and ways of fewer than two."""
    lacking = way_nodes.filter("lon = 0 and lat = 0").drop("lon", "lat").join(nodes.withColumnRenamed("id", "ref"), "ref")
    both = way_nodes.filter("not (lon = 0 and lat = 0)").unionByName(lacking)
    points = both.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "lon", "lat"))).alias("p"))
    coords = F.transform("p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat")))
    return points.select("id", coords.alias("coords")).filter(F.size("coords") >= 2)


def relation_points(members: DataFrame, nodes: DataFrame, ways: DataFrame | None = None) -> DataFrame:
    """id, lon, lat: the first member that is a node with known coordinates, or (ways: id, lon, lat) a way that carries some of its own."""
    node, way = members.filter("type = 'node'"), members.filter("type = 'way'")
    known = node.join(nodes.select(F.col("id").alias("ref"), "lon", "lat"), "ref").select("id", "at", "lon", "lat")
    if ways is not None:
        known = known.unionByName(way.join(ways.select(F.col("id").alias("ref"), "lon", "lat"), "ref").select("id", "at", "lon", "lat"))
    return known.groupBy("id").agg(F.min(F.struct("at", "lon", "lat")).alias("m")).select("id", "m.lon", "m.lat")


def own_points(way_nodes: DataFrame) -> DataFrame:
    """id, lon, lat: the first of the coordinates that a way carries itself."""
    own = way_nodes.filter("not (lon = 0 and lat = 0)")
    return own.groupBy("id").agg(F.min(F.struct("at", "lon", "lat")).alias("m")).select("id", "m.lon", "m.lat")


def _simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of a line stay (Douglas-Peucker); the first and last always do."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, inner = points[b] - points[a], points[a + 1 : b] - points[a]
        n = float(d @ d)
        t = np.clip(inner @ d / n, 0, 1) if n else np.zeros(len(inner))
        far = np.hypot(*(inner - t[:, None] * d).T)
        i = int(far.argmax())
        if far[i] > tolerance:
            keep[a + 1 + i] = True
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return keep


#: Pairs of segments that are compared at once.
_PAIRS = 1 << 20


def _crosses(points: np.ndarray) -> bool:
    """Whether a ring's edges meet elsewhere than at shared ends.

    A sweep along the axis on which fewer edges overlap: each edge is compared with those that start before it ends, in blocks of bounded size.
    """
    low, high = np.minimum(points[:-1], points[1:]), np.maximum(points[:-1], points[1:])

    def sweep(axis: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(low[:, axis], kind="stable")
        return order, np.searchsorted(low[order, axis], high[order, axis], "right") - np.arange(len(order)) - 1

    order, behind = min((sweep(axis) for axis in (0, 1)), key=lambda s: int(s[1].sum()))
    p, q, low, high = points[:-1][order], points[1:][order], low[order], high[order]
    side = lambda p, q, r: np.sign((q[:, 0] - p[:, 0]) * (r[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (r[:, 0] - p[:, 0]))
    upto = np.cumsum(behind)
    start = 0
    while start < len(behind):
        done = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, done + _PAIRS, "right")))
        own = behind[start:stop]
        for first in range(0, int(own.max(initial=0)), _PAIRS):  # one edge may overlap more than a block
            n = np.clip(own - first, 0, _PAIRS)
            i = np.repeat(np.arange(start, stop), n)
            j = i + 1 + first + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            near = ((low[i] <= high[j]) & (low[j] <= high[i])).all(axis=1)
            i, j = i[near], j[near]
            if ((side(p[i], q[i], p[j]) * side(p[i], q[i], q[j]) < 0) & (side(p[j], q[j], p[i]) * side(p[j], q[j], q[i]) < 0)).any():
                return True
        start = stop
    return False


def simplifier(tolerance: float):
    """An Arrow UDF over coords: fewer points within the tolerance; a ring keeps at least four and doesn't come to cross itself."""

    @F.arrow_udf(COORDS)
    def simplify(shapes: pa.Array) -> pa.Array:
        out = []
        for shape in shapes.to_pylist():
            if shape and len(shape) > 2:
                points = np.array([(c["lon"], c["lat"]) for c in shape])
                ring, now = len(points) >= 4 and (points[0] == points[-1]).all(), tolerance
                if ring:  # a ring starts and ends at one point, so it is cut at the farthest from it
                    far = int(np.hypot(*(points - points[0]).T).argmax())
                for _ in range(20):
                    keep = _simplify(points, now) if not ring else np.append(_simplify(points[: far + 1], now)[:-1], _simplify(points[far:], now))
                    if not ring or (keep.sum() >= 4 and not _crosses(points[keep])):
                        break
                    now /= 2
                else:
                    keep[:] = True
                shape = [c for c, k in zip(shape, keep, strict=True) if k]
            out.append(shape)
        return pa.array(out, pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())])))

    return simplify


def located(coords: Column, mode: str, tolerance: float = 0.0) -> Column:
    """struct<type, lon, lat, coords> by mode, rounded to five places; null for no-geo."""
    if mode not in MODES:
        raise ValueError(f"unknown geometry mode {mode}")
    rounded = lambda cs: F.transform(cs, lambda c: F.struct(geo.round5(c["lon"]).alias("lon"), geo.round5(c["lat"]).alias("lat")))
    none = F.lit(None).cast("double")
    if mode in ("geopoint", "geopoint-centroid"):
        point = geo.representative_point(coords) if mode == "geopoint" else geo.centroid(coords)
        return geo.let(point, lambda p: F.struct(F.lit("point").alias("type"), geo.round5(p["lon"]).alias("lon"), geo.round5(p["lat"]).alias("lat"), F.lit(None).cast(COORDS).alias("coords")))
    if mode == "geoshape-bbox":
        e = geo.envelope(coords)
        corners = F.array(*[F.struct(e[x].alias("lon"), e[y].alias("lat")) for x, y in (("min_lon", "min_lat"), ("max_lon", "min_lat"), ("max_lon", "max_lat"), ("min_lon", "max_lat"), ("min_lon", "min_lat"))])
        return F.struct(F.lit("polygon").alias("type"), none.alias("lon"), none.alias("lat"), rounded(corners).alias("coords"))
    if mode == "no-geo":
        return F.lit(None).cast(T.StructType([T.StructField("type", T.StringType()), T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType()), T.StructField("coords", COORDS)]))
    shape = simplifier(tolerance)(coords) if mode == "geoshape-simplified" else coords
    return F.struct(geo.shape_of(shape).alias("type"), none.alias("lon"), none.alias("lat"), rounded(shape).alias("coords"))


def locate(df: DataFrame, mode: str, tolerance: float = 0.0, rounded: bool = True) -> DataFrame:
    """Adds located() of the column coords as geom, in steps. rounded: points to five places, as they are stored."""
    c = F.col("coords")
    if mode not in ("geopoint", "geopoint-centroid"):
        return once(df, geom=located(c, mode, tolerance))
    ring, line = F.col("_shape") == "polygon", F.col("_shape") == "line"
    at = ("_in_lon", "_in_lat", "_ring_lon", "_ring_lat", "_line_lon", "_line_lat")
    out = once(df, _shape=geo.shape_of(c))
    out = opened(out, F.when(ring, geo.ring_centroid(c)), "_ring_lon", "_ring_lat")
    out = opened(out, F.when(line, geo.line_midpoint(c) if mode == "geopoint" else geo.line_centroid(c)), "_line_lon", "_line_lat")
    if mode == "geopoint":
        out = once(out, _holds=F.when(ring, geo.ring_holds(c, F.col("_ring_lon"), F.col("_ring_lat"))))
        out = opened(out, F.when(ring & ~F.col("_holds"), geo.ring_inner_point(c)), "_in_lon", "_in_lat").drop("_holds")
    else:
        out = out.withColumns({"_in_lon": F.lit(None).cast("double"), "_in_lat": F.lit(None).cast("double")})
    lon, lat = (F.coalesce(*at[i::2], F.get(c, 0)[k]) for i, k in enumerate(("lon", "lat")))
    lon, lat = (geo.round5(lon), geo.round5(lat)) if rounded else (lon, lat)
    geom = F.struct(F.lit("point").alias("type"), lon.alias("lon"), lat.alias("lat"), F.lit(None).cast(COORDS).alias("coords"))
    return out.withColumn("geom", geom).drop("_shape", *at)


def geojson(geom: Column) -> Column:
    """GeoJSON text of what located() gives."""
    pairs = F.transform(geom["coords"], lambda c: F.array(c["lon"], c["lat"]))
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.array(geom["lon"], geom["lat"]).alias("coordinates")))
    line = F.to_json(F.struct(F.lit("LineString").alias("type"), pairs.alias("coordinates")))
    ring = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(pairs).alias("coordinates")))
    alone = F.to_json(F.struct(F.lit("Point").alias("type"), F.get(pairs, 0).alias("coordinates")))
    return F.when(geom["lon"].isNotNull(), point).when(geom["type"] == "line", line).when(geom["type"] == "polygon", ring).when(geom["type"] == "point", alone)

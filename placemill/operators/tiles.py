"""Vector-tile features as tagged objects, and what is known of tiles and archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placemill.functions import geo
from placemill.functions.frames import once
from placemill.operators import names

# Layers that hold points of interest.
LAYERS = ("pois", "poi", "place", "places", "transportation", "water", "landuse", "point", "building", "housenumber", "water_name", "waterway", "aerodrome_label")


def added_tags(props: Column, layer: Column, languages: tuple[str, ...] = ()) -> Column:
    """What a tile feature's tags have beside its properties: the full name, and its class under the key that the layer stands for."""
    get = lambda k: names.tag(props, k)
    has = lambda k: F.map_contains_key(props, F.lit(k))
    kind = F.when(get("class") != "", get("class")).when(get("subclass") != "", get("subclass")).otherwise(get("key"))
    poi, water = layer.isin("pois", "poi", "point"), layer.isin("water", "waterway")
    more = {
        "place": F.when(layer.isin("place", "places"), kind),
        "amenity": F.when(poi & ~has("amenity"), kind).when((layer == "housenumber") & ~has("amenity"), "address"),
        "shop": F.when(poi & ~has("shop"), kind),
        "tourism": F.when(poi & ~has("tourism"), kind),
        "highway": F.when(layer == "transportation", kind),
        "natural": F.when(water & ~has("natural"), "water"),
        "water": F.when(water, kind),
        "aeroway": F.when(layer == "aerodrome_label", "aerodrome"),
        "landuse": F.when(layer == "landuse", kind),
        "building": F.when(layer == "building", "yes"),
    }
    pairs = [F.struct(F.lit(k).alias("k"), F.when(kind != "", v).alias("v")) for k, v in more.items()]
    plain = names.plain_name(props, languages)
    pairs.append(F.struct(F.lit("name").alias("k"), F.nullif(names.full_name(plain, props), F.lit("")).alias("v")))
    pairs.append(F.struct(F.lit("importance").alias("k"), F.when(has("rank") & (get("importance") == ""), get("rank")).alias("v")))
    pairs += [F.struct(F.lit(f"addr:{k}").alias("k"), F.when(has(k), get(k)).alias("v")) for k in ("housenumber", "street", "city", "postcode")]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull()))


def objects(features: DataFrame, languages: tuple[str, ...] = (), layers: tuple[str, ...] = LAYERS) -> DataFrame:
    """Tile features as objects. One without an id gets one from where it was found ("at"), so that no two are taken for one."""
    own = F.coalesce(F.col("fid").cast("string"), F.concat(F.col("layer"), F.lit("-"), F.col("at").cast("string")))
    kept = features.filter(F.col("layer").isin(*layers))
    kept = once(kept, added=added_tags(F.col("props"), F.col("layer"), languages))
    tags = F.map_concat(F.map_filter("props", lambda k, _: ~F.map_contains_key(F.col("added"), k)), F.col("added"))
    shape = [c for c in ("kind", "parts") if c in features.columns]
    return once(kept, tags=tags).select(F.concat(F.lit("pmtiles/"), own).alias("id"), "tags", "lat", "lon", F.array(F.struct("lon", "lat")).alias("coords"), *shape)


def layer_inventory(features: DataFrame) -> DataFrame:
    """layer, n_features, property keys."""
    return features.groupBy("layer").agg(F.count("*").alias("n_features"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("props"))))), ",").alias("keys"))


def tile_range(p_window: geo.Window, zoom: int) -> tuple[int, int, int, int]:
    """Least and largest column and row of the tiles that a window touches."""
    import math

    def xy(lon: float, lat: float) -> tuple[int, int]:
        n, r = 2.0**zoom, math.radians(lat)
        return int((lon + 180) / 360 * n), int((1 - math.log(math.tan(r) + 1 / math.cos(r)) / math.pi) / 2 * n)

    (a, b), (c, d) = xy(p_window.min_lon, p_window.max_lat), xy(p_window.max_lon, p_window.min_lat)
    return min(a, c), min(b, d), max(a, c), max(b, d)


def in_tile_range(features: DataFrame, window: geo.Window, zoom: int) -> DataFrame:
    """Features in the tiles that a window touches; with x and y as columns of the table, its files are pruned by them."""
    x1, y1, x2, y2 = tile_range(window, zoom)
    if {"x", "y"} <= set(features.columns):
        return features.filter(F.col("x").between(x1, x2) & F.col("y").between(y1, y2))
    x, y = geo.tile_xy(F.col("lon"), F.col("lat"), zoom)
    return features.filter(x.between(x1, x2) & y.between(y1, y2))


def at_point(features: DataFrame, lat: float, lon: float, least_zoom: int, most_zoom: int, layer: str = "") -> DataFrame:
    """z, x, y, layer, n_features of the tile at a point in each zoom."""
    zooms = features.sparkSession.range(least_zoom, most_zoom + 1).select(F.col("id").cast("int").alias("z"))
    x, y = geo.tile_xy(F.lit(lon), F.lit(lat), F.col("z"))
    asked = zooms.select("z", x.alias("x"), y.alias("y"))
    fx, fy = geo.tile_xy(F.col("lon"), F.col("lat"), F.col("z"))
    own = features.filter(F.col("layer") == layer) if layer else features
    placed = own.withColumn("z", F.explode(F.sequence(F.lit(least_zoom), F.lit(most_zoom)))) if "z" not in features.columns else own
    placed = placed.withColumns({"x": fx, "y": fy})
    return placed.join(F.broadcast(asked), ["z", "x", "y"]).groupBy("z", "x", "y", "layer").agg(F.count("*").alias("n_features"))


# --- archives ----------------------------------------------------------------------------------------------------


def header(spark: SparkSession, path: str) -> DataFrame:
    """One row with what an archive's header says."""
    from dataclasses import asdict

    from placemill.sources.pmtiles import Archive

    return spark.createDataFrame([asdict(Archive(path).header)])


def shape_summary(kind: Column, parts: Column) -> Column:
    n = F.aggregate(F.transform(parts, lambda p: F.size(p["coords"])), F.lit(0), lambda a, x: a + x)
    return F.format_string("%s of %d parts, %d positions", F.coalesce(kind, F.lit("unknown")), F.size(parts), n)


def inspect(spark: SparkSession, path: str, lat: float, lon: float, zooms: tuple[int, int] | None = None, layer: str = "", most: int = 100) -> DataFrame:
    """z, x, y, layer, fid, shape, props, keys of the features in an archive's tiles at a point; props as JSON, cut behind `most` characters."""
    from placemill.sources.pmtiles import Archive, lookup

    head = Archive(path).header
    low, high = zooms or (head.least_zoom, head.most_zoom)
    if not head.least_zoom <= low <= high <= head.most_zoom:
        raise ValueError(f"zooms {low} to {high} are not within those of the archive, {head.least_zoom} to {head.most_zoom}")
    x, y = geo.tile_xy(F.lit(lon), F.lit(lat), F.col("z"))
    asked = spark.range(low, high + 1).select(F.col("id").cast("int").alias("z")).select("z", x.alias("x"), y.alias("y"))
    rows = lookup(asked, path)
    rows = rows.filter(F.col("layer") == layer) if layer else rows
    text = F.to_json("props")
    short = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
    return rows.select("z", "x", "y", "layer", "fid", shape_summary(F.col("kind"), F.col("parts")).alias("shape"), short.alias("props"), F.array_sort(F.map_keys("props")).alias("keys"))


def list_layers(spark: SparkSession, path: str, lat: float, lon: float, zooms: tuple[int, int] | None = None) -> DataFrame:
    """layer, n_features, and the zooms at which a point's tiles hold it."""
    return inspect(spark, path, lat, lon, zooms).groupBy("layer").agg(F.count("*").alias("n_features"), F.array_sort(F.collect_set("z")).alias("zooms"))

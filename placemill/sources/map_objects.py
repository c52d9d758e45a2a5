"""From a map file to tagged, located objects: nodes as they are, ways by their nodes, relations by their members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placemill.config import Config
from placemill.operators import geometry
from placemill.sources import osm_pbf


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    osm_pbf.register(spark)
    return spark.read.format("osm_pbf").option("kind", kind).load(path)


def objects(nodes: DataFrame, ways: DataFrame, relations: DataFrame, conf: Config = Config()) -> DataFrame:
    """id, entity_type, osm_id, tags, lat, lon, coords of all objects that have tags and a position. nodes_only: ways and relations aren't read.

    Only nodes that ways or relations ask for are kept of the node table before it meets them; tagged objects alone are assembled.
    """
    tagged = F.size("tags") > 0
    whole = lambda df, kind, coords: df.select(F.concat(F.lit(f"{kind}/"), F.col("id").cast("string")).alias("id"), F.lit(kind).alias("entity_type"), F.col("id").alias("osm_id"), "tags", F.get(coords, 0)["lat"].alias("lat"), F.get(coords, 0)["lon"].alias("lon"), coords.alias("coords"))
    at = F.array(F.struct("lon", "lat"))
    points = whole(nodes.filter(tagged), "node", at)
    if conf.nodes_only:
        return points
    each = ways.select("id", "tags", F.posexplode("nodes").alias("at", "n")).select("id", "at", "n.ref", "n.lon", "n.lat")
    own = ways.filter(tagged)
    steps = each.join(own.select("id"), "id", "left_semi")
    members = relations.filter(tagged).select("id", F.posexplode("members").alias("at", "m")).select("id", "at", "m.type", "m.ref")
    places = nodes.select("id", "lon", "lat")
    needed = places.join(geometry.required_nodes(steps, members).withColumnRenamed("ref", "id"), "id", "left_semi")
    lines = own.select("id", "tags").join(geometry.way_coords(steps, needed), "id")
    centres = relations.filter(tagged).select("id", "tags").join(geometry.relation_points(members, needed, geometry.own_points(each)), "id")
    return points.unionByName(whole(lines, "way", F.col("coords"))).unionByName(whole(centres, "relation", at))


def from_file(spark: SparkSession, path: str, conf: Config = Config()) -> DataFrame:
    return objects(*(read(spark, path, kind) for kind in ("node", "way", "relation")), conf)

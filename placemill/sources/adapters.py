"""The driver's tables seen as map objects: integer arithmetic on their keys, the same in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placemill.functions.frames import once

CENTRE = (47.14, 9.52)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latitude(n: Column) -> Column:
    return (F.lit(4700000) + (n * 7919) % 28000).cast("double") / 100000.0


def longitude(n: Column) -> Column:
    return (F.lit(947000) + (n * 104729) % 18000).cast("double") / 100000.0


def poi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One object per document: two words as a name, and a category, place, address and contact by its id."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (i % n + 1).cast("int"))
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    return d.select(
        i.alias("osm_id"),
        pick(3, "node", "way", "relation").alias("entity_type"),
        F.trim(F.concat(F.split_part(first, F.lit(" "), F.lit(1)), F.lit(" "), F.split_part(first, F.lit(" "), F.lit(2)))).alias("name"),
        pick(8, "place", "amenity", "shop", "tourism", "leisure", "highway", "historic", "foo").alias("k"),
        pick(16, "city", "restaurant", "bakery", "museum", "park", "primary", "castle", "bar", "village", "cafe", "bakery", "museum", "park", "primary", "castle", "bar").alias("v"),
        "lang",
        F.col("source").alias("brand"),
        (F.col("n_chars") * 100).cast("string").alias("population"),
        F.concat(F.lit("Q"), (i % 200).cast("string")).alias("wikidata"),
        F.concat(F.lit("Main Street "), (i % 30).cast("string")).alias("street"),
        (i % 200 + 1).cast("string").alias("housenumber"),
        (i % 20 + 9480).cast("string").alias("postcode"),
        F.concat(F.lit("NATION_"), (i % 25).cast("string")).alias("city"),
        pick(2, "LI", "CH").alias("country"),
        F.when(i % 4 == 0, F.concat(F.lit("+423 "), (i % 1000).cast("string"))).otherwise("").alias("phone"),
        F.when(i % 4 == 1, F.concat(F.lit("+41 "), (i % 1000).cast("string"))).otherwise("").alias("contact_phone"),
        pick(3, "yes", "no", "limited").alias("wheelchair"),
        F.when(i % 5 == 0, "24/7").otherwise("Mo-Fr 09:00-17:00").alias("opening_hours"),
        F.coalesce("text", F.lit("")).alias("description"),
        latitude(i).alias("lat"),
        longitude(i).alias("lon"),
    )


_TAGS = {"population": "population", "wikidata": "wikidata", "brand": "brand", "addr:street": "street", "addr:housenumber": "housenumber", "addr:postcode": "postcode", "addr:city": "city", "addr:country": "country", "phone": "phone", "contact:phone": "contact_phone", "wheelchair": "wheelchair", "opening_hours": "opening_hours", "description": "description"}


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, entity_type, osm_id, tags, lang, lat, lon, coords: tagged points, without empty tags."""
    pairs = [x for tag, column in _TAGS.items() for x in (F.lit(tag), F.col(column))]
    tags = F.map_filter(F.create_map(F.lit("name"), F.col("name"), F.col("k"), F.col("v"), *pairs), lambda _, v: v != "")
    at = F.array(F.struct("lon", "lat"))
    return once(poi(spark, sf_dir), tags=tags).select(F.concat_ws("/", "entity_type", F.col("osm_id").cast("string")).alias("id"), "entity_type", "osm_id", "tags", "lang", "lat", "lon", at.alias("coords"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine tenths of the nodes that ways refer to; the rest can't be resolved."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").filter(k % 10 != 0).select(k.alias("id"), longitude(k).alias("lon"), latitude(k).alias("lat"))


def way_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ref and the columns that order a way's nodes. One in seven carries its own coordinates."""
    own = F.col("l_partkey") % 7 == 0
    at = [F.when(own, f(F.col("l_partkey") + 1)).otherwise(0.0) for f in (longitude, latitude)]
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("at"), F.col("l_partkey").alias("ref"), at[0].alias("lon"), at[1].alias("lat"))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and nodes in order."""
    each = F.array_sort(F.collect_list(F.struct("at", "ref", "lon", "lat")))
    return way_nodes(spark, sf_dir).groupBy("id").agg(each.alias("n")).select("id", F.transform("n", lambda x: F.struct(x["ref"].alias("ref"), x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("nodes"))


def relation_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "P", "node").when(F.col("o_orderstatus") == "O", "way").otherwise("relation")
    return o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("at"), kind.alias("type"), (F.col("o_orderkey") % 200 + 1).alias("ref"))


def importance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    language = F.element_at(F.array(*[F.lit(x) for x in ("en", "de", "fr", "es", "it")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return o.select(language.alias("language"), F.when(F.col("o_orderstatus") == "P", "r").otherwise("a").alias("type"), F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("title"), (F.col("o_totalprice") / 1e6).alias("importance"), F.concat(F.lit("Q"), (F.col("o_custkey") % 200).cast("string")).alias("wikidata_id"))


def tile_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z, layer, fid, props, lon, lat."""
    i = F.col("osm_id")
    layer = F.element_at(F.array(*[F.lit(x) for x in ("place", "poi", "transportation", "water", "landmark")]), (i % 5 + 1).cast("int"))
    props = F.create_map(F.lit("class"), F.col("v"), F.lit("name"), F.col("name"), F.lit("rank"), (i % 30).cast("string"), F.lit("housenumber"), F.col("housenumber"))
    return poi(spark, sf_dir).select(F.lit(14).alias("z"), layer.alias("layer"), F.when(i % 10 != 0, i).alias("fid"), i.alias("at"), props.alias("props"), "lon", "lat")


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, query: what users say; every fifth with "near" behind its first word."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    i, near = F.col("conv_id") * 100 + F.col("turn"), F.regexp_replace("text", r"^([^ ]+) ", "$1 near ")
    return c.select(i.alias("qid"), F.when(i % 5 == 0, near).otherwise(F.col("text")).alias("query"))


def multi_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, parts: a customer's orders as one shape, each order's way a line of it."""
    from placemill.operators import geometry

    ways = geometry.way_coords(way_nodes(spark, sf_dir), nodes(spark, sf_dir))
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"))
    part = F.struct("id", F.lit(False).alias("hole"), "coords")
    shape = ways.join(own, "id").groupBy(F.col("cust").alias("id")).agg(F.array_sort(F.collect_list(part)).alias("p"))
    return shape.select("id", F.lit("line").alias("kind"), F.transform("p", lambda p: F.struct(p["hole"].alias("hole"), p["coords"].alias("coords"))).alias("parts"))


def multi_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """osm_id, kind, parts: a square around each place with a square hole, and for two of three a second square east of it."""
    i = F.col("osm_id")

    def square(lon, lat, half):
        xs = (lon - half, lon + half, lon + half, lon - half, lon - half)
        ys = (lat - half, lat - half, lat + half, lat + half, lat - half)
        return F.array(*[F.struct(x.alias("lon"), y.alias("lat")) for x, y in zip(xs, ys, strict=True)])

    lon, lat = F.col("lon"), F.col("lat")
    ring = lambda coords, hole=False: F.struct(F.lit(hole).alias("hole"), coords.alias("coords"))
    outer, hole = ring(square(lon, lat, F.lit(0.01))), ring(F.reverse(square(lon, lat, 0.002 + 0.006 * (i % 2))), True)
    second = ring(square(lon + 0.03 * (i % 3), lat, F.lit(0.01)))
    return poi(spark, sf_dir).select("osm_id", F.lit("polygon").alias("kind"), F.when(i % 3 == 0, F.array(outer, hole)).otherwise(F.array(outer, hole, second)).alias("parts"))

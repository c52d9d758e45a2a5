"""Place-type ontology and importance tables: small lookup tables and what is aggregated from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placemill.functions.text import trim
from placemill.operators.classify import KEYS

# The built-in ontology, as id, level, label, key=value.
BUILT_IN = """
Q6256|0|country|place=country
Q108681067|1|first-level administrative division|boundary=administrative
Q20166006|2|second-level administrative division|boundary=administrative
Q13220611|3|third-level administrative division|boundary=administrative
Q24010666|4|fourth-level administrative division|boundary=administrative
Q13414608|5|fifth-level administrative division|boundary=administrative
Q22927291|6|sixth-level administrative division|boundary=administrative
Q16377063|1|continent|place=continent
Q515|2|city|place=city
Q3957|2|town|place=town
Q532|3|village|place=village
Q486972|3|human settlement|place=hamlet
Q3912148|4|neighbourhood|place=neighbourhood
Q15097374|4|quarter|place=quarter
Q23442|1|planet|natural=planet
Q4421|2|forest|natural=wood
Q8502|2|mountain|natural=peak
Q4022|2|river|waterway=river
Q23397|2|lake|natural=water
Q15324|3|ocean|natural=water
Q3334556|3|beach|natural=beach
Q16673529|3|valley|natural=valley
Q41176|3|building|building=yes
Q44357|3|castle|historic=castle
Q16917|3|hospital|amenity=hospital
Q33506|3|museum|tourism=museum
Q9842|4|primary school|amenity=school
Q131734|3|university|amenity=university
Q16560|3|station|railway=station
Q1248784|3|airport|aeroway=aerodrome
Q130003|3|ski resort|leisure=sports_centre
Q41593339|4|playground|leisure=playground
Q27207358|4|shop|shop=yes
Q11707|3|restaurant|amenity=restaurant
Q30034223|4|cafe|amenity=cafe
Q40231|3|hotel|tourism=hotel
Q17347893|4|park|leisure=park
Q5404044|4|monument|historic=monument
Q133274|3|church|building=cathedral
Q1255653|3|stadium|leisure=stadium
"""
SCHEMA = "qid string, level int, label string, osm_key string, osm_value string"
#: Lookups that are compiled into expressions hold at most so many rows; larger tables are joined.
MAX_LITERAL, MAX_BROADCAST = 5_000, 200_000
#: Titles and features of an id that are paired in one go, about.
SLICE, GROUP = 4_000, 2_000


def built_in_rows() -> list[tuple[str, int, str, str, str]]:
    rows = [line.split("|") for line in BUILT_IN.strip().splitlines()]
    return [(q, int(level), label, *kv.split("=")) for q, level, label, kv in rows]


def built_in(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(built_in_rows(), SCHEMA)


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """From CSV with id, level, label, key, value; lines of fewer fields, comments and levels outside 0 to 6 are dropped."""
    raw = spark.read.csv(path, schema="qid string, level string, label string, osm_key string, osm_value string", comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    level = F.col("level").try_cast("int")
    return raw.filter(F.col("osm_value").isNotNull() & level.between(0, 6)).withColumn("level", level)


def read_importance(spark: SparkSession, path: str) -> DataFrame:
    """From tab-separated text (also gzip): language, type, title, importance, id; comments and ids without Q are dropped."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter((F.trim("value") != "") & ~F.startswith("value", F.lit("#")) & (F.size(f) >= 5))
    rows = rows.select(F.get(f, 0).alias("language"), F.get(f, 1).alias("type"), F.get(f, 2).alias("title"), F.get(f, 3).try_cast("double").alias("importance"), F.trim(F.get(f, 4)).alias("wikidata_id"))
    return rows.filter(F.startswith("wikidata_id", F.lit("Q")) & F.col("importance").isNotNull())


def levels(ontology: DataFrame) -> DataFrame:
    """The least level of each key and value, and the ids that have it."""
    return ontology.groupBy("osm_key", "osm_value").agg(F.min("level").alias("level"), F.array_sort(F.collect_set("qid")).alias("qids"))


def level_map(ontology: DataFrame) -> dict[str, int]:
    rows = levels(ontology).limit(MAX_LITERAL + 1).collect()
    if len(rows) > MAX_LITERAL:
        raise ValueError(f"more than {MAX_LITERAL} key and value pairs: join the ontology instead")
    return {f"{r['osm_key']}={r['osm_value']}": r["level"] for r in rows}


def with_levels(objects: DataFrame, ontology: DataFrame) -> DataFrame:
    """Objects with a column `levels`: the ontology's level by "key=value", for the pairs among their tags alone; null without any.

    The ontology is joined, broadcast while it has at most MAX_BROADCAST pairs; AQE splits the tasks of common pairs else.
    Rows go by id; those that share one share the map, and a row without an id gets none.
    """
    known = levels(ontology).select(F.concat("osm_key", F.lit("="), "osm_value").alias("pair"), "level")
    known = known.groupBy("pair").agg(F.min("level").alias("level"))
    small = known.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    keys = F.array_intersect(F.map_keys("tags"), F.array(*[F.lit(k) for k in KEYS]))
    pairs = objects.select("id", F.explode(F.transform(keys, lambda k: F.concat(k, F.lit("="), F.element_at("tags", k)))).alias("pair"))
    found = pairs.join(F.broadcast(known) if small else known, "pair")
    return objects.join(found.groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("pair", "level"))).alias("levels")), "id", "left")


def label_matches(queries: DataFrame, ontology: DataFrame, column: str = "query") -> DataFrame:
    """Queries with the tags that their text names: by label, or, where no label fits, without a final s.

    The ontology is broadcast while it has at most MAX_BROADCAST rows.
    """
    text = F.lower(trim(F.col(column)))
    small = ontology.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    held = lambda df: F.broadcast(df) if small else df
    labels = ontology.select(F.lower("label").alias("l"), "osm_key", "osm_value")
    asked = queries.withColumn("l", text)
    whole = asked.join(held(labels), "l").withColumn("plural", F.lit(False))
    rest = asked.join(held(labels.select("l").distinct()), "l", "left_anti").filter(F.endswith("l", F.lit("s"))).withColumn("l", F.expr("substring(l, 1, length(l) - 1)"))
    return whole.unionByName(rest.join(held(labels), "l").withColumn("plural", F.lit(True))).drop("l")


def importance_scores(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Largest importance per id, and per id and language."""
    return table.groupBy("wikidata_id").agg(F.max("importance").alias("score")), table.groupBy("wikidata_id", "language").agg(F.max("importance").alias("score"))


def redirects(table: DataFrame) -> DataFrame:
    """Titles of redirects per id, in order; a title occurs as often as the table has it."""
    return table.filter("type = 'r'").groupBy("wikidata_id").agg(F.array_sort(F.collect_list("title")).alias("titles"), F.count("*").alias("n_redirects"))


def _wikidata() -> Column:
    return F.nullif(F.try_element_at("tags", F.lit("wikidata")), F.lit(""))


def _titles(table: DataFrame) -> DataFrame:
    """_qid, _titles: each title once, underscores as spaces."""
    titles = F.array_distinct(F.transform("titles", lambda t: F.translate(t, "_", " ")))
    return redirects(table).select(F.col("wikidata_id").alias("_qid"), titles.alias("_titles"))


def add_redirects(features: DataFrame, table: DataFrame) -> DataFrame:
    """Adds the titles of redirects to a feature's wikidata id to its other names, as redirect:0, redirect:1, ..., underscores as spaces.

    Features without such an id go by their own id, which is nobody's, so that they don't meet in one task.
    """
    own = F.coalesce(_wikidata(), F.concat(F.lit("-"), F.col("id").cast("string")))
    given = _titles(table)
    keys = F.transform("_titles", lambda _, i: F.concat(F.lit("redirect:"), i.cast("string")))
    more = F.when(F.col("_titles").isNull(), F.col("names")).otherwise(F.map_concat("names", F.map_from_arrays(keys, "_titles")))
    return features.withColumn("_qid", own).join(given, "_qid", "left").withColumn("names", more).select(*features.columns)


def redirect_names(features: DataFrame, table: DataFrame, most: int = SLICE, many: int = GROUP) -> DataFrame:
    """osm_id, title: a row for each name that add_redirects gives to a feature, without building the features' maps.

    An id's titles are dealt to slices of about `most` and its features to groups of about `many`, by hashes, and each slice meets each group: the pairs of a
    common id are many tasks' work, and no row holds more than a slice. The pairs are far more than what they come from: the numbers of partitions are explicit,
    as AQE would choose a few by the size of the inputs. Features are dealt by their own ids first, once for the counts and the pairs.
    """
    spark = features.sparkSession
    few = 2 * spark.sparkContext.defaultParallelism
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * few)
    own = features.select("osm_id", _wikidata().alias("_qid")).filter("_qid is not null").repartition(few, "osm_id")
    titles = table.filter("type = 'r' and title is not null").select(F.col("wikidata_id").alias("_qid"), F.translate("title", "_", " ").alias("title"))
    parts = lambda df, count, per, name: df.groupBy("_qid").agg(F.ceil(count / per).cast("int").alias(name))
    # repeated titles fall into one slice, so that they need not be counted; an estimate will do
    sizes = parts(own, F.count("*"), many, "_groups").join(parts(titles, F.approx_count_distinct("title"), most, "_slices"), "_qid")
    part_of = lambda c, of: F.pmod(F.xxhash64(c), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    sliced = titles.join(sizes, "_qid").select("_qid", "_groups", part_of("title", "_slices").alias("_slice"), "title").repartition(n, "_qid", "_slice")
    slices = sliced.groupBy("_qid", "_slice").agg(F.max("_groups").alias("_groups"), F.collect_set("title").alias("_some"))
    slices = slices.select("_qid", "_slice", every("_groups").alias("_group"), "_some").repartition(n, "_qid", "_slice", "_group")
    dealt = own.join(sizes, "_qid").repartition(few, "osm_id").select("osm_id", "_qid", part_of("osm_id", "_groups").alias("_group"), every("_slices").alias("_slice"))
    return dealt.repartition(n, "_qid", "_slice", "_group").join(slices, ["_qid", "_slice", "_group"]).select("osm_id", F.explode("_some").alias("title"))

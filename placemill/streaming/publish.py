"""Building an index in versions, and object streams enriched and filtered as they come."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placemill.config import Config, Params
from placemill.functions.frames import once
from placemill.operators import classify, features, filters, ontology


TYPES = ("node", "way", "relation")


def _count(name: str) -> tuple[Observation, list[Column]]:
    return Observation(name), [F.count("*").alias("all"), *[F.count_if(F.col("entity_type") == t).alias(t) for t in TYPES]]


def _observed(objects: DataFrame, conf: Config, levels: Mapping[str, int] | DataFrame | None) -> tuple[DataFrame, Observation | None, Observation | None]:
    """The features of objects, with counters that the job which writes them fills."""
    if "entity_type" not in objects.columns:
        return features.build(objects, conf, levels), None, None
    (scanned, one), (imported, two) = _count("scanned"), _count("imported")
    return features.build(objects.observe(scanned, *one), conf, levels).observe(imported, *two), scanned, imported


def _write_counts(spark: SparkSession, path: str, scanned: Observation | None, imported: Observation | None) -> None:
    if scanned is not None and imported is not None:
        seen, kept = scanned.get, imported.get
        rows = [(t, seen[t], kept[t], seen[t] - kept[t]) for t in ("all", *TYPES)]
        spark.createDataFrame(rows, "entity_type string, scanned long, imported long, skipped long").coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def publish(objects: DataFrame, root: str, version: str, conf: Config, levels: Mapping[str, int] | DataFrame | None = None, view: str | None = None, importance: DataFrame | None = None, ranked: bool = False) -> str:
    """Write a version of an index to its own folder; readers move to it when the view is replaced, not before.

    importance: a table as of ontology.read_importance, whose scores are added to those of the objects that name its ids, and
    (index_wikidata_redirects) whose titles of redirects are other names of these objects.
    ranked: with lists by impact, for pages of searches by filters alone.
    The numbers of objects scanned, imported and skipped by type are observed in the build's own job and written beside the index (`counts`).
    """
    path, spark = f"{root}/{version}", objects.sparkSession
    built, scanned, imported = _observed(objects, conf, levels)
    if importance is not None and not conf.disable_importance:
        built = classify.add_importance_table(built, *ontology.importance_scores(importance), conf.languages)
    if importance is not None and conf.index_wikidata_redirects:
        built = ontology.add_redirects(built, importance)
    built.write.mode("overwrite").parquet(f"{path}/built")
    _write_counts(spark, path, scanned, imported)
    stored = spark.read.schema(built.schema).parquet(f"{path}/built")
    features.write(stored, features.postings(stored, conf.name_analyzer), path, conf.geometry_mode.startswith("geoshape"), ranked=ranked)
    _remove(spark, f"{path}/built")
    if view:
        spark.read.parquet(f"{path}/features").createOrReplaceTempView(view)
    return path


def update(spark: SparkSession, old: str, new: str, changes: DataFrame, conf: Config, levels: Mapping[str, int] | DataFrame | None = None, ranked: bool = False) -> str:
    """Write the next version of an index from the one before and a batch of changes: objects with a column `deleted`.

    Only changed objects are built and analysed. Features and postings of their ids are left out and the new ones added; the statistics are the old
    ones less what went, plus what came. Of several rows of an id the one with the greatest `seq`, where there is such a column, is its state.
    """
    if "seq" in changes.columns:
        last = W.partitionBy("id").orderBy(F.desc("seq"))
        changes = changes.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "seq")
    changes.write.mode("overwrite").parquet(f"{new}/changes")
    changes = spark.read.schema(changes.schema).parquet(f"{new}/changes")
    ids = changes.select("id").distinct()
    built, scanned, imported = _observed(changes.filter("not deleted").drop("deleted"), conf, levels)
    built.write.mode("overwrite").parquet(f"{new}/built")
    _write_counts(spark, new, scanned, imported)
    came = spark.read.schema(built.schema).parquet(f"{new}/built")
    came_posts = features.postings(came, conf.name_analyzer)
    before = spark.read.schema(came.schema).parquet(f"{old}/features")
    posts = spark.read.schema(came_posts.schema).parquet(f"{old}/postings")
    gone = posts.join(ids, "id", "left_semi")
    # df of terms and number of features by field: what was, less what went, plus what came
    stats = spark.read.schema("field string, term string, df long, n_docs long").parquet(f"{old}/statistics")
    terms = lambda df, sign: df.groupBy("field", "term").agg((F.count("*") * sign).alias("df"))
    docs = lambda df, sign: df.groupBy("field").agg((F.count_distinct("id") * sign).alias("n_docs"))
    df = stats.select("field", "term", "df").unionByName(terms(gone, -1)).unionByName(terms(came_posts, 1)).groupBy("field", "term").agg(F.sum("df").alias("df")).filter("df > 0")
    n_docs = stats.groupBy("field").agg(F.max("n_docs").alias("n_docs")).unionByName(docs(gone, -1)).unionByName(docs(came_posts, 1)).groupBy("field").agg(F.sum("n_docs").alias("n_docs"))
    # one row for each of the fixed fields
    merged = df.join(F.broadcast(n_docs), "field").select("field", "term", "df", "n_docs")
    every = before.join(ids, "id", "left_anti").unionByName(came)
    features.write(every, posts.join(ids, "id", "left_anti").unionByName(came_posts), new, conf.geometry_mode.startswith("geoshape"), merged, ranked)
    for name in ("changes", "built"):
        _remove(spark, f"{new}/{name}")
    return new


def follow(changes: DataFrame, base: str, root: str, checkpoint: str, conf: Config, levels: Mapping[str, int] | DataFrame | None = None, ranked: bool = False):
    """A stream of changes as versions b0, b1, ... of an index, one for each micro-batch. A batch that is run again writes its version again, from the one before."""

    def apply(batch: DataFrame, n: int) -> None:
        update(batch.sparkSession, base if n == 0 else f"{root}/b{n - 1}", f"{root}/b{n}", batch, conf, levels, ranked)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def matching(stream: DataFrame, p: Params, conf: Config, levels: Mapping[str, int] | None = None) -> DataFrame:
    """Objects of a stream (id, tags, lat, lon) that meet a standing query; stateless, so it runs in any output mode that appends."""
    rows = once(stream.filter(filters.spatial_point(F.col("lat"), F.col("lon"), p)), classes=classify.classify(F.col("tags"), conf.importance, levels))
    return rows.filter((F.size("classes") > 0) & filters.direct_fields(F.col("tags"), F.col("classes"), p) & filters.direct_text(F.col("tags"), p))


def latest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/features")

"""Reports: relation statistics, build counters, and what a query log says of repeated queries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from placemill.config import Config
from placemill.operators import features
from placemill.operators.names import tag


def relation_statistics(relations: DataFrame) -> DataFrame:
    """kind (route, boundary, other), n, n_unique, members, mean_members of relations with tags and n_members."""
    t = F.col("tags")
    kind = F.when(tag(t, "route") != "", "route").when(tag(t, "boundary") == "administrative", "boundary").otherwise("other")
    own = (tag(t, "ref") != "") | ((tag(t, "name") != "") & ~F.contains(F.lower(tag(t, "name")), F.lit("stop")))
    return relations.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_if(own).alias("n_unique"), F.sum("n_members").alias("members"), F.round(F.avg("n_members"), 6).alias("mean_members"))


def route_types(relations: DataFrame) -> DataFrame:
    return relations.select(tag(F.col("tags"), "route").alias("route")).filter("route <> ''").groupBy("route").agg(F.count("*").alias("n"))


def log_buckets(log: DataFrame, seconds: int) -> DataFrame:
    """key, bucket, n: queries of a key in each stretch of so many seconds. Counts are made before the shuffle, so a hot key is cheap."""
    bucket = F.floor(F.col("ts").cast("timestamp").cast("double") / seconds)
    return log.groupBy("key", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def build_counts(objects: DataFrame, conf: Config, levels: Mapping[str, int] | None = None) -> DataFrame:
    """entity_type, scanned, imported, skipped: what a build does with the objects of each type."""
    built = features.build(objects, conf, levels).groupBy("entity_type").agg(F.count("*").alias("imported"))
    seen = objects.groupBy("entity_type").agg(F.count("*").alias("scanned"))
    imported = F.coalesce("imported", F.lit(0))
    return seen.join(built, "entity_type", "left").select("entity_type", "scanned", imported.alias("imported"), (F.col("scanned") - imported).alias("skipped"))


def cache_gaps(log: DataFrame, ttl_seconds: int) -> DataFrame:
    """key, n, fresh: queries of a key, and those within the time from the one before. One without a time is fresh to none.

    Stretches as long as the time are summed up before the shuffle: within one, all but the first are fresh, and the first is if it is near the end
    of the stretch before. So a hot key is as many rows as the log has stretches.
    """
    s = F.col("ts").cast("timestamp").cast("double")
    stretch = F.floor(s / ttl_seconds) if ttl_seconds else s
    each = log.groupBy("key", stretch.alias("stretch")).agg(F.count("*").alias("n"), F.min(s).alias("first"), F.max(s).alias("last"))
    near = F.col("first") - F.lag("last").over(W.partitionBy("key").orderBy("stretch")) <= ttl_seconds
    each = each.withColumn("fresh", F.when(F.col("stretch").isNull(), 0).otherwise(F.col("n") - 1 + F.coalesce(near.cast("int"), F.lit(0))))
    return each.groupBy("key").agg(F.sum("n").alias("n"), F.sum("fresh").alias("fresh"))

"""Versions of a feed's objects: re-sends left out, and the object just before each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_deliveries(objects: DataFrame) -> DataFrame:
    """(source_object_id, feed_id, ingested_at) of every object that is no re-send.

    A re-send has feed, content hash and sheet of an earlier object. An object without hash cannot be recognised as one.
    Objects without id, feed or time of ingest have no place in an order and are left out. Repeated rows count once.
    """
    o = objects.select("source_object_id", "feed_id", "ingested_at", "content_hash", "sheet_name").filter("source_object_id IS NOT NULL AND feed_id IS NOT NULL AND ingested_at IS NOT NULL")
    key = F.coalesce("content_hash", F.concat(F.lit("id "), F.col("source_object_id").cast("string")))
    return o.groupBy("feed_id", key.alias("key"), "sheet_name").agg(F.min(F.struct("ingested_at", "source_object_id")).alias("r")).select("r.source_object_id", "feed_id", "r.ingested_at")


def with_previous(deliveries: DataFrame) -> DataFrame:
    """Adds ``prev_object_id``, the object of the same feed just before (ties by id), NULL for the first.

    The lag runs within (feed, day) and over one row per day and feed, so that no task holds all objects of a hot feed.
    """
    d = deliveries.withColumn("day", F.to_date("ingested_at"))
    inner = Window.partitionBy("feed_id", "day").orderBy("ingested_at", "source_object_id")
    outer = Window.partitionBy("feed_id").orderBy("day")
    last = d.groupBy("feed_id", "day").agg(F.max(F.struct("ingested_at", "source_object_id")).alias("r")).select("feed_id", "day", F.lag("r.source_object_id").over(outer).alias("before"))
    return d.withColumn("within", F.lag("source_object_id").over(inner)).join(last, ["feed_id", "day"]).select("source_object_id", "feed_id", "ingested_at", F.coalesce("within", "before").alias("prev_object_id"))

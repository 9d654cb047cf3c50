"""Landed feed documents: one file for each fetch, under a folder for each source, read at once or as they land.

    <folder>/source=<name>/<any>.xml
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stories import honest_time
from . import feeds

SCHEMA = "value string, source string"


def _documents(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("source").alias("source_name"), F.col("value").alias("xml"), F.col("_metadata.file_modification_time").alias("landed_at"), F.col("_metadata.file_path").alias("file"))


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """All landed documents (source_name, xml, landed_at, file).  A file is one row, and never cut."""
    return _documents(spark.read.schema(SCHEMA).option("wholetext", True).text(folder))


def landing(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    """The same as a stream of the files as they land, ``files`` in a micro-batch; its checkpoint knows which were read."""
    reader = spark.readStream.schema(SCHEMA).option("wholetext", True)
    return _documents((reader if files is None else reader.option("maxFilesPerTrigger", files)).text(folder))


def latest(documents: DataFrame) -> DataFrame:
    """Each source's document that landed last, of equals the last by its file's name."""
    last = documents.groupBy("source_name").agg(F.max(F.struct("landed_at", "file")).alias("last")).select("source_name", "last.file")
    return documents.join(last, ["source_name", "file"])


def collected(catalog: DataFrame, documents: DataFrame, as_of: Column) -> DataFrame:
    """The items of all feeds of a catalogue (name, url, type, category), the newest first.

    Only feeds with a web address count, and of each its latest document.  Returns what
    ``feeds.items`` does, and category; equal times go by source and place.
    """
    sources = feeds.collectable(catalog).select(F.col("name").alias("source_name"), "url", "category").dropDuplicates(["source_name"])
    rows = latest(documents).join(sources, "source_name")
    found = feeds.items(rows.select("source_name", "url", "xml"), as_of)
    return found.join(sources.select("source_name", "category"), "source_name").orderBy(F.col("published").desc(), "source_name", "place")


def counts(catalog: DataFrame, items: DataFrame) -> DataFrame:
    """One row: feeds attempted, feeds that gave an item, and the items."""
    tried = feeds.collectable(catalog).agg(F.countDistinct("name").alias("attempted"))
    return tried.join(F.broadcast(items.agg(F.countDistinct("source_name").alias("succeeded"), F.count("*").alias("items"))))


def articles(items: DataFrame, as_of: Column) -> DataFrame:
    """Items as the tick takes them in; an estimated time is no publication time.

    An item's id is a hash of what tells it apart, so it is the same whenever it is read.
    """
    return items.select(
        F.xxhash64("source_name", "title", "link").bitwiseAND(F.lit((1 << 62) - 1)).alias("id"),
        "title",
        "link",
        "source_name",
        F.col("category").alias("source_category"),
        "summary",
        honest_time("published", "estimated").cast("timestamp_ntz").alias("published_at"),
        as_of.cast("timestamp_ntz").alias("first_seen_at"),
    )


def collect_batches(catalog: DataFrame, as_of: Callable[[int], Column], take: Callable[[DataFrame, int], None]):
    """A foreachBatch function over ``landing``: take(items, number) gets the items of each micro-batch's documents.

    as_of gives the time of a batch by its number, so that a batch that runs again has
    the same items.
    """

    def run(batch: DataFrame, number: int) -> None:
        take(collected(catalog, batch, as_of(number)), number)

    return run

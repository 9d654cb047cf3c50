"""Rollups of an ingest batch: links, relations and candidate names."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import tasks_for


def edge_rollup(article_entities: DataFrame) -> DataFrame:
    """Links of entities that meet in an article, smaller id first, with counts and arrivals.

    Articles and then pairs are dealt to tasks whose number grows with the rows.
    """
    tasks = tasks_for(article_entities)
    own = article_entities.select("article_id", "entity_id", "arrival_at").repartition(tasks, "article_id").dropDuplicates(["article_id", "entity_id"])
    a = own.select("article_id", F.col("entity_id").alias("entity_a"), "arrival_at")
    b = own.select("article_id", F.col("entity_id").alias("entity_b"))
    met = a.join(b, "article_id").where("entity_a < entity_b").repartition(tasks, "entity_a", "entity_b")
    return met.groupBy("entity_a", "entity_b").agg(
        F.min("arrival_at").alias("first_seen_at"), F.max("arrival_at").alias("last_seen_at"), F.count("*").alias("article_count")
    )


def relation_rollup(occurrences: DataFrame) -> DataFrame:
    """Typed relations with counts and arrivals; the evidence is the article that arrived last, of ties the later processed.

    seq is the order of processing where there is one, else that of the ids.
    """
    order = "seq" if "seq" in occurrences.columns else "article_id"
    return occurrences.groupBy("source_id", "target_id", "relation").agg(
        F.count("*").alias("article_count"),
        F.min("arrival_at").alias("first_seen_at"),
        F.max("arrival_at").alias("last_seen_at"),
        F.max(F.struct("arrival_at", F.col(order).alias("seq"), "article_id"))["article_id"].alias("evidence_article_id"),
    )


def first_values(rows: DataFrame, key: str, value: str, order: list[str], top: int) -> DataFrame:
    """(key, values): each key's first ``top`` distinct values in the order of their first row.

    A value is brought to its first row before rows of a key meet, and a key keeps no more
    than ``top`` of them, so none is gathered whole.
    """
    first = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(F.struct(*order)).alias("first"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("first", value))
    first = first.withColumn("rank", rank).where(F.col("rank") <= top)
    values = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(value).alias("v")))), lambda x: x["v"])
    return first.groupBy(key).agg(values.alias(value))


#: How many of its sources, titles, contexts and companions a candidate keeps.
KEPT = {"source_names": 10, "sample_titles": 3, "contexts": 3, "co_entities": 5}


def candidates(sightings: DataFrame) -> DataFrame:
    """Candidates by normalised name from sightings: norm, display, type_hint, source_name, title, effective_at, seq and
    optionally role_context and co_entities (an array).

    Sightings are taken in the order of news time, then seq.  The display, with its type,
    is the longest, the earliest of equals; sources, titles, contexts and companions are
    distinct in order, as many as KEPT says.  days holds the distinct UTC days.
    """
    held = sightings
    for name, kind in (("role_context", "string"), ("co_entities", "array<string>"), ("type_hint", "string")):
        held = held if name in held.columns else held.withColumn(name, F.lit(None).cast(kind))
    day = F.to_date("effective_at")
    rows = held.groupBy("norm").agg(
        F.count("*").alias("mention_count"),
        F.array_sort(F.collect_set(day)).alias("days"),
        F.min("effective_at").alias("first_seen_at"),
        F.max("effective_at").alias("last_seen_at"),
        F.min(F.struct((-F.length("display")).alias("l"), "effective_at", "seq", "display", "type_hint")).alias("best"),
    )
    rows = rows.select("norm", "best.display", "best.type_hint", "mention_count", "days", "first_seen_at", "last_seen_at").withColumnRenamed("display", "display_name")
    order = ["effective_at", "seq"]
    with_names = held.select("norm", *order, F.posexplode("co_entities").alias("place", "co"))
    sources = {
        "source_names": first_values(held, "norm", "source_name", order, KEPT["source_names"]).withColumnRenamed("source_name", "source_names"),
        "sample_titles": first_values(held, "norm", "title", order, KEPT["sample_titles"]).withColumnRenamed("title", "sample_titles"),
        "contexts": first_values(held.where("role_context <> ''"), "norm", "role_context", order, KEPT["contexts"]).withColumnRenamed("role_context", "contexts"),
        "co_entities": first_values(with_names, "norm", "co", [*order, "place"], KEPT["co_entities"]).withColumnRenamed("co", "co_entities"),
    }
    for name, found in sources.items():
        rows = rows.join(found, "norm", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return rows


def candidate_rollup(sightings: DataFrame) -> DataFrame:
    """``candidates`` of one batch with the number of their days, sources and titles joined by a bar."""
    joined = [F.array_join(c, "|").alias(c) for c in ("source_names", "sample_titles")]
    return candidates(sightings).select(
        "norm", "mention_count", F.size("days").cast("long").alias("day_count"), "first_seen_at", "last_seen_at", "display_name", *joined
    )


def merged_candidates(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored candidates (with day_count in place of days) after a batch from ``candidates``.

    A stored name keeps its display, type and first time.  Days count if they are later
    than the stored last day; lists grow in order up to what KEPT says.
    """
    s, b = stored.alias("s"), batch.alias("b")
    last_day = F.to_date("s.last_seen_at")
    fresh = F.coalesce(F.size(F.filter("b.days", lambda d: last_day.isNull() | (d > last_day))), F.lit(0))
    empty = F.array().cast("array<string>")
    lists = [
        F.slice(F.array_distinct(F.concat(F.coalesce(f"s.{c}", empty), F.coalesce(f"b.{c}", empty))), 1, n).alias(c) for c, n in KEPT.items()
    ]
    return s.join(b, "norm", "full_outer").select(
        "norm",
        F.coalesce("s.display_name", "b.display_name").alias("display_name"),
        F.when(F.col("s.display_name").isNotNull(), F.col("s.type_hint")).otherwise(F.col("b.type_hint")).alias("type_hint"),
        (F.coalesce("s.mention_count", F.lit(0)) + F.coalesce("b.mention_count", F.lit(0))).alias("mention_count"),
        (F.coalesce("s.day_count", F.lit(0)) + fresh).cast("long").alias("day_count"),
        F.coalesce("s.first_seen_at", "b.first_seen_at").alias("first_seen_at"),
        F.greatest("s.last_seen_at", "b.last_seen_at").alias("last_seen_at"),
        *lists,
    )


def unique_mentions(mentions: DataFrame, order: str = "seq") -> DataFrame:
    """Mentions with one row for each article and entity, the first by ``order``."""
    first = Window.partitionBy("article_id", "entity_id").orderBy(order)
    return mentions.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def last_seen(mentions: DataFrame) -> DataFrame:
    """Last arrival of each entity."""
    return mentions.groupBy("entity_id").agg(F.min("arrival_at").alias("first_seen_at"), F.max("arrival_at").alias("last_seen_at"))

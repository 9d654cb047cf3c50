"""The tables of a newsroom at one time, and what every reader of them needs: who is tracked, known and famous."""
from __future__ import annotations

from dataclasses import dataclass, fields
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..storage import cut
from . import panels, scoring


@dataclass
class Newsroom:
    """Stored tables.  Nothing in them is later than the time that a query is asked for.

    articles: id, title, link, source_name, source_category, published_at, first_seen_at, dup_group_id;
    article_entities: article_id, entity_id; entities: id, canonical_name, type, status, fame,
    aliases, first_seen_at, last_seen_at; hourly: entity_id, bucket, mentions, source_count,
    sentiment_sum; edges: entity_a, entity_b, first_seen_at, last_seen_at, article_count;
    relations: source_id, target_id, relation, article_count, first_seen_at, last_seen_at,
    evidence_article_id; candidates: as rollups.candidates, with day_count; terms: the dictionary.
    """

    articles: DataFrame
    article_entities: DataFrame
    entities: DataFrame
    hourly: DataFrame
    edges: DataFrame
    relations: DataFrame
    candidates: DataFrame
    terms: DataFrame

    @property
    def tracked(self) -> DataFrame:
        return self.entities.where("status = 'tracked'")

    @property
    def heads(self) -> DataFrame:
        """Articles that are no member of a group."""
        return self.articles.where("dup_group_id is null")


class Stored(Newsroom):
    """A newsroom of which each table is written once, when it is first asked for."""

    def __init__(self, room: Newsroom):
        self._room = room

    def __getattr__(self, name: str):
        # only asked for what is not there yet
        if name not in {f.name for f in fields(Newsroom)}:
            raise AttributeError(name)
        setattr(self, name, cut(getattr(self._room, name), name))
        return getattr(self, name)

    @cached_property
    def breadth(self) -> DataFrame:
        """Sources that ever named an entity."""
        return cut(_source_breadth(self), "breadth")


def stored(room: Newsroom) -> Newsroom:
    """The same newsroom with every table that is read written once, as readers come back to each many times."""
    return Stored(room)


def seconds(later: str, earlier: str) -> Column:
    return F.expr(f"(unix_micros(cast({later} as timestamp)) - unix_micros(cast({earlier} as timestamp))) / 1000000.0").cast("double")


def clock(room: Newsroom, as_of: str) -> DataFrame:
    """One row: the system's epoch, the whole days since, and the days that a baseline rests on; nulls without an article."""
    rows = room.articles.agg(F.min("first_seen_at").alias("epoch"))
    rows = rows.withColumn("days", F.floor(seconds(as_of, "epoch") / 86400))
    return rows.withColumn("baseline_days_all", scoring.effective_days("days"))


def rates(room: Newsroom, as_of: str) -> DataFrame:
    """The hourly panel of tracked entities with their daily rate."""
    tracked = room.tracked.select(F.col("id").alias("entity_id"))
    panel = panels.hourly_panel(room.hourly.join(tracked, "entity_id", "left_semi"), as_of)
    return panel.join(F.broadcast(clock(room, as_of))).withColumn("rate", F.col("baseline") / F.col("baseline_days_all"))


def percentile_above(rate: Column, share: float, least: float = 3.0) -> Column:
    """A percentile by linear interpolation, ``least`` at least; null without rows."""
    return F.greatest(F.lit(least), F.percentile(rate, F.lit(share)))


def in_dictionary(names: DataFrame, terms: DataFrame) -> DataFrame:
    """Distinct ids of names (id, name) that are terms of a dictionary, whatever their case."""
    held = terms.select(F.lower("term").alias("key")).distinct()
    return names.select("id", F.lower("name").alias("key")).join(held, "key", "left_semi").select("id").distinct()


def entity_names(entities: DataFrame) -> DataFrame:
    """(id, name) of canonical names and aliases."""
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    return entities.select("id", F.explode(F.concat(F.array("canonical_name"), aliases)).alias("name"))


def source_breadth(room: Newsroom) -> DataFrame:
    """Sources that ever named an entity, members of groups included; of a stored newsroom written once."""
    return room.breadth if isinstance(room, Stored) else _source_breadth(room)


def _source_breadth(room: Newsroom) -> DataFrame:
    rows = room.article_entities.join(room.articles.select(F.col("id").alias("article_id"), "source_name"), "article_id")
    return panels.source_breadth(rows)


def famous(room: Newsroom, rate: DataFrame, threshold: DataFrame) -> DataFrame:
    """(entity_id, famous) of all entities.

    rate: (entity_id, rate); threshold: one row with volume, infinite where nothing is
    mentioned.
    """
    known = in_dictionary(entity_names(room.entities), room.terms).withColumn("known", F.lit(True))
    rows = room.entities.select("id", "fame").join(known, "id", "left")
    rows = rows.join(source_breadth(room).withColumnRenamed("entity_id", "id"), "id", "left")
    rows = rows.join(rate.select(F.col("entity_id").alias("id"), "rate"), "id", "left").join(F.broadcast(threshold))
    return rows.select(F.col("id").alias("entity_id"), scoring.is_famous("fame", "known", "sources", "rate", "volume").alias("famous"))


def volume_threshold(rate: DataFrame) -> DataFrame:
    """One row: the daily rate from which an entity counts as famous."""
    return rate.agg(F.coalesce(percentile_above(F.col("rate"), 0.75), F.lit(float("inf"))).alias("volume"))


def name_index(entities: DataFrame) -> DataFrame:
    """(norm, entity_id): each normalised name's entity, the one with the smallest id, of its names the first."""
    rows = entity_names(entities).select(F.col("id").alias("entity_id"), T.normalize_name("name").alias("norm"))
    return rows.where("norm <> ''").groupBy("norm").agg(F.min("entity_id").alias("entity_id"))


def fixed1(x: Column) -> Column:
    """A number with one decimal, halves going up."""
    tenths = F.floor(x * 10 + 0.5).cast("long")
    return F.concat(F.when(tenths < 0, "-").otherwise(""), F.floor(F.abs(tenths) / 10).cast("string"), F.lit("."), (F.abs(tenths) % 10).cast("string"))


def first_articles(rows: DataFrame, key: list[str], most: int = 5) -> DataFrame:
    """(key, article_ids): the ``most`` smallest article ids of each key, in order."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("article_id"))
    first = rows.select(*key, "article_id").distinct().withColumn("n", rank).where(F.col("n") <= most)
    return first.groupBy(*key).agg(F.array_sort(F.collect_list("article_id")).alias("article_ids"))

"""The brief: what a reader sees first."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import developments, reports, scoring, stories
from . import newsroom as N
from .newsroom import Newsroom


def new_entities(room: Newsroom, as_of: str, hours: int = 48, guard: int = 72, top: int = 5) -> DataFrame:
    """Tracked entities of unknown fame first seen lately in a head article, the latest first, with the sources of their heads."""
    floor = room.tracked.agg(F.min("first_seen_at").alias("floor"))
    fresh = room.tracked.where("fame <> 'famous'").join(F.broadcast(floor))
    fresh = fresh.where(f"first_seen_at >= {as_of} - interval {hours} hours and first_seen_at >= floor + interval {guard} hours")
    heads = room.heads.select(F.col("id").alias("article_id"), "source_name")
    met = room.article_entities.join(heads, "article_id").join(fresh.select(F.col("id").alias("entity_id"), "canonical_name", "first_seen_at"), "entity_id")
    rows = met.groupBy("entity_id", "canonical_name", "first_seen_at").agg(F.countDistinct("source_name").alias("sources"))
    return rows.orderBy(F.col("first_seen_at").desc(), "entity_id").limit(top)


def movers(room: Newsroom, as_of: str, least: int = 3, top: int = 5) -> DataFrame:
    """Tracked entities with the highest lift of today's mentions over their daily rate."""
    names = room.tracked.select(F.col("id").alias("entity_id"), "canonical_name")
    rows = N.rates(room, as_of).where(F.col("observed") >= least).join(names, "entity_id").withColumn("lift", scoring.lift("observed", "rate"))
    return rows.orderBy(F.col("lift").desc(), "entity_id").limit(top)


def brief(room: Newsroom, signals: DataFrame, as_of: str, warmup_days: float = 7, blocks: int = 10) -> DataFrame:
    """Sections of the brief as rows (section, place, name, told, value): signals, new entities, stories, movers, developments.

    signals: open ones; the gravest ``blocks`` are told, of equals by their key.  Movers and
    developments wait until the newsroom is warm.  Every section is cut to a few rows
    before its places are given.
    """
    warm = room.articles.agg(F.min("first_seen_at").alias("epoch")).where(N.seconds(as_of, "epoch") >= warmup_days * 86400).select(F.lit(True).alias("warm"))
    if_warm = lambda rows: rows.join(F.broadcast(warm)).drop("warm")

    def section(name: str, rows: DataFrame, key: str, told: str, value: str, order: list) -> DataFrame:
        place = F.row_number().over(Window.orderBy(*order)).cast("long")
        return rows.select(F.lit(name).alias("section"), F.col(key).cast("string").alias("name"), F.col(told).alias("told"), F.round(F.col(value).cast("double"), 6).alias("value"), place.alias("place"))

    grave = [reports.severity_rank("severity"), F.col("dedupe_key")]
    fresh, told, lifted = new_entities(room, as_of), stories.top_groups(room.articles, as_of), if_warm(movers(room, as_of))
    cards = if_warm(developments.developments(room, as_of))
    return reduce(
        DataFrame.unionByName,
        [
            section("signal", signals.orderBy(*grave).limit(blocks), "dedupe_key", "title", "value", grave),
            section("new entity", fresh, "entity_id", "canonical_name", "sources", [F.col("first_seen_at").desc(), F.col("entity_id")]),
            section("story", told, "head_id", "title", "score", [F.col("score").desc(), F.col("head_id")]),
            section("mover", lifted, "entity_id", "canonical_name", "lift", [F.col("lift").desc(), F.col("entity_id")]),
            section("development", cards, "card", "why", "score", [F.col("score").desc(), F.col("first_observed").desc(), F.col("card")]),
        ],
    )

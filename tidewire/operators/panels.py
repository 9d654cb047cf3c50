"""Panels of mentions: what each entity did today against its own trailing baseline.

``as_of`` is a timestamp literal in SQL, for example "timestamp_ntz'2024-01-26 00:00:00'".
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scoring


def hourly_rollup(mentions: DataFrame) -> DataFrame:
    """Mentions by entity and hour of news time."""
    return mentions.groupBy("entity_id", F.date_trunc("hour", "effective_at").cast("timestamp_ntz").alias("bucket")).agg(
        F.count("*").alias("mentions"), F.countDistinct("source_name").alias("source_count"), F.sum("sentiment").alias("sentiment_sum")
    )


def hourly_panel(hourly: DataFrame, as_of: str) -> DataFrame:
    """For each entity the last 24 hours and the 14 days before them."""
    rows = hourly.where(f"bucket >= {as_of} - interval 15 days and bucket < {as_of}")
    today = f"bucket >= {as_of} - interval 24 hours"
    total = lambda c, when: F.expr(f"coalesce(sum(case when {when} then {c} end), 0)")
    return rows.groupBy("entity_id").agg(
        total("mentions", today).alias("observed"),
        total("sentiment_sum", today).alias("sentiment"),
        total("mentions", f"not ({today})").alias("baseline"),
        total("sentiment_sum", f"not ({today})").alias("baseline_sentiment"),
        F.expr(f"count(distinct case when not ({today}) then date_trunc('day', bucket) end)").alias("baseline_days"),
    )


def epoch(mentions: DataFrame) -> DataFrame:
    """One row: first arrival, last arrival and number of articles."""
    return mentions.agg(F.min("arrival_at").alias("epoch"), F.max("arrival_at").alias("last_arrival"), F.count("*").alias("articles"))


def warmup(mentions: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """One row: whether the system is still too young to judge, and for how many days more."""
    elapsed = F.expr(f"(unix_seconds(cast({as_of} as timestamp)) - unix_seconds(cast(epoch as timestamp))) / 86400.0").cast("double")
    rows = epoch(mentions).withColumn("elapsed", elapsed)
    return rows.select(
        F.coalesce(F.col("elapsed") < days, F.lit(True)).alias("active"),
        F.greatest(F.lit(0.0), F.lit(float(days)) - F.coalesce("elapsed", F.lit(0.0))).alias("remaining_days"),
    )


def movers(hourly: DataFrame, as_of: str, least: int = 3, top: int = 5, days: float = 14.0) -> DataFrame:
    """Entities with the highest lift of today's mentions over their daily rate."""
    panel = hourly_panel(hourly, as_of).where(F.col("observed") >= least)
    rows = panel.select("entity_id", "observed", F.round(F.col("baseline") / days, 6).alias("rate"), F.round(scoring.lift("observed", F.col("baseline") / days), 6).alias("lift"))
    return rows.orderBy(F.col("lift").desc(), "entity_id").limit(top)


def baseline_panel(entities: DataFrame, hourly: DataFrame, as_of: str) -> DataFrame:
    """Every tracked entity with its mentions of 15 days, those without any included."""
    rows = hourly.where(f"bucket >= {as_of} - interval 15 days and bucket < {as_of}")
    sums = rows.groupBy("entity_id").agg(
        F.sum("mentions").alias("total"), F.expr(f"sum(case when bucket < {as_of} - interval 24 hours then mentions else 0 end)").alias("baseline")
    )
    held = entities.where("status = 'tracked'").join(sums, F.col("id") == F.col("entity_id"), "left")
    return held.select(F.col("id").alias("entity_id"), "canonical_name", F.coalesce("baseline", F.lit(0)).alias("baseline"), F.coalesce("total", F.lit(0)).alias("total"))


def thresholds(panel: DataFrame, days: float = 14.0) -> DataFrame:
    """One row: daily rates above which an entity is an anchor (p90) or famous (p75), 3 at least; famous is infinite without entities."""
    rate = F.col("baseline") / days
    return panel.where("total > 0").agg(
        F.round(F.greatest(F.lit(3.0), F.coalesce(F.percentile(rate, F.lit(0.9)), F.lit(3.0))), 6).alias("anchor"),
        F.round(F.coalesce(F.greatest(F.lit(3.0), F.percentile(rate, F.lit(0.75))), F.lit(float("inf"))), 6).alias("famous"),
        F.round(F.percentile(rate, F.lit(0.9)), 6).alias("p90"),
        F.count("*").alias("population"),
    )


def category_baseline(mentions: DataFrame, as_of: str) -> DataFrame:
    """Active days of each entity before today and the mean number of categories on one."""
    rows = mentions.where(f"effective_at >= {as_of} - interval 15 days and effective_at < {as_of} - interval 24 hours")
    by_day = rows.groupBy("entity_id", F.to_date("effective_at").alias("day")).agg(F.countDistinct("category").alias("n"))
    return by_day.groupBy("entity_id").agg(F.count("*").alias("active_days"), F.avg("n").alias("usual"))


def source_breadth(mentions: DataFrame) -> DataFrame:
    """Sources that ever named an entity."""
    return mentions.groupBy("entity_id").agg(F.countDistinct("source_name").alias("sources"))


def entity_stats(entities: DataFrame) -> DataFrame:
    """One row of counts by status, fame and type, also for an empty table."""
    return entities.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "tracked").alias("tracked"),
        F.count_if(F.col("status") == "dismissed").alias("dismissed"),
        F.count_if(F.col("fame") == "famous").alias("famous"),
        F.count_if((F.col("fame") == "famous") & (F.col("status") == "tracked")).alias("famous_tracked"),
        F.count_if(F.col("type").isin("country", "region")).alias("places"),
        F.min(F.when(F.col("status") == "tracked", F.col("id"))).alias("first_tracked"),
        F.max(F.when(F.col("status") == "dismissed", F.col("id"))).alias("last_dismissed"),
    )


def fame_stats(entities: DataFrame) -> DataFrame:
    """One row on tracked entities' fame, also for an empty table: how many are of each, parked, never checked and locked, and the first and last check.

    Parked is one that was looked up without a verdict, which is not the same as never.
    """
    tracked, fame = F.col("status") == "tracked", F.col("fame")
    count = lambda test: F.count_if(tracked & F.coalesce(test, F.lit(False)))
    at = F.when(tracked, F.col("checked_at"))
    return entities.agg(
        F.count_if(tracked).alias("total_tracked"),
        count(fame == "famous").alias("famous"),
        count(fame == "not_famous").alias("not_famous"),
        count(fame == "unknown").alias("unknown"),
        count((fame == "unknown") & F.col("checked_at").isNotNull()).alias("parked"),
        count(F.col("checked_at").isNull()).alias("never_checked"),
        count(F.col("fame_locked")).alias("locked"),
        F.min(at).alias("oldest_checked_at"),
        F.max(at).alias("newest_checked_at"),
    )


def new_entities(mentions: DataFrame, as_of: str, hours: int = 48, top: int = 5) -> DataFrame:
    """Entities first met lately, the latest first, but not those of the first three days of all."""
    firsts = mentions.groupBy("entity_id").agg(F.min("arrival_at").alias("first_seen_at"), F.countDistinct("source_name").alias("sources"))
    floor = mentions.agg(F.min("arrival_at").alias("epoch"))
    rows = firsts.join(F.broadcast(floor)).where(f"first_seen_at >= {as_of} - interval {hours} hours and first_seen_at < {as_of} and first_seen_at >= epoch + interval 72 hours")
    return rows.select("entity_id", "first_seen_at", "sources").orderBy(F.col("first_seen_at").desc(), "entity_id").limit(top)

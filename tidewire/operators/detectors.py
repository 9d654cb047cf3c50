"""Anomaly detectors: each gives signals (type, entity_id, severity, confidence, value)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from . import graph, panels, scoring
from . import newsroom as N
from .newsroom import Newsroom


def _days(mentions: DataFrame, as_of: str) -> DataFrame:
    return panels.epoch(mentions).select(
        F.expr(f"floor((unix_seconds(cast({as_of} as timestamp)) - unix_seconds(cast(epoch as timestamp))) / 86400)").alias("days"), "epoch"
    )


def _signals(rows: DataFrame, kind: str, value: str) -> DataFrame:
    return rows.where("hit is not null").select(
        F.lit(kind).alias("type"),
        "entity_id",
        F.col("hit.severity").alias("severity"),
        F.round("hit.confidence", 6).alias("confidence"),
        F.round(F.col(value).cast("double"), 6).alias("value"),
    )


def surges(mentions: DataFrame, as_of: str, k: float = 3.0) -> DataFrame:
    """Entities mentioned far more today than their daily rate lets expect."""
    panel = panels.hourly_panel(panels.hourly_rollup(mentions), as_of).join(F.broadcast(_days(mentions, as_of)))
    rate = F.col("baseline") / scoring.effective_days("days")
    return _signals(panel.withColumn("hit", scoring.surge("observed", rate, "baseline_days", "days", k)), "surge", "hit.z")


def sentiment_shifts(mentions: DataFrame, as_of: str) -> DataFrame:
    """Entities whose mean sentiment fell.  None at all if no mention of the day has a sentiment."""
    panel = panels.hourly_panel(panels.hourly_rollup(mentions), as_of)
    alive = panel.agg(F.coalesce(F.bool_or(F.col("sentiment") != 0), F.lit(False)).alias("alive"))
    mean = lambda s, n: F.when(F.col(n) > 0, F.col(s) / F.col(n))
    hit = scoring.sentiment_shift(mean("sentiment", "observed"), "observed", mean("baseline_sentiment", "baseline"), "baseline", "baseline_days")
    return _signals(panel.join(F.broadcast(alive)).where("alive").withColumn("hit", hit), "sentiment", "hit.delta")


def category_spreads(mentions: DataFrame, as_of: str) -> DataFrame:
    """Entities met today in more categories than on their usual day."""
    today = mentions.where(f"effective_at >= {as_of} - interval 24 hours and effective_at < {as_of}").groupBy("entity_id").agg(F.countDistinct("category").alias("n"))
    rows = today.join(panels.category_baseline(mentions, as_of), "entity_id")
    return _signals(rows.withColumn("hit", scoring.category_spread("n", "usual", "active_days")), "cross_category", "hit.excess")


def first_seen(mentions: DataFrame, as_of: str) -> DataFrame:
    """Entities first met within 48 hours by two sources or more."""
    rows = panels.new_entities(mentions, as_of, top=2**31 - 1)
    return _signals(rows.withColumn("hit", scoring.counted("sources", 2, 8)), "first_seen", "sources")


def novel_edges(edges: DataFrame, entities: DataFrame, as_of: str, hours: int = 48) -> DataFrame:
    """Links of tracked entities first met lately in two articles or more, unless both ends are famous."""
    tracked = entities.where("status = 'tracked'").select("id", "fame")
    a, b = tracked.select(F.col("id").alias("entity_a"), F.col("fame").alias("fame_a")), tracked.select(F.col("id").alias("entity_b"), F.col("fame").alias("fame_b"))
    both = edges.join(a, "entity_a").join(b, "entity_b")
    floor = both.agg(F.min("first_seen_at").alias("floor"))
    fresh = both.join(F.broadcast(floor)).where(
        f"first_seen_at >= {as_of} - interval {hours} hours and first_seen_at < {as_of} and first_seen_at >= floor + interval 72 hours and not (fame_a = 'famous' and fame_b = 'famous')"
    )
    hit = scoring.counted("article_count", 2, 6)
    return fresh.withColumn("hit", hit).where("hit is not null").select(
        "entity_a", "entity_b", "article_count", F.col("hit.severity").alias("severity"), F.round("hit.confidence", 6).alias("confidence")
    )


def without_famous(signals: DataFrame, entities: DataFrame) -> DataFrame:
    """Signals whose subject is not known as famous."""
    famous = entities.where("fame = 'famous'").select(F.col("id").alias("entity_id"))
    return signals.join(famous, "entity_id", "left_anti")


# ------------------------------------------------------------------ over a newsroom

MOMENT_TYPES = ("surge", "first_seen", "cross_category", "sentiment")


def _told(rows: DataFrame, kind: str, value: str, title: F.Column, evidence: list) -> DataFrame:
    """Rows with hit, entity_ids and article_ids as signals."""
    ids = F.coalesce("article_ids", F.array().cast("array<long>"))
    key = F.concat(F.lit(f"{kind}:"), F.array_join(F.transform("entity_ids", lambda i: i.cast("string")), ":"))
    return rows.where("hit is not null").select(
        key.alias("dedupe_key"),
        F.lit(kind).alias("type"),
        F.col("hit.severity").alias("severity"),
        F.round("hit.confidence", 6).alias("confidence"),
        F.round(F.col(value).cast("double"), 6).alias("value"),
        title.alias("title"),
        "entity_ids",
        ids.alias("article_ids"),
        F.to_json(F.struct(*evidence, ids.alias("articleIds"))).alias("evidence"),
    )


def _today(room: Newsroom, as_of: str) -> DataFrame:
    """Tracked entities' head articles of the last 24 hours of news: (entity_id, article_id, source_category)."""
    at = F.coalesce("published_at", "first_seen_at")
    heads = room.heads.where(at >= F.expr(f"{as_of} - interval 24 hours")).select(F.col("id").alias("article_id"), "source_category")
    tracked = room.tracked.select(F.col("id").alias("entity_id"))
    return room.article_entities.join(heads, "article_id").join(tracked, "entity_id", "left_semi")


def _named(room: Newsroom) -> DataFrame:
    return room.tracked.select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("name"))


def surge_and_tone(room: Newsroom, as_of: str, k: float) -> tuple[DataFrame, DataFrame]:
    """Signals of entities mentioned far more than usual, and of those whose tone fell."""
    articles = N.first_articles(_today(room, as_of), ["entity_id"])
    panel = N.rates(room, as_of).join(_named(room), "entity_id").join(articles, "entity_id", "left").withColumn("entity_ids", F.array("entity_id"))
    hit = scoring.surge("observed", "rate", "baseline_days", "days", k)
    title = F.concat(F.lit("Surge: "), F.col("name"), F.lit(" (+"), F.col("observed").cast("string"), F.lit(" mentions/24h, "), N.fixed1(F.col("hit.z")), F.lit("σ)"))
    evidence = [F.col("observed").alias("observed24h"), F.col("rate").alias("baselineDaily"), F.col("hit.z").alias("z"), F.lit(float(k)).alias("k")]
    surge = _told(panel.withColumn("hit", hit), "surge", "hit.z", title, evidence)
    alive = panel.agg(F.coalesce(F.bool_or(F.col("sentiment") != 0), F.lit(False)).alias("alive"))
    now, before = F.col("sentiment") / F.col("observed"), F.when(F.col("baseline") > 0, F.col("baseline_sentiment") / F.col("baseline")).otherwise(0.0)
    rows = panel.where("observed > 0").withColumns({"tone_now": now, "tone_before": before}).join(F.broadcast(alive)).where("alive")
    hit = scoring.sentiment_shift("tone_now", "observed", "tone_before", "baseline", "baseline_days")
    evidence = [F.col("tone_now").alias("avg24h"), F.col("tone_before").alias("baselineAvg"), F.col("hit.delta").alias("delta"), F.col("observed").alias("mentions24h")]
    tone = _told(rows.withColumn("hit", hit), "sentiment", "hit.delta", F.concat(F.lit("Tone shift: "), F.col("name")), evidence)
    return surge, tone


def spread(room: Newsroom, as_of: str) -> DataFrame:
    """Signals of entities met today in more categories than on their usual active day."""
    today = _today(room, as_of)
    counts = today.groupBy("entity_id").agg(F.countDistinct("source_category").alias("n"))
    heads = room.heads.select(F.col("id").alias("article_id"), F.coalesce("published_at", "first_seen_at").alias("effective_at"), F.col("source_category").alias("category"))
    usual = panels.category_baseline(room.article_entities.join(heads, "article_id"), as_of)
    rows = counts.join(usual, "entity_id").join(_named(room), "entity_id").join(N.first_articles(today, ["entity_id"]), "entity_id", "left")
    rows = rows.withColumns({"entity_ids": F.array("entity_id"), "hit": scoring.category_spread("n", "usual", "active_days")})
    title = F.concat(F.lit("Category spread: "), F.col("name"), F.lit(" ("), F.col("n").cast("string"), F.lit(" categories, usually ~"), N.fixed1(F.col("usual")), F.lit(")"))
    evidence = [F.col("n").alias("categoryCount24h"), F.col("usual").alias("baselineAvgCategories"), F.col("hit.excess").alias("excess")]
    return _told(rows, "cross_category", "hit.excess", title, evidence)


def newly_seen(room: Newsroom, as_of: str, hours: int = 48, guard: int = 72) -> DataFrame:
    """Signals of tracked entities first seen lately in the heads of two sources or more, but not in the first days of all."""
    tracked = room.tracked
    floor = tracked.agg(F.min("first_seen_at").alias("floor"))
    fresh = tracked.join(F.broadcast(floor)).where(f"first_seen_at >= {as_of} - interval {hours} hours and first_seen_at >= floor + interval {guard} hours")
    fresh = fresh.select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("name"))
    heads = room.heads.select(F.col("id").alias("article_id"), "source_name")
    met = room.article_entities.join(fresh, "entity_id", "left_semi").join(heads, "article_id")
    rows = met.groupBy("entity_id").agg(F.countDistinct("source_name").alias("sources"))
    rows = rows.join(fresh, "entity_id").join(N.first_articles(met, ["entity_id"]), "entity_id")
    rows = rows.withColumns({"entity_ids": F.array("entity_id"), "hit": scoring.counted("sources", 2, 8)})
    title = F.concat(F.lit("New: "), F.col("name"), F.lit(" ("), F.col("sources").cast("string"), F.lit(" sources)"))
    return _told(rows, "first_seen", "sources", title, [F.col("sources").alias("sourceCount")])


def new_links(room: Newsroom, as_of: str, known: DataFrame, hours: int = 48, guard: int = 72) -> DataFrame:
    """Signals of links of tracked entities first seen lately, unless both ends are famous."""
    end = lambda x: room.tracked.select(F.col("id").alias(f"entity_{x}"), F.col("canonical_name").alias(f"name_{x}"))
    both = room.edges.join(end("a"), "entity_a").join(end("b"), "entity_b")
    floor = both.agg(F.min("first_seen_at").alias("floor"))
    fresh = both.join(F.broadcast(floor)).where(
        f"first_seen_at >= {as_of} - interval {hours} hours and first_seen_at >= floor + interval {guard} hours and article_count >= 2"
    )
    fame = lambda x: known.select(F.col("entity_id").alias(f"entity_{x}"), F.col("famous").alias(f"famous_{x}"))
    fresh = fresh.join(fame("a"), "entity_a", "left").join(fame("b"), "entity_b", "left").where("not (coalesce(famous_a, false) and coalesce(famous_b, false))")
    heads = room.heads.select(F.col("id").alias("article_id"))
    met = graph.pair_articles(room.article_entities, fresh, heads)
    rows = fresh.join(N.first_articles(met, ["entity_a", "entity_b"]), ["entity_a", "entity_b"], "left")
    rows = rows.withColumns({"entity_ids": F.array("entity_a", "entity_b"), "hit": scoring.counted("article_count", 2, 6)})
    title = F.concat(F.lit("Emerging link: "), F.col("name_a"), F.lit(" + "), F.col("name_b"))
    return _told(rows, "novel_edge", "article_count", title, [F.col("article_count").alias("articleCount")])


def fame(room: Newsroom, as_of: str) -> DataFrame:
    """(entity_id, famous) as the detectors and the store of signals see it."""
    rate = N.rates(room, as_of)
    return N.famous(room, rate, N.volume_threshold(rate))


def run(room: Newsroom, as_of: str, k: float = 3.0, warmup_days: float = 7) -> DataFrame:
    """All signals of a newsroom; none while it warms up.

    Signals of one entity are dropped if it is famous, links if both ends are.  Returns
    dedupe_key, type, severity, confidence, value, title, entity_ids, article_ids (five at
    most, the smallest) and evidence (JSON).
    """
    known = cut(fame(room, as_of), "fame")
    surge, tone = surge_and_tone(room, as_of, k)
    single = reduce(DataFrame.unionByName, [surge, newly_seen(room, as_of), spread(room, as_of), tone])
    stars = known.where("famous").select("entity_id")
    single = single.withColumn("entity_id", F.col("entity_ids")[0]).join(stars, "entity_id", "left_anti").drop("entity_id")
    warm = room.articles.agg(F.min("first_seen_at").alias("epoch")).where(N.seconds(as_of, "epoch") >= warmup_days * 86400).select(F.lit(True).alias("warm"))
    return single.unionByName(new_links(room, as_of, known)).join(F.broadcast(warm)).drop("warm")

"""Development cards: little-known subjects that lately turned up beside well-known ones."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..storage import cut
from . import graph, panels, scoring
from . import newsroom as N
from .newsroom import Newsroom

WINDOW_DAYS, GUARD_HOURS = 14, 72


def corroborated(candidates: DataFrame) -> DataFrame:
    """Candidates seen on two days in two sources, or in three sources."""
    names = F.col("source_names")
    sources = F.size(names) if dict(candidates.dtypes)["source_names"].startswith("array") else F.size(F.split(names, "\\|"))
    return candidates.where(((F.col("day_count") >= 2) & (sources >= 2)) | (sources >= 3))


def roster(room: Newsroom, as_of: str) -> DataFrame:
    """Tracked entities: entity_id, name, type, rate, whether they are an anchor, famous and a satellite, and the two thresholds.

    An anchor is a place, or mentioned as often as the top tenth of those mentioned in 15
    days; a satellite is neither famous nor an anchor.
    """
    panel = panels.baseline_panel(room.entities, room.hourly, as_of).join(F.broadcast(N.clock(room, as_of)))
    panel = panel.withColumn("rate", F.col("baseline") / F.col("baseline_days_all"))
    bars = panel.where("total > 0").agg(
        F.coalesce(N.percentile_above(F.col("rate"), 0.9), F.lit(3.0)).alias("bar"), F.coalesce(N.percentile_above(F.col("rate"), 0.75), F.lit(float("inf"))).alias("volume")
    )
    known = N.famous(room, panel, bars.select("volume"))
    rows = panel.join(room.entities.select(F.col("id").alias("entity_id"), "type"), "entity_id").join(known, "entity_id").join(F.broadcast(bars))
    anchor = is_anchor(F.col("type"), F.col("rate"), F.col("bar"))
    return rows.select("entity_id", F.col("canonical_name").alias("name"), "type", "rate", anchor.alias("anchor"), "famous", (~anchor & ~F.col("famous")).alias("satellite"), "bar")


def is_anchor(kind: Column, rate: Column, bar: Column) -> Column:
    return F.coalesce(kind.isin("country", "region"), F.lit(False)) | (rate >= bar)


def _top_anchors(pairs: DataFrame, known: DataFrame, most: int = 3) -> DataFrame:
    """(card, anchors): of pairs (card, entity_id) the anchors with the highest rates, equal ones by name in the order of letters, whatever their case."""
    rows = pairs.distinct().join(known.where("anchor").select("entity_id", "name", "rate"), "entity_id")
    rank = F.row_number().over(Window.partitionBy("card").orderBy(F.col("rate").desc(), F.collate("name", "UNICODE"), "entity_id"))
    rows = rows.withColumn("n", rank).where(F.col("n") <= most)
    return rows.groupBy("card").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]).alias("anchors"))


def _drafts(rows: DataFrame, kind: str, label: str, reason: Column, relation: Column | None = None, days: Column | None = None) -> DataFrame:
    return rows.select(
        "card",
        F.lit(kind).alias("kind"),
        F.col("name").alias("subject"),
        F.col("type").alias("subject_type"),
        F.col("rate").cast("double").alias("rate"),
        F.col("famous"),
        "anchors",
        reason.alias("reason"),
        F.lit(label).alias("label"),
        "first_observed",
        "last_observed",
        (F.lit(None).cast("string") if relation is None else relation).alias("relation"),
        (F.lit(None).cast("long") if days is None else days.cast("long")).alias("own_days"),
        *[c for c in ("entity_a", "entity_b", "evidence_article_id") if c in rows.columns],
    )


#: Columns of an article in the evidence of a card.
TOLD = ["article_id", "source_name", "published_at", "first_seen_at"]


def _heads(room: Newsroom) -> DataFrame:
    return room.heads.withColumnRenamed("id", "article_id").select(TOLD)


def _ends(links: DataFrame, known: DataFrame, a: str, b: str, of: str) -> DataFrame:
    """Links whose ends differ in ``of``, with the subject (the satellite, or who is no anchor) and the other end's name."""
    side = lambda x, end: known.select(F.col("entity_id").alias(x), *[F.col(c).alias(f"{c}_{end}") for c in ("name", "type", "rate", "anchor", "famous", "satellite")])
    rows = links.join(side(a, "a"), a).join(side(b, "b"), b).where(f"{of}_a <> {of}_b")
    subject = F.col("satellite_a") if of == "satellite" else F.col("anchor_b")
    pick = lambda c: F.when(subject, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b"))
    other = F.when(subject, F.col("name_b")).otherwise(F.col("name_a"))
    return rows.withColumns({"name": pick("name"), "type": pick("type"), "rate": pick("rate"), "famous": pick("famous"), "anchors": F.array(other)})


def relation_cards(room: Newsroom, known: DataFrame, as_of: str) -> DataFrame:
    """R: stated relations of exactly one satellite, first seen lately but not in the first days, with their ends and stored evidence."""
    tracked = known.select("entity_id")
    both = room.relations.join(tracked.withColumnRenamed("entity_id", "source_id"), "source_id", "left_semi").join(tracked.withColumnRenamed("entity_id", "target_id"), "target_id", "left_semi")
    floor = both.agg(F.min("first_seen_at").alias("floor"))
    fresh = both.join(F.broadcast(floor)).where(f"first_seen_at >= {as_of} - interval {WINDOW_DAYS} days and first_seen_at >= floor + interval {GUARD_HOURS} hours")
    rows = _ends(fresh, known, "source_id", "target_id", "satellite")
    rows = rows.withColumn("card", F.concat_ws(":", F.lit("R"), "source_id", "target_id", "relation"))
    rows = rows.withColumns({"first_observed": F.col("first_seen_at"), "last_observed": F.col("last_seen_at"), "entity_a": F.least("source_id", "target_id"), "entity_b": F.greatest("source_id", "target_id")})
    return _drafts(rows, "R", "observed", F.concat("relation", F.lit(" (stated relation)")), F.col("relation"))


def newcomer_cards(room: Newsroom, known: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """N: tracked entities first seen lately beside an anchor, but neither an anchor nor at once in six sources or more."""
    tracked = room.tracked.select(F.col("id").alias("entity_id"), "first_seen_at", "last_seen_at")
    floor = tracked.agg(F.min("first_seen_at").alias("floor"))
    fresh = tracked.join(F.broadcast(floor)).where(f"first_seen_at >= {as_of} - interval {WINDOW_DAYS} days and first_seen_at >= floor + interval {GUARD_HOURS} hours")
    rows = fresh.join(known, "entity_id").where("not anchor").withColumn("card", F.concat_ws(":", F.lit("N"), "entity_id"))
    met = room.article_entities.join(rows.select("entity_id", "card", F.col("first_seen_at").alias("since")), "entity_id")
    met = cut(met.join(_heads(room), "article_id"), "met")
    at_once = F.when(F.col("first_seen_at") <= F.col("since") + F.expr("interval 48 hours"), F.col("source_name"))
    slow = met.groupBy("card").agg(F.countDistinct(at_once).alias("n")).where("n < 6").select("card")
    met = met.join(slow, "card", "left_semi").select("card", "entity_id", *TOLD)
    others = room.article_entities.select("article_id", F.col("entity_id").alias("other_id"))
    beside = met.join(others, "article_id").where("other_id <> entity_id").select("card", F.col("other_id").alias("entity_id"))
    rows = rows.join(_top_anchors(beside, known), "card")
    rows = rows.withColumns({"first_observed": F.col("first_seen_at"), "last_observed": F.coalesce("last_seen_at", "first_seen_at")})
    return _drafts(rows, "N", "observed", F.concat(F.lit("first observed around "), F.col("anchors")[0])), met.select("card", *TOLD).distinct()


def candidate_cards(room: Newsroom, known: DataFrame, as_of: str, fanout: int = 30) -> tuple[DataFrame, DataFrame]:
    """C: corroborated candidates with an anchor among their companions, the ``fanout`` latest; evidence by exact titles.

    A sample title that leads to several groups of articles says nothing and is left out.
    What is broadcast are the titles of ``fanout`` candidates and as many articles at most.
    """
    rows = corroborated(room.candidates.where(f"last_seen_at >= {as_of} - interval {WINDOW_DAYS} days")).withColumn("card", F.concat_ws(":", F.lit("C"), "norm"))
    companions = rows.select("card", F.explode("co_entities").alias("name")).select("card", T.normalize_name("name").alias("norm"))
    rows = rows.join(_top_anchors(companions.join(N.name_index(room.tracked), "norm").select("card", "entity_id"), known), "card")
    rows = cut(rows.orderBy(F.col("last_seen_at").desc(), "norm").limit(fanout), "latest")
    asked = rows.select("card", F.explode("sample_titles").alias("title"), "source_names", "first_seen_at", "last_seen_at")
    articles = room.articles.select("title", "source_name", F.coalesce("published_at", "first_seen_at").alias("at"), F.coalesce("dup_group_id", "id").alias("article_id"))
    met = articles.join(F.broadcast(asked), "title").where(
        "array_contains(source_names, source_name) and at between first_seen_at - interval 2 days and last_seen_at + interval 2 days"
    )
    clear = met.groupBy("card", "title").agg(F.min("article_id").alias("article_id"), F.max("article_id").alias("last")).where("article_id = last")
    evidence = cut(_heads(room).join(F.broadcast(clear.select("card", "article_id").distinct()), "article_id").select("card", *TOLD), "titles")
    seen = evidence.groupBy("card").agg(F.min("first_seen_at").alias("first_observed"), F.max("first_seen_at").alias("last_observed"))
    names = rows.select(F.col("card").alias("id"), F.explode(F.array("display_name", "norm")).alias("name"))
    famous = N.in_dictionary(names, room.terms).select(F.col("id").alias("card"), F.lit(True).alias("famous"))
    rows = rows.join(seen, "card").join(famous, "card", "left").withColumn("famous", F.coalesce("famous", F.lit(False)))
    rows = rows.withColumns({"name": F.col("display_name"), "type": F.col("type_hint"), "rate": F.lit(None).cast("double")})
    context = F.when(F.size("contexts") > 0, F.expr("contexts[0]")) if "contexts" in rows.columns else F.lit(None).cast("string")
    return _drafts(rows, "C", "observed", F.coalesce(context, F.concat(F.lit("recurring alongside "), F.col("anchors")[0])), days=F.col("day_count")), evidence


def link_cards(room: Newsroom, known: DataFrame, as_of: str) -> DataFrame:
    """E: links in two articles or more, first seen lately but not in the first days, of exactly one anchor, with their ends."""
    tracked = known.select("entity_id")
    both = room.edges.join(tracked.withColumnRenamed("entity_id", "entity_a"), "entity_a", "left_semi").join(tracked.withColumnRenamed("entity_id", "entity_b"), "entity_b", "left_semi")
    floor = both.agg(F.min("first_seen_at").alias("floor"))
    fresh = both.join(F.broadcast(floor)).where(
        f"first_seen_at >= {as_of} - interval {WINDOW_DAYS} days and first_seen_at >= floor + interval {GUARD_HOURS} hours and article_count >= 2"
    )
    rows = _ends(fresh, known, "entity_a", "entity_b", "anchor").withColumn("card", F.concat_ws(":", F.lit("E"), "entity_a", "entity_b"))
    rows = rows.withColumns({"first_observed": F.col("first_seen_at"), "last_observed": F.col("last_seen_at")})
    return _drafts(rows, "E", "pattern", F.concat(F.lit("recurring co-coverage with "), F.col("anchors")[0]))


def pair_evidence(room: Newsroom, drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drafts of relations and links with the key of their evidence (backing), and that evidence: (backing, TOLD).

    The heads that name both ends are looked up once for a pair, and all cards of the pair share
    them.  A relation whose stored evidence is another head has its own list: the pair's and that one.
    """
    ends = ["entity_a", "entity_b"]
    met = cut(graph.pair_articles(room.article_entities, drafts.select(ends), _heads(room)), "met")
    stored = drafts.select("card", *ends, F.col("evidence_article_id").alias("article_id")).where("article_id is not null")
    apart = stored.join(met, [*ends, "article_id"], "left_anti").join(_heads(room), "article_id")
    apart = cut(apart.select("card", *ends, *TOLD), "apart")
    own = apart.select("card", *TOLD).unionByName(met.join(apart.select("card", *ends), ends).select("card", *TOLD))
    pair = F.concat_ws(":", F.lit("P"), *ends)
    alone = apart.select("card", F.lit(True).alias("alone"))
    keyed = drafts.join(alone, "card", "left").withColumn("backing", F.when(F.col("alone"), F.col("card")).otherwise(pair))
    return keyed.drop("alone", "evidence_article_id", *ends), met.select(pair.alias("backing"), *TOLD).unionByName(own.withColumnRenamed("card", "backing"))


def link_clause(kind: Column, relation: Column, anchor: Column) -> Column:
    return (
        F.when((kind == "R") & relation.isNotNull(), F.concat(F.lit("linked to "), anchor, F.lit(" by a stated "), relation, F.lit(" relation")))
        .when(kind == "N", F.concat(F.lit("newly tracked alongside "), anchor))
        .when(kind == "C", F.concat(F.lit("recurring alongside "), anchor))
        .otherwise(F.concat(F.lit("recurring in coverage alongside "), anchor))
    )


def scored(drafts: DataFrame, evidence: DataFrame, bar: DataFrame, as_of: str, shown: int = 5) -> DataFrame:
    """Eligible cards with their score, sentence and evidence.

    A card needs an article, two sources and an anchor; its subject is neither famous nor
    an anchor itself.  drafts and evidence (TOLD) meet by ``backing``, each article once.
    bar: one row with the rate of anchors.  article_ids are the ``shown`` latest.
    """
    sums = evidence.groupBy("backing").agg(
        F.count("*").alias("articles"),
        F.countDistinct("source_name").alias("sources"),
        F.size(F.collect_set(F.to_date("first_seen_at"))).cast("long").alias("days"),  # few: the days that articles are kept
        F.max("published_at").alias("newest"),
    )
    rank = F.row_number().over(Window.partitionBy("backing").orderBy(F.col("first_seen_at").desc(), "article_id"))
    latest = evidence.withColumn("n", rank).where(F.col("n") <= shown).groupBy("backing")
    latest = latest.agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "article_id"))), lambda x: x["article_id"]).alias("article_ids"))
    rows = drafts.join(sums.join(latest, "backing"), "backing").drop("backing").join(F.broadcast(bar))
    rows = rows.where((F.col("sources") >= 2) & (F.size("anchors") >= 1) & ~F.col("famous") & ~is_anchor(F.col("subject_type"), F.coalesce("rate", F.lit(0.0)), F.col("bar")))
    days = F.coalesce("own_days", "days")
    age = N.seconds(as_of, "first_observed") / 86400.0
    stale = F.coalesce(N.seconds("first_observed", "newest") > 7 * 86400, F.lit(False))
    strength = scoring.relation_strength("kind", "relation")
    score = scoring.development(strength, age, "sources", days, F.size("anchors"), stale, "rate", "bar")
    why = F.concat(
        F.lit("First observed "), T.plural(F.floor(age + 0.5), "day"), F.lit(" ago, reported by "), T.plural(F.col("sources"), "source"), F.lit(" over "), T.plural(days, "day"),
        F.lit(", "), link_clause(F.col("kind"), F.col("relation"), F.col("anchors")[0]), F.lit("."),
    )
    return rows.withColumns({"strength": strength, "stale": stale, "score": F.round(score, 6), "why": why})


def best_of_subjects(cards: DataFrame) -> DataFrame:
    """One card of each subject by its normalised name: the strongest, of equals by kind R, N, C, E, then by card."""
    kind = F.array_position(F.array(*map(F.lit, "RNCE")), F.col("kind"))
    named = cards.withColumn("norm", T.name_or_itself("subject"))
    order = Window.partitionBy("norm").orderBy(F.col("strength").desc(), kind, "card")
    return named.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n", "norm")


def cards(room: Newsroom, as_of: str) -> DataFrame:
    """Every eligible card of all four kinds, before the best of each subject are chosen."""
    known = cut(roster(room, as_of), "roster")
    links = link_cards(room, known, as_of).withColumn("evidence_article_id", F.lit(None).cast("long"))
    linked, met = pair_evidence(room, cut(relation_cards(room, known, as_of).unionByName(links), "links"))
    made = [build(room, known, as_of) for build in (newcomer_cards, candidate_cards)]
    drafts, evidence = (reduce(DataFrame.unionByName, side).withColumn("backing", F.col("card")) for side in zip(*made))
    drafts = cut(linked.unionByName(drafts), "drafts")
    evidence = cut(evidence.drop("card"), "evidence").unionByName(met)
    bar = known.agg(F.coalesce(F.max("bar"), F.lit(3.0)).alias("bar"))
    return scored(drafts, evidence, bar, as_of)


def developments(room: Newsroom, as_of: str, top: int = 8) -> DataFrame:
    """The ``top`` cards: the best of each subject by score, then the latest observed; none without an article."""
    rows = best_of_subjects(cards(room, as_of))
    return rows.orderBy(F.col("score").desc(), F.col("first_observed").desc(), "card").limit(top)

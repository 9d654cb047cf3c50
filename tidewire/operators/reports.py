"""Lists, lookups and summaries for readers and reviewers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import language as L
from ..functions import text as T
from ..storage import tasks_for
from . import scoring
from .rollups import first_values

SEVERITIES = ("critical", "warning", "advisory")


def severity_rank(severity: str) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(severity)), F.lit(0)), F.lit(len(SEVERITIES) + 1))


def signal_list(signals: DataFrame, entities: DataFrame, states: list[str], top: int | None = None) -> DataFrame:
    """Signals in some states with their entities' names in the order of their ids, the gravest and latest first.

    Unknown ids are left out; a signal without known entities has an empty list.
    """
    rows = signals.where(F.col("state").isin(states))
    named = rows.select("id", F.posexplode("entity_ids").alias("place", "entity_id")).join(
        entities.select(F.col("id").alias("entity_id"), "canonical_name"), "entity_id"
    )
    named = named.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "canonical_name"))), lambda s: s["canonical_name"]).alias("names"))
    out = rows.join(named, "id", "left").withColumn("names", F.array_join(F.coalesce("names", F.array().cast("array<string>")), "|"))
    out = out.orderBy(severity_rank("severity"), F.col("last_evidence_at").desc(), "id").select("id", "severity", "names")
    return out if top is None else out.limit(top)


def best_cards(cards: DataFrame) -> DataFrame:
    """One card of each subject: the strongest, of equals by kind R, N, C, E, then the first."""
    kind = F.array_position(F.array(*map(F.lit, "RNCE")), F.col("kind"))
    order = Window.partitionBy("subject_norm").orderBy(F.col("strength").desc(), kind, "seq")
    return cards.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def median_of_months(views: DataFrame, months: DataFrame) -> DataFrame:
    """Median of each name's monthly views over exactly the given months, missing ones counting as 0."""
    calendar = views.select("name").distinct().crossJoin(F.broadcast(months))
    full = calendar.join(views, ["name", "month"], "left").fillna(0, ["views"])
    return full.groupBy("name").agg(F.floor(F.percentile("views", F.lit(0.5)) + 0.5).cast("long").alias("median_views"))


def entity_summary(items: DataFrame, as_of: str, least: int = 2) -> DataFrame:
    """Per entity of items (entity, category, source, at, sentiment): counts by age, mean sentiment, breadth, last seen."""
    age = f"(unix_seconds(cast({as_of} as timestamp)) - unix_seconds(cast(at as timestamp)))"
    recent = lambda hours: F.expr(f"count_if({age} between 0 and {hours * 3600})")
    rows = items.groupBy("entity").agg(
        F.count("*").alias("mentions"),
        F.max("at").alias("last_seen"),
        recent(1).alias("last_1h"),
        recent(6).alias("last_6h"),
        recent(24).alias("last_24h"),
        (F.floor(F.avg("sentiment") * 100 + 0.5) / 100).alias("sentiment"),
        F.countDistinct("category").alias("categories"),
        F.countDistinct("source").alias("sources"),
    )
    return rows.where(F.col("mentions") >= least)


def ring_baseline(samples: DataFrame, slots: int = 168) -> DataFrame:
    """Mean of each entity's last ``slots`` samples (entity_id, bucket, value)."""
    order = Window.partitionBy("entity_id").orderBy(F.col("bucket").desc())
    return samples.withColumn("n", F.row_number().over(order)).where(F.col("n") <= slots).groupBy("entity_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("samples"))


def novelty(parts: DataFrame) -> DataFrame:
    """A score of 0 to 100 for what is new about an entity, with the reasons, the strongest first.

    parts: entity_id, categories, sources, new_edges, mentions and usual (mean of its
    past, null or 0 without one).  Points: 6 for each category, 30 at most, a reason from
    three on; 20 for sources over mentions, 15 at most; 8 for each new link, 25 at most;
    5 for each time that mentions exceed the usual, 20 at most, from more than twice on;
    10 without a past for two mentions or more; for five mentions or less, 2 for each
    below six, 10 at most, if there is another reason.  Returns entity_id, novelty and
    reasons (names joined by a bar).
    """
    half_up = lambda x: F.floor(x + 0.5).cast("double")
    category = F.least(F.lit(30.0), F.col("categories") * 6.0)
    ratio = F.when(F.col("usual") > 0, F.col("mentions") / F.col("usual"))
    surprise = F.when(ratio > 2, F.least(F.lit(20.0), half_up((ratio - 1) * 5))).otherwise(0.0)
    emergence = F.when(ratio.isNull() & (F.col("mentions") >= 2), 10.0).otherwise(0.0)
    edges = F.least(F.lit(25.0), F.col("new_edges") * 8.0)
    diversity = F.when(F.col("mentions") > 0, F.least(F.lit(15.0), half_up(F.col("sources") / F.col("mentions") * 20))).otherwise(0.0)
    rows = parts.select("entity_id", "mentions", "categories", category.alias("category"), diversity.alias("diversity"), edges.alias("edges"), surprise.alias("surprise"), emergence.alias("emergence"))
    other = (F.col("categories") >= 3) | (F.col("edges") > 0) | (F.col("surprise") > 0) | (F.col("emergence") > 0)
    rows = rows.withColumn("quiet", F.when(other & (F.col("mentions") <= 5), F.least(F.lit(10.0), half_up((6 - F.col("mentions")) * 2.0))).otherwise(0.0))
    named = [
        (F.col("categories") >= 3, "category", 0, "category_crossover"),
        (F.col("edges") > 0, "edges", 1, "novel_edge"),
        (F.col("surprise") > 0, "surprise", 2, "baseline_surprise"),
        (F.col("emergence") > 0, "emergence", 3, "entity_emergence"),
        (F.col("quiet") > 0, "quiet", 4, "quiet_mover"),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.struct((-F.col(score)).alias("score"), F.lit(place).alias("place"), F.lit(name).alias("name"))) for test, score, place, name in named]))
    score = sum((F.col(c) for c in ("diversity", "edges", "surprise", "emergence", "quiet")), F.col("category"))
    reasons = F.array_join(F.transform(F.array_sort(found), lambda r: r["name"]), "|")
    return rows.select("entity_id", F.least(F.lit(100.0), score).alias("novelty"), reasons.alias("reasons"))


def merged_history(history: DataFrame, now_counts: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """History of links (pair, count, last_seen) with today's counts added and what is old left out."""
    tasks = tasks_for(history, now_counts)
    both = history.repartition(tasks, "pair").alias("h").join(now_counts.repartition(tasks, "pair").alias("n"), "pair", "full_outer")
    rows = both.select(
        "pair",
        (F.coalesce("h.count", F.lit(0)) + F.coalesce("n.count", F.lit(0))).alias("count"),
        F.when(F.col("n.count").isNotNull(), F.expr(as_of)).otherwise(F.col("h.last_seen")).alias("last_seen"),
    )
    return rows.where(f"last_seen >= {as_of} - interval {days} days")


def sweep_queue(entities: DataFrame, top: int = 40) -> DataFrame:
    """Entities to look up next: those never checked first, then the latest met."""
    return entities.orderBy(F.col("checked_at").isNull().desc(), F.col("first_seen_at").desc(), "id").limit(top).select("id")


def promotable(candidates: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """Candidates with three sources or more on two days or more, seen lately, by number of sources."""
    sources = F.size(F.split("source_names", "\\|"))
    return candidates.withColumn("sources", sources).where((F.col("sources") >= 3) & (F.col("day_count") >= 2)).where(f"last_seen_at >= {as_of} - interval {days} days").select("norm", "sources")


def find_entities(entities: DataFrame, words: str, offset: int = 0, top: int = 50, status: str | None = None, fame: str | None = None) -> DataFrame:
    """A page of entities whose normalised name or an alias holds the normalised words, with the number of all matches.

    status, fame: only those.  A page has 1 to 200 rows; other sizes, offsets below 0 and
    unknown values are errors.
    """
    if not 1 <= top <= 200 or offset < 0:
        raise ValueError("a page has 1 to 200 rows and begins at 0 or later")
    if status not in (None, "tracked", "dismissed") or fame not in (None, "unknown", "not_famous", "famous"):
        raise ValueError("unknown status or fame")
    wanted = T.normalize_name(F.lit(words))
    hit = F.contains(T.normalize_name("canonical_name"), wanted) | F.exists("aliases", lambda a: F.contains(T.normalize_name(a), wanted))
    rows = entities.where(hit) if words.strip() else entities
    for column, value in (("status", status), ("fame", fame)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy("canonical_name", "id").offset(offset).limit(top)
    return page.join(F.broadcast(total)).select("id", "canonical_name", "total")


def resolve_names(names: DataFrame, entities: DataFrame, tracked: bool = False) -> DataFrame:
    """For each name the entity of that normalised canonical name, else of that alias, the smallest id first.

    tracked: only among tracked entities.
    """
    held = entities.where("status = 'tracked'") if tracked else entities
    known = held.select("id", T.normalize_name("canonical_name").alias("name"), F.lit(0).alias("way")).unionByName(
        held.select("id", F.explode("aliases").alias("a")).select("id", T.normalize_name("a").alias("name"), F.lit(1).alias("way"))
    )
    best = known.where("name <> ''").groupBy("name").agg(F.min(F.struct("way", "id"))["id"].alias("entity_id"))
    return names.withColumn("key", T.normalize_name("name")).join(best.withColumnRenamed("name", "key"), "key", "left").select("name", "entity_id")


def tally(rows: DataFrame, reason: str, sample: str, most: int = 3) -> DataFrame:
    """Rows by reason, with the first few of the distinct samples."""
    first = first_values(rows, reason, sample, [sample], most).withColumnRenamed(sample, "samples")
    counts = rows.groupBy(reason).agg(F.count("*").alias("n"))
    return counts.join(first, reason, "left").withColumn("samples", F.array_join(F.coalesce("samples", F.array().cast("array<string>")), "|"))


#: What a model may call an entity (place is an old word for region), how well known, and how related.
MODEL_TYPES = (
    "person", "company", "organization", "government_body", "armed_group", "political_party", "country", "region",
    "city", "product", "technology", "financial_asset", "disease", "infrastructure", "other", "place",
)
PROMINENCE = ("famous", "known", "obscure")
RELATIONS = (
    "acquisition", "investment", "appointment", "partnership", "funding",
    "sanction", "legal_action", "conflict", "regulation", "supply",
    "membership", "statement_about", "other",
)


def _answers(results: DataFrame) -> DataFrame:
    """(custom_id, index, e: entities, r: relations as variants) of a model's answers (custom_id, result).

    The text from the first [ to the last ] is read; articles without a whole number as
    index or without a list of entities are left out.
    """
    array = F.regexp_extract("result", "(?s)\\[.*\\]", 0)
    parsed = results.select("custom_id", array.alias("array")).withColumn("v", F.expr("try_parse_json(array)"))
    rows = parsed.select("custom_id", F.explode(F.expr("try_variant_get(v, '$', 'array<variant>')")).alias("a"))
    whole = F.expr("schema_of_variant(variant_get(a, '$.index', 'variant'))") == "BIGINT"
    rows = rows.where(F.coalesce(whole, F.lit(False)))
    rows = rows.select("custom_id", F.expr("try_variant_get(a, '$.index', 'bigint')").alias("index"), F.expr("try_variant_get(a, '$.entities', 'array<variant>')").alias("e"), F.expr("try_variant_get(a, '$.relations', 'array<variant>')").alias("r"))
    return rows.where("e is not null")


def parsed_extractions(results: DataFrame) -> DataFrame:
    """Entities a model found (custom_id, index, place, name, type, role, prominence) from its answers' JSON arrays.

    Unknown types count as other, place as region, an unknown prominence as known; nameless
    entries are dropped.
    """
    rows = _answers(results).select("custom_id", "index", F.posexplode("e").alias("place", "v"))
    field = lambda name: F.expr(f"case when schema_of_variant(variant_get(v, '$.{name}', 'variant')) = 'STRING' then try_variant_get(v, '$.{name}', 'string') end")
    rows = rows.select("custom_id", "index", "place", F.trim(field("name")).alias("name"), field("type").alias("type"), F.trim(field("role")).alias("role"), field("prominence").alias("prominence"))
    kind = F.when(F.col("type") == "place", "region").when(F.col("type").isin(*MODEL_TYPES), F.col("type")).otherwise("other")
    prominence = F.when(F.col("prominence").isin(*PROMINENCE), F.col("prominence")).otherwise("known")
    return rows.where("name <> ''").select("custom_id", "index", "place", "name", kind.alias("type"), F.nullif("role", F.lit("")).alias("role"), prominence.alias("prominence"))


def parsed_relations(results: DataFrame) -> DataFrame:
    """Relations a model states (custom_id, index, place, source, relation, target, known).

    Both ends must be names of the same article's entities; known tells whether the
    relation is one of RELATIONS, others are to be dropped and counted.
    """
    rows = _answers(results).select("custom_id", "index", F.posexplode("r").alias("place", "v"))
    field = lambda name: F.expr(f"try_variant_get(v, '$.{name}', 'string')")
    rows = rows.select("custom_id", "index", "place", F.trim(field("source")).alias("source"), field("relation").alias("relation"), F.trim(field("target")).alias("target"))
    rows = rows.where("source <> '' and target <> '' and relation is not null").withColumn("known", F.col("relation").isin(*RELATIONS))
    names = parsed_extractions(results).groupBy("custom_id", "index").agg(F.collect_set("name").alias("names"))
    held = rows.join(names, ["custom_id", "index"])
    return held.where((~F.col("known")) | (F.array_contains("names", F.col("source")) & F.array_contains("names", F.col("target")))).drop("names")


# ------------------------------------------------------------------ pages


def hourly_series(hourly: DataFrame, entity_id: int, as_of: str, days: int = 7) -> DataFrame:
    """An entity's hours of the last days in order; hours without a mention have no row."""
    rows = hourly.where((F.col("entity_id") == entity_id) & F.expr(f"bucket >= {as_of} - interval {days} days and bucket < {as_of}"))
    return rows.orderBy("bucket").select("bucket", "mentions", "source_count", "sentiment_sum")


def series_scale(series: DataFrame) -> DataFrame:
    """One row: the largest number of mentions of a series, 1 at least."""
    return series.agg(F.greatest(F.lit(1), F.coalesce(F.max("mentions"), F.lit(0))).alias("scale"))


def recent_articles(article_entities: DataFrame, articles: DataFrame, entity_id: int, top: int = 20) -> DataFrame:
    """An entity's head articles by news time, the latest first."""
    own = article_entities.where(F.col("entity_id") == entity_id).select(F.col("article_id").alias("id")).distinct()
    rows = articles.where("dup_group_id is null").join(own, "id", "left_semi")
    rows = rows.select("id", "title", "link", "source_name", F.coalesce("published_at", "first_seen_at").alias("published"))
    return rows.orderBy(F.col("published").desc(), "id").limit(top)


def evidence_articles(signals: DataFrame, articles: DataFrame) -> DataFrame:
    """(id, place, article_id, title, link, source_name) of signals' article_ids in their order; missing ones are left out."""
    rows = signals.select("id", F.posexplode("article_ids").alias("place", "article_id"))
    return rows.join(articles.select(F.col("id").alias("article_id"), "title", "link", "source_name"), "article_id").select("id", "place", "article_id", "title", "link", "source_name")


def asked_states(states: str | None) -> list[str]:
    """States from a list with commas; blank means the open ones, an unknown one is an error."""
    names = [s.strip() for s in (states or "").split(",") if s.strip()]
    wrong = [s for s in names if s not in ("new", "seen", "dismissed", "promoted")]
    if wrong:
        raise ValueError(f"unknown state {wrong[0]}")
    return names or ["new", "seen", "promoted"]


def item_entities(items: DataFrame, matches: DataFrame, as_of: str, least: int = 2, top: int = 5) -> DataFrame:
    """Entities over items (id, category, source, at, text) by matches (id, name, type): what a reader sees of each.

    Returns name, type, mentions, last_seen, last_1h, last_6h, last_24h, sentiment, categories,
    sources, counts by urgency and partners (the ``top`` most frequent others with counts).
    Entities of less than ``least`` items are left out.
    """
    held = items.select("id", "category", "source", "at", L.sentiment("text").alias("sentiment"), L.urgency("category").alias("urgency"))
    once = matches.groupBy("id", "name").agg(F.min("type").alias("type"))
    rows = once.join(held, "id")
    age = f"(unix_micros(cast({as_of} as timestamp)) - unix_micros(cast(at as timestamp)))"
    recent = lambda hours: F.expr(f"count_if({age} <= {hours * 3_600_000_000})")
    sums = rows.groupBy("name").agg(
        F.min("type").alias("type"),
        F.count("*").alias("mentions"),
        F.max("at").alias("last_seen"),
        recent(1).alias("last_1h"),
        recent(6).alias("last_6h"),
        recent(24).alias("last_24h"),
        (F.floor(F.avg("sentiment") * 100 + 0.5) / 100).alias("sentiment"),
        F.countDistinct("category").alias("categories"),
        F.countDistinct("source").alias("sources"),
        *[F.count_if(F.col("urgency") == level).alias(f"urgency_{level}") for level in L.URGENCY_LEVELS],
    )
    a = once.select("id", "name")
    pairs = a.join(a.withColumnRenamed("name", "other"), "id").where("name <> other").groupBy("name", "other").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.col("n").desc(), "other"))
    partners = pairs.withColumn("rank", rank).where(F.col("rank") <= top).groupBy("name")
    partners = partners.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other", "n"))), lambda p: F.concat(p["other"], F.lit(":"), p["n"].cast("string"))), "|").alias("partners"))
    return sums.where(F.col("mentions") >= least).join(partners, "name", "left").withColumn("partners", F.coalesce("partners", F.lit("")))


def worst_urgency(counts: DataFrame) -> F.Column:
    """The gravest level of which there is one, from the columns of ``item_entities``."""
    out = None
    for level in L.URGENCY_LEVELS[:-1]:
        test = F.col(f"urgency_{level}") > 0
        out = F.when(test, level) if out is None else out.when(test, level)
    return out.otherwise(L.URGENCY_LEVELS[-1])


def map_markers(entities: DataFrame, matches: DataFrame, items: DataFrame, coordinates: DataFrame, top: int = 5) -> DataFrame:
    """Places with coordinates (name, lat, lng) among entities: with radius, gravest urgency and the first headlines.

    coordinates is a fixed table of places and goes to every task.
    """
    rows = entities.where(F.col("type").isin("country", "region")).join(F.broadcast(coordinates), "name")
    most = rows.agg(F.greatest(F.lit(1), F.coalesce(F.max("mentions"), F.lit(1))).alias("most"))
    first = first_values(matches.join(items.select("id", "title"), "id").withColumn("t", F.concat(F.lpad(F.col("id").cast("string"), 20, "0"), F.lit(" "), F.col("title"))), "name", "t", ["id"], top)
    heads = first.select("name", F.array_join(F.transform("t", lambda t: F.substr(t, F.lit(22))), "|").alias("headlines"))
    rows = rows.join(F.broadcast(most)).join(heads, "name", "left")
    return rows.select("name", "lat", "lng", "mentions", F.round(scoring.map_radius("mentions", "most"), 6).alias("radius"), worst_urgency(rows).alias("urgency"), "headlines")


def as_json(rows: DataFrame, *keep: str) -> DataFrame:
    """Rows as one JSON object each, nulls included, with some columns kept beside it."""
    return rows.select(*keep, F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("json"))


def throttled(last_updated, as_of, minutes: int = 55) -> Column:
    """Whether a ring of samples takes another: none yet, or its last is old enough."""
    age = F.unix_millis(F.expr(as_of).cast("timestamp")) - F.unix_millis(F.col(last_updated).cast("timestamp"))
    return F.coalesce(age >= minutes * 60_000, F.lit(True))

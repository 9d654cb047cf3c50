"""Graph operators over links and relations."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..storage import cut, forget, tasks_for


def top_partners(edges: DataFrame, top: int = 5) -> DataFrame:
    """The strongest links of each entity, in either direction."""
    both = edges.select(F.col("entity_a").alias("entity_id"), F.col("entity_b").alias("other_id"), "article_count").unionByName(
        edges.select(F.col("entity_b").alias("entity_id"), F.col("entity_a").alias("other_id"), "article_count")
    )
    both = both.repartition(2 * tasks_for(edges), "entity_id")
    order = Window.partitionBy("entity_id").orderBy(F.col("article_count").desc(), "other_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def network_links(edges: DataFrame, mentions: DataFrame, top: int = 5, least: int = 2) -> DataFrame:
    """Links to draw: among each entity's strongest, both ends mentioned often enough, each pair once.

    Both directions of a link have one count, so whichever is met first, that is its value.
    """
    often = mentions.groupBy("entity_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("entity_id")
    links = top_partners(edges, top).join(often, "entity_id", "left_semi").join(often.withColumnRenamed("entity_id", "other_id"), "other_id", "left_semi")
    return links.groupBy(F.least("entity_id", "other_id").alias("source"), F.greatest("entity_id", "other_id").alias("target")).agg(F.max("article_count").alias("value"))


def current_edges(partners: DataFrame) -> DataFrame:
    """Counts of pairs from both ends' lists of partners (entity, other, count): the larger of the two."""
    return partners.groupBy(T.pair_key("entity", "other").alias("pair")).agg(F.max("count").alias("count"))


def ego_edges(edges: DataFrame, entities: DataFrame, entity_id: int, top: int = 10) -> DataFrame:
    """An entity's strongest links with the names of the other ends."""
    other = F.when(F.col("entity_a") == entity_id, F.col("entity_b")).otherwise(F.col("entity_a"))
    own = edges.where((F.col("entity_a") == entity_id) | (F.col("entity_b") == entity_id)).select(other.alias("other_id"), "article_count", "last_seen_at")
    named = own.join(entities.select(F.col("id").alias("other_id"), "canonical_name"), "other_id")
    return named.orderBy(F.col("article_count").desc(), "other_id").limit(top)


def _met(article_entities: DataFrame, pairs: DataFrame, *carried: str, articles: DataFrame | None = None) -> DataFrame:
    """(entity_a, entity_b, article_id, carried) for the articles that name both ends of a pair, the smaller id first.

    Entities meet inside their article; the pairs asked for then pick among those.  Articles and
    then pairs are dealt to tasks whose number grows with the rows.  articles: the only ones that
    count (article_id, carried), joined where the entities meet.
    """
    tasks = tasks_for(article_entities)
    if articles is not None:
        rows = article_entities.select("article_id", "entity_id").repartition(tasks, "article_id")
        article_entities = rows.join(articles.select("article_id", *carried).repartition(tasks, "article_id"), "article_id")
    held = article_entities.select("article_id", F.col("entity_id").alias("entity_a"), *carried).repartition(tasks, "article_id").distinct()
    b = held.select("article_id", F.col("entity_a").alias("entity_b")).distinct()
    met = held.join(b, "article_id").where("entity_a < entity_b").repartition(tasks, "entity_a", "entity_b")
    asked = pairs.select(F.least("entity_a", "entity_b").alias("entity_a"), F.greatest("entity_a", "entity_b").alias("entity_b")).repartition(tasks, "entity_a", "entity_b")
    return met.join(asked.distinct(), ["entity_a", "entity_b"], "left_semi").select("entity_a", "entity_b", "article_id", *carried)


def pair_articles(article_entities: DataFrame, pairs: DataFrame, articles: DataFrame | None = None) -> DataFrame:
    """(entity_a, entity_b, article_id) for the articles that name both ends of a pair, the smaller id first.

    articles: the only ones that count (article_id, ...); their other columns are added.
    """
    carried = [] if articles is None else [c for c in articles.columns if c != "article_id"]
    return _met(article_entities, pairs, *carried, articles=articles)


def pair_evidence(article_entities: DataFrame, pairs: DataFrame, top: int = 5) -> DataFrame:
    """For each pair (entity_a, entity_b) the articles that name both, the latest first."""
    rows = article_entities.repartition(tasks_for(article_entities), "article_id")
    arrivals = rows.groupBy("article_id").agg(F.min("arrival_at").alias("arrival_at"))
    met = _met(rows.select("article_id", "entity_id").join(arrivals, "article_id"), pairs, "arrival_at")
    order = Window.partitionBy("entity_a", "entity_b").orderBy(F.col("arrival_at").desc(), "article_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("entity_a", "entity_b", "rank", "article_id", "arrival_at")


def co_occurring(article_entities: DataFrame, subjects: DataFrame) -> DataFrame:
    """(entity_id, other_id): who stands beside each subject (entity_id) in an article, each pair once."""
    own = article_entities.join(subjects.select("entity_id").distinct(), "entity_id", "left_semi").select("article_id", "entity_id")
    others = article_entities.select("article_id", F.col("entity_id").alias("other_id"))
    return own.join(others, "article_id").where("entity_id <> other_id").select("entity_id", "other_id").distinct()


def relation_ends(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations of tracked sources with their names."""
    names = entities.where("status = 'tracked'").select(F.col("id").alias("source_id"), F.col("canonical_name").alias("source_name"))
    return relations.join(names, "source_id").select("source_id", "source_name", "target_id", "relation", "article_count", "evidence_article_id")


def entity_relations(relations: DataFrame, entities: DataFrame, entity_id: int) -> DataFrame:
    """An entity's relations in both directions with the names of the other ends, the most frequent first."""
    columns = ["relation", "article_count", "last_seen_at"]
    out = relations.where(F.col("source_id") == entity_id).select(F.lit("outgoing").alias("direction"), F.col("target_id").alias("other_id"), *columns)
    back = relations.where(F.col("target_id") == entity_id).select(F.lit("incoming").alias("direction"), F.col("source_id").alias("other_id"), *columns)
    names = entities.select(F.col("id").alias("other_id"), F.col("canonical_name").alias("other_name"))
    return out.unionByName(back).join(names, "other_id").orderBy("direction", F.col("article_count").desc(), "other_id", "relation")


def name_groups(entities: DataFrame) -> DataFrame:
    """(id, component) of groups of two or more entities whose names are equal or one the first or last words of another's.

    Names are compared normalised and without punctuation.  Pairs come from equal-key
    joins on a name and the longer names' heads and tails; equal names are linked with
    the smallest id of their name.  The smallest id of a group spreads along pairs and
    then along the labels already reached, so its way halves in every round.
    """
    key = T.name_key("canonical_name")
    named = cut(entities.select("id", key.alias("run")), "names")
    least = named.groupBy("run").agg(F.min("id").alias("least"))
    same = named.join(least, "run").where("id <> least").select("id", F.col("least").alias("other"))
    parts = least.withColumn("w", F.split("run", " ")).where("size(w) > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    heads = F.array_join(F.slice("w", F.lit(1), F.col("k")), " ")
    tails = F.array_join(F.slice("w", F.size("w") - F.col("k") + 1, F.col("k")), " ")
    runs = parts.select(F.col("least").alias("id"), F.explode(F.array_distinct(F.array(heads, tails))).alias("run"))
    near = runs.join(least, "run").select("id", F.col("least").alias("other"))
    pairs = same.unionByName(near).where("id <> other")
    both = cut(pairs.unionByName(pairs.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct(), "pairs")
    label = cut(both.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("component")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("component").alias("low"))
        after = label.join(near, "id").select("id", F.least("component", "low").alias("component"))
        jump = label.select(F.col("id").alias("component"), F.col("component").alias("far"))
        after = cut(after.join(jump, "component").select("id", F.least("component", "far").alias("component")), "labels")
        settled = after.exceptAll(label).isEmpty()
        forget(label)
        label = after
        if settled:
            forget(both, named)
            return label


def similar_names(entities: DataFrame) -> DataFrame:
    """Groups of likely names of one entity: (component, place, id, canonical_name), groups and members by smallest id."""
    found = name_groups(entities).join(entities.select("id", "canonical_name"), "id")
    place = F.row_number().over(Window.partitionBy("component").orderBy("id"))
    return found.select("component", place.alias("place"), "id", "canonical_name")


#: What follows from trouble in a domain, in this order.
CASCADES = (
    ("military", (("energy", "Energy supply disruption"), ("humanitarian", "Civilian displacement"), ("sanctions", "Sanctions escalation"), ("diplomatic", "Diplomatic crisis"))),
    ("energy", (("shipping", "Shipping route repricing"), ("commodities", "Commodity price shock"), ("financial", "Market volatility"), ("supply_chain", "Input cost surge"))),
    ("shipping", (("supply_chain", "Delivery delays"), ("commodities", "Trade flow disruption"))),
    ("cyber", (("infrastructure", "Infrastructure degradation"), ("financial", "Market confidence loss"), ("energy", "Grid/pipeline vulnerability"))),
    ("sanctions", (("financial", "Capital flow restriction"), ("commodities", "Trade embargo effects"), ("diplomatic", "Alliance realignment"))),
    ("humanitarian", (("diplomatic", "International pressure"), ("health", "Public health strain"))),
    ("infrastructure", (("supply_chain", "Logistics bottleneck"), ("financial", "Asset repricing"))),
    ("commodities", (("financial", "Price transmission"), ("supply_chain", "Procurement disruption"))),
    ("diplomatic", (("sanctions", "Sanction triggers"), ("military", "Force posture shift"))),
    ("health", (("humanitarian", "Aid mobilization"), ("diplomatic", "International response"))),
    ("financial", (("commodities", "Capital reallocation"), ("diplomatic", "Economic pressure"))),
    ("supply_chain", (("commodities", "Scarcity pricing"), ("financial", "Earnings impact"))),
)
#: Domains of entities and of categories.
ENTITY_DOMAINS = (
    ("Strait of Hormuz", ("energy", "shipping")), ("Persian Gulf", ("energy", "shipping")),
    ("OPEC", ("energy",)), ("IAEA", ("energy",)), ("Red Sea", ("shipping", "military")),
    ("Suez Canal", ("shipping",)), ("Bab el-Mandeb", ("shipping", "military")),
    ("South China Sea", ("shipping", "military")), ("Taiwan Strait", ("shipping", "military")),
    ("NATO", ("military",)), ("Pentagon", ("military",)), ("IDF", ("military",)),
    ("Wagner Group", ("military",)), ("Hamas", ("military",)), ("Hezbollah", ("military",)),
    ("ISIS", ("military",)), ("Al-Qaeda", ("military",)), ("Houthi", ("military",)),
    ("IMF", ("financial",)), ("World Bank", ("financial",)), ("ECB", ("financial",)),
    ("WTO", ("supply_chain",)), ("WHO", ("health",)), ("UNHCR", ("humanitarian",)),
    ("Red Cross", ("humanitarian",)), ("Doctors Without Borders", ("humanitarian",)),
    ("Amnesty International", ("humanitarian",)), ("Human Rights Watch", ("humanitarian",)),
)
CATEGORY_DOMAINS = (
    ("Conflict", "military"), ("Defense", "military"), ("OSINT", "military"),
    ("Military/Alerts", "military"), ("Military/Aviation", "military"),
    ("Military/Electronic Warfare", "military"), ("Military/Infrastructure", "military"),
    ("Military/Maritime", "military"), ("Military/Space", "military"),
    ("Economic/Energy", "energy"), ("Infrastructure/Energy", "energy"),
    ("Radiation", "energy"), ("Radiation/Nuclear", "energy"),
    ("Trade/Maritime", "shipping"), ("Supply Chain/Maritime", "shipping"),
    ("Economic/Markets", "financial"), ("Economic/Credit", "financial"),
    ("Crypto", "financial"), ("Economic/Crypto", "financial"), ("Prediction Markets", "financial"),
    ("Supply Chain", "supply_chain"),
    ("Cyber", "cyber"), ("Cyber Threats", "cyber"),
    ("Infrastructure", "infrastructure"), ("Infrastructure/Tech", "infrastructure"),
    ("Infrastructure/Telecom", "infrastructure"), ("Infrastructure/Resources", "infrastructure"),
    ("Humanitarian", "humanitarian"), ("Displacement/Humanitarian", "humanitarian"),
    ("Conflict/Humanitarian", "humanitarian"),
    ("Economic/Sanctions", "sanctions"), ("Sanctions", "sanctions"),
    ("Geopolitics", "diplomatic"), ("Think Tank", "diplomatic"), ("Government Advisory", "diplomatic"),
    ("Health", "health"), ("Food Security", "health"),
    ("Economic", "commodities"), ("Economic/Sentiment", "commodities"),
    ("Economic/Forecasts", "commodities"), ("Economic/Development", "commodities"),
)


def causal_edges(spark: SparkSession) -> DataFrame:
    """The fixed graph of domains as (domain, next, label, place)."""
    rows = [(domain, after, label, place) for domain, steps in CASCADES for place, (after, label) in enumerate(steps)]
    return spark.createDataFrame(rows, "domain string, next string, label string, place int")


def domains(signals: DataFrame, items: DataFrame) -> DataFrame:
    """Triggers for ``cascades`` from signals (seq, severity, names: array) and items (name, category): (seq, severity, domain, rank).

    A name with domains of its own has those; another the domain of its most frequent
    category, of equals the first by letters, if that has one.
    """
    spark = signals.sparkSession
    own = spark.createDataFrame([(n, list(d)) for n, d in ENTITY_DOMAINS], "name string, direct array<string>")
    by_category = spark.createDataFrame(CATEGORY_DOMAINS, "category string, domain string")
    named = signals.select("seq", "severity", F.posexplode("names").alias("place", "name")).join(F.broadcast(own), "name", "left")
    counted = items.groupBy("name", "category").agg(F.count("*").alias("n"))
    usual = counted.groupBy("name").agg(F.min(F.struct((-F.col("n")).alias("n"), "category"))["category"].alias("category")).join(F.broadcast(by_category), "category")
    found = named.join(usual.select("name", "domain"), "name", "left").withColumn("all", F.coalesce("direct", F.array("domain")))
    rows = found.select("seq", "severity", "place", F.posexplode("all").alias("step", "domain")).where("domain is not null")
    rank = F.min(F.struct("place", "step")).alias("first")
    rows = rows.groupBy("seq", "severity", "domain").agg(rank)
    return rows.select("seq", "severity", "domain", F.row_number().over(Window.partitionBy("seq").orderBy("first")).alias("rank"))


def cascades(edges: DataFrame, triggers: DataFrame, top: int = 6) -> DataFrame:
    """Chains trigger -> second -> third along ordered adjacency (domain, next, place).

    triggers: (seq, domain, severity) and optionally rank, the order of a signal's domains.
    The first two steps of a domain are followed, then the first step that does not lead
    back.  A pair of trigger and second counts once, for the earliest trigger;
    critical chains and then longer ones come first.
    """
    if "rank" not in triggers.columns:
        triggers = triggers.withColumn("rank", F.lit(0))
    first = triggers.where("severity <> 'advisory'").join(edges.where("place < 2"), "domain").select(
        "seq", "rank", "severity", F.col("domain").alias("trigger"), F.col("next").alias("second"), "place"
    )
    once = Window.partitionBy("trigger", "second").orderBy("seq", "rank", "place")
    first = first.withColumn("n", F.row_number().over(once)).where("n = 1").drop("n")
    step = edges.select(F.col("domain").alias("second"), F.col("next").alias("third"), F.col("place").alias("third_place"))
    held = first.join(step, "second", "left").where("third is null or third <> trigger")
    third = held.groupBy("seq", "severity", "trigger", "second", "place").agg(F.min(F.struct("third_place", "third"))["third"].alias("third"))
    rows = first.join(third.select("seq", "trigger", "second", "third"), ["seq", "trigger", "second"], "left")
    order = [(F.col("severity") == "critical").desc(), F.col("third").isNotNull().desc(), "seq", "rank", "place", "trigger", "second"]
    return rows.orderBy(*order).limit(top).select("seq", "severity", "trigger", "second", "third")

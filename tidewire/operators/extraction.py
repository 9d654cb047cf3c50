"""From texts to entities: candidate names of an article in layers, their merge, and what each one is."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import language as L
from ..functions import text as T
from . import newsroom as N

#: Layers by rank, the strongest first.
LAYERS = ("dictionary", "llm", "compromise", "acronym", "person-regex", "product-pattern")

FOUND = ["article_id", "layer", "seq", "display", "type_hint", "role_context", "prominence"]


def _layer(rows: DataFrame, layer: str, type_hint) -> DataFrame:
    """Rows (article_id, display) as found names of a layer, in the order of letters."""
    rank = F.row_number().over(Window.partitionBy("article_id").orderBy("display"))
    none = F.lit(None).cast("string")
    kind = F.lit(type_hint) if isinstance(type_hint, str) else type_hint
    return rows.select("article_id", F.lit(layer).alias("layer"), rank.alias("seq"), "display", kind.alias("type_hint"), none.alias("role_context"), none.alias("prominence"))


def found_names(articles: DataFrame, terms: DataFrame, dictionary_only: bool = False) -> DataFrame:
    """Names in the title and summary of articles (id, title, summary) by layer: dictionary, acronyms, persons, products."""
    texts = articles.select("id", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit(""))).alias("text"))
    matches = L.dictionary_matches(texts, terms).select(F.col("id").alias("article_id"), F.col("canonical").alias("display"), "type")
    layers = [_layer(matches, "dictionary", F.col("type"))]
    if not dictionary_only:
        named = lambda column: texts.select(F.col("id").alias("article_id"), F.explode(column).alias("display"))
        unknown = lambda rows: rows.withColumn("key", F.lower("display")).join(terms.select(F.lower("term").alias("key")), "key", "left_anti")
        layers.append(_layer(unknown(named(L.acronyms("text"))), "acronym", "organization"))
        layers.append(_layer(named(L.person_names("text")), "person-regex", "person"))
        layers.append(_layer(unknown(named(L.products("text"))), "product-pattern", "other"))
    return reduce(DataFrame.unionByName, layers).select(FOUND)


def answered_names(articles: DataFrame, terms: DataFrame, answered: DataFrame, answers: DataFrame) -> DataFrame:
    """Found names of articles of which some have a model's answer.

    answered: (article_id) of those that have one, empty or not; answers: its names, with the
    columns of FOUND.  They are joined by what the dictionary finds in the article, and by
    nothing else; an article without an answer is searched by all layers.
    """
    ids = answered.select(F.col("article_id").alias("id")).distinct()
    held = answers.join(ids.withColumnRenamed("id", "article_id"), "article_id", "left_semi").select(FOUND)
    beside = found_names(articles.join(ids, "id", "left_semi"), terms, dictionary_only=True)
    return held.unionByName(beside).unionByName(found_names(articles.join(ids, "id", "left_anti"), terms))


def merged_names(found: DataFrame) -> DataFrame:
    """One candidate for each article and normalised name: (article_id, norm, display, type_hint, layer, role_context, prominence).

    found: as from ``found_names``, any layers.  Names are taken by layer and order.  Type,
    layer, role and prominence are those of the strongest layer, the first of it.  The
    display is the longest among those whose layer is at least as strong as the strongest
    so far.  Names of which nothing is left are dropped.
    """
    order = F.array_position(F.array(*map(F.lit, LAYERS)), F.col("layer")).cast("int")
    rows = found.withColumns({"norm": T.normalize_name("display"), "rank": F.lit(len(LAYERS)) - order}).where("norm <> ''")
    item = F.struct((-F.col("rank")).alias("o"), "seq", "display", "rank", "type_hint", "layer", "role_context", "prominence")
    kind = "struct<rank:int,display:string,type_hint:string,layer:string,role_context:string,prominence:string>"
    fold = f"""aggregate(items, cast(null as {kind}), (kept, x) -> case
        when kept is null or x.rank > kept.rank then named_struct('rank', x.rank,
          'display', case when kept is null or length(x.display) > length(kept.display) then x.display else kept.display end,
          'type_hint', x.type_hint, 'layer', x.layer, 'role_context', x.role_context, 'prominence', x.prominence)
        when x.rank = kept.rank and length(x.display) > length(kept.display) then named_struct('rank', kept.rank, 'display', x.display,
          'type_hint', kept.type_hint, 'layer', kept.layer, 'role_context', kept.role_context, 'prominence', kept.prominence)
        else kept end)"""
    items = rows.groupBy("article_id", "norm").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return items.select("article_id", "norm", F.expr(fold).alias("c")).select("article_id", "norm", "c.display", "c.type_hint", "c.layer", "c.role_context", "c.prominence")


def classified(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds kind, entity_id and name: resolved (the registry knows the name), new (a dictionary's, or one that a model calls famous) or candidate.

    registry: entities of every status (id, canonical_name, aliases); of those that share a
    name the one with the smallest id counts.
    """
    known = N.name_index(registry).join(registry.select(F.col("id").alias("entity_id"), "canonical_name"), "entity_id")
    rows = candidates.join(known, "norm", "left")
    accepted = (F.col("layer") == "llm") & (F.col("prominence") == "famous")
    kind = F.when(F.col("entity_id").isNotNull(), "resolved").when((F.col("layer") == "dictionary") | F.coalesce(accepted, F.lit(False)), "new").otherwise("candidate")
    name = F.coalesce("canonical_name", "display")
    return rows.withColumns({"kind": kind, "name": name, "auto_accepted": F.col("entity_id").isNull() & F.coalesce(accepted, F.lit(False))}).drop("canonical_name")


def new_entities(found: DataFrame, articles: DataFrame) -> DataFrame:
    """Entities to insert from classified names of kind new: (canonical_name, type, first_seen_at, last_seen_at), times of arrival.

    The type is that of the first article.
    """
    rows = found.where("kind = 'new'").join(articles.select(F.col("id").alias("article_id"), F.col("first_seen_at").alias("arrival_at")), "article_id")
    return rows.groupBy(F.col("name").alias("canonical_name")).agg(
        F.min(F.struct("article_id", "norm", "type_hint"))["type_hint"].alias("type"), F.min("arrival_at").alias("first_seen_at"), F.max("arrival_at").alias("last_seen_at")
    )


def resolved_mentions(found: DataFrame, entities: DataFrame, articles: DataFrame) -> DataFrame:
    """Mentions (article_id, entity_id, effective_at, arrival_at, source_name, sentiment) of known and new names, one for an article and entity."""
    ids = entities.select(F.col("canonical_name").alias("name"), F.col("id").alias("new_id"))
    rows = found.where("kind in ('resolved', 'new')").join(ids, "name", "left")
    rows = rows.select("article_id", F.coalesce("entity_id", "new_id").alias("entity_id")).where("entity_id is not null").distinct()
    held = articles.select(
        F.col("id").alias("article_id"),
        F.coalesce("published_at", "first_seen_at").alias("effective_at"),
        F.col("first_seen_at").alias("arrival_at"),
        "source_name",
        L.sentiment(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit("")))).alias("sentiment"),
    )
    return rows.join(held, "article_id")


def sightings(found: DataFrame, articles: DataFrame) -> DataFrame:
    """Sightings of names of kind candidate, with the names that the same article resolves, for ``rollups.candidates``."""
    beside = found.where("kind in ('resolved', 'new')").groupBy("article_id").agg(F.array_sort(F.collect_set("name")).alias("co_entities"))
    held = articles.select(F.col("id").alias("article_id"), F.coalesce("published_at", "first_seen_at").alias("effective_at"), "source_name", "title")
    rows = found.where("kind = 'candidate'").join(held, "article_id").join(beside, "article_id", "left")
    return rows.select("norm", "display", "type_hint", "source_name", "title", "effective_at", F.col("article_id").alias("seq"), "role_context", F.coalesce("co_entities", F.array().cast("array<string>")).alias("co_entities"))


def resolved_relations(stated: DataFrame, entities: DataFrame, articles: DataFrame) -> DataFrame:
    """Relation occurrences (source_id, target_id, relation, article_id, arrival_at) of stated ones (article_id, source, relation, target).

    Ends that no entity has as a name, and loops, are left out.
    """
    index = N.name_index(entities)
    end = lambda x: index.select(F.col("norm").alias(f"{x}_norm"), F.col("entity_id").alias(f"{x}_id"))
    rows = stated.withColumns({"source_norm": T.normalize_name("source"), "target_norm": T.normalize_name("target")})
    rows = rows.join(end("source"), "source_norm").join(end("target"), "target_norm").where("source_id <> target_id")
    arrivals = articles.select(F.col("id").alias("article_id"), F.col("first_seen_at").alias("arrival_at"))
    return rows.join(arrivals, "article_id").select("source_id", "target_id", "relation", "article_id", "arrival_at")

"""The ingest tick as a stream: micro-batches merged into stored tables, all of them at once or none."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extraction, panels, rollups, state, stories
from .ledger import Commit, Ledger, Table

#: Hours of an entity lie in one of so many parts a day.
SPREAD = 16


def tables(parts: int = 64) -> dict[str, Table]:
    """The tables of a tick, each dealt to ``parts`` by a hash of its key, or by day where rows come with time."""
    by = lambda keys: f"pmod(xxhash64({keys}), {parts})"
    day = lambda time: f"datediff({time}, date'1970-01-01')"
    times = "first_seen_at timestamp_ntz, last_seen_at timestamp_ntz"
    return {
        "articles": Table(
            "id long, title string, link string, source_name string, source_category string, summary string, published_at timestamp_ntz, first_seen_at timestamp_ntz, "
            "content_hash string, title_signature string, dup_group_id long, entities_processed_at timestamp_ntz",
            by("title_signature"),
        ),
        "entities": Table(f"id long, canonical_name string, type string, status string, fame string, aliases array<string>, {times}", by("canonical_name")),
        "links": Table("article_id long, entity_id long, arrival_at timestamp_ntz", day("arrival_at")),
        "hourly": Table("entity_id long, bucket timestamp_ntz, mentions long, source_count long, sentiment_sum double", f"{day('bucket')} * {SPREAD} + pmod(xxhash64(entity_id), {SPREAD})"),
        "edges": Table(f"entity_a long, entity_b long, {times}, article_count long", by("entity_a, entity_b")),
        "candidates": Table(
            f"norm string, display_name string, type_hint string, mention_count long, day_count long, {times}, "
            "source_names array<string>, sample_titles array<string>, contexts array<string>, co_entities array<string>",
            by("norm"),
        ),
        "relations": Table(f"source_id long, target_id long, relation string, article_count long, {times}, evidence_article_id long", by("source_id, target_id, relation")),
    }


def ingest(
    commit: Commit,
    items: DataFrame,
    names: Callable[[DataFrame], DataFrame],
    stated: Callable[[DataFrame], DataFrame] | None = None,
) -> dict[str, int]:
    """One tick over a batch of feed items: articles, entities, links and rollups, and which heads are processed.

    items: id, title, link, source_name, source_category, summary, published_at and
    first_seen_at.  names finds the names in articles (as ``extraction.found_names``),
    stated the relations (as ``extraction.resolved_relations`` takes them).  Items whose
    content is stored already are dropped; members of a stored or new group are stored,
    but only heads are searched for names.  Returns counts, which are kept among the
    commit's facts.  An empty batch changes nothing.

    Nothing is visible before ``commit.publish``, so marks of processed articles and the
    sums they guard can't part.
    """
    items = commit.held(stories.identified(items).withColumns({"dup_group_id": F.lit(None).cast("long"), "entities_processed_at": F.lit(None).cast("timestamp_ntz")}), "items")
    last = items.agg(F.max("first_seen_at").cast("string")).first()[0]
    if last is None:
        return {}
    as_of = f"timestamp_ntz'{last}'"

    # articles and their groups: equal contents have equal titles, so both lookups stay in the touched parts
    columns = [f.name for f in commit.ledger.table("articles", []).schema]
    parts = commit.parts("articles", items)
    stored = commit.table("articles", parts)
    fresh = commit.held(stories.insert_new(stored, items).select(columns), "fresh")
    articles = stored.unionByName(fresh)
    articles = stories.grouped(articles, commit.held(stories.duplicate_groups(articles), "groups"))
    heads = commit.held(state.unprocessed_heads(articles, as_of, hours=None), "heads")
    commit.replace("articles", state.mark_processed(articles, heads, as_of), parts)

    # names, entities and mentions
    registry = commit.table("entities").select("id", "canonical_name", "aliases")
    found = commit.held(extraction.classified(extraction.merged_names(names(heads)), registry), "found")
    new = extraction.new_entities(found, heads)
    top = commit.facts.get("last_entity", 0)
    touched = commit.parts("entities", found.where("kind <> 'candidate'").select(F.col("name").alias("canonical_name")))
    entities = commit.held(state.upsert_entities(commit.table("entities", touched), new, top), "entities")
    commit.facts["last_entity"] = max(top, entities.agg(F.max("id")).first()[0] or 0)
    mentions = commit.held(extraction.resolved_mentions(found, entities, heads), "mentions")
    if touched:
        commit.replace("entities", state.bump_last_seen(entities, mentions), touched)

    commit.merge("links", mentions.select("article_id", "entity_id", "arrival_at"), state.insert_dated_links)
    commit.merge("hourly", panels.hourly_rollup(mentions), state.merge_hourly)
    commit.merge("edges", rollups.edge_rollup(mentions), state.merge_edges)
    sightings = commit.held(extraction.sightings(found, heads), "sightings")  # read for every list of a candidate
    commit.merge("candidates", rollups.candidates(sightings), state.merge_candidates)
    if stated is not None:
        commit.merge("relations", rollups.relation_rollup(extraction.resolved_relations(stated(heads), commit.table("entities"), heads)), state.merge_relations)

    n = items.agg(F.count("*")).first()[0]
    inserted = fresh.count()
    counts = {
        "inserted": inserted,
        "duplicates": n - inserted,
        "processed": heads.count(),
        "mentions": mentions.count(),
        "new_entities": commit.facts["last_entity"] - top,
        "candidates": sightings.select("norm").distinct().count(),
    }
    commit.facts["counts"] = counts
    return counts


def ingest_batches(ledger: Ledger, names: Callable[[DataFrame], DataFrame], stated: Callable[[DataFrame], DataFrame] | None = None):
    """A foreachBatch function that commits each micro-batch of items to all tables under its number.

    A batch that is done is not run again; one that broke off anywhere leaves what readers
    see as it was, and is run anew.  The ledger belongs to one stream's checkpoint.
    """

    def run(batch: DataFrame, number: int) -> None:
        commit = ledger.begin(number)
        if commit is None:
            return
        try:
            ingest(commit, batch, names, stated)
            commit.publish()
        finally:
            commit.close()

    return run


def merge_batch(folder: str):
    """A foreachBatch function that keeps the hourly table under ``folder``; ``hourly_table`` reads it."""

    def run(batch: DataFrame, number: int) -> None:
        commit = Ledger(batch.sparkSession, folder, {"hourly": tables()["hourly"]}).begin(number)
        if commit is None:
            return
        try:
            commit.merge("hourly", panels.hourly_rollup(batch), state.merge_hourly)
            commit.publish()
        finally:
            commit.close()

    return run


def hourly_table(spark, folder: str) -> DataFrame:
    """The hourly table that ``merge_batch`` keeps."""
    return Ledger(spark, folder, {"hourly": tables()["hourly"]}).table("hourly")


def hourly_stream(mentions: DataFrame, late: str = "15 days") -> DataFrame:
    """Mentions by entity and hour of a stream, with late mentions taken for ``late``."""
    rows = mentions.withColumn("effective_at", F.col("effective_at").cast("timestamp")).withWatermark("effective_at", late)
    return rows.groupBy("entity_id", F.window("effective_at", "1 hour")).agg(F.count("*").alias("mentions"), F.sum("sentiment").alias("sentiment_sum")).select(
        "entity_id", F.col("window.start").alias("bucket"), "mentions", "sentiment_sum"
    )


def unique_articles(articles: DataFrame, span: str = "48 hours") -> DataFrame:
    """Articles of a stream without those whose content_hash came within ``span`` before."""
    return articles.withWatermark("first_seen_at", span).dropDuplicatesWithinWatermark(["content_hash"])

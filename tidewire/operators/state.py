"""Merging a batch into stored tables.  Every function returns the table's next snapshot."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import LOCK_MINUTES, is_recent
from ..storage import tasks_for
from . import rollups
from .detectors import MOMENT_TYPES

#: What an entity may be.
TYPES = (
    "person", "company", "organization", "government_body", "armed_group",
    "political_party", "country", "region", "city", "product", "technology",
    "financial_asset", "disease", "infrastructure", "other",
)
STATUSES, FAMES = ("tracked", "dismissed"), ("unknown", "not_famous", "famous")
#: Settings and their defaults.
SETTINGS = {"surprise_k": 3.0, "dismiss_cooldown_hours": 72.0, "brief_max_blocks": 10.0, "warmup_days": 7.0, "llm_monthly_budget_usd": 5.0}
ACTIVE = ("new", "seen", "promoted")


def merged(stored: DataFrame, batch: DataFrame, keys: list[str], how: dict[str, str]) -> DataFrame:
    """Upsert by keys.  how says for each other column what to do where both have a row:

    "sum", "least", "greatest", "new" (the batch's) or "old" (the stored one).  Keys are
    dealt to tasks whose number grows with the rows.
    """
    tasks = tasks_for(stored, batch)
    both = stored.repartition(tasks, *keys).alias("s").join(batch.repartition(tasks, *keys).alias("b"), keys, "full_outer")
    made = []
    for column, rule in how.items():
        s, b = F.col(f"s.{column}"), F.col(f"b.{column}")
        made.append(
            {
                "sum": F.when(s.isNull(), b).when(b.isNull(), s).otherwise(s + b),
                "least": F.least(s, b),
                "greatest": F.greatest(s, b),
                "new": F.coalesce(b, s),
                "old": F.coalesce(s, b),
            }[rule].alias(column)
        )
    return both.select(*keys, *made)


def merge_hourly(stored: DataFrame, batch: DataFrame) -> DataFrame:
    return merged(stored, batch, ["entity_id", "bucket"], {"mentions": "sum", "source_count": "greatest", "sentiment_sum": "sum"})


def merge_edges(stored: DataFrame, batch: DataFrame) -> DataFrame:
    return merged(stored, batch, ["entity_a", "entity_b"], {"first_seen_at": "least", "last_seen_at": "greatest", "article_count": "sum"})


def merge_relations(stored: DataFrame, batch: DataFrame) -> DataFrame:
    rules = {"article_count": "sum", "first_seen_at": "old", "last_seen_at": "greatest", "evidence_article_id": "new"}
    return merged(stored, batch, ["source_id", "target_id", "relation"], rules)


def merge_last_seen(stored: DataFrame, batch: DataFrame) -> DataFrame:
    return merged(stored, batch, ["entity_id"], {"first_seen_at": "old", "last_seen_at": "greatest"})


def merge_usage(stored: DataFrame, batch: DataFrame, counters: list[str]) -> DataFrame:
    return merged(stored, batch, ["month"], dict.fromkeys(counters, "sum"))


def merge_candidates(stored: DataFrame, batch: DataFrame) -> DataFrame:
    return rollups.merged_candidates(stored, batch)


def upsert_entities(entities: DataFrame, batch: DataFrame, last: int | None = None) -> DataFrame:
    """Entities after a batch (canonical_name, type, first_seen_at, last_seen_at).

    A known name keeps its row but for a later last_seen_at.  New ones are tracked, of
    unknown fame, and get the next ids in the order of their names.  last: the largest id
    so far, where ``entities`` are only those that the batch can touch.
    """
    b = batch.select("canonical_name", F.col("type").alias("new_type"), F.col("first_seen_at").alias("new_first"), F.col("last_seen_at").alias("new_last"))
    kept = entities.join(b.select("canonical_name", "new_last"), "canonical_name", "left")
    kept = kept.withColumn("last_seen_at", F.greatest("last_seen_at", "new_last")).select(entities.columns)
    top = entities.agg((F.coalesce(F.max("id"), F.lit(0)) if last is None else F.lit(last)).alias("top"))
    fresh = b.join(entities.select("canonical_name"), "canonical_name", "left_anti")
    # ids: names are ranked inside ranges of their hash, and the ranges' sizes give each range its start
    fresh = fresh.withColumn("part", F.pmod(F.xxhash64("canonical_name"), F.lit(64)))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("canonical_name"))
    sizes = fresh.groupBy("part").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.orderBy("part")) - F.col("size")
    fresh = fresh.withColumn("rank", rank).join(F.broadcast(sizes.withColumn("before", before)), "part").join(F.broadcast(top))
    values = {"id": F.col("top") + F.col("before") + F.col("rank"), "type": F.col("new_type"), "status": F.lit("tracked"), "fame": F.lit("unknown"), "first_seen_at": F.col("new_first"), "last_seen_at": F.col("new_last")}
    made = [values[f.name].cast(f.dataType).alias(f.name) if f.name in values else (F.col(f.name) if f.name == "canonical_name" else (F.array() if f.name == "aliases" else F.lit(None)).cast(f.dataType).alias(f.name)) for f in entities.schema]
    return kept.unionByName(fresh.select(made))


def bump_last_seen(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities with the latest arrival of their mentions as last_seen_at, if that is later."""
    latest = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.max("arrival_at").alias("latest"))
    return entities.join(latest, "id", "left").withColumn("last_seen_at", F.greatest("last_seen_at", "latest")).select(entities.columns)


def insert_links(article_entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Links of articles and entities with those of mentions that aren't there yet."""
    fresh = mentions.select("article_id", "entity_id").distinct().join(article_entities, ["article_id", "entity_id"], "left_anti")
    return article_entities.select("article_id", "entity_id").unionByName(fresh)


def insert_dated_links(links: DataFrame, batch: DataFrame) -> DataFrame:
    """Links (article_id, entity_id, arrival_at) with those of a batch that aren't there yet."""
    return links.unionByName(batch.dropDuplicates(["article_id", "entity_id"]).join(links, ["article_id", "entity_id"], "left_anti"))


def unprocessed_heads(articles: DataFrame, as_of: str, held: DataFrame | None = None, hours: int | None = 6) -> DataFrame:
    """Heads that arrived in the last hours (None: ever) and are not marked processed, but for those that a batch holds (id)."""
    rows = articles.where("dup_group_id is null and entities_processed_at is null")
    rows = rows if hours is None else rows.where(f"first_seen_at >= {as_of} - interval {hours} hours")
    return rows if held is None else rows.join(held.select("id"), "id", "left_anti")


def still_unprocessed(articles: DataFrame, ids: DataFrame) -> DataFrame:
    """Articles of a batch's ids that no run has marked in the meantime, so that none counts twice."""
    return articles.where("entities_processed_at is null").join(ids.select("id").distinct(), "id", "left_semi")


def mark_processed(articles: DataFrame, ids: DataFrame, as_of: str) -> DataFrame:
    done = ids.select("id").distinct().withColumn("done", F.lit(True))
    rows = articles.join(done, "id", "left")
    return rows.withColumn("entities_processed_at", F.when(F.col("done"), F.expr(as_of)).otherwise(F.col("entities_processed_at"))).select(articles.columns)


def unsuppressed(signals: DataFrame, stored: DataFrame, as_of: str, hours: int = 72) -> DataFrame:
    """Signals not dismissed within the cooldown."""
    dismissed = stored.where(f"state = 'dismissed' and state_changed_at >= {as_of} - interval {hours} hours").select("dedupe_key").distinct()
    return signals.join(dismissed, "dedupe_key", "left_anti")


def purged(signals: DataFrame, famous: DataFrame) -> DataFrame:
    """Signals (type, state, entity_ids) without new ones whose subject is famous, or of links whose ends both are.

    famous: (entity_id, famous).
    """
    stars = famous.where("famous").select(F.col("entity_id").alias("star")).distinct()
    end = lambda k: stars.select(F.col("star").alias(f"end_{k}"), F.lit(True).alias(f"star_{k}"))
    rows = signals.withColumns({"end_0": F.get("entity_ids", F.lit(0)), "end_1": F.get("entity_ids", F.lit(1))})
    rows = rows.join(end(0), "end_0", "left").join(end(1), "end_1", "left")
    first, second = F.coalesce("star_0", F.lit(False)), F.coalesce("star_1", F.lit(False))
    gone = (F.col("type").isin(*MOMENT_TYPES) & first) | ((F.col("type") == "novel_edge") & (F.size("entity_ids") == 2) & first & second)
    return rows.where(~((F.col("state") == "new") & gone)).select(signals.columns)


def persist_counts(stored: DataFrame, signals: DataFrame, as_of: str, hours: int = 72) -> DataFrame:
    """One row: how many signals a run creates, refreshes and suppresses."""
    fresh = unsuppressed(signals, stored, as_of, hours)
    active = stored.where(F.col("state").isin(*ACTIVE)).select("dedupe_key").distinct().withColumn("there", F.lit(True))
    counts = fresh.join(active, "dedupe_key", "left").agg(F.count("*").alias("n"), F.count_if("there").alias("refreshed"))
    return signals.agg(F.count("*").alias("whole")).join(F.broadcast(counts)).select((F.col("n") - F.col("refreshed")).alias("created"), "refreshed", (F.col("whole") - F.col("n")).alias("suppressed"))


def persist_signals(stored: DataFrame, signals: DataFrame, as_of: str) -> DataFrame:
    """Stored signals (dedupe_key, state, confidence, first_detected_at, last_evidence_at, state_changed_at) after a run.

    An active row of the same key is refreshed, never its state.  Otherwise a signal
    becomes a new row, unless it is suppressed.
    """
    now = F.expr(as_of)
    fresh = unsuppressed(signals, stored, as_of).select("dedupe_key", F.col("confidence").alias("now_confidence"))
    active = stored.where(F.col("state").isin(*ACTIVE))
    refreshed = active.join(fresh, "dedupe_key", "left").select(
        "dedupe_key",
        "state",
        F.coalesce("now_confidence", "confidence").alias("confidence"),
        "first_detected_at",
        F.when(F.col("now_confidence").isNotNull(), now).otherwise(F.col("last_evidence_at")).alias("last_evidence_at"),
        "state_changed_at",
    )
    made = fresh.join(active, "dedupe_key", "left_anti").select(
        "dedupe_key", F.lit("new").alias("state"), F.col("now_confidence").alias("confidence"), now.alias("first_detected_at"), now.alias("last_evidence_at"), F.lit(None).cast("timestamp_ntz").alias("state_changed_at")
    )
    rest = stored.where(~F.col("state").isin(*ACTIVE)).select(refreshed.columns)
    return refreshed.unionByName(made).unionByName(rest)


def transition(stored: DataFrame, changes: DataFrame, as_of: str) -> DataFrame:
    """States after asked changes (dedupe_key, action): active rows may go anywhere, a dismissed one reopens, all else stays."""
    to = F.expr("case when state in ('new', 'seen', 'promoted') and action in ('seen', 'dismissed', 'promoted') then action when state = 'dismissed' and action = 'reopen' then 'new' end")
    rows = stored.join(changes.dropDuplicates(["dedupe_key"]), "dedupe_key", "left").withColumn("to", to)
    return rows.withColumn("state_changed_at", F.when(F.col("to").isNotNull(), F.expr(as_of)).otherwise(F.col("state_changed_at"))).withColumn("state", F.coalesce("to", "state")).drop("to", "action")


def kept_articles(articles: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return articles.where(f"first_seen_at >= {as_of} - interval {days} days")


def regrouped(articles: DataFrame) -> DataFrame:
    """Kept articles; a group whose head is gone is no group any more."""
    heads = articles.select(F.col("id").alias("dup_group_id"), F.lit(True).alias("there"))
    rows = articles.join(heads, "dup_group_id", "left")
    return rows.withColumn("dup_group_id", F.when(F.col("there"), F.col("dup_group_id"))).select(articles.columns)


def kept_hourly(hourly: DataFrame, as_of: str, days: int = 180) -> DataFrame:
    return hourly.where(f"bucket >= {as_of} - interval {days} days")


def kept_candidates(candidates: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    return candidates.where(f"last_seen_at >= {as_of} - interval {days} days")


def expired(signals: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """New signals of a moment without evidence for ``days``; a link's signal never expires."""
    return signals.where((F.col("state") == "new") & F.col("type").isin(*MOMENT_TYPES)).where(f"last_evidence_at < {as_of} - interval {days} days")


def kept_signals(signals: DataFrame, as_of: str, dismissed_days: int = 90, days: int = 7) -> DataFrame:
    """Signals without expired ones and without those dismissed long ago."""
    moment = F.col("type").isin(*MOMENT_TYPES)
    rows = signals.where(F.expr(f"not (state = 'dismissed' and coalesce(state_changed_at < {as_of} - interval {dismissed_days} days, false))"))
    return rows.where(~((F.col("state") == "new") & moment & F.expr(f"last_evidence_at < {as_of} - interval {days} days")))


def kept_links(article_entities: DataFrame, articles: DataFrame) -> DataFrame:
    """Links whose article is still there."""
    return article_entities.join(articles.select(F.col("id").alias("article_id")), "article_id", "left_semi")


def kept_evidence(relations: DataFrame, articles: DataFrame) -> DataFrame:
    """Relations; evidence whose article is gone becomes null."""
    there = articles.select(F.col("id").alias("evidence_article_id"), F.lit(True).alias("there"))
    rows = relations.join(there, "evidence_article_id", "left")
    return rows.withColumn("evidence_article_id", F.when(F.col("there"), F.col("evidence_article_id"))).select(relations.columns)


def repaired_times(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities' first and last seen, from the arrivals of their articles; an entity without one keeps its times."""
    times = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.min("arrival_at").alias("first"), F.max("arrival_at").alias("last"))
    rows = entities.join(times, "id", "left")
    return rows.withColumns({"first_seen_at": F.coalesce("first", "first_seen_at"), "last_seen_at": F.coalesce("last", "last_seen_at")}).select(entities.columns)


def clamped_edges(edges: DataFrame, articles: DataFrame) -> DataFrame:
    """Links whose times are no earlier than the first article of all; without an article they stay."""
    epoch = articles.agg(F.min("first_seen_at").alias("epoch"))
    rows = edges.join(F.broadcast(epoch))
    return rows.withColumns({c: F.greatest(c, "epoch") for c in ("first_seen_at", "last_seen_at")}).select(edges.columns)


def decided(entities: DataFrame, candidates: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities and candidates after decisions (name_norm, action: accept or dismiss, type), and what came of each item.

    A candidate becomes an entity, tracked with the given type or dismissed with its own,
    unless its name is taken; it goes either way.  An item with a bad name or type, or
    without a candidate, fails alone.  Of several items of a name the first by action counts.
    """
    once = items.groupBy("name_norm").agg(F.min(F.struct("action", "type")).alias("i")).select("name_norm", "i.*")
    c = candidates.select(F.col("norm").alias("name_norm"), "display_name", "type_hint", "first_seen_at", "last_seen_at")
    named = (F.length(F.trim("name_norm")) > 0) & (F.length("name_norm") <= 200)
    fit = (F.col("action") == "dismiss") | F.coalesce(F.col("type").isin(*TYPES), F.lit(False))
    rows = once.join(c, "name_norm", "left")
    error = (
        F.when(~F.coalesce(named, F.lit(False)), "Invalid nameNorm").when(~fit, "type is required for accept").when(F.col("display_name").isNull(), "Candidate not found")
    )
    rows = rows.withColumn("error", error)
    good = rows.where("error is null")
    batch = good.groupBy(F.col("display_name").alias("canonical_name")).agg(F.min(F.struct("name_norm", "action", "type", "type_hint", "first_seen_at", "last_seen_at")).alias("g"))
    batch = batch.select("canonical_name", F.when(F.col("g.action") == "accept", F.col("g.type")).otherwise(F.col("g.type_hint")).alias("type"), "g.first_seen_at", "g.last_seen_at", "g.action")
    fresh = batch.join(entities.select("canonical_name"), "canonical_name", "left_anti")
    after = upsert_entities(entities, fresh.drop("action")).join(fresh.select("canonical_name", "action"), "canonical_name", "left")
    after = after.withColumn("status", F.when(F.col("action") == "dismiss", "dismissed").otherwise(F.col("status"))).select(entities.columns)
    left = candidates.join(good.select(F.col("name_norm").alias("norm")), "norm", "left_anti")
    return after, left, rows.select("name_norm", F.col("error").isNull().alias("ok"), "error")


def merged_into(entities: DataFrame, candidates: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and candidates after merges (name_norm, merge_into): an entity of that name gets the candidate's names as aliases."""
    c = candidates.select(F.col("norm").alias("name_norm"), "display_name")
    good = merges.join(c, "name_norm").join(entities.select(F.col("canonical_name").alias("merge_into")), "merge_into", "left_semi")
    more = good.groupBy(F.col("merge_into").alias("canonical_name")).agg(F.array_sort(F.collect_list(F.struct("name_norm", "display_name"))).alias("more"))
    rows = entities.join(more, "canonical_name", "left")
    names = F.flatten(F.transform(F.coalesce("more", F.array()), lambda m: F.array(m["name_norm"], m["display_name"])))
    rows = rows.withColumn("aliases", F.when(F.col("more").isNull(), F.col("aliases")).otherwise(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), names)))
    return rows.select(entities.columns), candidates.join(good.select(F.col("name_norm").alias("norm")), "norm", "left_anti")


def accepted(entities: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates that become entities: those whose name none has yet, one of each name, the smallest norm."""
    once = candidates.groupBy("display_name").agg(F.min("norm").alias("norm"))
    return once.join(entities.select(F.col("canonical_name").alias("display_name")), "display_name", "left_anti")


def patched(stored: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Values of a patch where it has one, else the stored ones."""
    both = stored.alias("s").join(patch.alias("p"), key, "left")
    rest = [F.col(f"s.{c}").alias(c) for c in stored.columns if c not in columns and c != key]
    return both.select(key, *[F.coalesce(f"p.{c}", f"s.{c}").alias(c) for c in columns], *rest)


def patched_entities(entities: DataFrame, patch: DataFrame) -> DataFrame:
    """Entities after a patch (id, type, status, fame, fame_locked; nulls change nothing).

    A patch with an unknown value is left out whole.  Setting the fame locks it unless the
    patch says otherwise.
    """
    allowed = {"type": TYPES, "status": STATUSES, "fame": FAMES}
    good = patch
    for column, values in allowed.items():
        good = good.where(F.col(column).isNull() | F.col(column).isin(*values))
    locked = F.coalesce("fame_locked", F.when(F.col("fame").isNotNull(), F.lit(True)))
    rows = patched(entities, good.withColumn("fame_locked", locked), "id", ["type", "status", "fame", "fame_locked"])
    return rows.select(entities.columns)


def overlaid(settings: DataFrame) -> dict[str, float]:
    """Settings: the defaults with the stored values (key, value: JSON) that are finite numbers; unknown keys are ignored.

    There is a row for each setting, a handful.
    """
    number = F.when(F.expr("schema_of_variant(try_parse_json(value)) rlike '^(BIGINT|DECIMAL|DOUBLE|FLOAT)'"), F.expr("try_variant_get(try_parse_json(value), '$', 'double')"))
    rows = settings.where(F.col("key").isin(*SETTINGS)).select("key", number.alias("n")).where("n is not null and abs(n) < double('infinity')")
    return SETTINGS | {r["key"]: r["n"] for r in rows.collect()}


def may_tick(locked_at, as_of) -> F.Column:
    """Whether a tick may begin: no lock, or one of ten minutes or more ago."""
    return ~is_recent(locked_at, as_of, LOCK_MINUTES)

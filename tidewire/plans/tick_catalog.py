"""Queries over tables that several ticks of the ingest have kept, each with DuckDB SQL for the same rows."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir
from ..streaming import tick
from ..streaming.ledger import Ledger
from . import views as V
from .catalog import query

#: Arrivals from which the second and the third tick begin.
BORDERS = ("2024-01-11 00:00:00", "2024-01-21 00:00:00")
SECOND = "if(event_id % 40 = 0, 100000 + 2 * day(ts) + event_id div 40 % 2, user_id + 1 + event_id % 3)"


def items(spark: SparkSession, d: str) -> DataFrame:
    """All events as feed items: every sixth has the headline of the one before, every twelfth its host, too.

    The summary names the event's user and a second entity or candidate.
    """
    story = lambda n: f"event_id - if(event_id % {n} = {n - 1}, 1, 0)"
    second = f"if({SECOND} >= 100000, concat('Cand ', {SECOND}), concat('Name ', {SECOND}))"
    return V.table(spark, d, "events").selectExpr(
        "event_id as id",
        f"concat('Story ', 1000000 + {story(6)}) as title",
        f"concat('https://news', {story(12)}, '.example.com/a') as link",
        "concat('u', user_id % 7 + event_id % 4) as source_name",
        "event_type as source_category",
        f"concat('Name ', user_id, '|', {second}) as summary",
        "if(event_id % 7 = 0, null, ts) as published_at",
        "ts + make_dt_interval(0, cast(event_id % 3 as int)) as first_seen_at",
    )


def names(articles: DataFrame) -> DataFrame:
    """The names of the summaries: known ones as a dictionary's, with a type, the others as new."""
    rows = articles.select(F.col("id").alias("article_id"), F.posexplode(F.split("summary", r"\|")).alias("seq", "display"))
    number = "cast(split(display, ' ')[1] as long)"
    return rows.selectExpr(
        "article_id",
        "if(display like 'Name %', 'dictionary', 'acronym') as layer",
        "seq",
        "display",
        f"element_at(array('country', 'person', 'company', 'organization'), cast({number} % 4 as int) + 1) as type_hint",
        "cast(null as string) as role_context",
        "cast(null as string) as prominence",
    )


def stated(articles: DataFrame) -> DataFrame:
    """A relation between the two names of each summary, by its category."""
    return articles.selectExpr("id as article_id", "split(summary, '\\\\|')[0] as source", "source_category as relation", "split(summary, '\\\\|')[1] as target")


def ticked(spark: SparkSession, d: str) -> Ledger:
    """The tables after three ticks over all events, by arrival."""
    ledger = Ledger(spark, f"{shared_dir(spark)}/tidewire-ticks-{uuid.uuid4().hex}", tick.tables())
    run, rows = tick.ingest_batches(ledger, names, stated), items(spark, d)
    low, high = (f"timestamp_ntz'{b}'" for b in BORDERS)
    for number, part in enumerate((f"first_seen_at < {low}", f"first_seen_at >= {low} and first_seen_at < {high}", f"first_seen_at >= {high}")):
        run(rows.where(part), number)
    return ledger


@query(
    f"""with all_items as (select event_id as id, event_id - case when event_id % 6 = 5 then 1 else 0 end as story, event_id % 12 = 11 as copy, concat('u', user_id % 7 + event_id % 4) as source_name,
  event_type as relation, user_id, case when event_id % 40 = 0 then 100000 + 2 * day(ts) + event_id // 40 % 2 else user_id + 1 + event_id % 3 end as second_id,
  case when event_id % 7 <> 0 then ts end as published_at, ts + to_hours(event_id % 3) as arrival from events),
items as (select *, coalesce(published_at, arrival) as effective, case when arrival < timestamp '{BORDERS[0]}' then 0 when arrival < timestamp '{BORDERS[1]}' then 1 else 2 end as tick
  from all_items where not copy or id - 1 not in (select id from all_items)),
grouped as (select i.*, (select min({{'a': h.arrival, 'i': h.id}}) from items h where h.story = i.story and h.id <> i.id and (h.arrival < i.arrival or h.arrival = i.arrival and h.id < i.id) and h.arrival >= i.arrival - interval 48 hours).i as head from items i),
heads as (select * from grouped where head is null),
linked as (select id, user_id as entity, arrival, effective, source_name, tick from heads union all select id, second_id, arrival, effective, source_name, tick from heads where second_id < 100000),
hours as (select tick, entity, date_trunc('hour', effective) as bucket, count(*) as n, count(distinct source_name) as sources from linked group by all)
select 'article' as kind, cast(id as varchar) as key, coalesce(head, -1) as n, arrival as first_at, coalesce(published_at, arrival) as last_at, case when head is null then 'processed' else 'member' end as detail from grouped
union all select 'entity', concat('Name ', entity), count(*), min(arrival), max(arrival), ['country', 'person', 'company', 'organization'][entity % 4 + 1] from linked group by entity
union all select 'hour', concat('Name ', entity), cast(sum(n) as bigint), bucket, bucket, cast(max(sources) as varchar) from hours group by entity, bucket
union all select 'edge', concat(least(concat('Name ', user_id), concat('Name ', second_id)), '|', greatest(concat('Name ', user_id), concat('Name ', second_id))), count(*), min(arrival), max(arrival), '' from heads where second_id < 100000 group by all
union all select 'candidate', concat('cand ', second_id), cast(sum(n) as bigint), arg_min(first, tick), max(last), concat('Cand ', second_id) from (
  select second_id, tick, count(*) as n, min(effective) as first, max(effective) as last from heads where second_id >= 100000 group by all) group by second_id
union all select 'relation', concat('Name ', user_id, '|Name ', second_id, '|', relation), count(*), min(arrival), max(arrival), cast(arg_max(id, {{'a': arrival, 'i': id}}) as varchar) from heads where second_id < 100000 group by user_id, second_id, relation
"""
)
def ingest_ticks(spark, d):
    """What three committed ticks leave in all tables, in one list."""
    ledger = ticked(spark, d)
    manifest = ledger.latest()
    table = lambda name: ledger.table(name, manifest=manifest)
    named = lambda end: table("entities").selectExpr(f"id as {end}", f"canonical_name as {end}_name")
    links = table("links").groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n"))
    lists = [
        table("articles").selectExpr("'article'", "cast(id as string)", "coalesce(dup_group_id, -1)", "first_seen_at", "coalesce(published_at, first_seen_at)", "case when entities_processed_at is not null then 'processed' when dup_group_id is not null then 'member' end"),
        table("entities").join(links, "id").selectExpr("'entity'", "canonical_name", "n", "first_seen_at", "last_seen_at", "type"),
        table("hourly").join(named("entity_id"), "entity_id").selectExpr("'hour'", "entity_id_name", "mentions", "bucket", "bucket", "cast(source_count as string)"),
        table("edges").join(named("entity_a"), "entity_a").join(named("entity_b"), "entity_b").selectExpr("'edge'", "concat(least(entity_a_name, entity_b_name), '|', greatest(entity_a_name, entity_b_name))", "article_count", "first_seen_at", "last_seen_at", "''"),
        table("candidates").selectExpr("'candidate'", "norm", "mention_count", "first_seen_at", "last_seen_at", "display_name"),
        table("relations").join(named("source_id"), "source_id").join(named("target_id"), "target_id").selectExpr("'relation'", "concat(source_id_name, '|', target_id_name, '|', relation)", "article_count", "first_seen_at", "last_seen_at", "cast(evidence_article_id as string)"),
    ]
    columns = ("kind", "key", "n", "first_at", "last_at", "detail")
    out = lists[0].toDF(*columns)
    for rows in lists[1:]:
        out = out.unionByName(rows.toDF(*columns))
    return out

"""Queries on what a desk decides and is shown: statistics, counts of a run, decisions, evidence, cascades."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, panels, reports, state
from . import views as V
from .catalog import D_NOW, NOW, SIGNALS_SQL, _stored_signals, query

_CHECKED = "case when s_acctbal < 2000 then null else timestamp{ntz}'2024-01-01 00:00:00' + {hours} end"


@query(
    f"""with e as (select case when s_suppkey % 10 = 0 then 'dismissed' else 'tracked' end as status, case when s_acctbal > 7000 then 'famous' when s_acctbal > 4000 then 'not_famous' else 'unknown' end as fame,
  s_nationkey = 3 as fame_locked, {_CHECKED.format(ntz='', hours='to_hours(s_suppkey % 500)')} as checked_at from supplier)
select count(*) filter (status = 'tracked') as total_tracked, count(*) filter (status = 'tracked' and fame = 'famous') as famous, count(*) filter (status = 'tracked' and fame = 'not_famous') as not_famous,
  count(*) filter (status = 'tracked' and fame = 'unknown') as unknown, count(*) filter (status = 'tracked' and fame = 'unknown' and checked_at is not null) as parked,
  count(*) filter (status = 'tracked' and checked_at is null) as never_checked, count(*) filter (status = 'tracked' and fame_locked) as locked,
  min(checked_at) filter (status = 'tracked') as oldest_checked_at, max(checked_at) filter (status = 'tracked') as newest_checked_at from e"""
)
def fame_stats(spark, d):
    """The nine counts and times of tracked entities' fame."""
    rows = V.table(spark, d, "supplier").selectExpr(
        "if(s_suppkey % 10 = 0, 'dismissed', 'tracked') as status",
        "case when s_acctbal > 7000 then 'famous' when s_acctbal > 4000 then 'not_famous' else 'unknown' end as fame",
        "s_nationkey = 3 as fame_locked",
        f"{_CHECKED.format(ntz='_ntz', hours='make_dt_interval(0, cast(s_suppkey % 500 as int))')} as checked_at",
    )
    return panels.fame_stats(rows)


@query(
    f"""with {SIGNALS_SQL} select (select count(*) from fresh where dedupe_key not in (select dedupe_key from stored where state <> 'dismissed')) as created,
  (select count(*) from fresh where dedupe_key in (select dedupe_key from stored where state <> 'dismissed')) as refreshed, (select count(*) from found) - (select count(*) from fresh) as suppressed"""
)
def signal_counts(spark, d):
    """How many signals a run over all suppliers creates, refreshes and suppresses."""
    signals = V.table(spark, d, "supplier").selectExpr("concat(if(s_suppkey % 3 = 0, 'n', 'k'), s_suppkey) as dedupe_key", "cast(0.75 as double) as confidence")
    return state.persist_counts(_stored_signals(spark, d), signals, NOW)


_ITEMS = (
    "case when c_acctbal < -900 then '  ' when c_acctbal < -800 then concat('nobody ', c_custkey) else lower(c_name) end as name_norm",
    "case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'dismiss' else 'accept' end as action",
    "case c_nationkey % 5 when 0 then 'country' when 1 then 'company' when 2 then 'person' when 3 then 'planet' end as type",
)


@query(
    f"""with items as (select distinct {', '.join(_ITEMS)} from customer), once as (select name_norm, min({{'a': action, 't': coalesce(type, '')}}).a as action, nullif(min({{'a': action, 't': coalesce(type, '')}}).t, '') as type from items group by name_norm),
judged as (select o.name_norm, action, type, c_name, case when trim(o.name_norm) = '' then 'Invalid nameNorm' when action = 'accept' and coalesce(type, '') not in ('country', 'company', 'person') then 'type is required for accept' when c_name is null then 'Candidate not found' end as error
  from once o left join customer on lower(c_name) = o.name_norm)
select 'item' as kind, name_norm as name, coalesce(error, 'ok') as outcome from judged
union all select 'entity', c_name, case when action = 'accept' then concat('tracked ', type) else 'dismissed other' end from judged where error is null
union all select 'left', lower(c_name), '' from customer where lower(c_name) not in (select name_norm from judged where error is null)"""
)
def decided_candidates(spark, d):
    """What all customers' items, as decisions on candidates of their names, do: outcomes, entities made and candidates left."""
    customers = V.table(spark, d, "customer")
    candidates = customers.selectExpr("lower(c_name) as norm", "c_name as display_name", "'other' as type_hint", f"{NOW} as first_seen_at", f"{NOW} as last_seen_at")
    entities = V.entities(spark, d).selectExpr("*", f"{NOW} as first_seen_at", f"{NOW} as last_seen_at")
    after, left, outcomes = state.decided(entities, candidates, customers.selectExpr(*_ITEMS))
    made = after.join(entities.select("canonical_name"), "canonical_name", "left_anti")
    return (
        outcomes.selectExpr("'item' as kind", "name_norm as name", "coalesce(error, 'ok') as outcome")
        .unionByName(made.selectExpr("'entity' as kind", "canonical_name as name", "concat(status, ' ', type) as outcome"))
        .unionByName(left.selectExpr("'left' as kind", "norm as name", "'' as outcome"))
    )


@query(
    V.with_views("articles")
    + """, signals as (select o_custkey as id, list(o_orderkey % 2000 order by o_orderdate, o_orderkey) as ids from orders group by o_custkey),
listed as (select id, unnest(ids) as article_id, cast(unnest(range(0, len(ids))) as integer) as place from signals)
select l.id, place, article_id, title, link, source_name from listed l join articles a on a.id = article_id"""
)
def signal_evidence(spark, d):
    """The articles of each customer's signal, in the order of its list; those that are gone are left out."""
    rows = V.table(spark, d, "orders").selectExpr("o_custkey as id", "struct(o_orderdate, o_orderkey, o_orderkey % 2000 as article_id) as a")
    signals = rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("a")), lambda a: a["article_id"]).alias("article_ids"))
    return reports.evidence_articles(signals, V.articles(spark, d))


def _stories(spark, d):
    return V.table(spark, d, "events").selectExpr("concat('user ', user_id) as name", "element_at(array('Conflict', 'Cyber Threats', 'Economic/Energy', 'Gossip'), cast(event_id * 7 % 4 as int) + 1) as category")


@query(
    """with counted as (select user_id, ['Conflict', 'Cyber Threats', 'Economic/Energy', 'Gossip'][event_id * 7 % 4 + 1] as c, count(*) as n from events group by all),
usual as (select user_id, arg_min(c, {'n': -n, 'c': c}) as c from counted group by user_id)
select user_id as seq, case when user_id % 3 = 0 then 'critical' else 'warning' end as severity, case c when 'Conflict' then 'military' when 'Cyber Threats' then 'cyber' else 'energy' end as domain, 1 as rank from usual where c <> 'Gossip'"""
)
def signal_domains(spark, d):
    """The domain of each user's signal, by the category that is most frequent among the user's events."""
    signals = V.table(spark, d, "events").select("user_id").distinct().selectExpr("user_id as seq", "if(user_id % 3 = 0, 'critical', 'warning') as severity", "array(concat('user ', user_id)) as names")
    return graph.domains(signals, _stories(spark, d))

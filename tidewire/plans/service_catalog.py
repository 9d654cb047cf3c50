"""Queries on what is asked of other services: sweeps that stop, requests that are packed and paid for."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import fame, requests
from . import views as V
from .catalog import query

_ATTEMPTS = (
    "user_id * 100 + cast(floor(day(ts) / 8) as bigint) as sweep",
    "cast(row_number() over (partition by user_id, floor(day(ts) / 8) order by ts, event_id) - 1 as int) as place",
    "event_id",
    "case when event_type = 'error' then 'failure' else 'success' end as outcome",
    "case when event_type <> 'error' then null when value < 40 then 'search_http_429' when value < 80 then 'pageviews_http_403' else 'search_http_500' end as reason",
    "cast(floor(value * 30) as bigint) as took_ms",
)


@query(
    f"""with attempts as (select {', '.join(_ATTEMPTS)} from events),
chunks as (select sweep, place // 3 as chunk, max(took_ms) as took, bool_or(coalesce(reason, '') in ('search_http_429', 'pageviews_http_403')) as refused from attempts group by all),
so_far as (select *, coalesce(sum(took) over w, 0) as begun, coalesce(bool_or(refused) over w, false) as stopped from chunks window w as (partition by sweep order by chunk rows between unbounded preceding and 1 preceding))
select sweep, a.place, event_id, outcome, reason from attempts a join so_far s using (sweep) where a.place // 3 = s.chunk and begun < 12000 and not stopped"""
)
def swept_attempts(spark, d):
    """Events as attempts of a sweep for each user and part of the month: those made before it stops."""
    attempts = V.table(spark, d, "events").selectExpr(*_ATTEMPTS)
    return fame.swept(attempts).select("sweep", "place", "event_id", "outcome", "reason")


_LEDGER = {"input_tokens": "o_orderkey % 9000", "output_tokens": "o_custkey % 700", "batch_input_tokens": "o_orderkey % 77 * 2", "batch_output_tokens": "o_custkey % 31 * 2"}


@query(
    """with numbered as (select strftime(o_orderdate, '%Y-%m') as batch, row_number() over (partition by strftime(o_orderdate, '%Y-%m') order by o_orderkey) - 1 as n, o_orderkey from orders),
packed as (select batch, n // 25 as request, count(*) as articles, min(o_orderkey) as first_id, max(o_orderkey) as last_id from numbered group by all),
spent as (select strftime(o_orderdate, '%Y-%m') as batch, sum(o_orderkey % 9000) / 1e6 * 1.0 + sum(o_custkey % 700) / 1e6 * 5.0 + sum(o_orderkey % 77 * 2) / 1e6 * 0.5 + sum(o_custkey % 31 * 2) / 1e6 * 2.5 as cost from orders group by all)
select batch, request, articles, first_id, last_id, case when cost >= 1.2 then 'budget_gate' end as reason from packed join spent using (batch)"""
)
def packed_requests(spark, d):
    """All orders as articles of a month's batch, packed into requests in the order of ids; months over the budget are refused."""
    orders = V.table(spark, d, "orders").withColumn("batch", D.month("o_orderdate"))
    usage = orders.groupBy("batch").agg(*[F.sum(F.expr(e).cast("double")).alias(n) for n, e in _LEDGER.items()])
    packed = requests.packed(orders.select("batch", "o_orderkey"), order="o_orderkey")
    ends = packed.groupBy("batch", "request").agg(F.min("o_orderkey").alias("first_id"), F.max("o_orderkey").alias("last_id"))
    return requests.submitted(packed, usage, budget=1.2).join(ends, ["batch", "request"]).select("batch", "request", "articles", "first_id", "last_id", "reason")

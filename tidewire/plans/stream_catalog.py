"""Queries whose rows come out of streams with state, each with DuckDB SQL for the same rows.

A query lands its rows in the order of time, one part after the other, and lets a stream take
each part as a micro-batch, with its state restored from the checkpoint in between.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import remove, shared_dir
from ..streaming import stateful
from . import views as V
from .catalog import CLUSTERS_SQL, RECURSIVE, SIGNED_SQL, _signed, query


def streamed(spark: SparkSession, rows: DataFrame, time, borders: tuple[str, ...], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream gives out over rows that land in parts cut at ``borders`` of a time; rows without one land first."""
    stateful.use_state_store(spark)
    folder = f"{shared_dir(spark)}/tidewire-stream-{uuid.uuid4().hex}"
    try:
        for part in range(len(borders) + 1):
            place = sum((F.coalesce(time >= F.expr(f"timestamp_ntz'{b}'"), F.lit(False))).cast("int") for b in borders)
            rows.where(place == part).write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
            sink = run(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
            sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for name in ("in", "state"):
            remove(spark, f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/out")


@query(RECURSIVE + f", {SIGNED_SQL}, {CLUSTERS_SQL} select * from heads")
def stream_clusters(spark, d):
    """The clusters of ``story_clusters``, from a stream of the articles in three parts."""
    articles = _signed(spark, d).select("id", "title_signature", "published_at", "first_seen_at")
    time = F.coalesce("published_at", "first_seen_at")
    return streamed(spark, articles, time, ("2024-01-09 12:00:00", "2024-01-22 00:00:00"), stateful.cluster_heads)


@query(
    """with seen as (select concat(least(concat('c', o_custkey), o_orderpriority), '|', greatest(concat('c', o_custkey), o_orderpriority)) as key, o_orderdate as seen_at, o_orderkey as id,
  lag(o_orderdate) over (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey) as before from orders),
runs as (select *, coalesce(seen_at - before < interval 30 days, false) as known, sum(case when coalesce(seen_at - before < interval 30 days, false) then 0 else 1 end) over (partition by key order by seen_at, id) as run from seen)
select key, seen_at, known, min(seen_at) over (partition by key, run) as first_seen_at, row_number() over (partition by key, run order by seen_at, id) as n from runs"""
)
def stream_links(spark, d):
    """The history of links between customers and priorities, from a stream of all orders; what is older than thirty days is forgotten."""
    links = V.table(spark, d, "orders").selectExpr("concat('c', o_custkey) as a", "o_orderpriority as b", "o_orderdate as seen_at", "1L as n")
    return streamed(spark, links, F.col("seen_at"), ("1994-06-01 00:00:00", "1997-01-01 00:00:00"), stateful.link_history)


@query(
    """with recursive samples as (select concat('user ', user_id) as key, ts, min(cast(floor(value) as bigint)) as n from events group by user_id, ts),
jumps as (select *, min(ts) over (partition by key order by ts range between interval 55 minutes following and unbounded following) as next from samples),
counted as (select key, ts, n, next from (select *, row_number() over (partition by key order by ts) as k from jumps) where k = 1
  union all select j.key, j.ts, j.n, j.next from counted c join jumps j on j.key = c.key and j.ts = c.next)
select key, ts as seen_at, cast(count(*) over w as integer) as slots, avg(n) over w as rate from counted window w as (partition by key order by ts rows between 167 preceding and current row)"""
)
def stream_baselines(spark, d):
    """The baseline of each user's values after each sample that counts, from a stream of all events."""
    samples = V.table(spark, d, "events").selectExpr("concat('user ', user_id) as name", "ts as seen_at", "cast(floor(value) as bigint) as mentions")
    return streamed(spark, samples, F.col("seen_at"), ("2024-01-08 00:00:00", "2024-01-20 12:00:00"), stateful.baselines)

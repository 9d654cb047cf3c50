"""Steps whose tasks grow with the rows, so that one task's share doesn't."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewire import storage
from tidewire.functions import language as L
from tidewire.functions import text as T
from tidewire.operators import graph, reports, rollups, state, stories

DAY = dt.datetime(1995, 1, 1)


@pytest.fixture
def linked(spark, tmp_path, monkeypatch):
    """Two entities in each of 400 articles, in a file; a task gets 50 rows."""
    monkeypatch.setattr(storage.tasks_for, "__kwdefaults__", {"each": 50})
    rows = [(i // 2, i % 2 + i // 2 % 37, DAY + dt.timedelta(i // 2)) for i in range(800)]
    spark.createDataFrame(rows, "article_id long, entity_id long, arrival_at timestamp_ntz").write.parquet(f"{tmp_path}/linked")
    return spark.read.parquet(f"{tmp_path}/linked")


def test_tasks_grow_with_the_rows_of_files(spark, linked, monkeypatch):
    assert storage.tasks_for(linked) == 16 and storage.tasks_for(linked, linked.where("article_id = 1")) == 32
    assert storage.tasks_for(linked.selectExpr("article_id + 1 as x").distinct()) == 16
    assert storage.tasks_for(spark.range(9).toDF("x")) == 4


def test_links_are_dealt_to_as_many_tasks(linked):
    edges = rollups.edge_rollup(linked)
    assert edges.rdd.getNumPartitions() == 16
    assert {tuple(r) for r in edges.select("entity_a", "entity_b", "article_count").collect()} == {(k, k + 1, 11 if k < 30 else 10) for k in range(37)}
    assert graph.top_partners(edges).rdd.getNumPartitions() == 32
    found = graph.pair_evidence(linked, edges)
    assert found.count() == 37 * 5
    assert {r["article_id"] for r in found.where("rank = 1 and entity_a < 30").collect()} == set(range(370, 400))
    assert state.merge_edges(edges, edges).rdd.getNumPartitions() == 32
    counts = edges.selectExpr("concat(entity_a, '|', entity_b) as pair", "article_count as count")
    history = counts.selectExpr("pair", "count", "timestamp_ntz'1995-01-01' as last_seen")
    assert reports.merged_history(history, counts, "timestamp_ntz'1995-01-02'").rdd.getNumPartitions() == 32


def test_signatures_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def signature(title):
        made.add(1)
        return title

    rows = spark.range(120).selectExpr("id", "concat('t', id % 9) as title", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int)) as first_seen_at", "cast(null as timestamp_ntz) as published_at")
    rows = rows.withColumn("title_signature", signature("title"))
    assert len({r["head_id"] for r in stories.clusters(rows).collect()}) == 27
    assert made.value == 120
    assert stories.duplicate_groups(rows).count() == 120 - 9
    assert made.value == 240


def test_a_title_is_normalised_once_for_its_signature(spark):
    rows = spark.createDataFrame([("The of",), ("War &amp; Peace",), ("",), (None,)], "title string").select(T.title_signature("title").alias("s"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("&(?:amp") <= 1
    assert [r["s"] for r in rows.collect()] == ["the of", "peace|war", "", None]


def test_a_text_is_split_once_for_its_sentiment(spark):
    rows = spark.createDataFrame([("great attack",), ("",), (None,)], "t string").select(L.sentiment("t").alias("s"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 1
    assert [r["s"] for r in rows.collect()][1:] == [0.0, 0.0]

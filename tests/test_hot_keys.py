"""A headline that comes very often, at many times or at one, against one pass over sorted rows."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import stories

START = dt.datetime(2024, 1, 1)
SCHEMA = "id long, title_signature string, first_seen_at timestamp_ntz, published_at timestamp_ntz"


@pytest.fixture(scope="module", autouse=True)
def many_slices(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def hot_rows(seed, n):
    draw = random.Random(seed)
    rows = [(i, "wire", START + dt.timedelta(seconds=draw.randrange(48 * 3600))) for i in range(n)]
    rows += [(n + i, "wire", START + dt.timedelta(hours=draw.randrange(500))) for i in range(n // 10)]
    rows += [(2 * n + i, "burst", START) for i in range(n // 10)]
    rows += [(3 * n + i, draw.choice(["", "a", "b", "c"]), START + dt.timedelta(hours=draw.randrange(500))) for i in range(n // 10)]
    draw.shuffle(rows)
    return [(*r, None) for r in rows]


def test_hot_headlines_spread_and_stay_right(spark):
    rows = hot_rows(1, 6000)
    articles = spark.createDataFrame(rows, SCHEMA)
    window, groups, heads = dt.timedelta(hours=48), {}, {}
    by_key = {}
    for id_, key, at, _ in rows:
        by_key.setdefault(key, []).append((at, id_))
    for key, held in by_key.items():
        held.sort()
        first, head = 0, None
        for at, id_ in held:
            while held[first][0] < at - window:
                first += 1
            if held[first][1] != id_:
                groups[id_] = held[first][1]
            if key == "":
                heads[id_] = id_
                continue
            if head is None or at - head[0] > window:
                head = (at, id_)
            heads[id_] = head[1]
    assert {tuple(r) for r in stories.duplicate_groups(articles).collect()} == set(groups.items())
    assert {tuple(r) for r in stories.clusters(articles).collect()} == set(heads.items())


def test_no_slice_holds_much_more_than_its_share(spark):
    articles = spark.createDataFrame(hot_rows(2, 6000), SCHEMA)
    rows = articles.select(F.col("title_signature").alias("key"), F.unix_micros(F.col("first_seen_at").cast("timestamp")).alias("at"), "id")
    moments = rows.groupBy("key", "at").agg(F.min("id").alias("id"))
    sizes = [r["count"] for r in stories._sliced(moments, "moments").groupBy("slice").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / len(sizes)

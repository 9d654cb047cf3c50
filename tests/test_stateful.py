"""Streams with state against one pass over all rows, for random splits into micro-batches."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import stories
from tidewire.streaming import stateful

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    stateful.use_state_store(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def streamed(spark, tmp_path, rows, schema, order, run, seed):
    """All rows that a stream gives out, after batches in the order of time but split and shuffled at random."""
    draw = random.Random(seed)
    rows = sorted(rows, key=order)
    cuts = sorted(draw.sample(range(1, len(rows)), 3))
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        part = rows[a:b]
        draw.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        # one run for each batch: state comes back from the checkpoint
        stream = spark.readStream.schema(schema).parquet(source)
        query = run(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None
    return spark.read.parquet(sink).collect()


def test_heads_of_clusters(spark, tmp_path):
    draw = random.Random(1)
    schema = "id long, title_signature string, published_at timestamp_ntz, first_seen_at timestamp_ntz"
    rows = [(i, draw.choice(["a", "b", "c", "", None]), START + dt.timedelta(hours=draw.randrange(400)) if draw.random() < 0.8 else None, START + dt.timedelta(hours=draw.randrange(400))) for i in range(150)]
    rows += [(900, "edge", START, START), (901, "edge", START + dt.timedelta(hours=48), START), (902, "edge", START + dt.timedelta(hours=48, microseconds=1), START), (903, "a", None, None)]
    got = streamed(spark, tmp_path, rows, schema, lambda r: (r[2] or r[3] or START, r[0]), stateful.cluster_heads, 5)
    expected = {tuple(r) for r in stories.clusters(spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == len(rows) and {tuple(r) for r in got} == expected
    assert {(900, 900), (901, 900), (902, 902), (903, 903)} <= expected


def brute_memory(rows, limit, closed):
    entries, out = {}, []
    for key, at, n in sorted(rows, key=lambda r: (r[1], r[2])):
        entry = entries.get(key)
        known = entry is not None and (at - entry[1] < limit or closed and at - entry[1] == limit)
        entries[key] = entry = (entry[0], at, entry[2] + n) if known else (at, at, n)
        out.append((key, at, known, entry[0], entry[2]))
    return sorted(out)


def test_links_are_forgotten_after_thirty_days(spark, tmp_path):
    draw = random.Random(2)
    rows = [(draw.choice("ab"), draw.choice("bc"), START + dt.timedelta(days=draw.choice([0, 1, 20, 31, 50, 61, 91, 130]), hours=draw.randrange(5)), draw.randrange(1, 4)) for _ in range(60)]
    rows += [("x", "y", START, 1), ("y", "x", START + dt.timedelta(days=30) - dt.timedelta(microseconds=1), 2), ("x", "y", START + dt.timedelta(days=60) - dt.timedelta(microseconds=1), 4), ("x", None, START, 1)]
    schema = "a string, b string, seen_at timestamp_ntz, n long"
    got = streamed(spark, tmp_path, rows, schema, lambda r: (r[2], r[3]), stateful.link_history, 6)
    keyed = [("|".join(sorted(r[:2])), r[2], r[3]) for r in rows if r[1] is not None]
    assert sorted(map(tuple, got)) == brute_memory(keyed, dt.timedelta(days=30), False)


def test_names_are_known_for_two_hours(spark, tmp_path):
    draw = random.Random(3)
    rows = [(draw.choice(["n1", "n2", "n3"]), START + dt.timedelta(minutes=30 * draw.randrange(60))) for _ in range(60)] + [(None, START)]
    got = streamed(spark, tmp_path, rows, "name string, seen_at timestamp_ntz", lambda r: (r[1], r[0] or ""), stateful.names_seen, 7)
    assert sorted(map(tuple, got)) == brute_memory([(n, at, 1) for n, at in rows if n], dt.timedelta(hours=2), True)


def test_rings_of_samples(spark, tmp_path):
    draw = random.Random(4)
    rows = [(draw.choice(["e1", "e2"]), START + dt.timedelta(minutes=5 * i), draw.randrange(9)) for i in range(300)]
    rows += [("e3", START, 1), ("e3", START + dt.timedelta(minutes=55), 3), ("e3", START + dt.timedelta(minutes=109), 5), (None, START, 1)]
    got = streamed(spark, tmp_path, rows, "name string, seen_at timestamp_ntz, mentions long", lambda r: (r[1], r[2]), lambda s: stateful.baselines(s, slots=7), 8)
    rings, last, expected = {}, {}, []
    for name, at, n in sorted((r for r in rows if r[0]), key=lambda r: (r[1], r[2])):
        if name in last and at - last[name] < dt.timedelta(minutes=55):
            continue
        last[name] = at
        rings[name] = [*rings.get(name, []), n][-7:]
        expected.append((name, at, len(rings[name]), sum(rings[name]) / len(rings[name])))
    assert sorted(map(tuple, got)) == sorted(expected)
    assert [r[3] for r in sorted(expected) if r[0] == "e3"] == [1.0, 2.0]


def test_state_is_dropped_when_its_time_is_over(spark, tmp_path):
    schema = "name string, seen_at timestamp_ntz"
    rows = [("old", START), ("new", START + dt.timedelta(hours=9)), ("newer", START + dt.timedelta(hours=10)), ("last", START + dt.timedelta(hours=11))]
    source, left = str(tmp_path / "in"), []
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(source)
        query = stateful.names_seen(spark.readStream.schema(schema).parquet(source)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        left.append([p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1])
    # two hours after "old" the watermark of a later batch drops it; what stays is bounded by the window
    assert left[-1] <= left[0] * 3


def test_keys_share_the_state_of_their_bucket(spark, tmp_path):
    schema = "a string, b string, seen_at timestamp_ntz, n long"
    rows = [[(f"x{i}", "y", START + dt.timedelta(days=40 * batch, hours=i % 3), 1) for i in range(300) if batch < 2 or i < 5] for batch in range(3)]
    source, sink, checkpoint = (str(tmp_path / name) for name in ("in", "out", "cp"))
    for batch in rows:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = stateful.link_history(spark.readStream.schema(schema).parquet(source), buckets=4)
        query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        # a bucket's entries are one row, and so is its timer, but for the index over timers
        assert [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1] <= 3 * 4
    got = spark.read.parquet(sink).collect()
    assert len(got) == 605 and not any(r["known"] for r in got)
    # links that are over leave the bucket, the newest stay in it
    held = spark.read.format("statestore").option("stateVarName", "held").load(checkpoint).selectExpr("explode(value.key) as key")
    assert {r["key"] for r in held.collect()} == {f"x{i}|y" for i in range(5)}

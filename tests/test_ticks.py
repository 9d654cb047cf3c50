"""Ticks that break off anywhere, merges that rewrite only what they touch, readers that see whole commits."""
import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import panels, state
from tidewire.plans import tick_catalog
from tidewire.streaming import tick
from tidewire.streaming.ledger import PART, Commit, Ledger, Table

START = dt.datetime(2024, 1, 1)
ITEMS = "id long, title string, link string, source_name string, source_category string, summary string, published_at timestamp_ntz, first_seen_at timestamp_ntz"


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """Ticks of a handful of rows are many small jobs."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def items(seed, n=60, first=0):
    draw = random.Random(seed)
    rows = []
    for i in range(first, first + n):
        at = START + dt.timedelta(hours=i)
        title = f"Story {1000 + draw.randrange(n)} told" if draw.random() < 0.9 else None
        known = f"Name {draw.randrange(6)}|" + (f"Name {draw.randrange(6)}" if draw.random() < 0.7 else f"Cand {100000 + draw.randrange(3)}")
        rows.append((i, title, f"https://h{draw.randrange(3)}.example.com/{i}", f"s{draw.randrange(4)}", draw.choice(["deal", "talk"]), known, at if i % 5 else None, at))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, ITEMS)


def content(ledger):
    return {name: sorted(map(str, (tuple(r) for r in ledger.table(name).collect()))) for name in ledger.tables}


def batches(spark):
    rows = items(1)
    return [frame(spark, rows[:25]), frame(spark, rows[20:40]), frame(spark, [])]


@pytest.fixture(scope="module")
def clean(spark, tmp_path_factory):
    ledger = Ledger(spark, f"file://{tmp_path_factory.mktemp('clean')}", tick.tables(parts=3))
    run = tick.ingest_batches(ledger, tick_catalog.names, tick_catalog.stated)
    for number, batch in enumerate(batches(spark)):
        run(batch, number)
    return ledger


class Killed(Exception):
    pass


def test_a_tick_that_breaks_off_after_any_write_leaves_what_a_clean_run_leaves(spark, tmp_path, clean, monkeypatch):
    expected, made, turn, last = content(clean), batches(spark), {"left": None, "count": 0}, []
    replace, publish = Commit.replace, Ledger._publish

    def killed_replace(self, name, *rest):
        replace(self, name, *rest)
        turn["count"] += 1
        if turn["left"] is not None:
            turn["left"] -= 1
            if turn["left"] < 0:
                raise Killed(name)

    def killed_publish(self, *rest):
        if turn["left"] == 0:
            raise Killed("manifest")
        publish(self, *rest)

    monkeypatch.setattr(Commit, "replace", killed_replace)
    monkeypatch.setattr(Ledger, "_publish", killed_publish)
    ledger = Ledger(spark, f"file://{tmp_path}", tick.tables(parts=3))
    run = tick.ingest_batches(ledger, tick_catalog.names, tick_catalog.stated)
    run(made[0], 0)
    writes, before = turn["count"], content(ledger)
    assert writes == len(ledger.tables)
    for kill in range(writes + 1):
        turn["left"] = kill
        with pytest.raises(Killed) as died:
            run(made[1], 1)
        last.append(str(died.value))
        # whatever was written, readers still see the tick before
        if kill in (0, writes - 1, writes):
            assert ledger.latest()["number"] == 0 and content(ledger) == before
    assert last[-1] == "manifest" and set(last[:-1]) == set(ledger.tables)
    turn["left"] = None
    run(made[1], 1)
    run(made[1], 1)  # a stream may hand a batch over again
    run(made[2], 2)
    assert content(ledger) == expected
    assert ledger.latest()["number"] == 2


def test_counts_and_what_a_tick_holds(spark, clean):
    articles = {r.id: r for r in clean.table("articles").collect()}
    rows = items(1)[:40]
    assert len(articles) == len({(r[1] or "", r[2].split("/")[2]) for r in rows})
    assert all((a.dup_group_id is None) == (a.entities_processed_at is not None) for a in articles.values())
    links = {(r.article_id, r.entity_id) for r in clean.table("links").collect()}
    names = {r.id: r.canonical_name for r in clean.table("entities").collect()}
    assert len(set(names.values())) == len(names) and sorted(names) == list(range(1, len(names) + 1))
    told = {i: set(r[5].split("|")) for i, r in enumerate(rows)}
    assert {(a, names[e]) for a, e in links} == {(i, n) for i, a in articles.items() if a.dup_group_id is None for n in told[i] if n.startswith("Name")}
    assert sum(r.mentions for r in clean.table("hourly").collect()) == len(links)
    assert clean.latest()["facts"]["last_entity"] == len(names)


def test_a_batch_of_one_entity_rewrites_one_part(spark, tmp_path):
    tables = {"hourly": tick.tables()["hourly"], "edges": tick.tables(parts=8)["edges"]}
    ledger = Ledger(spark, f"file://{tmp_path}", tables)
    schema = "article_id long, entity_id long, effective_at timestamp_ntz, arrival_at timestamp_ntz, source_name string, sentiment double"
    draw = random.Random(2)
    rows = [(i, draw.randrange(40), START + dt.timedelta(hours=draw.randrange(72)), START, f"s{i % 3}", 1.0) for i in range(400)]
    many, one = spark.createDataFrame(rows, schema), spark.createDataFrame([(900, 7, START, START, "s9", -1.0), (901, 7, START, START, "s8", 1.0)], schema)
    edges = spark.createDataFrame([(a, b, START, START, 1) for a in range(10) for b in range(a + 1, 10)], "entity_a long, entity_b long, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, article_count long")
    for number, (mentions, links) in enumerate([(many, edges), (one, edges.where("entity_a = 2 and entity_b = 5"))]):
        commit = ledger.begin(number)
        commit.merge("hourly", panels.hourly_rollup(mentions), state.merge_hourly)
        touched = commit.merge("edges", links, state.merge_edges)
        commit.publish()
    manifest = ledger.latest()
    for name in tables:
        written = [n for n in manifest["tables"][name].values() if n == 1]
        assert len(written) == 1 and len(manifest["tables"][name]) > 5
        assert [d for d in os.listdir(f"{tmp_path}/{name}/1") if d.startswith(PART)] == [f"{PART}={p}" for p, n in manifest["tables"][name].items() if n == 1]
    assert len(touched) == 1
    whole = state.merge_hourly(panels.hourly_rollup(many), panels.hourly_rollup(one))
    assert {tuple(r) for r in ledger.table("hourly").collect()} == {tuple(r) for r in whole.select("entity_id", "bucket", "mentions", "source_count", "sentiment_sum").collect()}
    assert {tuple(r) for r in ledger.table("edges").collect()} == {tuple(r) for r in state.merge_edges(edges, edges.where("entity_a = 2 and entity_b = 5")).collect()}


def test_old_files_go_and_emptied_parts_vanish(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}", {"t": Table("k long, v string", "k")})
    for number in range(5):
        commit = ledger.begin(number)
        rows = spark.createDataFrame([(number % 2, f"n{number}")], "k long, v string")
        commit.merge("t", rows, lambda stored, batch: batch)
        commit.publish()
    assert {tuple(r) for r in ledger.table("t").collect()} == {(0, "n4"), (1, "n3")}
    assert sorted(os.listdir(f"{tmp_path}/manifest")) == [n for n in sorted(os.listdir(f"{tmp_path}/manifest")) if n.startswith((".", "00000000000"))]
    assert {int(n[:12]) for n in os.listdir(f"{tmp_path}/manifest") if n.endswith(".json")} == {3, 4}
    assert not os.path.exists(f"{tmp_path}/t/0/{PART}=0") and os.path.exists(f"{tmp_path}/t/2/{PART}=0")
    commit = ledger.begin(5)
    commit.replace("t", spark.createDataFrame([], "k long, v string"), [0])
    with pytest.raises(ValueError):
        commit.replace("t", spark.createDataFrame([], "k long, v string"), [0])
    commit.publish()
    assert [tuple(r) for r in ledger.table("t").collect()] == [(1, "n3")]
    assert ledger.begin(5) is None and ledger.begin(3) is None


def test_a_stream_of_items_fills_all_tables(spark, tmp_path, clean):
    source = str(tmp_path / "in")
    for batch in batches(spark)[:2]:
        batch.coalesce(1).write.mode("append").parquet(source)
    ledger = Ledger(spark, f"file://{tmp_path}/tables", tick.tables(parts=3))
    stream = spark.readStream.schema(ITEMS).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(source)
    run = stream.writeStream.foreachBatch(tick.ingest_batches(ledger, tick_catalog.names, tick_catalog.stated)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert ledger.latest()["number"] == 1
    got, expected = content(ledger), content(clean)
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in expected.items()}
    assert got["articles"] == expected["articles"] and got["entities"] == expected["entities"]

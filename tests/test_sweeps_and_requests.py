"""Sweeps that stop, requests packed by number, and the tick's lock, against plain loops."""
import datetime as dt
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from tidewire.operators import fame, requests
from tidewire.streaming import lock

START = dt.datetime(2024, 1, 1)


def test_a_sweep_stops_at_a_refusal_or_when_its_time_is_over(spark):
    draw = random.Random(1)
    rows = []
    for sweep in range(60):
        for place in range(draw.randrange(1, 41)):
            bad = draw.random() < 0.1
            reason = draw.choice(["search_http_429", "pageviews_http_403", "search_http_500", "x_http_4290", "timeout"]) if bad else None
            rows.append((sweep, place, "failure" if bad else "success", reason, draw.choice([None, 10, 900, 2500])))
    rows += [(99, 0, "success", "late_http_429", 12_000), (99, 3, "success", None, 1)]
    attempts = spark.createDataFrame(rows, "sweep long, place int, outcome string, reason string, took_ms long")
    expected, aborted = set(), {}
    for sweep in {r[0] for r in rows}:
        own, spent, stop = [r for r in rows if r[0] == sweep], 0, False
        for chunk in range(0, 41, 3):
            those = [r for r in own if chunk <= r[1] < chunk + 3]
            if stop or spent >= 12_000 or not those:
                continue
            expected |= set(those)
            spent += max(r[4] or 0 for r in those)
            stop = any(r[2] == "failure" and r[3] and r[3].endswith(("_http_429", "_http_403")) for r in those)
        aborted[sweep] = stop
    made = fame.swept(attempts)
    assert {tuple(r) for r in made.collect()} == expected and 0 < len(expected) < len(rows)
    tallies = {r.sweep: r for r in fame.sweep_tallies(made.where("sweep <> 99")).collect()}
    assert all(tallies[s].rate_limited == aborted[s] for s in tallies)
    assert fame.swept(attempts.limit(0)).count() == 0


def test_packing_gives_the_numbers_of_one_sort(spark):
    draw = random.Random(2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(draw.choice(["jan", "jan", "jan", "feb", None]), i, "x") for i in draw.sample(range(9000), 1500)]
        articles = spark.createDataFrame(rows, "batch string, id long, n string")
        packed = requests.packed(articles)
        got = {(r.batch, r.id): (r.request, r.place) for r in packed.collect()}
        for batch in ("jan", "feb", None):
            ids = sorted(r[1] for r in rows if r[0] == batch)
            assert [got[batch, i] for i in ids] == [(k // 25, k % 25) for k in range(len(ids))]
        usage = spark.createDataFrame([("jan", 5_000_000, 0, 0, 0)], "batch string, input_tokens long, output_tokens long, batch_input_tokens long, batch_output_tokens long")
        sent = requests.submitted(packed, usage, budget=5.0).collect()
        assert all(r.reason == ("budget_gate" if r.batch == "jan" else None) for r in sent)
        assert sum(r.articles for r in sent) == 1500 and all(r.articles <= 25 for r in sent)
        assert {r.reason for r in requests.submitted(requests.packed(articles, size=30), usage, 5.0).collect()} == {"chunk_too_large"}
        assert requests.packed(articles.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_of_ten_takers_wins_and_again_after_ten_minutes(spark, tmp_path):
    folder = f"file://{tmp_path}/lock"

    def takers(now):
        with ThreadPoolExecutor(10) as pool:
            return sum(pool.map(lambda _: lock.take(spark, folder, now), range(10)))

    assert takers(START) == 1
    assert takers(START + dt.timedelta(minutes=9, seconds=59)) == 0
    assert takers(START + dt.timedelta(minutes=10)) == 1
    assert takers(START + dt.timedelta(minutes=12)) == 0
    assert takers(START + dt.timedelta(minutes=25)) == 1
    (tmp_path / "lock" / "tick9").touch()  # taken by one that died before it wrote the time
    assert takers(dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)) == 0
    assert takers(dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) + dt.timedelta(minutes=11)) == 1

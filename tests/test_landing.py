"""Landed feeds, read at once and as a stream, up to the tables of a tick."""
import datetime as dt
import os

from pyspark.sql import functions as F

from tidewire.operators import extraction
from tidewire.sources import feeds, landing
from tidewire.streaming import tick
from tidewire.streaming.ledger import Ledger

def as_of(_=0):
    return F.to_timestamp(F.lit("2024-01-10 12:00:00"))


TERMS = [("NATO", "NATO", "organization", 1)]


def rss(*items):
    return "<rss><channel>" + "".join(f"<item><title>{t}</title><link>https://x.example.com/{i}</link>{d}</item>" for i, (t, d) in enumerate(items)) + "</channel></rss>"


def date(hours):
    return f"<pubDate>{(dt.datetime(2024, 1, 10, 12) - dt.timedelta(hours=hours)).strftime('%a, %d %b %Y %H:%M:%S')} GMT</pubDate>"


def land(folder, source, name, text, at):
    os.makedirs(f"{folder}/source={source}", exist_ok=True)
    path = f"{folder}/source={source}/{name}.xml"
    with open(path, "w") as file:
        file.write(text)
    os.utime(path, (at, at))


def catalogue(spark):
    rows = [("One", "https://one.example.com/rss", "RSS", "World"), ("7", "https://seven.example.com", "Atom", "World"), ("Gone", "https://gone.example.com", "RSS/Atom", "World"), ("Page", "https://p.example.com", "HTML", "World"), ("Local", "file:///x", "RSS", "World")]
    return spark.createDataFrame(rows, "name string, url string, type string, category string")


def fill(folder):
    land(folder, "One", "a", rss(("Old story", date(3))), 1000)
    land(folder, "7", "a", "<feed><entry><title>Atom story</title><link href='https://a.example.com/1'/><updated>2024-01-10T11:00:00Z</updated></entry></feed>", 1001)
    land(folder, "One", "b", rss(*[(f"NATO story number {i}", date(i)) for i in range(20)], ("Undated", "")), 1002)
    land(folder, "Page", "a", rss(("Never", date(1))), 1003)
    land(folder, "Stranger", "a", rss(("Never", date(1))), 1004)


def test_all_feeds_sorted_with_counts(spark, tmp_path):
    fill(tmp_path)
    catalog, documents = catalogue(spark), landing.landed(spark, f"file://{tmp_path}")
    assert documents.count() == 5
    items = landing.collected(catalog, documents, as_of())
    rows = items.collect()
    assert [r.source_name for r in rows].count("One") == 15 and "Never" not in {r.title for r in rows} and "Old story" not in {r.title for r in rows}
    assert [r.published for r in rows] == sorted((r.published for r in rows), reverse=True)
    assert {r.title for r in rows if r.source_name == "7"} == {"Atom story"}
    assert tuple(landing.counts(catalog, items).first()) == (3, 2, 16)
    newest = landing.latest(documents).join(catalog.selectExpr("name as source_name", "url"), "source_name").where("source_name in ('One', '7')")
    expected = {tuple(r) for r in feeds.items(newest.select("source_name", "url", "xml"), as_of()).collect()}
    assert {tuple(r)[:-1] for r in rows} == expected
    assert landing.collected(catalog, documents.where("false"), as_of()).count() == 0


def test_a_stream_of_feeds_gives_the_same_items_and_fills_the_tables(spark, tmp_path):
    folder, seen = tmp_path / "feeds", []
    fill(folder)
    catalog = catalogue(spark)
    ledger = Ledger(spark, f"file://{tmp_path}/tables", tick.tables(parts=2))
    ingest = tick.ingest_batches(ledger, lambda heads: extraction.found_names(heads, spark.createDataFrame(TERMS, "term string, canonical string, type string, place int")))

    def take(items, number):
        seen.extend((number, tuple(r)) for r in items.collect())
        ingest(landing.articles(items, as_of()), number)

    stream = landing.landing(spark, f"file://{folder}", files=2)
    query = stream.writeStream.foreachBatch(landing.collect_batches(catalog, as_of, take)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = {tuple(r) for r in landing.collected(catalog, landing.landed(spark, f"file://{folder}"), as_of()).collect()}
    # the first micro-batch also has what a later document of its source replaces
    assert {r for _, r in seen} == batch | {r for n, r in seen if n == 0}
    assert {n for n, _ in seen} == {0, 1}
    articles = ledger.table("articles").collect()
    assert len(articles) == len({r[2] for _, r in seen}) == 17
    assert {r.canonical_name for r in ledger.table("entities").collect()} == {"NATO"}

"""Operators that no SQL over the test tables covers."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewire.functions import dates, language, text
from tidewire.operators import graph, panels, state, stories
from tidewire.sources import feeds
from tidewire.streaming import tick


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "raw, plain",
    [
        ("<b>A</b> &amp;lt;i&amp;gt; b", "A b"),
        ("x &#8217; y&nbsp;&quot;z&quot;", 'x y "z"'),
        ("", ""),
        (None, None),
        ("<p>a</p>\n\n<p>b", "a b"),
    ],
)
def test_strip_html(spark, raw, plain):
    assert one(spark, text.strip_html(F.lit(raw).cast("string"))) == plain


def test_names_and_titles(spark):
    assert one(spark, text.normalize_name(F.lit("  Société   Général Inc."))) == "societe general"
    assert one(spark, text.normalize_name(F.lit("Inc"))) == "inc"
    assert one(spark, text.title_signature(F.lit("The Fall &amp; Rise of Big, Big Rivers"))) == "big|fall|rise|rivers"
    assert one(spark, text.title_signature(F.lit("The of"))) == "the of"
    assert one(spark, text.content_hash(F.lit(" A  b"), F.lit("https://X.org:443/q"))) == one(spark, F.sha2(F.lit("a b|x.org"), 256))
    assert one(spark, text.host(F.lit("http://u@x.org:8080/"))) == "x.org:8080"
    assert one(spark, text.sanitize_url(F.lit("javascript:alert(1)"))) == ""
    assert one(spark, text.extract_tag(F.lit("<t><![CDATA[ a <b> ]]></t>"), "t")) == "a <b>"
    assert one(spark, text.image_url(F.lit('<description><p><img class="x" src="http://i/1.png"></p></description>'))) == "http://i/1.png"
    assert one(spark, text.image_url(F.lit('<p><img class="x" src="http://i/1.png"></p>'))) == ""


@pytest.mark.parametrize(
    "raw, parsed",
    [
        ("Tue, 02 Jan 2024 03:04:05 GMT", dt.datetime(2024, 1, 2, 3, 4, 5)),
        ("2 Jan 2024 03:04:05 +0200", dt.datetime(2024, 1, 2, 1, 4, 5)),
        ("2024-01-02T03:04:05Z", dt.datetime(2024, 1, 2, 3, 4, 5)),
        ("soon", None),
    ],
)
def test_feed_dates(spark, raw, parsed):
    assert one(spark, dates.parse_feed_date(F.lit(raw))) == parsed


def test_window_months(spark):
    months = one(spark, dates.window_months(F.lit(dt.date(2024, 3, 31))))
    assert months[0] == "2023-02" and months[-1] == "2024-01" and len(months) == 12


def test_sentiment_and_lists(spark):
    assert one(spark, language.sentiment(F.lit("war attackers peace"), ("peace",), ("war", "attack"))) == pytest.approx(-1 / 3**0.5)
    assert one(spark, language.sentiment(F.lit(None).cast("string"))) == 0
    assert one(spark, language.acronyms(F.lit("NATO and THE EU met A1, CEO of IT"))) == ["A1", "EU", "NATO", "THE"]


RSS = "<rss><channel>" + "".join(
    f"<item><title>Story {i}</title><link>https://a.org/{i}</link><pubDate>Tue, 02 Jan 2024 03:{i:02d}:05 GMT</pubDate><description>&lt;b&gt;x&lt;/b&gt; {i}</description></item>" for i in range(20)
) + "<item><title>No date</title></item><item><title>Sponsored thing</title><pubDate>2024-01-02T00:00:00Z</pubDate></item><item><title>Old</title><pubDate>2020-01-02T00:00:00Z</pubDate></item></channel></rss>"
ATOM = '<feed><entry><title>One</title><link href="https://b.org/1"/><updated>2031-01-02T03:04:05Z</updated><summary>s</summary></entry><entry><title></title></entry></feed>'


def test_feed_items(spark):
    docs = spark.createDataFrame([("r", "https://a.org", RSS), ("a", "https://b.org", ATOM), ("none", "https://c.org", "<x/>"), ("null", None, None)], "source_name string, url string, xml string")
    now = F.to_timestamp(F.lit("2024-01-03 00:00:00"))
    rows = feeds.items(docs, now).collect()
    rss = sorted((r for r in rows if r.source_name == "r"), key=lambda r: r.place)
    assert [r.title for r in rss] == [f"Story {i}" for i in range(15)]
    assert rss[3].summary == "x 3" and rss[3].link == "https://a.org/3" and not rss[3].estimated
    (atom,) = [r for r in rows if r.source_name == "a"]
    assert atom.link == "https://b.org/1" and atom.estimated and atom.published == dt.datetime(2024, 1, 3)
    assert len(rows) == 16


def test_clusters_hang_on_their_head(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(1, "s", day), (2, "s", day + dt.timedelta(hours=40)), (3, "s", day + dt.timedelta(hours=60)), (4, "", day), (5, None, day), (6, "s", day + dt.timedelta(hours=60))]
    articles = spark.createDataFrame(rows, "id long, title_signature string, first_seen_at timestamp_ntz").withColumn("published_at", F.lit(None).cast("timestamp_ntz"))
    heads = {r.id: r.head_id for r in stories.clusters(articles).collect()}
    assert heads == {1: 1, 2: 1, 3: 3, 6: 3, 4: 4, 5: 5}
    groups = {r.id: r.dup_group_id for r in stories.duplicate_groups(articles).collect()}
    assert groups == {2: 1, 3: 2, 6: 2}


def test_similar_names(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    names = spark.createDataFrame([(1, "Acme"), (2, "Acme Corp"), (3, "The Acme Corp"), (4, "Other"), (5, "Acmeville"), (6, None)], "id long, canonical_name string")
    assert {r.id: r.component for r in graph.similar_names(names).collect()} == {1: 1, 2: 1, 3: 1}


def test_cascades(spark):
    edges = spark.createDataFrame([("a", "b", 0), ("a", "c", 1), ("a", "d", 2), ("b", "a", 0), ("b", "e", 1), ("c", "a", 0)], "domain string, next string, place int")
    triggers = spark.createDataFrame([(1, "a", "warning"), (2, "a", "critical"), (3, "b", "critical"), (4, "c", "advisory")], "seq int, domain string, severity string")
    got = [tuple(r) for r in graph.cascades(edges, triggers).collect()]
    assert got == [(3, "critical", "b", "a", "c"), (3, "critical", "b", "e", None), (1, "warning", "a", "b", "e"), (1, "warning", "a", "c", None)]


def test_signal_states(spark):
    rows = [("k1", "new"), ("k2", "dismissed"), ("k3", "dismissed"), ("k4", "seen")]
    stored = spark.createDataFrame(rows, "dedupe_key string, state string").withColumn("state_changed_at", F.lit(None).cast("timestamp_ntz"))
    changes = spark.createDataFrame([("k1", "promoted"), ("k2", "reopen"), ("k3", "seen"), ("k9", "seen")], "dedupe_key string, action string")
    got = {r.dedupe_key: r.state for r in state.transition(stored, changes, "timestamp_ntz'2024-01-01 00:00:00'").collect()}
    assert got == {"k1": "promoted", "k2": "new", "k3": "dismissed", "k4": "seen"}


def test_warming_up(spark):
    mentions = spark.createDataFrame([(1, 1, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1), "s", "c", 0.0)], "article_id long, entity_id long, effective_at timestamp_ntz, arrival_at timestamp_ntz, source_name string, category string, sentiment double")
    assert panels.warmup(mentions, "timestamp_ntz'2024-01-03 00:00:00'").first().active
    assert panels.warmup(mentions.limit(0), "timestamp_ntz'2024-01-03 00:00:00'").first().active


def test_ticks_of_a_stream(spark, tmp_path):
    schema = "article_id long, entity_id long, effective_at timestamp_ntz, arrival_at timestamp_ntz, source_name string, category string, sentiment double"
    rows = [(i, i % 3, dt.datetime(2024, 1, 1, i % 5), dt.datetime(2024, 1, 2), f"s{i % 2}", "c", 1.0) for i in range(30)]
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    frame = spark.createDataFrame(rows, schema)
    frame.where("article_id < 15").coalesce(1).write.parquet(source)
    frame.where("article_id >= 15").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = stream.writeStream.foreachBatch(tick.merge_batch(target)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {(r.entity_id, r.bucket): r.mentions for r in tick.hourly_table(spark, target).collect()}
    expected = {(r.entity_id, r.bucket): r.mentions for r in panels.hourly_rollup(frame).collect()}
    assert got == expected

"""Small operators on what a desk is shown."""
import datetime as dt
import json

from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators import developments, fame, panels, reports, rollups, stories

START = dt.datetime(2024, 1, 1)


def test_rows_as_json_keep_nulls_and_sort_their_keys(spark):
    rows = spark.createDataFrame([(1, "a", None, [1, 2])], "id long, name string, at timestamp, list array<int>")
    row = reports.as_json(rows, "id").first()
    assert row.id == 1 and row.json == '{"at":null,"id":1,"list":[1,2],"name":"a"}' and json.loads(row.json)["at"] is None
    assert reports.as_json(rows.limit(0)).count() == 0


def test_evidence_keeps_its_order_and_leaves_out_what_is_gone(spark):
    signals = spark.createDataFrame([(1, [30, 10, 99, 10]), (2, []), (3, None)], "id long, article_ids array<long>")
    articles = spark.createDataFrame([(10, "t10", "l", "s"), (30, "t30", "l", "s")], "id long, title string, link string, source_name string")
    assert [(r.id, r.place, r.title) for r in sorted(reports.evidence_articles(signals, articles).collect())] == [(1, 0, "t30"), (1, 1, "t10"), (1, 3, "t10")]


def test_the_scale_of_a_series_is_one_at_least(spark):
    series = spark.createDataFrame([(3,), (7,), (0,)], "mentions long")
    assert reports.series_scale(series).first().scale == 7
    assert reports.series_scale(series.where("mentions = 0")).first().scale == 1 and reports.series_scale(series.limit(0)).first().scale == 1


def test_the_first_mention_of_an_article_and_entity_counts(spark):
    rows = spark.createDataFrame([(1, 1, 5, "b"), (1, 1, 2, "a"), (1, 2, 9, "c"), (2, 1, 1, "d")], "article_id long, entity_id long, seq long, v string")
    assert sorted(r.v for r in rollups.unique_mentions(rows).collect()) == ["a", "c", "d"]


def test_sorting_by_letters_and_by_update(spark):
    rows = [(1, "zeta", START, None), (2, "Älter", START + dt.timedelta(1), None), (3, "alpha", START, START + dt.timedelta(2)), (4, None, None, None), (5, "Beta", START, None)]
    articles = spark.createDataFrame(rows, "id long, title string, published timestamp_ntz, updated_at timestamp_ntz")
    assert [r.id for r in stories.sorted_by(articles, "title").collect()] == [3, 2, 5, 1, 4]
    assert [r.id for r in stories.sorted_by(articles, "title", descending=True).collect()] == [1, 5, 2, 3, 4]
    assert [r.id for r in stories.sorted_by(articles, "published", descending=True).collect()] == [3, 2, 1, 5, 4]
    assert [r.id for r in stories.sorted_by(articles, "id").collect()] == [1, 2, 3, 4, 5]


def test_an_estimated_time_is_not_stored(spark):
    rows = spark.createDataFrame([(START, True), (START, False), (START, None), (None, False)], "published timestamp_ntz, estimated boolean")
    assert [r[0] for r in rows.select(stories.honest_time("published", "estimated")).collect()] == [None, START, START, None]


def test_signs_after_a_match_and_samples_of_exceptions(spark):
    row = spark.range(1).select(
        T.trim_punctuation(F.lit("Acme, Inc.,;")).alias("a"),
        T.trim_punctuation(F.lit("?!")).alias("b"),
        T.exception_text(F.lit("Type Error<x>"), F.lit("at https://a.example.com/k?t=1 failed " + "y" * 300)).alias("c"),
        T.exception_text(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("d"),
    ).first()
    assert (row.a, row.b, row.d) == ("Acme, Inc", "", "Error: ")
    assert row.c.startswith("TypeErrorx: at [url] failed yy") and len(row.c) == len("TypeErrorx: ") + 160


def test_fame_in_nine_numbers(spark):
    rows = [("tracked", "famous", True, START), ("tracked", "not_famous", None, START + dt.timedelta(3)), ("tracked", "unknown", False, None), ("tracked", "unknown", False, START + dt.timedelta(1)), ("dismissed", "famous", True, START - dt.timedelta(9))]
    entities = spark.createDataFrame(rows, "status string, fame string, fame_locked boolean, checked_at timestamp_ntz")
    assert tuple(panels.fame_stats(entities).first()) == (4, 1, 1, 2, 1, 1, 1, START, START + dt.timedelta(3))
    assert tuple(panels.fame_stats(entities.limit(0)).first()) == (0, 0, 0, 0, 0, 0, 0, None, None)


def test_anchors_of_one_rate_go_by_letters(spark):
    known = spark.createDataFrame([(1, "Zeta", 5.0, True), (2, "Älter", 5.0, True), (3, "alpha", 5.0, True), (4, "Beta", 9.0, True), (5, "aaa", 99.0, False)], "entity_id long, name string, rate double, anchor boolean")
    pairs = spark.createDataFrame([("c", i) for i in (1, 2, 3, 4, 5, 5)], "card string, entity_id long")
    assert developments._top_anchors(pairs, known).first().anchors == ["Beta", "alpha", "Älter"]


def test_aliases_of_an_entity_in_the_order_of_languages(spark):
    answer = {"entities": {"Q1": {"labels": {"de": {"value": "Deutsch"}, "en": {"value": "English"}, "sv": {"value": "No"}}, "aliases": {"en": [{"value": " Eng "}, {"value": "English"}], "tr": [{"value": "Türk"}, {"value": ""}]}, "sitelinks": {"enwiki": {"title": "T"}}}, "-1": {"missing": ""}}}
    row = fame.entity_details(spark.createDataFrame([(json.dumps(answer),)], "json string")).first()
    assert (row.id, row.aliases, row.sitelinks) == ("Q1", ["English", "Eng", "Deutsch", "Türk"], 1)

"""State, extraction, fame and streams on small tables, against values worked out by hand."""
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewire.functions import dates as D
from tidewire.functions import language as L
from tidewire.functions import text as T
from tidewire.operators import detectors, extraction, fame, graph, reports, rollups, state, stories
from tidewire.operators.newsroom import Newsroom
from tidewire.sources import feeds
from tidewire.streaming import tick

NOW = "timestamp_ntz'2024-03-20 12:00:00'"
T0 = dt.datetime(2024, 3, 20, 12)


def at(days=0, hours=0):
    return T0 - dt.timedelta(days=days, hours=hours)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


# ------------------------------------------------------------------ functions


def test_names(spark):
    rows = spark.createDataFrame([("Veltrax  Industries Inc.",), ("Őrült Škoda AG",), ("ＦＵＬＬ Width",), ("Inc",), ("",), (None,), ("Café Corp Ltd",)], "n string")
    got = [r[0] for r in rows.select(T.normalize_name("n")).collect()]
    assert got == ["veltrax industries", "orult skoda", "full width", "inc", "", None, "cafe corp"]


def test_titles_and_signatures(spark):
    row = one(
        spark,
        a=T.title_signature(F.lit("Breaking news: The Fed &amp; ECB raise rates after report")),
        b=T.title_signature(F.lit("the of &lt;!&gt;")),
        c=T.normalize_title(F.lit("A&amp;lt;b  c!")),
        d=T.title_signature(F.lit("zeta eta theta iota kappa lambda mu alpha")),
    )
    assert tuple(row) == ("ecb|fed|raise|rates", "the of", "alt b c".replace("alt b", "altb"), "alpha|eta|iota|kappa|lambda|theta")


def test_tone_and_levels(spark):
    row = one(
        spark,
        a=L.sentiment(F.lit("War and peace: killings")),
        b=L.sentiment(F.lit("bombings destroyed")),
        c=L.urgency(F.lit("Cyber Threats")),
        d=L.urgency(F.lit("Economic/Energy")),
        e=L.urgency(F.lit(None).cast("string")),
    )
    assert row.a == pytest.approx(-1 / 2)  # war -1, peace +1, killings begins with killing
    assert row.b == -1.0 and (row.c, row.d, row.e) == ("critical", "monitoring", "neutral")


def test_dictionary_of_any_words(spark):
    terms = [("Bank of New York", "BNY", "organization", 1), ("g7 summit", "G7", "organization", 2), ("al-shabaab", "Al-Shabaab", "organization", 3), ("MIT", "MIT", "organization", 4), ("OPEC+", "OPEC", "organization", 5), ("москва", "Moscow", "city", 6), ("it", "Italy", "country", 7), ("Hamas", "Palestine", "country", 8), ("hamas", "Hamas", "organization", 9)]
    texts = [(1, "the bank of new york at the G7 summit, 2MIT, Al-Shabaab"), (2, "mit and emit and MITs"), (3, "OPEC+ éMIT Москва it IT"), (4, None), (5, "HAMAS bank of new yorker")]
    held = spark.createDataFrame(terms, "term string, canonical string, type string, place int")
    asked = spark.createDataFrame(texts, "id long, text string")
    expected = {(1, "BNY"), (1, "G7"), (1, "MIT"), (1, "Al-Shabaab"), (3, "OPEC"), (3, "MIT"), (3, "Moscow"), (5, "Hamas")}
    assert {(r.id, r.canonical) for r in L.dictionary_matches(asked, held).collect()} == expected
    few, L.FEW_TERMS = L.FEW_TERMS, 1
    try:
        assert {(r.id, r.canonical) for r in L.dictionary_matches(asked, held).collect()} == expected
    finally:
        L.FEW_TERMS = few
    known = L.is_dictionary_term(spark.createDataFrame([("hamas",), ("x",)], "name string"), held).collect()
    assert {r.name: r.known for r in known} == {"hamas": True, "x": False}


def test_plausible_names(spark):
    text = "President Emmanuel Macron met Angela Merkel, Fox News, The Guardian Angel, Iran War Zone and Sky Daily Post in New York. Why Pakistan. Reuters World"
    row = one(spark, p=L.plausible_names(F.lit(text), F.array(F.lit("Iran")), F.array(F.lit("sky daily"))), s=L.source_names(F.array(F.lit("BBC – World: News"))))
    assert row.p == ["Angela Merkel", "Emmanuel Macron"]
    assert row.s == ["bbc", "bbc – world: news", "news", "world"]


def test_times(spark):
    now = F.expr(NOW)
    row = one(
        spark,
        a=D.is_recent(F.lit(at(hours=0.2)), now, 15),
        b=D.is_recent(F.lit(None).cast("timestamp_ntz"), now, 15),
        c=D.cache_state(F.lit(at(hours=0.3)), F.lit(0), now),
        d=D.cache_state(F.lit(at(hours=0.3)), F.lit(2), now),
        e=D.last_day(F.lit("202402")),
        f=state.may_tick(F.lit(at(hours=0.2)), now),
        g=state.may_tick(F.lit(None).cast("timestamp_ntz"), now),
    )
    assert tuple(row) == (True, False, "stale", "none", 29, True, True)
    assert (D.freshness(True), D.freshness(False)) == (10, 15)


# ------------------------------------------------------------------ stories


def articles(spark, rows):
    return spark.createDataFrame(rows, "id long, title_signature string, first_seen_at timestamp_ntz, published_at timestamp_ntz, dup_group_id long, title string, link string, source_name string, source_category string")


def article(i, when, sign="s", group=None, published=None, source="a"):
    return (i, sign, when, published, group, f"t{i}", f"l{i}", source, "c")


def test_a_headline_over_three_days_begins_a_new_head(spark):
    rows = articles(spark, [article(i, at(hours=72 - 12 * i)) for i in range(7)])
    got = {r.id: r.dup_group_id for r in stories.duplicate_groups(rows, NOW).collect()}
    # only those of the last 48 hours are grouped, each with the earliest head within 48 hours before it
    assert got == {2: 0, 3: 0, 4: 0, 5: 1, 6: 2}


def test_members_and_blank_signatures(spark):
    rows = articles(spark, [article(1, at(hours=40), "", group=9), article(2, at(hours=30), ""), article(3, at(hours=20), ""), article(4, at(hours=20), "x")])
    groups = stories.duplicate_groups(rows, NOW)
    assert {r.id: r.dup_group_id for r in groups.collect()} == {3: 2}
    assert {r.id: r.dup_group_id for r in stories.grouped(rows, groups).collect()} == {1: 9, 2: None, 3: 2, 4: None}


def test_clusters_are_those_of_one_pass(spark):
    import random

    draw = random.Random(3)
    rows = [article(i, at(hours=draw.choice((draw.uniform(0, 900), draw.randint(0, 18) * 48))), draw.choice(("a", "b"))) for i in range(150)]
    head, expected = {}, {}
    for i, sign, when, *_ in sorted(rows, key=lambda r: (r[2], r[0])):
        if sign not in head or when - head[sign][1] > dt.timedelta(hours=48):
            head[sign] = (i, when)
        expected[i] = head[sign][0]
    assert {r.id: r.head_id for r in stories.clusters(articles(spark, rows)).collect()} == expected


def test_feed_and_lookups(spark):
    rows = articles(spark, [article(1, at(days=9)), article(2, at(days=2)), article(3, at(days=1), group=2, source="b"), article(4, at(hours=1), group=1), article(5, at(hours=2), published=at(days=1))])
    feed = stories.group_feed(rows, NOW).collect()
    assert [(r.id, r.cluster_size, r.updated_at) for r in feed] == [(5, 1, at(hours=2)), (2, 2, at(days=1))]
    assert [stories.clamped_days(x) for x in (None, 0, -1, float("nan"), 2.9, 99)] == [7, 7, 7, 7, 2, 30]
    found = stories.titled(rows, spark.createDataFrame([("t2",), ("none",)], "title string"), NOW).collect()
    assert [(r.title, r.link) for r in found] == [("t2", "l2")]
    counts = stories.insert_counts(rows.select("id", F.col("title").alias("content_hash")).limit(2), spark.createDataFrame([(1, "t1"), (7, "n"), (8, "n")], "id long, content_hash string")).first()
    assert tuple(counts) == (1, 2)


# ------------------------------------------------------------------ state

ENTITIES = "id long, canonical_name string, type string, status string, fame string, fame_locked boolean, aliases array<string>, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz"


def entities(spark):
    return spark.createDataFrame([(1, "A", "person", "tracked", "unknown", False, ["a1"], at(9), at(5)), (2, "B", "company", "dismissed", "famous", False, [], at(8), None)], ENTITIES)


def test_entity_upsert_and_bump(spark):
    batch = spark.createDataFrame([("A", "city", at(20), at(1)), ("C", "region", at(3), at(2)), ("D", "other", at(3), at(2))], "canonical_name string, type string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz")
    got = {r.canonical_name: r for r in state.upsert_entities(entities(spark), batch).collect()}
    assert (got["A"].type, got["A"].first_seen_at, got["A"].last_seen_at) == ("person", at(9), at(1))
    assert sorted((got["C"].id, got["D"].id)) == [3, 4] and (got["C"].status, got["C"].fame, got["C"].aliases) == ("tracked", "unknown", [])
    assert got["B"].last_seen_at is None
    mentions = spark.createDataFrame([(1, 2, at(1)), (3, 2, at(2))], "article_id long, entity_id long, arrival_at timestamp_ntz")
    assert {r.id: r.last_seen_at for r in state.bump_last_seen(entities(spark), mentions).collect()} == {1: at(5), 2: at(1)}


def test_merges(spark):
    rel = "source_id long, target_id long, relation string, article_count long, first_seen_at int, last_seen_at int, evidence_article_id long"
    got = state.merge_relations(spark.createDataFrame([(1, 2, "x", 3, 5, 6, 50)], rel), spark.createDataFrame([(1, 2, "x", 1, 1, 9, 70), (1, 3, "x", 1, 2, 2, 8)], rel)).collect()
    assert sorted(map(tuple, got)) == [(1, 2, "x", 4, 5, 9, 70), (1, 3, "x", 1, 2, 2, 8)]
    seen = "entity_id long, first_seen_at int, last_seen_at int"
    assert sorted(map(tuple, state.merge_last_seen(spark.createDataFrame([(1, 3, 4)], seen), spark.createDataFrame([(1, 1, 9), (2, 5, 5)], seen)).collect())) == [(1, 3, 9), (2, 5, 5)]
    use = "month string, calls long"
    assert sorted(map(tuple, state.merge_usage(spark.createDataFrame([("m", 2)], use), spark.createDataFrame([("m", 3), ("n", 1)], use), ["calls"]).collect())) == [("m", 5), ("n", 1)]
    links = spark.createDataFrame([(1, 1)], "article_id long, entity_id long")
    more = spark.createDataFrame([(1, 1), (1, 2), (1, 2)], "article_id long, entity_id long")
    assert sorted(map(tuple, state.insert_links(links, more).collect())) == [(1, 1), (1, 2)]


def test_processing_counts_nothing_twice(spark):
    rows = spark.createDataFrame([(1, None, None, at(hours=1)), (2, 1, None, at(hours=1)), (3, None, at(1), at(hours=1)), (4, None, None, at(hours=7)), (5, None, None, at(hours=2))], "id long, dup_group_id long, entities_processed_at timestamp_ntz, first_seen_at timestamp_ntz")
    held = spark.createDataFrame([(5,)], "id long")
    assert [r.id for r in state.unprocessed_heads(rows, NOW, held).collect()] == [1]
    batch = spark.createDataFrame([(1,), (3,)], "id long")
    fresh = state.still_unprocessed(rows, batch)
    assert [r.id for r in fresh.collect()] == [1]
    after = state.mark_processed(rows, fresh, NOW)
    assert state.still_unprocessed(after, batch).count() == 0 and after.count() == 5


def test_retention_and_repair(spark):
    signals = spark.createDataFrame(
        [("a", "surge", "new", at(8), None), ("b", "novel_edge", "new", at(8), None), ("c", "surge", "seen", at(8), None), ("d", "surge", "dismissed", at(99), at(91)), ("e", "surge", "dismissed", at(99), at(89)), ("f", "sentiment", "new", at(6), None)],
        "dedupe_key string, type string, state string, last_evidence_at timestamp_ntz, state_changed_at timestamp_ntz",
    )
    assert [r.dedupe_key for r in state.expired(signals, NOW).collect()] == ["a"]
    assert sorted(r.dedupe_key for r in state.kept_signals(signals, NOW).collect()) == ["b", "c", "e", "f"]
    hourly = spark.createDataFrame([(1, at(179)), (1, at(181))], "entity_id long, bucket timestamp_ntz")
    assert state.kept_hourly(hourly, NOW).count() == 1
    rows = articles(spark, [article(2, at(3), group=1), article(3, at(4))])
    assert {r.id: r.dup_group_id for r in state.regrouped(rows).collect()} == {2: None, 3: None}
    links = spark.createDataFrame([(1, 9), (2, 9)], "article_id long, entity_id long")
    assert [r.article_id for r in state.kept_links(links, rows).collect()] == [2]
    relations = spark.createDataFrame([(1, 1), (2, 3)], "source_id long, evidence_article_id long")
    assert {r.source_id: r.evidence_article_id for r in state.kept_evidence(relations, rows).collect()} == {1: None, 2: 3}
    assert state.kept_candidates(spark.createDataFrame([("x", at(15)), ("y", at(1))], "norm string, last_seen_at timestamp_ntz"), NOW).count() == 1
    mentions = spark.createDataFrame([(2, at(7)), (2, at(6))], "entity_id long, arrival_at timestamp_ntz")
    assert {r.id: (r.first_seen_at, r.last_seen_at) for r in state.repaired_times(entities(spark), mentions).collect()} == {1: (at(9), at(5)), 2: (at(7), at(6))}
    edges = spark.createDataFrame([(1, 2, at(30), at(1))], "entity_a long, entity_b long, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz")
    assert state.clamped_edges(edges, rows).first().first_seen_at == at(4)
    assert state.clamped_edges(edges, rows.limit(0)).first().first_seen_at == at(30)


def test_signals_of_famous_subjects_are_purged(spark):
    known = spark.createDataFrame([(1, True), (2, True), (3, False)], "entity_id long, famous boolean")
    rows = [("a", "surge", "new", [1]), ("b", "surge", "seen", [1]), ("c", "surge", "new", [3]), ("d", "novel_edge", "new", [1, 2]), ("e", "novel_edge", "new", [1, 3]), ("f", "surge", "new", [8])]
    signals = spark.createDataFrame(rows, "dedupe_key string, type string, state string, entity_ids array<long>")
    assert sorted(r.dedupe_key for r in state.purged(signals, known).collect()) == ["b", "c", "e", "f"]
    stored = spark.createDataFrame([("a", "new", None), ("b", "dismissed", at(1)), ("c", "dismissed", at(9))], "dedupe_key string, state string, state_changed_at timestamp_ntz")
    fresh = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "dedupe_key string")
    assert tuple(state.persist_counts(stored, fresh, NOW).first()) == (2, 1, 1)


CANDIDATES = "norm string, display_name string, type_hint string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz"


def test_decisions_on_candidates(spark):
    candidates = spark.createDataFrame([("n", "N", "person", at(3), at(2)), ("a", "A", "person", at(3), at(2)), ("o", "O", "city", at(3), at(2)), ("p", "P", "city", at(3), at(2))], CANDIDATES)
    items = spark.createDataFrame([("n", "accept", "company"), ("a", "accept", "person"), ("o", "dismiss", None), ("p", "accept", "wrong"), ("gone", "dismiss", None), (" ", "dismiss", None)], "name_norm string, action string, type string")
    after, left, told = state.decided(entities(spark), candidates, items)
    assert {r.canonical_name: (r.type, r.status) for r in after.collect()} == {"A": ("person", "tracked"), "B": ("company", "dismissed"), "N": ("company", "tracked"), "O": ("city", "dismissed")}
    assert [r.norm for r in left.collect()] == ["p"]
    assert {r.name_norm: r.error for r in told.collect()} == {"n": None, "a": None, "o": None, "p": "type is required for accept", "gone": "Candidate not found", " ": "Invalid nameNorm"}
    merges = spark.createDataFrame([("n", "A"), ("o", "nobody")], "name_norm string, merge_into string")
    merged, rest = state.merged_into(entities(spark), candidates, merges)
    assert {r.canonical_name: r.aliases for r in merged.collect()} == {"A": ["a1", "n", "N"], "B": []}
    assert sorted(r.norm for r in rest.collect()) == ["a", "o", "p"]
    assert [r.norm for r in state.accepted(entities(spark), candidates.where("norm in ('n', 'a')")).collect()] == ["n"]


def test_patches_and_settings(spark):
    patch = spark.createDataFrame([(1, None, None, "famous", None), (2, "nonsense", "tracked", None, None)], "id long, type string, status string, fame string, fame_locked boolean")
    got = {r.id: (r.type, r.status, r.fame, r.fame_locked) for r in state.patched_entities(entities(spark), patch).collect()}
    assert got == {1: ("person", "tracked", "famous", True), 2: ("company", "dismissed", "famous", False)}
    stored = spark.createDataFrame([("surprise_k", "4.5"), ("warmup_days", '"9"'), ("unknown", "1"), ("brief_max_blocks", "x")], "key string, value string")
    assert state.overlaid(stored) == {"surprise_k": 4.5, "dismiss_cooldown_hours": 72.0, "brief_max_blocks": 10.0, "warmup_days": 7.0, "llm_monthly_budget_usd": 5.0}


# ------------------------------------------------------------------ extraction


def test_an_article_becomes_mentions_and_sightings(spark):
    rows = spark.createDataFrame([(1, "NATO meets Jane Doe", "about ACME and iPhone15, Jane Doe", "src", at(2), at(1)), (2, "Nato", None, "src", None, at(1))], "id long, title string, summary string, source_name string, published_at timestamp_ntz, first_seen_at timestamp_ntz")
    terms = spark.createDataFrame([("NATO", "NATO", "organization", 1), ("Nowhere", "Nowhere", "country", 2)], "term string, canonical string, type string, place int")
    found = extraction.found_names(rows, terms)
    assert {(r.article_id, r.layer, r.display) for r in found.collect()} == {(1, "dictionary", "NATO"), (1, "acronym", "ACME"), (1, "person-regex", "Jane Doe"), (1, "product-pattern", "iPhone15")} - {(1, "product-pattern", "iPhone15")}
    model = spark.createDataFrame([(1, "llm", 0, "Jane  Doe", "person", "chair", "famous"), (1, "llm", 1, "Acme Inc.", "company", None, "known")], found.schema)
    names = extraction.merged_names(found.unionByName(model))
    by = {r.norm: r for r in names.collect()}
    assert (by["jane doe"].display, by["jane doe"].layer, by["jane doe"].role_context) == ("Jane  Doe", "llm", "chair")
    assert (by["acme"].type_hint, by["acme"].display) == ("company", "Acme Inc.")
    registry = entities(spark).withColumn("aliases", F.when(F.col("id") == 2, F.array(F.lit("ACME"))).otherwise(F.col("aliases")))
    known = extraction.classified(names, registry)
    assert {r.norm: (r.kind, r.auto_accepted) for r in known.collect()} == {"nato": ("new", False), "jane doe": ("new", True), "acme": ("resolved", False)}
    fresh = extraction.new_entities(known, rows)
    after = state.upsert_entities(registry, fresh)
    mentions = extraction.resolved_mentions(known, after, rows).collect()
    assert len(mentions) == 3 and {m.arrival_at for m in mentions} == {at(1)} and {m.effective_at for m in mentions} == {at(2)}
    stated = spark.createDataFrame([(1, "Jane Doe", "membership", "ACME Inc"), (1, "Jane Doe", "supply", "nobody")], "article_id long, source string, relation string, target string")
    assert extraction.resolved_relations(stated, after, rows).count() == 1
    plain = extraction.classified(extraction.merged_names(found), registry.limit(0))
    seen = extraction.sightings(plain, rows).collect()
    assert {(s.norm, tuple(s.co_entities)) for s in seen} == {("jane doe", ("NATO",)), ("acme", ("NATO",))}


def test_candidates_grow_by_days_and_keep_their_first_values(spark):
    rows = [("n", "Name", f"s{i}", f"t{i % 4}", at(6 - i // 3), i, f"role {i % 2}", ["X", f"Y{i}"]) for i in range(14)]
    seen = spark.createDataFrame(rows, "norm string, display string, source_name string, title string, effective_at timestamp_ntz, seq long, role_context string, co_entities array<string>")
    first = rollups.candidates(seen.where("seq < 7")).withColumn("day_count", F.size("days")).drop("days")
    (got,) = rollups.merged_candidates(first, rollups.candidates(seen.where("seq >= 7"))).collect()
    assert (got.mention_count, got.day_count, got.first_seen_at, got.last_seen_at) == (14, 5, at(6), at(2))
    assert got.source_names == [f"s{i}" for i in range(10)] and got.sample_titles == ["t0", "t1", "t2"]
    assert got.contexts == ["role 0", "role 1"] and got.co_entities == ["X", "Y0", "Y1", "Y2", "Y3"]


# ------------------------------------------------------------------ fame


def test_aliases_and_sweeps(spark):
    row = one(spark, a=fame.merged_aliases(F.array(F.lit("Old")), F.array(*map(F.lit, ("old", "New", "NEW Inc.", "Canon", "", "Next"))), F.lit("Canon"), 3))
    assert row.a == ["Old", "New", "Next"]
    rows = spark.createDataFrame(
        [(1, "A", "tracked", "unknown", False, ["a"], None, at(9), None, None, None), (2, "B", "tracked", "unknown", False, [], at(hours=1), at(8), None, None, None), (3, "C", "tracked", "not_famous", False, [], at(31), at(7), None, None, None), (4, "D", "tracked", "unknown", True, [], None, at(6), None, None, None), (5, "E", "tracked", "unknown", False, [], None, at(2), None, None, None)],
        "id long, canonical_name string, status string, fame string, fame_locked boolean, aliases array<string>, checked_at timestamp_ntz, first_seen_at timestamp_ntz, wiki_title string, wiki_sitelinks int, wiki_pageviews_monthly long",
    )
    assert [r.id for r in fame.sweep_batch(rows, NOW).collect()] == [5, 1, 3]
    outcomes = spark.createDataFrame([(1, "success", "famous", "A page", 30, 5000, ["A", "x"], None), (3, "failure", None, None, None, None, ["c2"], "search_http_429"), (5, "rescue", None, None, None, None, ["lost"], "boom")], "id long, outcome string, fame string, wiki_title string, sitelinks int, views long, aliases array<string>, reason string")
    got = {r.id: (r.fame, r.aliases, r.checked_at == T0) for r in fame.written(rows, outcomes, NOW).collect()}
    assert got == {1: ("famous", ["a", "x"], True), 2: ("unknown", [], False), 3: ("not_famous", ["c2"], True), 4: ("unknown", [], False), 5: ("unknown", [], True)}
    assert tuple(fame.sweep_tally(outcomes).first()) == (3, 1, 2, True)


# ------------------------------------------------------------------ detectors


def room_of(spark, rows, links, hourly, names=((1, "One"), (2, "Two"))):
    """A newsroom of articles (id, arrival, news time, source, category), links and hours."""
    held = spark.createDataFrame([(i, f"t{i}", f"l{i}", s, c, p, a, None) for i, a, p, s, c in rows], "id long, title string, link string, source_name string, source_category string, published_at timestamp_ntz, first_seen_at timestamp_ntz, dup_group_id long")
    pairs = spark.createDataFrame(links, "article_id long, entity_id long")
    seen = pairs.join(held.select(F.col("id").alias("article_id"), "first_seen_at"), "article_id").groupBy("entity_id").agg(F.min("first_seen_at").alias("first_seen_at"), F.max("first_seen_at").alias("last_seen_at"))
    who = spark.createDataFrame([(i, n, "person", "tracked", "unknown", []) for i, n in names], "id long, canonical_name string, type string, status string, fame string, aliases array<string>").join(seen, F.col("id") == F.col("entity_id"), "left").drop("entity_id")
    hours = spark.createDataFrame(hourly, "entity_id long, bucket timestamp_ntz, mentions long, source_count long, sentiment_sum double")
    edges = rollups.edge_rollup(pairs.join(held.selectExpr("id as article_id", "first_seen_at as arrival_at"), "article_id"))
    relations = spark.createDataFrame([], "source_id long, target_id long, relation string, article_count long, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, evidence_article_id long")
    candidates = spark.createDataFrame([], "norm string, display_name string, type_hint string, mention_count long, day_count int, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, source_names array<string>, sample_titles array<string>, contexts array<string>, co_entities array<string>")
    return Newsroom(held, pairs, who, hours, edges, relations, candidates, spark.createDataFrame([], "term string, canonical string, type string, place int"))


def surge_hours(tone=0.0):
    quiet = [(2, at(days=d), 1, 1, 0.0) for d in range(2, 7)]
    return quiet + [(2, at(hours=2), 20, 3, tone), (1, at(days=3), 200, 1, 0.0)]


def test_a_spike_after_quiet_days_is_a_surge(spark):
    room = room_of(spark, [(1, at(20), at(20), "a", "c"), (2, at(hours=2), at(hours=2), "a", "c")], [(1, 1), (2, 2)], surge_hours())
    (got,) = detectors.run(room, NOW).collect()
    assert (got.dedupe_key, got.type, got.severity, got.entity_ids, got.article_ids) == ("surge:2", "surge", "critical", [2], [2])
    rate = 5 / 14
    z = (20 - rate) / (rate + 1) ** 0.5
    assert got.title == f"Surge: Two (+20 mentions/24h, {z:.1f}σ)" and json.loads(got.evidence)["articleIds"] == [2]


def test_no_tone_at_all_skips_the_pass(spark):
    hours = [(2, at(days=d), 5, 1, 4.0) for d in range(2, 7)] + [(2, at(hours=2), 6, 1, 0.0)]
    rows = [(1, at(20), at(20), "a", "c")]
    assert not [r for r in detectors.run(room_of(spark, rows, [(1, 1)], hours), NOW).collect() if r.type == "sentiment"]
    hours.append((1, at(hours=3), 1, 1, -1.0))
    assert [r.dedupe_key for r in detectors.run(room_of(spark, rows, [(1, 1)], hours), NOW).collect() if r.type == "sentiment"] == ["sentiment:2"]


def test_a_backdated_week_on_launch_day_keeps_everything_silent(spark):
    rows = [(1, at(hours=5), at(8), "a", "c"), (2, at(hours=2), at(hours=2), "a", "c")]
    assert detectors.run(room_of(spark, rows, [(1, 1), (2, 2)], surge_hours(-9.0)), NOW).count() == 0


# ------------------------------------------------------------------ graph, reports, feeds, streams


def test_domains_of_signals(spark):
    signals = spark.createDataFrame([(1, "critical", ["NATO", "Somebody"]), (2, "warning", ["Nobody", "Red Sea"])], "seq long, severity string, names array<string>")
    items = spark.createDataFrame([("Somebody", "Health"), ("Somebody", "Health"), ("Somebody", "Cyber"), ("Nobody", "Sport")], "name string, category string")
    triggers = graph.domains(signals, items)
    assert sorted((r.seq, r["rank"], r.domain) for r in triggers.collect()) == [(1, 1, "military"), (1, 2, "health"), (2, 1, "shipping"), (2, 2, "military")]
    chains = graph.cascades(graph.causal_edges(spark), triggers).collect()
    assert [(r.trigger, r.second, r.third) for r in chains][:2] == [("military", "energy", "shipping"), ("military", "humanitarian", "diplomatic")] and len(chains) == 6


def test_current_edges_take_the_larger_count(spark):
    rows = spark.createDataFrame([("a", "b", 2), ("b", "a", 3)], "entity string, other string, count long")
    assert [tuple(r) for r in graph.current_edges(rows).collect()] == [("a|b", 3)]


def test_map_and_entities_of_items(spark):
    items = spark.createDataFrame([(i, f"title {i}", ["Cyber", "Health"][i % 2], "src", at(hours=i), "war" if i else "peace") for i in range(4)], "id long, title string, category string, source string, at timestamp_ntz, text string")
    matches = spark.createDataFrame([(i, "Italy", "country") for i in range(4)] + [(0, "Rome", "city"), (1, "Rome", "city")], "id long, name string, type string")
    found = reports.item_entities(items, matches, NOW)
    by = {r.name: r for r in found.collect()}
    assert (by["Italy"].mentions, by["Italy"].last_1h, by["Italy"].sentiment, by["Italy"].urgency_critical, by["Italy"].partners) == (4, 2, -0.5, 2, "Rome:2")
    places = spark.createDataFrame([("Italy", 42.0, 12.0)], "name string, lat double, lng double")
    (mark,) = reports.map_markers(found, matches, items, places).collect()
    assert (mark.radius, mark.urgency, mark.headlines) == (28.0, "critical", "title 0|title 1|title 2|title 3")
    assert reports.asked_states(" ") == ["new", "seen", "promoted"] and reports.asked_states("new, dismissed") == ["new", "dismissed"]
    with pytest.raises(ValueError):
        reports.asked_states("other")
    with pytest.raises(ValueError):
        reports.find_entities(entities(spark), "x", top=201)


def test_feeds_report_what_failed(spark, tmp_path):
    (tmp_path / "c.csv").write_text('#,name,category,type,tier,url,notes\n1,"A, B",News,RSS,1,https://a.example,"say ""x"""\n2,C,News,API,1,https://c.example,\n3,D,News,Atom,1,ftp://d.example,\n')
    catalog = feeds.read_catalog(spark, str(tmp_path / "c.csv"))
    assert [r.name for r in feeds.collectable(catalog).collect()] == ["A, B"]
    (tmp_path / "r.jsonl").write_text('{"custom_id": "1", "result": "x"}\nnot json\n{"result": "y"}\n')
    assert sorted(r.good for r in feeds.read_results(spark, str(tmp_path / "r.jsonl")).collect()) == [False, False, True]
    rows = [(403, None, None), (404, None, None), (429, None, None), (503, None, None), (410, None, None), (None, "AbortError", "x"), (None, "TypeError", "getaddrinfo ENOTFOUND"), (None, "TypeError", "connect ECONNREFUSED"), (None, "TypeError", "odd"), (200, None, None)]
    kinds = spark.createDataFrame(rows, "status int, name string, message string").select(feeds.error_kind("status", "name", "message").alias("k"))
    assert [r.k for r in kinds.collect()] == ["http_403", "http_404", "http_429", "http_5xx", "http_other", "timeout", "dns", "connection_refused", "unknown", "ok"]
    fetches = spark.createDataFrame([("a", "direct", 0, "timeout"), ("a", "relay", 2, "ok"), ("a", "alt", 3, "ok"), ("b", "direct", 0, "dns"), ("b", "alt", 0, "http_404")], "source_name string, phase string, items int, kind string")
    best = feeds.first_phase(fetches)
    assert {r.source_name: r.phase for r in best.collect()} == {"a": "relay", "b": "alt"}
    assert tuple(feeds.counts(best).first()) == (2, 1, 2)
    assert {r.kind: (r.n, r.sources) for r in feeds.diagnostics(best).collect()} == {"ok": (1, "a"), "http_404": (1, "b")}


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "article_id long, entity_id long, effective_at timestamp_ntz, sentiment double, content_hash string, first_seen_at timestamp"
    rows = [(1, 7, at(hours=5), 1.0, "x", at(hours=5)), (2, 7, at(hours=5), 0.5, "x", at(hours=4)), (3, 8, at(hours=1), 0.0, "y", at(hours=1))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    for name, made, mode in (("tidewire_hours", tick.hourly_stream(stream), "complete"), ("tidewire_unique", tick.unique_articles(stream), "append")):
        made.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.entity_id, r.mentions, r.sentiment_sum) for r in spark.table("tidewire_hours").collect()) == [(7, 2, 1.5), (8, 1, 0.0)]
    assert sorted(r.content_hash for r in spark.table("tidewire_unique").collect()) == ["x", "y"]


def test_answers_stand_beside_the_dictionary_only(spark):
    from tidewire.operators import extraction

    articles = spark.createDataFrame([(1, "NATO meets Angela Merkel", ""), (2, "NATO meets Angela Merkel", ""), (3, "Nothing", None)], "id long, title string, summary string")
    terms = spark.createDataFrame([("NATO", "NATO", "organization", 1)], "term string, canonical string, type string, place int")
    answered = spark.createDataFrame([(1,), (3,)], "article_id long")
    answers = spark.createDataFrame([(1, "llm", 1, "nato", "person", "ally", "famous"), (2, "llm", 1, "Never", "person", None, None)], "article_id long, layer string, seq int, display string, type_hint string, role_context string, prominence string")
    got = extraction.merged_names(extraction.answered_names(articles, terms, answered, answers)).collect()
    # the stronger layer gives type and role; article 2 has no answer, so its names come from all layers
    assert {(r.article_id, r.display, r.type_hint, r.layer, r.role_context) for r in got} == {(1, "NATO", "organization", "dictionary", None), (2, "NATO", "organization", "dictionary", None), (2, "Angela Merkel", "person", "person-regex", None)}

"""Queries by name over the test tables, each with DuckDB SQL for the same rows."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import language as L
from ..functions import text as T
from ..operators import detectors, developments, graph, panels, rollups, scoring, state, stories
from . import expected as X
from . import views as V

#: Time of the queries over events, and of those over orders.
AS_OF, ORDERS_AS_OF = "2024-01-26 00:00:00", "1995-03-01 00:00:00"
NOW, ORDERS_NOW = f"timestamp_ntz'{AS_OF}'", f"timestamp_ntz'{ORDERS_AS_OF}'"
D_NOW, D_ORDERS_NOW = f"timestamp '{AS_OF}'", f"timestamp '{ORDERS_AS_OF}'"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def _hourly(spark, d):
    return panels.hourly_rollup(V.mentions(spark, d))


def _edges(spark, d):
    return rollups.edge_rollup(V.article_entities(spark, d))


def _users(spark, d) -> DataFrame:
    """Users of events as entities."""
    return V.mentions(spark, d).select("entity_id").distinct().selectExpr(
        "entity_id as id",
        "concat('user ', entity_id) as canonical_name",
        "case entity_id % 4 when 0 then 'country' when 1 then 'person' else 'organization' end as type",
        "case when entity_id % 10 = 0 then 'dismissed' else 'tracked' end as status",
        "case when entity_id % 17 = 0 then 'famous' else 'unknown' end as fame",
    )


USERS_SQL = """users as (select distinct entity_id as id, concat('user ', entity_id) as canonical_name,
  case entity_id % 4 when 0 then 'country' when 1 then 'person' else 'organization' end as type,
  case when entity_id % 10 = 0 then 'dismissed' else 'tracked' end as status, case when entity_id % 17 = 0 then 'famous' else 'unknown' end as fame from mentions)"""
PANEL_SQL = f"""panel as (select entity_id,
  coalesce(sum(mentions) filter (bucket >= {D_NOW} - interval 24 hours), 0) as observed,
  coalesce(sum(sentiment_sum) filter (bucket >= {D_NOW} - interval 24 hours), 0) as sentiment,
  coalesce(sum(mentions) filter (bucket < {D_NOW} - interval 24 hours), 0) as baseline,
  coalesce(sum(sentiment_sum) filter (bucket < {D_NOW} - interval 24 hours), 0) as baseline_sentiment,
  count(distinct date_trunc('day', bucket)) filter (bucket < {D_NOW} - interval 24 hours) as baseline_days
  from hourly where bucket >= {D_NOW} - interval 15 days and bucket < {D_NOW} group by entity_id)"""
EPOCH_SQL = f"epoch as (select min(arrival_at) as epoch, floor((epoch({D_NOW}) - epoch(min(arrival_at))) / 86400) as days from mentions)"
SURGE_SQL = """surge as (select entity_id, (observed - baseline / greatest(1, least(14, days - 1))) / sqrt(baseline / greatest(1, least(14, days - 1)) + 1) as z
  from panel cross join epoch where baseline_days >= 3 and days >= 4)"""


def _surges(k: float) -> str:
    return f"""select 'surge' as type, entity_id, case when z >= {2 * k} then 'critical' when z >= {1.5 * k} then 'warning' else 'advisory' end as severity,
  round(least(1.0, z / {2 * k}), 6) as confidence, round(z, 6) as value from surge where z >= {k}"""


# ------------------------------------------------------------------ panels


@query(
    V.with_views("mentions", "hourly")
    + f""", {PANEL_SQL}
select entity_id, cast(observed as bigint) as observed, round(baseline / 14.0, 6) as rate, round(observed / greatest(baseline / 14.0, 0.5), 6) as lift
from panel where observed >= 3 order by lift desc, entity_id limit 5"""
)
def movers(spark, d):
    return panels.movers(_hourly(spark, d), NOW)


@query(V.with_views("mentions", "hourly") + f", {PANEL_SQL} select entity_id, cast(observed as bigint) as observed, sentiment, cast(baseline as bigint) as baseline, baseline_sentiment, baseline_days from panel")
def hourly_panel(spark, d):
    return panels.hourly_panel(_hourly(spark, d), NOW)


@query(V.with_views("mentions", "hourly") + " select * from hourly")
def hourly_rollup(spark, d):
    return _hourly(spark, d)


@query(V.with_views("mentions") + " select min(arrival_at) as epoch, max(arrival_at) as last_arrival, count(*) as articles from mentions")
def system_epoch(spark, d):
    return panels.epoch(V.mentions(spark, d))


@query(
    V.with_views("mentions")
    + f""" select coalesce(elapsed < 7, true) as active, greatest(0.0, 7.0 - coalesce(elapsed, 0.0)) as remaining_days
from (select (epoch({D_NOW}) - epoch(min(arrival_at))) / 86400.0 as elapsed from mentions)"""
)
def warmup_state(spark, d):
    return panels.warmup(V.mentions(spark, d), NOW)


ROSTER_SQL = f"""roster as (select u.id as entity_id, canonical_name, cast(coalesce(sum(mentions) filter (bucket < {D_NOW} - interval 24 hours), 0) as bigint) as baseline,
  cast(coalesce(sum(mentions), 0) as bigint) as total from users u left join hourly h on h.entity_id = u.id and bucket >= {D_NOW} - interval 15 days and bucket < {D_NOW}
  where status = 'tracked' group by all)"""


def _roster(spark, d):
    return panels.baseline_panel(_users(spark, d), _hourly(spark, d), NOW)


@query(V.with_views("mentions", "hourly") + f", {USERS_SQL}, {ROSTER_SQL} select * from roster")
def baseline_panel(spark, d):
    return _roster(spark, d)


@query(
    V.with_views("mentions", "hourly")
    + f""", {USERS_SQL}, {ROSTER_SQL} select round(greatest(3.0, coalesce(quantile_cont(baseline / 14.0, 0.9), 3.0)), 6) as anchor,
  round(coalesce(greatest(3.0, quantile_cont(baseline / 14.0, 0.75)), 'infinity'::double), 6) as famous, round(quantile_cont(baseline / 14.0, 0.9), 6) as p90, count(*) as population
from roster where total > 0"""
)
def baseline_thresholds(spark, d):
    return panels.thresholds(_roster(spark, d))


@query(V.with_views("mentions") + " select entity_id, count(distinct source_name) as sources from mentions group by entity_id")
def source_breadth(spark, d):
    return panels.source_breadth(V.mentions(spark, d))


CATEGORY_SQL = f"""usual as (select entity_id, count(*) as active_days, avg(n) as usual from (select entity_id, cast(effective_at as date) as day, count(distinct category) as n
  from mentions where effective_at >= {D_NOW} - interval 15 days and effective_at < {D_NOW} - interval 24 hours group by all) group by entity_id)"""


@query(V.with_views("mentions") + f", {CATEGORY_SQL} select entity_id, active_days, round(usual, 6) as usual from usual")
def category_baseline(spark, d):
    return panels.category_baseline(V.mentions(spark, d), NOW).withColumn("usual", F.round("usual", 6))


@query(
    V.with_views("entities")
    + """ select count(*) as total, count(*) filter (status = 'tracked') as tracked, count(*) filter (status = 'dismissed') as dismissed, count(*) filter (fame = 'famous') as famous,
  count(*) filter (fame = 'famous' and status = 'tracked') as famous_tracked, count(*) filter (type in ('country', 'region')) as places,
  min(id) filter (status = 'tracked') as first_tracked, max(id) filter (status = 'dismissed') as last_dismissed from entities"""
)
def entity_stats(spark, d):
    return panels.entity_stats(V.entities(spark, d))


def _customers(spark, d) -> DataFrame:
    """Customers as entities that their orders mention."""
    return V.table(spark, d, "orders").selectExpr("o_orderkey as article_id", "o_custkey as entity_id", "o_orderdate as arrival_at", "o_orderpriority as source_name")


CUSTOMERS_SQL = "with mentions as (select o_orderkey as article_id, o_custkey as entity_id, o_orderdate as arrival_at, o_orderpriority as source_name from orders)"
YEAR_NOW, D_YEAR_NOW = "timestamp_ntz'1996-01-01 00:00:00'", "timestamp '1996-01-01 00:00:00'"
FIRSTS_SQL = "firsts as (select entity_id, min(arrival_at) as first_seen_at, count(distinct source_name) as sources from mentions group by entity_id)"


@query(
    f"""{CUSTOMERS_SQL}, {FIRSTS_SQL} select * from firsts where first_seen_at >= {D_YEAR_NOW} - interval 480 hours and first_seen_at < {D_YEAR_NOW}
  and first_seen_at >= (select min(arrival_at) from mentions) + interval 72 hours order by first_seen_at desc, entity_id limit 5"""
)
def new_entities(spark, d):
    return panels.new_entities(_customers(spark, d), YEAR_NOW, hours=480)


# ------------------------------------------------------------------ detectors


@query(V.with_views("mentions", "hourly") + f", {PANEL_SQL}, {EPOCH_SQL}, {SURGE_SQL} {_surges(2.0)}")
def surge_signals(spark, d):
    return detectors.surges(V.mentions(spark, d), NOW, k=2.0)


SHIFT_SQL = """shift as (select entity_id, observed, sentiment / observed - baseline_sentiment / baseline as delta from panel
  where baseline_days >= 3 and baseline >= 10 and observed >= 5 and (select coalesce(bool_or(sentiment <> 0), false) from panel))"""
SHIFTS_SQL = """select 'sentiment' as type, entity_id, case when delta <= -0.5 and observed >= 10 then 'critical' else 'warning' end as severity,
  round(least(1.0, 2 * abs(delta)), 6) as confidence, round(delta, 6) as value from shift where delta <= -0.3"""


@query(V.with_views("mentions", "hourly") + f", {PANEL_SQL}, {SHIFT_SQL} {SHIFTS_SQL}")
def sentiment_shift(spark, d):
    return detectors.sentiment_shifts(V.mentions(spark, d), NOW)


SPREAD_SQL = f"""spread as (select entity_id, n, n - usual as excess, active_days from usual join (select entity_id, count(distinct category) as n from mentions
  where effective_at >= {D_NOW} - interval 24 hours and effective_at < {D_NOW} group by entity_id) using (entity_id))"""
SPREADS_SQL = """select 'cross_category' as type, entity_id, case when excess >= 4 then 'critical' when excess >= 3 then 'warning' else 'advisory' end as severity,
  round(least(1.0, excess / 4.0), 6) as confidence, round(excess, 6) as value from spread where active_days >= 3 and n >= 4 and excess >= 2"""


@query(V.with_views("mentions") + f", {CATEGORY_SQL}, {SPREAD_SQL} {SPREADS_SQL}")
def category_spread(spark, d):
    return detectors.category_spreads(V.mentions(spark, d), NOW)


FIRST_SEEN_SQL = f"""select 'first_seen' as type, entity_id, case when sources >= 8 then 'critical' else 'warning' end as severity, round(least(1.0, sources / 8.0), 6) as confidence,
  cast(sources as double) as value from firsts where sources >= 2 and first_seen_at >= {D_NOW} - interval 48 hours and first_seen_at < {D_NOW}
  and first_seen_at >= (select min(arrival_at) from mentions) + interval 72 hours"""


@query(f"{CUSTOMERS_SQL}, {FIRSTS_SQL} {FIRST_SEEN_SQL}".replace(D_NOW, D_YEAR_NOW))
def first_seen_novelty(spark, d):
    return detectors.first_seen(_customers(spark, d), YEAR_NOW)


@query(
    V.with_views("article_entities", "edges", "entities")
    + f""", both_ends as (select e.*, a.fame as fame_a, b.fame as fame_b from edges e join entities a on a.id = entity_a and a.status = 'tracked' join entities b on b.id = entity_b and b.status = 'tracked')
select entity_a, entity_b, article_count, case when article_count >= 6 then 'critical' else 'warning' end as severity, round(least(1.0, article_count / 6.0), 6) as confidence from both_ends
where first_seen_at >= {D_ORDERS_NOW} - interval 240 hours and first_seen_at < {D_ORDERS_NOW} and first_seen_at >= (select min(first_seen_at) from both_ends) + interval 72 hours
  and not (fame_a = 'famous' and fame_b = 'famous') and article_count >= 2"""
)
def novel_edges(spark, d):
    return detectors.novel_edges(_edges(spark, d), V.entities(spark, d), ORDERS_NOW, hours=240)


# ------------------------------------------------------------------ graph


@query(V.with_views("article_entities", "edges") + " select * from edges")
def edge_rollup(spark, d):
    return _edges(spark, d)


PARTNERS_SQL = """partners as (select * from (select entity_id, other_id, article_count, cast(row_number() over (partition by entity_id order by article_count desc, other_id) as integer) as rank
  from (select entity_a as entity_id, entity_b as other_id, article_count from edges union all select entity_b, entity_a, article_count from edges)) where rank <= 5)"""


@query(V.with_views("article_entities", "edges") + f", {PARTNERS_SQL} select * from partners")
def cooccurrence_top5(spark, d):
    return graph.top_partners(_edges(spark, d))


@query(V.with_views("article_entities", "edges") + f", {PARTNERS_SQL} select least(entity_id, other_id) as source, greatest(entity_id, other_id) as target, max(article_count) as value from partners group by all")
def network_links(spark, d):
    return graph.network_links(_edges(spark, d), V.article_entities(spark, d), least=1)


@query(
    V.with_views("article_entities", "edges", "entities")
    + """ select case when entity_a = 3 then entity_b else entity_a end as other_id, article_count, last_seen_at, canonical_name
from edges join entities on id = case when entity_a = 3 then entity_b else entity_a end where entity_a = 3 or entity_b = 3 order by article_count desc, other_id limit 10"""
)
def ego_edges(spark, d):
    return graph.ego_edges(_edges(spark, d), V.entities(spark, d), 3)


@query(
    V.with_views("article_entities")
    + """ select * from (select a.entity_id as entity_a, b.entity_id as entity_b, cast(row_number() over (partition by a.entity_id, b.entity_id order by a.arrival_at desc, a.article_id) as integer) as rank, a.article_id, a.arrival_at
from article_entities a join article_entities b on a.article_id = b.article_id and a.entity_id < b.entity_id) where rank <= 5"""
)
def pair_evidence(spark, d):
    return graph.pair_evidence(V.article_entities(spark, d), _edges(spark, d))


RELATIONS_SQL = """rolled as (select source_id, target_id, relation, count(*) as article_count, min(arrival_at) as first_seen_at, max(arrival_at) as last_seen_at,
  arg_max(article_id, {'a': arrival_at, 'b': article_id}) as evidence_article_id from relations group by all)"""


@query(V.with_views("relations") + f", {RELATIONS_SQL} select * from rolled")
def relation_rollup(spark, d):
    return rollups.relation_rollup(V.relations(spark, d))


@query(
    V.with_views("relations", "entities")
    + f", {RELATIONS_SQL} select source_id, canonical_name as source_name, target_id, relation, article_count, evidence_article_id from rolled join entities on id = source_id and status = 'tracked'"
)
def relation_ends(spark, d):
    return graph.relation_ends(rollups.relation_rollup(V.relations(spark, d)), V.entities(spark, d))


@query(V.with_views("mentions") + " select entity_id, min(arrival_at) as first_seen_at, max(arrival_at) as last_seen_at from mentions group by entity_id")
def last_seen(spark, d):
    return rollups.last_seen(V.mentions(spark, d))


# ------------------------------------------------------------------ stories

SPACES_SQL = "\\s\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}"
NORMAL_SQL = f"""trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '&(amp|lt|gt|quot|#39);', '', 'g'), '[^a-z0-9{SPACES_SQL}]', '', 'g'), '[{SPACES_SQL}]+', ' ', 'g'), ' ')"""
SIGNED_SQL = f"""signed as (select *, coalesce(nullif(array_to_string(list_slice(list_sort(list_distinct(list_filter(string_split(plain, ' '), lambda w: length(w) >= 3 and w not in ({X.STOPWORDS})))), 1, 6), '|'), ''), plain) as title_signature
  from (select *, {NORMAL_SQL} as plain from articles))"""
HASH_SQL = """sha256(concat_ws('|', trim(regexp_replace(lower(title), '[ \\t\\n\\r]+', ' ', 'g'), ' '), regexp_extract(link, '^https?://([^/]+)', 1)))"""


def _signed(spark, d):
    return stories.identified(V.articles(spark, d))


@query(V.with_views("articles") + f", {SIGNED_SQL} select id, title_signature from signed")
def title_signature(spark, d):
    return _signed(spark, d).select("id", "title_signature")


@query(V.with_views("articles") + f" select id, {HASH_SQL} as content_hash from articles")
def content_hash(spark, d):
    return _signed(spark, d).select("id", "content_hash")


@query(
    V.with_views("articles")
    + f""", hashed as (select id, {HASH_SQL} as content_hash from articles)
select min(id) as id, content_hash from hashed where id % 3 <> 0 and content_hash not in (select content_hash from hashed where id % 3 = 0) group by content_hash"""
)
def insert_new_articles(spark, d):
    rows = _signed(spark, d).select("id", "content_hash")
    return stories.insert_new(rows.where("id % 3 = 0"), rows.where("id % 3 <> 0"))


GROUPS_SQL = """grouped as (select a.id, arg_min(h.id, {'t': h.first_seen_at, 'i': h.id}) as dup_group_id from signed a join signed h on h.title_signature = a.title_signature and h.id <> a.id
  and h.first_seen_at <= a.first_seen_at and h.first_seen_at >= a.first_seen_at - interval 48 hours and (h.first_seen_at < a.first_seen_at or h.id < a.id) group by a.id)"""


@query(V.with_views("articles") + f", {SIGNED_SQL}, {GROUPS_SQL} select * from grouped")
def duplicate_groups(spark, d):
    return stories.duplicate_groups(_signed(spark, d))


CLUSTERS_SQL = """ordered as (select id, title_signature, coalesce(published_at, first_seen_at) as t, row_number() over (partition by title_signature order by coalesce(published_at, first_seen_at), id) as k from signed where title_signature <> ''),
folded as (select id, title_signature, t, k, id as head_id, t as head_at from ordered where k = 1 union all
  select o.id, o.title_signature, o.t, o.k, case when o.t - f.head_at > interval 48 hours then o.id else f.head_id end, case when o.t - f.head_at > interval 48 hours then o.t else f.head_at end
  from folded f join ordered o on o.title_signature = f.title_signature and o.k = f.k + 1),
heads as (select id, head_id from folded union all select id, id from signed where title_signature = '')"""
RECURSIVE = "with recursive " + V.with_views("articles")[5:]


@query(RECURSIVE + f", {SIGNED_SQL}, {CLUSTERS_SQL} select * from heads")
def story_clusters(spark, d):
    return stories.clusters(_signed(spark, d))


FEED_SQL = f"""feed as (select c.*, a.title, a.source_category from (select head_id, count(*) as cluster_size, max(first_seen_at) as updated_at, count(distinct source_name) as sources
  from signed join heads using (id) group by head_id) c join articles a on a.id = c.head_id where updated_at < {D_NOW})"""


@query(RECURSIVE + f", {SIGNED_SQL}, {CLUSTERS_SQL}, {FEED_SQL} select * from feed where updated_at >= {D_NOW} - interval 30 days order by updated_at desc, head_id limit 500")
def cluster_feed(spark, d):
    rows = _signed(spark, d)
    return stories.cluster_feed(rows, stories.clusters(rows), NOW)


@query(
    RECURSIVE
    + f""", {SIGNED_SQL}, {CLUSTERS_SQL}, {FEED_SQL}
select head_id, f.title, cluster_size, sources, round(ln(1 + cluster_size) * exp(-((epoch({D_NOW}) - epoch(coalesce(published_at, first_seen_at))) / 3600.0) / 24.0), 6) as score
from feed f join articles a on a.id = f.head_id where f.updated_at >= {D_NOW} - interval 30 days and coalesce(published_at, first_seen_at) >= {D_NOW} - interval 48 hours and coalesce(published_at, first_seen_at) < {D_NOW}
order by score desc, head_id limit 15"""
)
def top_stories(spark, d):
    rows = _signed(spark, d)
    return stories.top_stories(rows, stories.clusters(rows), NOW)


@query(
    V.with_views("articles")
    + " select id, title from articles where source_category = 'en' and (contains(lower(title), 'license') or contains(lower(source_name), 'license') or contains(lower(summary), 'license') or contains(lower(source_category), 'license'))"
)
def feed_search(spark, d):
    return stories.search(V.articles(spark, d), " License ", "en").select("id", "title")


# ------------------------------------------------------------------ texts


@query("select page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ' ') as title from pages")
def extract_title(spark, d):
    return V.table(spark, d, "pages").select("page_id", T.extract_tag("html", "title").alias("title"))


def _strip_sql(column: str) -> str:
    out = f"regexp_replace({column}, '<[^>]*>', ' ', 'g')"
    for a, b in T.HTML_ENTITIES:
        out = f"replace({out}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    out = f"regexp_replace(regexp_replace({out}, '&#x?[0-9a-fA-F]+;', '', 'g'), '<[^>]*>', ' ', 'g')"
    return f"trim(regexp_replace({out}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')"


@query(f"select page_id, {_strip_sql('html')} as plain from pages")
def strip_html(spark, d):
    return V.table(spark, d, "pages").select("page_id", T.strip_html("html").alias("plain"))


@query("select page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) as domain, case when url like 'http://%' or url like 'https://%' then url else '' end as link from pages")
def page_hosts(spark, d):
    return V.table(spark, d, "pages").select("page_id", T.domain("url").alias("domain"), T.sanitize_url("url").alias("link"))


SENTIMENT_SQL = f"""greatest(-1.0, least(1.0, list_sum(list_transform(string_split_regex(lower(coalesce(t, '')), '[^a-zA-Z0-9_]+'),
  lambda w: case when w in ({X.listed(X.NEGATIVE)}) then -1 when w in ({X.listed(X.POSITIVE)}) then 1
  else cast(regexp_matches(w, '^({X.stems(X.POSITIVE)})') as integer) - cast(regexp_matches(w, '^({X.stems(X.NEGATIVE)})') as integer) end))
  / greatest(1.0, sqrt(len(string_split_regex(lower(coalesce(t, '')), '[^a-zA-Z0-9_]+'))))))"""
TEXT_SQL = "(select id, concat_ws(' ', title, summary) as t from headlines)"


def _texts(spark, d) -> DataFrame:
    return V.headlines(spark, d).select("id", F.concat_ws(" ", "title", "summary").alias("text"))


@query(V.with_views("headlines") + f" select id, round({SENTIMENT_SQL}, 6) as sentiment from {TEXT_SQL}")
def sentiment_score(spark, d):
    return _texts(spark, d).select("id", F.round(L.sentiment("text"), 6).alias("sentiment"))


@query(
    V.with_views("headlines", "terms")
    + f""", found as (select id, unnest(regexp_extract_all(t, '\\b([A-Z][A-Z0-9]{{1,4}})\\b', 1)) as w from {TEXT_SQL}),
kept as (select id, string_agg(distinct w, '|' order by w) as acronyms from found where w not in ({X.ACRONYM_STOPLIST}) and lower(w) not in (select lower(term) from terms) group by id)
select id, coalesce(acronyms, '') as acronyms from headlines left join kept using (id)"""
)
def acronyms(spark, d):
    known = V.terms(spark).agg(F.collect_set(F.lower("term")).alias("known"))
    return _texts(spark, d).join(F.broadcast(known)).select("id", F.array_join(L.acronyms("text", "known"), "|").alias("acronyms"))


@query(
    V.with_views("headlines")
    + f""" select id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(t, '\\b([A-Z][a-z]+(?:[{SPACES_SQL}]+[A-Z][a-z]+){{1,2}})\\b', 1), lambda w: lower(w) not in ({X.PERSON_STOPLIST})))), '|') as names from {TEXT_SQL}"""
)
def person_names(spark, d):
    return _texts(spark, d).select("id", F.array_join(L.person_names("text"), "|").alias("names"))


@query(
    V.with_views("headlines")
    + f""" select id, array_to_string(list_sort(list_distinct(list_filter(list_concat(list_filter(regexp_extract_all(t, '\\b([A-Z][a-zA-Z0-9-]*[0-9][a-zA-Z0-9-]*)\\b', 1), lambda w: length(w) >= 3),
  regexp_extract_all(t, '\\b([A-Z][a-z]+[A-Z][a-zA-Z]*)\\b', 1)), lambda w: lower(w) not in ('covid-19', 'covid19', '24/7', '9/11', '401k', 'y2k')))), '|') as products from {TEXT_SQL}"""
)
def product_names(spark, d):
    return _texts(spark, d).select("id", F.array_join(L.products("text"), "|").alias("products"))


@query(
    V.with_views("headlines", "terms")
    + f""", lasts as (select lower(term) as key, arg_max(canonical, place) as canonical, arg_max(type, place) as type, bool_or(length(term) between 2 and 5 and term = upper(term) and term <> lower(term)) as acronym from terms group by all),
usable as (select *, regexp_replace(key, '([.+*?()])', '\\\\\\1', 'g') as pattern from lasts where length(key) >= 3 or acronym)
select distinct id, canonical, type from {TEXT_SQL} join usable on case when acronym then regexp_matches(t, '(^|[^A-Za-z])' || upper(pattern) || '($|[^A-Za-z])') else regexp_matches(lower(t), '(^|[^a-z])' || pattern || '($|[^a-z])') end"""
)
def dictionary_match(spark, d):
    return L.dictionary_matches(_texts(spark, d), V.terms(spark))


@query(
    V.with_views("headlines")
    + f""" select id, list_bool_or([contains(lower(link), s) for s in [{X.AD_LINKS}]]) or regexp_matches(title, '(?i){X.AD_TITLES}')
  or regexp_matches(t, '(?i)paid (content|partner|post|promotion)') or (regexp_matches(t, '(?i)\\baffiliate\\b') and regexp_matches(t, '(?i)\\b(link|commission|earn)\\b')) as ad,
  regexp_matches(title, '(?i){X.FINANCIAL_AD_TITLES}') as financial from (select *, concat_ws(' ', title, coalesce(summary, '')) as t from headlines)"""
)
def ad_filter(spark, d):
    return V.headlines(spark, d).select("id", L.is_ad("title", "summary", "link").alias("ad"), L.is_financial_ad("title").alias("financial"))


CATEGORIES = ("Conflict/Humanitarian", "cyber threats", "Space weather", "Natural Disaster", "Health", "Government Advisory", "AVIATION", "Economic/Energy", "Supply Chain", "Trade/Maritime", "AI/ML", "Visual", "Think Tank", "")


@query(f"select event_id, {X.URGENCY} as urgency from (select event_id, lower([{', '.join(repr(c) for c in CATEGORIES)}][event_id % {len(CATEGORIES)} + 1]) as c from events)")
def urgency_level(spark, d):
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("event_id") % len(CATEGORIES) + 1).cast("int"))
    return V.table(spark, d, "events").select("event_id", L.urgency(category).alias("urgency"))


@query(
    f"select event_id, strftime(ts, '%Y-%m') as month, case when s < 5 then 'NOW' when s < 60 then concat(s, 's') when s < 3600 then concat(s // 60, 'm') when s < 86400 then concat(s // 3600, 'h') else concat(s // 86400, 'd') end as age from (select event_id, ts, cast(floor((epoch_ms({D_NOW}) - epoch_ms(ts)) / 1000) as bigint) as s from events where ts < {D_NOW})"
)
def event_ages(spark, d):
    rows = V.table(spark, d, "events").where(f"ts < {NOW}")
    return rows.select("event_id", D.month("ts").alias("month"), D.age("ts", F.expr(NOW)).alias("age"))


# ------------------------------------------------------------------ candidates, state, developments


def _sightings(spark, d):
    return V.mentions(spark, d).selectExpr(
        "concat('n', entity_id % 40) as norm",
        "concat('Name ', repeat('x', cast(article_id % 5 as int)), entity_id) as display",
        "category as source_name",
        "concat('t', article_id % 9) as title",
        "effective_at",
        "article_id as seq",
    )


SIGHTINGS_SQL = """sightings as (select concat('n', entity_id % 40) as norm, concat('Name ', repeat('x', article_id % 5), entity_id) as display, category as source_name, concat('t', article_id % 9) as title, effective_at, article_id as seq from mentions),
firsts as (select norm, 's' as kind, source_name as value, min({'a': effective_at, 'b': seq}) as t from sightings group by all union all select norm, 't', title, min({'a': effective_at, 'b': seq}) from sightings group by all),
picked as (select norm, kind, value, t, row_number() over (partition by norm, kind order by t) as k from firsts),
rolled as (select norm, count(*) as mention_count, count(distinct cast(effective_at as date)) as day_count, min(effective_at) as first_seen_at, max(effective_at) as last_seen_at,
  arg_min(display, {'l': -length(display), 'a': effective_at, 'b': seq}) as display_name from sightings group by norm),
candidates as (select r.*, (select string_agg(value, '|' order by k) from picked p where p.norm = r.norm and kind = 's' and k <= 10) as source_names,
  (select string_agg(value, '|' order by k) from picked p where p.norm = r.norm and kind = 't' and k <= 3) as sample_titles from rolled r)"""


@query(V.with_views("mentions") + f", {SIGHTINGS_SQL} select * from candidates")
def candidate_rollup(spark, d):
    return rollups.candidate_rollup(_sightings(spark, d))


@query(V.with_views("mentions") + f", {SIGHTINGS_SQL} select norm, day_count from candidates where (day_count >= 2 and len(string_split(source_names, '|')) >= 2) or len(string_split(source_names, '|')) >= 3")
def corroborated_candidates(spark, d):
    return developments.corroborated(rollups.candidate_rollup(_sightings(spark, d))).select("norm", "day_count")


@query(
    V.with_views("mentions")
    + """, half as (select article_id % 2 as side, entity_id, date_trunc('hour', effective_at) as bucket, count(*) as mentions, count(distinct source_name) as source_count, sum(sentiment) as sentiment_sum from mentions group by all)
select entity_id, bucket, cast(sum(mentions) as bigint) as mentions, max(source_count) as source_count, sum(sentiment_sum) as sentiment_sum from half group by all"""
)
def hourly_upsert(spark, d):
    rows = V.mentions(spark, d)
    return state.merge_hourly(panels.hourly_rollup(rows.where("article_id % 2 = 0")), panels.hourly_rollup(rows.where("article_id % 2 = 1")))


@query(V.with_views("article_entities", "edges") + " select * from edges")
def edge_upsert(spark, d):
    rows = V.article_entities(spark, d)
    return state.merge_edges(rollups.edge_rollup(rows.where("article_id % 2 = 0")), rollups.edge_rollup(rows.where("article_id % 2 = 1")))


def _stored_signals(spark, d):
    return V.table(spark, d, "customer").selectExpr(
        "concat('k', c_custkey) as dedupe_key",
        "element_at(array('new', 'seen', 'dismissed', 'promoted'), cast(c_custkey % 4 as int) + 1) as state",
        "cast(0.25 as double) as confidence",
        f"{NOW} - interval 5 days as first_detected_at",
        f"{NOW} - interval 4 days as last_evidence_at",
        f"if(c_custkey % 4 = 2, {NOW} - make_dt_interval(0, cast(c_custkey % 150 as int)), cast(null as timestamp_ntz)) as state_changed_at",
    )


SIGNALS_SQL = f"""stored as (select concat('k', c_custkey) as dedupe_key, ['new', 'seen', 'dismissed', 'promoted'][cast(c_custkey % 4 as int) + 1] as state, cast(0.25 as double) as confidence,
  {D_NOW} - interval 5 days as first_detected_at, {D_NOW} - interval 4 days as last_evidence_at, case when c_custkey % 4 = 2 then {D_NOW} - to_hours(c_custkey % 150) end as state_changed_at from customer),
found as (select concat(case when s_suppkey % 3 = 0 then 'n' else 'k' end, s_suppkey) as dedupe_key, cast(0.75 as double) as confidence from supplier),
fresh as (select * from found where dedupe_key not in (select dedupe_key from stored where state = 'dismissed' and state_changed_at >= {D_NOW} - interval 72 hours))"""


@query(
    f"""with {SIGNALS_SQL} select s.dedupe_key, s.state, case when s.state <> 'dismissed' then coalesce(f.confidence, s.confidence) else s.confidence end as confidence, s.first_detected_at,
  case when s.state <> 'dismissed' and f.confidence is not null then {D_NOW} else s.last_evidence_at end as last_evidence_at, s.state_changed_at from stored s left join fresh f using (dedupe_key)
union all select dedupe_key, 'new', confidence, {D_NOW}, {D_NOW}, null from fresh where dedupe_key not in (select dedupe_key from stored where state <> 'dismissed')"""
)
def signal_upsert(spark, d):
    stored = _stored_signals(spark, d)
    fresh = V.table(spark, d, "supplier").selectExpr("concat(if(s_suppkey % 3 = 0, 'n', 'k'), s_suppkey) as dedupe_key", "cast(0.75 as double) as confidence")
    return state.persist_signals(stored, fresh, NOW)


@query("select c_mktsegment as state, count(*) as n from customer group by all union all select 'all', count(*) from customer")
def state_counts(spark, d):
    rows = V.table(spark, d, "customer").selectExpr("c_mktsegment as state")
    return rows.groupBy("state").agg(F.count("*").alias("n")).unionByName(rows.agg(F.count("*").alias("n")).withColumn("state", F.lit("all")))


@query(V.with_views("articles") + f" select id from articles where first_seen_at >= {D_NOW} - interval 20 days")
def retention(spark, d):
    return state.kept_articles(V.articles(spark, d), NOW, days=20).select("id")


@query(
    """select s_suppkey as id, case when coalesce(s_suppkey % 3 > 0 and (views >= 20000 or (links >= 25 and views >= 3000)), false) then 'famous' else 'not_famous' end as fame
from (select s_suppkey, cast(round(s_acctbal * 10) as bigint) as views, s_suppkey % 60 as links from supplier)"""
)
def wiki_fame(spark, d):
    rows = V.table(spark, d, "supplier").selectExpr("s_suppkey as id", "cast(round(s_acctbal * 10) as bigint) as views", "s_suppkey % 60 as links", "s_suppkey % 3 > 0 as matched")
    return rows.select("id", scoring.wiki_fame("matched", "views", "links").alias("fame"))


@query(
    """select strftime(o_orderdate, '%Y-%m') as month, round(sum(o_orderkey % 9000) / 1e6 * 1.0 + sum(o_custkey % 700) / 1e6 * 5.0 + sum(o_orderkey % 77 * 2) / 1e6 * 0.5 + sum(o_custkey % 31 * 2) / 1e6 * 2.5, 6) as cost,
  sum(o_orderkey % 9000) / 1e6 * 1.0 + sum(o_custkey % 700) / 1e6 * 5.0 + sum(o_orderkey % 77 * 2) / 1e6 * 0.5 + sum(o_custkey % 31 * 2) / 1e6 * 2.5 < 5.0 as open from orders group by all"""
)
def month_cost(spark, d):
    counters = {"input_tokens": "o_orderkey % 9000", "output_tokens": "o_custkey % 700", "batch_input_tokens": "o_orderkey % 77 * 2", "batch_output_tokens": "o_custkey % 31 * 2"}
    rows = V.table(spark, d, "orders").groupBy(D.month("o_orderdate").alias("month")).agg(*[F.sum(F.expr(e).cast("double")).alias(n) for n, e in counters.items()])
    return rows.select("month", F.round(scoring.month_cost(), 6).alias("cost"), scoring.within_budget(scoring.month_cost(), F.lit(5.0)).alias("open"))

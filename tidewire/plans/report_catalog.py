"""More queries by name: lists, lookups and summaries, each with DuckDB SQL for the same rows."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, reports, rollups, stories
from . import catalog as C
from . import views as V
from .catalog import D_NOW, NOW, query


@query(
    V.with_views("entities")
    + """, s as (select c_custkey as id, case c_custkey % 3 when 0 then 'advisory' when 1 then 'critical' else 'warning' end as severity, case when c_custkey % 4 = 0 then 'dismissed' else 'new' end as state,
  [c_custkey % 40, c_custkey % 300, 5] as ids, c_custkey % 50 as last_evidence_at from customer)
select s.id, severity, coalesce(string_agg(e.canonical_name, '|' order by k), '') as names from s cross join range(1, 4) r(k) left join entities e on e.id = s.ids[k] where state in ('new', 'seen') group by s.id, severity"""
)
def lateral_names(spark, d):
    signals = V.table(spark, d, "customer").selectExpr(
        "c_custkey as id",
        "case c_custkey % 3 when 0 then 'advisory' when 1 then 'critical' else 'warning' end as severity",
        "case when c_custkey % 4 = 0 then 'dismissed' else 'new' end as state",
        "array(c_custkey % 40, c_custkey % 300, 5L) as entity_ids",
        "c_custkey % 50 as last_evidence_at",
    )
    return reports.signal_list(signals, V.entities(spark, d), ["new", "seen"])


CARD = "concat('subject ', p_size) as subject_norm, substr('RNCE', cast(p_partkey % 4 as int) + 1, 1) as kind, cast(p_partkey % 6 as double) / 10 as strength, p_partkey as seq"


@query(
    f"""select subject_norm, kind, strength, seq from (select *, row_number() over (partition by subject_norm order by strength desc, instr('RNCE', kind), seq) as n from (select {CARD} from part)) where n = 1"""
)
def card_dedupe(spark, d):
    return reports.best_cards(spark.sql(f"select {CARD} from {{part}}", part=V.table(spark, d, "part")))


@query(
    """with v as (select c_mktsegment as name, strftime(o_orderdate, '%Y-%m') as month, count(*) as views from orders join customer on c_custkey = o_custkey group by all),
m as (select strftime(date '1997-01-01' + to_months(cast(k as integer)), '%Y-%m') as month from range(0, 12) r(k))
select name, cast(floor(quantile_cont(coalesce(views, 0), 0.5) + 0.5) as bigint) as median_views from (select distinct name from v) n cross join m left join v using (name, month) group by name"""
)
def median_pageviews(spark, d):
    orders = V.table(spark, d, "orders").join(V.table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    views = orders.groupBy(F.col("c_mktsegment").alias("name"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("views"))
    months = spark.range(12).selectExpr("date_format(add_months(date'1997-01-01', cast(id as int)), 'yyyy-MM') as month")
    return reports.median_of_months(views, months)


@query(
    V.with_views("mentions")
    + f""" select cast(entity_id as varchar) as entity, count(*) as mentions, max(effective_at) as last_seen, count(*) filter (age between 0 and 3600) as last_1h, count(*) filter (age between 0 and 21600) as last_6h,
  count(*) filter (age between 0 and 86400) as last_24h, floor(avg(sentiment) * 100 + 0.5) / 100 as sentiment, count(distinct category) as categories, count(distinct source_name) as sources
from (select *, floor(epoch({D_NOW})) - floor(epoch(effective_at)) as age from mentions) group by entity_id having count(*) >= 2"""
)
def entity_summary(spark, d):
    items = V.mentions(spark, d).selectExpr("cast(entity_id as string) as entity", "category", "source_name as source", "effective_at as at", "sentiment")
    return reports.entity_summary(items, NOW)


@query(
    V.with_views("mentions", "hourly")
    + " select entity_id, round(avg(mentions), 6) as mean, count(*) as samples from (select *, row_number() over (partition by entity_id order by bucket desc) as n from hourly) where n <= 168 group by entity_id"
)
def ring_baseline(spark, d):
    return reports.ring_baseline(C._hourly(spark, d).withColumnRenamed("mentions", "value"))


@query(
    V.with_views("mentions")
    + """, p as (select entity_id, count(distinct category) as categories, count(distinct source_name) as sources, entity_id % 5 as new_edges, case when entity_id % 4 = 0 then entity_id % 8 else count(*) end as mentions, case when entity_id % 3 > 0 then (entity_id % 40 + 1) / 2.0 end as usual from mentions group by entity_id),
q as (select entity_id, mentions, categories, least(30.0, categories * 6.0) as category, case when mentions > 0 then least(15.0, floor(sources / mentions * 20 + 0.5)) else 0.0 end as diversity, least(25.0, new_edges * 8.0) as edges,
  case when mentions / usual > 2 then least(20.0, floor((mentions / usual - 1) * 5 + 0.5)) else 0.0 end as surprise, case when usual is null and mentions >= 2 then 10.0 else 0.0 end as emergence from p),
r as (select *, case when mentions <= 5 and (categories >= 3 or edges > 0 or surprise > 0 or emergence > 0) then least(10.0, floor((6 - mentions) * 2.0 + 0.5)) else 0.0 end as quiet from q),
told as (select entity_id, unnest([{'s': case when categories >= 3 then category end, 'k': 0, 'n': 'category_crossover'}, {'s': nullif(edges, 0), 'k': 1, 'n': 'novel_edge'}, {'s': nullif(surprise, 0), 'k': 2, 'n': 'baseline_surprise'}, {'s': nullif(emergence, 0), 'k': 3, 'n': 'entity_emergence'}, {'s': nullif(quiet, 0), 'k': 4, 'n': 'quiet_mover'}]) as x from r)
select entity_id, least(100.0, category + diversity + edges + surprise + emergence + quiet) as novelty, coalesce((select string_agg(x.n, '|' order by x.s desc, x.k) from told t where t.entity_id = r.entity_id and x.s is not null), '') as reasons from r"""
)
def novelty_score(spark, d):
    parts = V.mentions(spark, d).groupBy("entity_id").agg(F.countDistinct("category").alias("categories"), F.countDistinct("source_name").alias("sources"), F.count("*").alias("n"))
    parts = parts.withColumns({"new_edges": F.expr("entity_id % 5"), "usual": F.expr("case when entity_id % 3 > 0 then cast(entity_id % 40 + 1 as double) / 2 end"), "mentions": F.expr("if(entity_id % 4 = 0, entity_id % 8, n)")})
    return reports.novelty(parts)


@query(
    V.with_views("article_entities", "edges")
    + f""", h as (select concat_ws('|', entity_a, entity_b) as pair, article_count as count, {D_NOW} - to_days(cast(entity_a % 50 as integer)) as last_seen from edges where first_seen_at < timestamp '1998-01-01'),
n as (select concat_ws('|', entity_a, entity_b) as pair, article_count as count from edges where last_seen_at >= timestamp '1998-01-01')
select * from (select coalesce(h.pair, n.pair) as pair, coalesce(h.count, 0) + coalesce(n.count, 0) as count, case when n.count is not null then {D_NOW} else last_seen end as last_seen from h full join n on h.pair = n.pair)
where last_seen >= {D_NOW} - interval 30 days"""
)
def edge_history(spark, d):
    edges = C._edges(spark, d).withColumn("pair", F.concat_ws("|", "entity_a", "entity_b"))
    border = "timestamp_ntz'1998-01-01'"
    history = edges.where(f"first_seen_at < {border}").selectExpr("pair", "article_count as count", f"{NOW} - make_dt_interval(cast(entity_a % 50 as int)) as last_seen")
    return reports.merged_history(history, edges.where(f"last_seen_at >= {border}").selectExpr("pair", "article_count as count"), NOW)


@query(
    """select id from (select s_suppkey as id, case when s_suppkey % 3 > 0 then s_suppkey end as checked_at, s_suppkey * 7 % 31 as first_seen_at from supplier) order by checked_at is null desc, first_seen_at desc, id limit 40"""
)
def sweep_queue(spark, d):
    return reports.sweep_queue(V.table(spark, d, "supplier").selectExpr("s_suppkey as id", "case when s_suppkey % 3 > 0 then s_suppkey end as checked_at", "s_suppkey * 7 % 31 as first_seen_at"))


@query(
    V.with_views("mentions")
    + f", {C.SIGHTINGS_SQL} select norm, len(string_split(source_names, '|')) as sources from candidates where len(string_split(source_names, '|')) >= 3 and day_count >= 2 and last_seen_at >= {D_NOW} - interval 14 days"
)
def promotable_candidates(spark, d):
    return reports.promotable(rollups.candidate_rollup(C._sightings(spark, d)), NOW)


@query(V.with_views("entities") + " select id, canonical_name, (select count(*) from entities where contains(lower(canonical_name), '7') or contains(aliases[1], '7')) as total from entities where contains(lower(canonical_name), '7') or contains(aliases[1], '7') order by canonical_name, id limit 50 offset 2")
def entity_search(spark, d):
    return reports.find_entities(V.entities(spark, d), " 7 ", offset=2)


@query(
    V.with_views("entities")
    + """, names as (select case when c_custkey % 2 = 0 then concat('SUP ', c_custkey) else c_name end as name from customer), known as (select id, lower(canonical_name) as name, 0 as way from entities union all select id, lower(unnest(aliases)), 1 from entities)
select n.name, coalesce((select arg_min(id, {'w': way, 'i': id}) from known k where k.name = lower(n.name)), -1) as entity_id from names n"""
)
def name_lookup(spark, d):
    names = V.table(spark, d, "customer").selectExpr("case when c_custkey % 2 = 0 then concat('SUP ', c_custkey) else c_name end as name")
    return reports.resolve_names(names, V.entities(spark, d)).fillna(-1, ["entity_id"])


@query(
    """select o_orderpriority as reason, count(*) as n, (select string_agg(x, '|' order by x) from (select distinct cast(o_custkey as varchar) as x from orders i where i.o_orderpriority = o.o_orderpriority order by x limit 3)) as samples from orders o group by o_orderpriority"""
)
def failure_tally(spark, d):
    return reports.tally(V.table(spark, d, "orders").selectExpr("o_orderpriority as reason", "cast(o_custkey as string) as sample"), "reason", "sample")


@query(
    """select cast(s_suppkey as varchar) as custom_id, cast(s_suppkey % 9 as bigint) as index, 0 as place, s_name as name, case s_suppkey % 4 when 0 then 'person' when 1 then 'region' else 'other' end as type, case when s_suppkey % 5 = 0 then 'chair' end as role,
  case when s_suppkey % 2 = 0 then 'famous' else 'known' end as prominence from supplier where s_suppkey % 10 <> 9 union all select cast(s_suppkey as varchar), s_suppkey % 9, 2, 'Acme', 'company', null, 'known' from supplier where s_suppkey % 10 <> 9"""
)
def model_extractions(spark, d):
    return reports.parsed_extractions(_answers(spark, d))


def _answers(spark, d):
    """A model's answer for each supplier; every tenth is cut off and can't be read."""
    answer = """concat('Here: [{"index": ', s_suppkey % 9, ', "entities": [{"name": " ', s_name, '", "type": "', element_at(array('person', 'place', 'gadget', 'other'), cast(s_suppkey % 4 as int) + 1), '"', if(s_suppkey % 5 = 0, ', "role": " chair "', ''),
      if(s_suppkey % 2 = 0, ', "prominence": "famous"', ', "prominence": "huge"'), '}, {"name": " "}, {"name": "Acme", "type": "company"}], "relations": [{"source": "Acme", "target": "', s_name, '", "relation": "', if(s_suppkey % 3 = 0, 'supply', 'likes'), '"},
      {"source": "Acme", "target": "Nobody", "relation": "supply"}]}, {"index": "x", "entities": []}', if(s_suppkey % 10 = 9, '', ']'), ' done')"""
    return V.table(spark, d, "supplier").selectExpr("cast(s_suppkey as string) as custom_id", f"{answer} as result")


@query(
    """select cast(s_suppkey as varchar) as custom_id, cast(s_suppkey % 9 as bigint) as index, 0 as place, 'Acme' as source, case when s_suppkey % 3 = 0 then 'supply' else 'likes' end as relation, s_name as target, s_suppkey % 3 = 0 as known from supplier where s_suppkey % 10 <> 9"""
)
def model_relations(spark, d):
    return reports.parsed_relations(_answers(spark, d))


@query("select cast(row_number() over (order by category <> 'all', category) - 1 as integer) as place, category from (select distinct event_type as category from events union all select 'all')")
def category_list(spark, d):
    return stories.categories(V.table(spark, d, "events").selectExpr("event_type as source_category"))


PLACES = (
    '<media:content medium="image" url="http://m/{0}.png?x"/>',
    '<media:content url="https://m/{0}"/><media:thumbnail url=\'http://t/{0}\'/>',
    "<media:thumbnail url='t/{0}'/>",
    '<enclosure url="http://e/{0}" length="3" type="image/jpeg"/>',
    '<enclosure type="image/gif" url="http://f/{0}"/>',
    "<image><url> http://i/{0} </url></image>",
    "<description>text <img class='a' src='http://d/{0}'> more</description>",
    "<description>&lt;img src=&quot;x&quot;&gt; <img src=&quot;http://q/{0}&quot;></description>",
    "<description><img src='/relative/{0}'></description>",
)
FOUND = ("http://m/{0}.png?x", "https://m/{0}", "t/{0}", "http://e/{0}", "http://f/{0}", "http://i/{0}", "http://d/{0}", "http://q/{0}", "")


def _filled(parts, key: str, join: str = "concat") -> list[str]:
    return [f"{join}({', '.join(x for x in (_quoted(a), key, _quoted(b)))})" if "{0}" in p else _quoted(p) for p in parts for a, _, b in [p.partition("{0}")]]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(
    f"select page_id, [{', '.join(_filled(FOUND, 'page_id'))}][page_id % {len(FOUND)} + 1] as image, concat('https://www.google.com/s2/favicons?domain=', lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '&sz=128') as icon, regexp_replace(url, '[A-Za-z][A-Za-z0-9+.-]*://[^ \\t\\n\\r]+', '[url]', 'g') as redacted from pages"
)
def page_images(spark, d):
    rows = V.table(spark, d, "pages")
    items = F.array(*[F.concat(F.lit(a), F.col("page_id").cast("string"), F.lit(b.replace("{0}", "9"))) if "{0}" in p else F.lit(p) for p in PLACES for a, _, b in [p.partition("{0}")]])
    item = F.concat(F.lit("<item>"), F.element_at(items, (F.col("page_id") % len(PLACES) + 1).cast("int")), F.lit("</item>"))
    return rows.select("page_id", T.image_url(item).alias("image"), T.source_image_url("url", F.lit("")).alias("icon"), T.redact_urls("url").alias("redacted"))


@query(
    """with e as (select r_name as domain, n_name as next, cast(row_number() over (partition by r_name order by n_nationkey) - 1 as integer) as place from nation join region on n_regionkey = r_regionkey
  union all select n_name, r_name, 0 from nation join region on n_regionkey = r_regionkey union all select n_name, concat('x', n_nationkey), 1 from nation),
t as (select r_regionkey as seq, r_name as domain, case when r_regionkey % 2 = 0 then 'critical' else 'warning' end as severity from region),
f as (select t.seq, t.severity, t.domain as trigger, e.next as second, e.place from t join e on e.domain = t.domain and e.place < 2)
select seq, severity, trigger, second, third from (select *, (select arg_min(next, place) from e where e.domain = f.second and next <> f.trigger) as third from f)
order by severity = 'critical' desc, (third is not null) desc, seq, place, trigger, second limit 6"""
)
def cascades(spark, d):
    both = V.table(spark, d, "nation").join(V.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    edges = both.selectExpr("r_name as domain", "n_name as next", "cast(row_number() over (partition by r_name order by n_nationkey) - 1 as int) as place")
    edges = edges.union(both.selectExpr("n_name", "r_name", "0")).union(both.selectExpr("n_name", "concat('x', n_nationkey)", "1"))
    triggers = V.table(spark, d, "region").selectExpr("r_regionkey as seq", "r_name as domain", "case when r_regionkey % 2 = 0 then 'critical' else 'warning' end as severity")
    return graph.cascades(edges, triggers)

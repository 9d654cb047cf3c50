"""Queries along the extraction path: names in layers, their merge, what each one is, each with DuckDB SQL for the same rows."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import language as L
from ..operators import extraction
from . import expected as X
from . import views as V
from .catalog import SPACES_SQL, query

#: Ranks of the layers, as the SQL states them.
_RANK = "case layer when 'dictionary' then 5 when 'llm' then 4 when 'compromise' then 3 when 'acronym' then 2 when 'person-regex' then 1 else 0 end"
_NORM = "trim(regexp_replace(lower(strip_accents(display)), '\\s+', ' ', 'g'))"
TEXTS_SQL = V.with_views("headlines", "terms") + ", texts as (select id, concat(coalesce(title, ''), ' ', coalesce(summary, '')) as t from headlines)"
FOUND_SQL = (
    TEXTS_SQL
    + f""", lasts as (select lower(term) as key, arg_max(canonical, place) as canonical, arg_max(type, place) as type, bool_or(length(term) between 2 and 5 and term = upper(term) and term <> lower(term)) as acronym from terms group by all),
usable as (select *, regexp_replace(key, '([.+*?()])', '\\\\\\1', 'g') as pattern from lasts where length(key) >= 3 or acronym),
matched as (select distinct id, canonical, type from texts join usable on case when acronym then regexp_matches(t, '(^|[^A-Za-z])' || upper(pattern) || '($|[^A-Za-z])') else regexp_matches(lower(t), '(^|[^a-z])' || pattern || '($|[^a-z])') end),
named as (select id, 'dictionary' as layer, canonical as display, type as type_hint from matched
  union all select distinct id, 'acronym', w, 'organization' from (select id, unnest(regexp_extract_all(t, '\\b([A-Z][A-Z0-9]{{1,4}})\\b', 1)) as w from texts) where w not in ({X.ACRONYM_STOPLIST}) and lower(w) not in (select lower(term) from terms)
  union all select distinct id, 'person-regex', w, 'person' from (select id, unnest(regexp_extract_all(t, '\\b([A-Z][a-z]+(?:[{SPACES_SQL}]+[A-Z][a-z]+){{1,2}})\\b', 1)) as w from texts) where lower(w) not in ({X.PERSON_STOPLIST})
  union all select distinct id, 'product-pattern', w, 'other' from (select id, unnest(list_concat(list_filter(regexp_extract_all(t, '\\b([A-Z][a-zA-Z0-9-]*[0-9][a-zA-Z0-9-]*)\\b', 1), lambda w: length(w) >= 3), regexp_extract_all(t, '\\b([A-Z][a-z]+[A-Z][a-zA-Z]*)\\b', 1))) as w from texts)
    where lower(w) not in ('covid-19', 'covid19', '24/7', '9/11', '401k', 'y2k') and lower(w) not in (select lower(term) from terms)),
found as (select id as article_id, layer, cast(row_number() over (partition by id, layer order by display) as integer) as seq, display, type_hint, cast(null as varchar) as role_context, cast(null as varchar) as prominence from named)"""
)
ANSWERS_SQL = """answers as (select id as article_id, 'llm' as layer, 1 as seq, concat('Desk ', source_name) as display, 'organization' as type_hint, concat('role ', id % 4) as role_context, case when id % 2 = 0 then 'famous' else 'known' end as prominence
  from headlines where source_name is not null union all select id, 'llm', 2, 'nato', 'person', 'ally', 'known' from headlines)"""


def merged_sql(found: str) -> str:
    """One row for each article and name of a table of found names."""
    return f"""ranked as (select *, {_NORM} as norm, {_RANK} as rank from {found}),
strongest as (select *, max(rank) over (partition by article_id, norm) as top from ranked where norm <> ''),
merged as (select article_id, norm, arg_min(display, {{'l': -length(display), 's': seq, 'd': display}}) as display, arg_min(type_hint, {{'s': seq, 'd': display}}) as type_hint, any_value(layer) as layer,
  arg_min(coalesce(role_context, '-'), {{'s': seq, 'd': display}}) as role, arg_min(coalesce(prominence, '-'), {{'s': seq, 'd': display}}) as prominence from strongest where rank = top group by article_id, norm)"""


def _found(spark, d) -> DataFrame:
    return extraction.found_names(V.headlines(spark, d), V.terms(spark))


def _answered(spark, d) -> DataFrame:
    """Names of a model's answers for the articles of some sources, and of the dictionary; all layers for the others."""
    rows = V.headlines(spark, d)
    answers = rows.where("source_name is not null").selectExpr("id as article_id", "'llm' as layer", "1 as seq", "concat('Desk ', source_name) as display", "'organization' as type_hint", "concat('role ', id % 4) as role_context", "if(id % 2 = 0, 'famous', 'known') as prominence")
    answers = answers.unionByName(rows.selectExpr("id as article_id", "'llm' as layer", "2 as seq", "'nato' as display", "'person' as type_hint", "'ally' as role_context", "'known' as prominence"))
    answered = rows.where("source_name not like 'src1%'").selectExpr("id as article_id")
    return extraction.answered_names(rows, V.terms(spark), answered, answers)


def _plain(rows: DataFrame) -> DataFrame:
    return rows.select("article_id", "norm", "display", "type_hint", "layer", F.coalesce("role_context", F.lit("-")).alias("role"), F.coalesce("prominence", F.lit("-")).alias("prominence"))


@query(f"{FOUND_SQL} select article_id, layer, seq, display, type_hint from found")
def extracted_names(spark, d):
    """Names of all articles by layer."""
    return _found(spark, d).select("article_id", "layer", "seq", "display", "type_hint")


@query(f"{FOUND_SQL}, {merged_sql('found')} select * from merged")
def merged_names(spark, d):
    """One candidate for each article and name, from all layers."""
    return _plain(extraction.merged_names(_found(spark, d)))


MIXED_SQL = f"""{FOUND_SQL}, {ANSWERS_SQL}, mixed as (select a.* from answers a join headlines on id = article_id where source_name not like 'src1%' union all
  select f.* from found f join headlines on id = article_id where source_name not like 'src1%' and layer = 'dictionary' union all select f.* from found f join headlines on id = article_id where (source_name like 'src1%' or source_name is null)), {merged_sql('mixed')}"""


@query(f"{MIXED_SQL} select * from merged")
def model_and_dictionary_names(spark, d):
    """Candidates where models' answers and the dictionary's names come together, and those of articles without an answer."""
    return _plain(extraction.merged_names(_answered(spark, d)))


@query(
    f"""{MIXED_SQL}, registry as (select canonical, min(place) as id from terms where type = 'country' or canonical = 'NATO' group by canonical union all select concat('Desk ', source_name), 100 + dense_rank() over (order by source_name) from (select distinct source_name from headlines where source_name like '%5')),
known as (select {_NORM.replace('display', 'canonical')} as norm, min(id) as entity_id, arg_min(canonical, id) as canonical from registry group by all)
select article_id, m.norm, coalesce(canonical, display) as name, case when entity_id is not null then 'resolved' when layer = 'dictionary' or (layer = 'llm' and prominence = 'famous') then 'new' else 'candidate' end as kind,
  entity_id is null and layer = 'llm' and prominence = 'famous' as auto_accepted, coalesce(entity_id, -1) as entity_id from merged m left join known k on k.norm = m.norm"""
)
def classified_names(spark, d):
    """What each candidate is, against a registry of some terms and of some sources' desks."""
    terms = V.terms(spark).where("type = 'country' or canonical = 'NATO'").groupBy("canonical").agg(F.min("place").cast("long").alias("id"))
    desks = V.headlines(spark, d).where("source_name like '%5'").select("source_name").distinct().selectExpr("concat('Desk ', source_name) as canonical", "100 + dense_rank() over (order by source_name) as id")
    registry = terms.unionByName(desks).selectExpr("cast(id as long) as id", "canonical as canonical_name", "cast(array() as array<string>) as aliases")
    rows = extraction.classified(extraction.merged_names(_answered(spark, d)), registry)
    return rows.select("article_id", "norm", "name", "kind", "auto_accepted", F.coalesce("entity_id", F.lit(-1)).alias("entity_id"))


def _untitled(name: str) -> str:
    """The name without the first title that stands before it, if two words of two letters or more are left."""
    cases = " ".join(f"when starts_with(lower({name}), '{t} ') then substr({name}, {len(t) + 2})" for t in X.NAME_TITLES)
    return f"case {cases} end"


@query(
    f"""{FOUND_SQL}, sources as (select distinct lower(trim(p)) as s from (select unnest(list_concat([source_name], string_split_regex(source_name, '\\s*[-–—|:]\\s*'))) as p from headlines where source_name is not null)),
persons as (select distinct id, w, string_split_regex(lower(w), '[{SPACES_SQL}]+') as words from (select id, unnest(regexp_extract_all(t, '\\b([A-Z][a-z]+(?:[{SPACES_SQL}]+[A-Z][a-z]+){{1,2}})\\b', 1)) as w from texts) where lower(w) not in ({X.PERSON_STOPLIST})),
plausible as (select id, w, {_untitled('w')} as rest from persons p where not list_has_any(words, [{X.NO_NAME_WORDS}, {X.FILLERS}]) and len(list_filter(words, lambda x: length(x) < 2)) = 0
  and lower(w) not in (select s from sources) and not exists (select 1 from matched m where m.id = p.id and contains(lower(w), lower(m.canonical)))),
kept as (select distinct id, case when len(string_split_regex(rest, '[{SPACES_SQL}]+')) >= 2 and len(list_filter(string_split_regex(rest, '[{SPACES_SQL}]+'), lambda x: length(x) < 2)) = 0 then rest else w end as name from plausible)
select id, coalesce((select string_agg(name, '|' order by name) from kept k where k.id = x.id), '') as names from texts x"""
)
def plausible_names(spark, d):
    """Names of persons that pass for one, without titles, of all articles."""
    rows = V.headlines(spark, d)
    texts = rows.select("id", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit(""))).alias("text"))
    known = L.dictionary_matches(texts, V.terms(spark)).groupBy("id").agg(F.collect_set("canonical").alias("known"))
    # a name for each source of the catalogue
    sources = rows.where("source_name is not null").agg(F.collect_set("source_name").alias("names")).select(L.source_names(F.col("names")).alias("sources"))
    held = texts.join(known, "id", "left").join(F.broadcast(sources))
    return held.select("id", F.array_join(L.plausible_names("text", "known", "sources"), "|").alias("names"))

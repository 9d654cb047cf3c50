"""Fame from recorded answers of an encyclopedia: parsing, the best match, page views, and what is written back."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from . import reports, scoring

#: Languages whose labels and aliases are kept, in this order; aliases of an entity at most.
ALIAS_LANGUAGES = ("en", "de", "fr", "es", "it", "pl", "pt", "nl", "tr")
MOST_ALIASES = 24
#: Entities looked up together, milliseconds of a sweep, and how a refusal's reason ends.
CHUNK, BUDGET_MS, REFUSED = 3, 12_000, "_http_(429|403)\\z"


def _value(json, path: str, kind: str = "string") -> Column:
    return F.expr(f"try_variant_get(try_parse_json({json}), '{path}', '{kind}')")


def search_ids(answers: DataFrame) -> DataFrame:
    """(name, place, id): hits of search answers (name, json) in their order; bad answers have none."""
    rows = answers.select("name", F.posexplode(_value("json", "$.search", "array<variant>")).alias("place", "hit"))
    return rows.select("name", "place", F.expr("try_variant_get(hit, '$.id', 'string')").alias("id")).where("id <> ''")


def entity_details(answers: DataFrame) -> DataFrame:
    """(id, wiki_title, sitelinks, aliases) of the entities in answers (json).

    aliases: distinct labels and aliases of ALIAS_LANGUAGES in their order.  Entities that
    are missing (their key begins with a minus) or empty are left out.
    """
    rows = answers.select(F.explode(_value("json", "$.entities", "map<string,variant>")).alias("id", "e"))
    rows = rows.where("not startswith(id, '-') and to_json(e) <> '{}'")
    label = [F.expr(f"array(try_variant_get(e, '$.labels.{x}.value', 'string'))") for x in ALIAS_LANGUAGES]
    other = [F.expr(f"transform(coalesce(try_variant_get(e, '$.aliases.{x}', 'array<variant>'), array()), a -> try_variant_get(a, '$.value', 'string'))") for x in ALIAS_LANGUAGES]
    names = F.concat(*[c for pair in zip(label, other) for c in pair])
    trimmed = F.transform(names, lambda n: F.regexp_replace(n, f"^[{T.SPACES}]+|[{T.SPACES}]+\\z", ""))
    names = F.array_distinct(F.filter(trimmed, lambda n: n.isNotNull() & (n != "")))
    links = F.expr("size(coalesce(try_variant_get(e, '$.sitelinks', 'map<string,variant>'), map()))")
    return rows.select("id", F.expr("try_variant_get(e, '$.sitelinks.enwiki.title', 'string')").alias("wiki_title"), links.alias("sitelinks"), names.alias("aliases"))


def best_matches(hits: DataFrame, details: DataFrame) -> DataFrame:
    """For each name its hit with a title and the most links, the earliest of equals; without any, its first hit."""
    rows = hits.join(details, "id")
    titled = F.col("wiki_title").isNotNull()
    order = Window.partitionBy("name").orderBy(titled.desc(), F.when(titled, -F.col("sitelinks")), "place")
    found = rows.withColumn("n", F.row_number().over(order)).where("n = 1 and (wiki_title is not null or place = 0)")
    return found.select("name", "id", "wiki_title", "sitelinks", "aliases")


def titled_matches(names: DataFrame, details: DataFrame) -> DataFrame:
    """Names (name) with the details whose title is theirs, underscores and case aside."""
    own = details.where("wiki_title is not null").withColumn("key", T.match_title("wiki_title"))
    own = own.groupBy("key").agg(F.min(F.struct("id", "wiki_title", "sitelinks", "aliases")).alias("d"))
    return names.withColumn("key", T.match_title("name")).join(own, "key").select("name", "d.*")


def page_views(answers: DataFrame) -> DataFrame:
    """(name, month, views) of answers (name, json): months as yyyyMM, the last value of a month."""
    rows = answers.select("name", F.posexplode(_value("json", "$.items", "array<variant>")).alias("place", "item"))
    rows = rows.select("name", "place", F.expr("try_variant_get(item, '$.timestamp', 'string')").alias("t"), F.expr("try_variant_get(item, '$.views', 'bigint')").alias("views"))
    rows = rows.where("length(t) >= 6 and views is not null")
    return rows.groupBy("name", F.substring("t", 1, 6).alias("month")).agg(F.max(F.struct("place", "views"))["views"].alias("views"))


def verdicts(matches: DataFrame, views: DataFrame, months: DataFrame) -> DataFrame:
    """(name, wiki_title, sitelinks, aliases, median_views, fame) of matches; a match without a title has no views.

    months: (month), the twelve that count.  A page without a view in a month had 0.
    """
    titled = matches.where("wiki_title is not null").select("name").distinct()
    full = titled.crossJoin(F.broadcast(months)).join(views, ["name", "month"], "left").fillna(0, ["views"])
    median = full.groupBy("name").agg(F.floor(F.percentile("views", F.lit(0.5)) + 0.5).cast("long").alias("median_views"))
    rows = matches.join(median, "name", "left").withColumn("median_views", F.coalesce("median_views", F.lit(0)))
    return rows.withColumn("fame", scoring.wiki_fame(F.lit(True), "median_views", "sitelinks"))


def sweep_batch(entities: DataFrame, as_of: str, top: int = 40, retry_hours: int = 6) -> DataFrame:
    """Tracked, unlocked entities to look up next: unknown ones not checked for ``retry_hours``, others not famous for 30 days.

    Never checked ones come first, then the latest met.
    """
    due = (
        f"(fame = 'unknown' and (checked_at is null or checked_at < {as_of} - interval {retry_hours} hours))"
        f" or (fame = 'not_famous' and checked_at < {as_of} - interval 30 days)"
    )
    rows = entities.where("status = 'tracked' and not coalesce(fame_locked, false)").where(due)
    return reports.sweep_queue(rows, top)


def merged_aliases(existing: Column, fresh: Column, canonical: Column, most: int = MOST_ALIASES) -> Column:
    """Aliases with the fresh ones that are new by their normalised name, ``most`` in all; existing ones are never cut."""
    keyed = F.transform(fresh, lambda a: F.struct(T.normalize_name(a).alias("k"), a.alias("a")))
    seen = F.transform(F.concat(existing, F.array(canonical)), T.normalize_name)
    kept = F.aggregate(
        keyed,
        F.array().cast("array<struct<k:string,a:string>>"),
        lambda done, x: F.when(
            (x["k"] == "") | F.array_contains(seen, x["k"]) | F.exists(done, lambda d: d["k"] == x["k"]) | (F.size(done) >= F.greatest(F.lit(0), most - F.size(existing))), done
        ).otherwise(F.concat(done, F.array(x))),
    )
    return F.concat(existing, F.transform(kept, lambda x: x["a"]))


def written(entities: DataFrame, outcomes: DataFrame, as_of: str) -> DataFrame:
    """Entities after a sweep's outcomes (id, outcome, fame, wiki_title, sitelinks, views, aliases).

    success writes the verdict and aliases; failure the time and aliases; rescue the time alone.
    """
    o = outcomes.select(*[F.col(c).alias(f"new_{c}") if c != "id" else F.col("id") for c in ("id", "outcome", "fame", "wiki_title", "sitelinks", "views", "aliases")])
    rows = entities.join(o, "id", "left")
    good, named = F.col("new_outcome") == "success", F.col("new_outcome").isin("success", "failure")
    pick = lambda test, new, old: F.when(F.coalesce(test, F.lit(False)), F.col(new)).otherwise(F.col(old))
    empty = F.array().cast("array<string>")
    merged = merged_aliases(F.coalesce("aliases", empty), F.coalesce("new_aliases", empty), F.col("canonical_name"))
    rows = rows.withColumns(
        {
            "aliases": F.when(F.coalesce(named, F.lit(False)), merged).otherwise(F.col("aliases")),
            "fame": pick(good, "new_fame", "fame"),
            "wiki_title": pick(good, "new_wiki_title", "wiki_title"),
            "wiki_sitelinks": pick(good, "new_sitelinks", "wiki_sitelinks"),
            "wiki_pageviews_monthly": pick(good, "new_views", "wiki_pageviews_monthly"),
            "checked_at": F.when(F.col("new_outcome").isNotNull(), F.expr(as_of)).otherwise(F.col("checked_at")),
        }
    )
    return rows.select(entities.columns)


def swept(attempts: DataFrame, chunk: int = CHUNK, budget_ms: int = BUDGET_MS) -> DataFrame:
    """The attempts (sweep, place, outcome, reason, took_ms, ...) that a sweep really makes.

    A sweep takes its entities by place, from 0, ``chunk`` at a time and those together, so a
    chunk takes as long as its slowest.  Before each chunk the time so far is compared with
    the budget; a chunk under way is never broken off.  After a chunk in which the other
    side refused (429 or 403) none follows.  Entities beyond have no row, so nothing is
    written of them and they are due again.  A missing time counts as none.

    Chunks are summed up first, so of a sweep only one row for each meets the others.
    """
    rows = attempts.withColumn("chunk", F.floor(F.col("place") / chunk))
    refused = F.bool_or((F.col("outcome") == "failure") & F.coalesce(F.col("reason").rlike(REFUSED), F.lit(False)))
    chunks = rows.groupBy("sweep", "chunk").agg(F.max(F.coalesce("took_ms", F.lit(0))).alias("took"), F.coalesce(refused, F.lit(False)).alias("refused"))
    before = Window.partitionBy("sweep").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumns({"begun": F.coalesce(F.sum("took").over(before), F.lit(0)), "stopped": F.coalesce(F.bool_or("refused").over(before), F.lit(False))})
    made = chunks.where(f"begun < {budget_ms} and not stopped").select("sweep", "chunk")
    return rows.join(made, ["sweep", "chunk"], "left_semi").drop("chunk").select(attempts.columns)


def sweep_tallies(made: DataFrame) -> DataFrame:
    """``sweep_tally`` of each sweep (sweep, outcome, reason)."""
    refused = F.coalesce(F.col("reason").rlike(REFUSED), F.lit(False))
    success = F.coalesce(F.col("outcome") == "success", F.lit(False))
    return made.groupBy("sweep").agg(F.count("*").alias("checked"), F.count_if(success).alias("succeeded"), F.count_if(~success).alias("failed"), F.bool_or(refused).alias("rate_limited"))


def sweep_tally(outcomes: DataFrame) -> DataFrame:
    """One row: outcomes checked, succeeded and failed, and whether the sweep must stop because the other side refuses."""
    refused = F.coalesce(F.col("reason").rlike(REFUSED), F.lit(False))
    return outcomes.agg(
        F.count("*").alias("checked"), F.count_if(F.col("outcome") == "success").alias("succeeded"), F.count_if(F.col("outcome") != "success").alias("failed"), F.coalesce(F.bool_or(refused), F.lit(False)).alias("rate_limited")
    )

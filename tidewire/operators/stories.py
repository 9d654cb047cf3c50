"""Articles to stories: identity, duplicate groups, clusters and their ranking."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.dates import news_time
from ..storage import cut, forget
from . import scoring

HOUR = 3_600_000_000  # microseconds


def identified(articles: DataFrame) -> DataFrame:
    """Articles with content_hash and title_signature."""
    return articles.withColumns({"content_hash": T.content_hash("title", "link"), "title_signature": T.title_signature("title")})


def insert_new(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of a batch whose content_hash isn't stored yet, one of each, the smallest id."""
    own = Window.partitionBy("content_hash").orderBy("id")
    once = batch.withColumn("n", F.row_number().over(own)).where("n = 1").drop("n")
    return once.join(stored.select("content_hash"), "content_hash", "left_anti")


def insert_counts(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """One row: how many rows of a batch are new and how many are duplicates, stored or in the batch."""
    fresh = insert_new(stored, batch).agg(F.count("*").alias("inserted"))
    return batch.agg(F.count("*").alias("n")).join(F.broadcast(fresh)).select("inserted", (F.col("n") - F.col("inserted")).alias("duplicates"))


def honest_time(published: str, estimated: str) -> F.Column:
    """A publication time as it is stored: null where it was only estimated."""
    return F.when(~F.coalesce(F.col(estimated), F.lit(False)), F.col(published))


def _sliced(rows: DataFrame, name: str) -> DataFrame:
    """Rows (key, at, ...) written once in contiguous slices of (key, at), numbered in order.

    Slices are of like size whatever one key holds, and rows of one key and time share one.
    """
    return cut(rows.repartitionByRange("key", "at").withColumn("slice", F.spark_partition_id()), name)


def _nearest(rows: DataFrame, backward: bool, tie: Column) -> DataFrame:
    """``rows`` (key, slice, at, mark: a struct that begins with at, or null) with the mark ``near``est in time.

    That is the last mark at or before a row, or backward the first at or after it, of the
    same key; tie orders rows of one time, those that come later see the marks of those before.
    One ordered pass through each slice carries the last mark met.  A key reaches over the
    border of two slices at most once for each border, so what slices hand on is a table
    of fewer than twice as many rows as there are slices.
    """
    at = F.col("at").desc() if backward else F.col("at")
    order = Window.partitionBy("key", "slice").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.withColumn("near", F.last("mark", ignorenulls=True).over(order))
    ends = rows.groupBy("slice").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    ends = ends.select("slice", F.explode(F.array("low", "high")).alias("key")).distinct()
    edge = F.min("mark") if backward else F.max("mark")
    handed = rows.join(F.broadcast(ends), ["key", "slice"]).groupBy("key", "slice").agg(edge.alias("edge"))
    place = F.col("slice").desc() if backward else F.col("slice")
    before = Window.partitionBy("key").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    handed = handed.withColumn("handed", F.last("edge", ignorenulls=True).over(before)).where("handed is not null").drop("edge")
    return met.join(F.broadcast(handed), ["key", "slice"], "left").withColumn("near", F.coalesce("near", "handed")).drop("handed")


def duplicate_groups(articles: DataFrame, as_of: str | None = None, hours: int = 48) -> DataFrame:
    """For each ungrouped article the earliest head with its signature within ``hours`` before it: (id, dup_group_id).

    Heads are the articles without a dup_group_id when the run begins, so a member of
    today's run may itself have become a head's member (articles without that column
    are all heads).  With as_of only articles that arrived in the ``hours`` before it are
    grouped.  An article that is its own earliest head has no row.  Blank signatures
    are a signature like any other.

    Articles of one signature and time have one answer, and are asked for once.  Times are
    searched in slices of like size, so a headline that comes very often is spread over many tasks.
    """
    span = hours * HOUR
    held = articles if "dup_group_id" in articles.columns else articles.withColumn("dup_group_id", F.lit(None).cast("long"))
    rows = held.where("dup_group_id is null").select(
        "id", F.col("title_signature").alias("key"), F.unix_micros(F.col("first_seen_at").cast("timestamp")).alias("at"), "first_seen_at"
    )
    # signatures are made here, once: a filter over them would make them again, and so would each of the reads below
    rows = cut(rows, "signed").where("key is not null and at is not null")
    asked = rows if as_of is None else rows.where(f"first_seen_at >= {as_of} - interval {hours} hours")
    points = rows.groupBy("key", "at").agg(F.struct("at", F.min("id").alias("id")).alias("mark")).withColumn("asked", F.lit(None).cast("long"))
    questions = asked.select("key", (F.col("at") - span).alias("at"), F.lit(None).cast("struct<at:long,id:long>").alias("mark"), F.col("at").alias("asked")).distinct()
    # the earliest head of the window is the first one from its beginning on; a point is met before a question of its time
    found = _nearest(_sliced(points.unionByName(questions), "moments"), True, F.col("asked").isNotNull())
    found = found.where("asked is not null").select("key", F.col("asked").alias("at"), F.col("near")["id"].alias("dup_group_id"))
    return asked.select("id", "key", "at").join(found, ["key", "at"]).select("id", "dup_group_id").where("id <> dup_group_id")


def grouped(articles: DataFrame, groups: DataFrame) -> DataFrame:
    """Articles with the groups found for them."""
    found = groups.select("id", F.col("dup_group_id").alias("found"))
    return articles.join(found, "id", "left").withColumn("dup_group_id", F.coalesce("dup_group_id", "found")).drop("found").select(articles.columns)


def clusters(articles: DataFrame, hours: int = 48) -> DataFrame:
    """Clusters of equal signatures, each at most ``hours`` long from its first article: (id, head_id).

    In the order of time an article joins the open cluster, or begins one if that
    began too long ago - so the window hangs on the head, not on the gap.  An article
    without a time or a signature stands alone.

    Articles of one signature and time are one moment, of which the smallest id stands for all.
    A moment after a gap is a head.  From each moment the next head would be the first one beyond
    its window; following that from the heads after gaps, twice as far in every round, gives
    all heads in a number of rounds that grows with the logarithm of the longest run.  Times
    are searched in slices of like size, so no signature is gathered in one task.
    """
    span = hours * HOUR
    micros = F.unix_micros(news_time("published_at", "first_seen_at").cast("timestamp"))
    # signatures are made here, once: a filter over them would make them again, and so would each of the reads below
    rows = cut(articles.select("id", F.col("title_signature").alias("key"), micros.alias("at")), "signed")
    alone = rows.where("coalesce(key, '') = '' or at is null").select("id", F.col("id").alias("head_id"))
    rows = rows.where("coalesce(key, '') <> '' and at is not null")
    moments = rows.groupBy("key", "at").agg(F.min("id").alias("id"))
    # beside the points two questions of each moment: the first one beyond its window (asked before points of that time
    # are met), and the first one of the window before it (asked after): a moment that is its own answer begins anew
    kinds = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(shift).cast("long").alias("shift")) for kind, shift in ((0, span), (1, 0), (2, -span))])).alias("q")
    asked = moments.select("key", "id", F.col("at").alias("own"), kinds)
    asked = asked.select("key", "id", "own", (F.col("own") + F.col("q.shift")).alias("at"), F.col("q.kind").alias("kind"))
    sliced = _sliced(asked.withColumn("mark", F.when(F.col("kind") == 1, F.struct("at", "id"))), "moments")
    found = cut(_nearest(sliced, True, F.col("kind")).where("kind <> 1").select("id", "kind", F.col("near")["id"].alias("next")), "jumps")
    starts = found.where("kind = 2 and next = id").select("id")
    # a head after a gap is known as one and is not jumped to
    jump = cut(found.where("kind = 0 and next is not null").select("id", "next").join(starts.withColumnRenamed("id", "next"), "next", "left_anti").select("id", "next"), "jumps")
    heads = cut(starts, "heads")
    forget(found)
    while True:
        more = cut(jump.join(heads, "id").select(F.col("next").alias("id")).join(heads, "id", "left_anti").distinct(), "heads")
        if more.isEmpty():
            break
        both = cut(heads.unionByName(more), "heads")
        far = cut(jump.join(jump.select(F.col("id").alias("next"), F.col("next").alias("then")), "next").select("id", F.col("then").alias("next")), "jumps")
        forget(heads, more, jump)
        heads, jump = both, far
    forget(more, jump)
    # the last head at or before each moment
    points = sliced.where("kind = 1").select("key", "slice", "at", "id").join(heads.withColumn("is_head", F.lit(True)), "id", "left")
    points = points.withColumn("mark", F.when(F.col("is_head"), F.struct("at", "id")))
    found = _nearest(points, False, F.col("id")).select("key", "at", F.col("near")["id"].alias("head_id"))
    return rows.join(found, ["key", "at"]).select("id", "head_id").unionByName(alone)


def cluster_heads(articles: DataFrame, heads: DataFrame) -> DataFrame:
    """One row for each cluster: head_id, members, sources, latest and its members' ids, the latest first."""
    at = news_time("published_at", "first_seen_at")
    held = articles.select("id", "source_name", at.alias("at")).join(heads, "id")
    return held.groupBy("head_id").agg(F.count("*").alias("members"), F.countDistinct("source_name").alias("sources"), F.max("at").alias("latest"))


def cluster_feed(articles: DataFrame, heads: DataFrame, as_of: str, days: int = 30, top: int = 500) -> DataFrame:
    """One row for each cluster: its size, its latest arrival and its head's title, the latest first."""
    held = articles.join(heads, "id")
    sums = held.groupBy("head_id").agg(F.count("*").alias("cluster_size"), F.max("first_seen_at").alias("updated_at"), F.countDistinct("source_name").alias("sources"))
    rows = sums.join(articles.select(F.col("id").alias("head_id"), "title", "source_category"), "head_id").where(f"updated_at >= {as_of} - interval {days} days and updated_at < {as_of}")
    return rows.orderBy(F.col("updated_at").desc(), "head_id").limit(top)


def group_feed(articles: DataFrame, as_of: str, days: float | None = 7, category: str | None = None, top: int = 500) -> DataFrame:
    """Heads that arrived in the last days with the size and the latest arrival of their stored group, the latest first.

    A member's arrival counts for its head whenever it came, though members are never served.
    """
    days = clamped_days(days)
    group = F.coalesce("dup_group_id", "id")
    sums = articles.groupBy(group.alias("id")).agg(F.max("first_seen_at").alias("updated_at"), F.count("*").alias("cluster_size"))
    rows = articles.where(f"dup_group_id is null and first_seen_at >= {as_of} - interval {days} days and first_seen_at < {as_of}")
    if category is not None:
        rows = rows.where(F.col("source_category") == category)
    published = news_time("published_at", "first_seen_at")
    rows = rows.join(sums, "id").select("id", "title", published.alias("published"), "updated_at", "cluster_size", "source_category")
    return rows.orderBy(F.col("updated_at").desc(), "id").limit(top)


def clamped_days(days: float | None, usual: int = 7, most: int = 30) -> int:
    """Days asked for: whole, at most ``most``; the usual ones for none, a number that isn't finite, or none above 0."""
    if days is None or days != days or days in (float("inf"), float("-inf")) or days <= 0:
        return usual
    return min(int(days), most)


def titled(articles: DataFrame, titles: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """For each title (title) the link of its latest article of the last days, of equals the smallest id."""
    rows = articles.where(f"first_seen_at >= {as_of} - interval {days} days and first_seen_at < {as_of}").join(titles.select("title").distinct(), "title", "left_semi")
    latest = rows.groupBy("title").agg(F.max(F.struct("first_seen_at", (-F.col("id")).alias("id"), "link")).alias("last"))
    return latest.select("title", "last.link")


def top_stories(articles: DataFrame, heads: DataFrame, as_of: str, hours: int = 48, top: int = 15) -> DataFrame:
    """The most interesting clusters whose head is recent."""
    feed = cluster_feed(articles, heads, as_of, top=2**31 - 1)
    at = articles.select(F.col("id").alias("head_id"), news_time("published_at", "first_seen_at").alias("at"))
    return _ranked(feed.join(at, "head_id"), as_of, hours, top)


def top_groups(articles: DataFrame, as_of: str, hours: int = 48, top: int = 15) -> DataFrame:
    """The most interesting stored groups whose head is recent: a head, its members, and the sources of both."""
    at = news_time("published_at", "first_seen_at")
    sums = articles.groupBy(F.coalesce("dup_group_id", "id").alias("head_id")).agg(F.count("*").alias("cluster_size"), F.countDistinct("source_name").alias("sources"))
    heads = articles.where("dup_group_id is null").select(F.col("id").alias("head_id"), "title", at.alias("at"))
    return _ranked(heads.join(sums, "head_id"), as_of, hours, top)


def _ranked(rows: DataFrame, as_of: str, hours: int, top: int) -> DataFrame:
    age = F.expr(f"(unix_micros(cast({as_of} as timestamp)) - unix_micros(cast(at as timestamp))) / {float(HOUR)}").cast("double")
    rows = rows.where(f"at >= {as_of} - interval {hours} hours and at < {as_of}")
    rows = rows.select("head_id", "title", "cluster_size", "sources", F.round(scoring.story("cluster_size", age), 6).alias("score"))
    return rows.orderBy(F.col("score").desc(), "head_id").limit(top)


def search(articles: DataFrame, query: str, category: str = "all", entity: str | None = None) -> DataFrame:
    """Articles with a text in their title, source, summary or category, whatever its case; blank means all.

    entity: a name that must stand in the title or the summary, whatever its case.
    """
    rows = articles if category == "all" else articles.where(F.col("source_category") == category)
    if entity:
        rows = rows.where(_holds(entity.lower(), ("title", "summary")))
    wanted = query.strip().lower()
    return rows.where(_holds(wanted, ("title", "source_name", "summary", "source_category"))) if wanted else rows


def _holds(wanted: str, columns: tuple[str, ...]) -> F.Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(wanted))
    return out


def sorted_by(articles: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Articles in the order of a column; published means the update where there was one.  Texts go by letters, not by case."""
    if column == "published":
        key = F.coalesce("updated_at", "published")
    else:
        key = F.collate(F.col(column), "UNICODE") if dict(articles.dtypes)[column] == "string" else F.col(column)
    return articles.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "id")


def categories(articles: DataFrame) -> DataFrame:
    """Distinct categories in the order of letters, after ``all``: (place, category)."""
    found = articles.select(F.col("source_category").alias("category")).where("category is not null").distinct()
    whole = articles.agg(F.count("*").alias("n")).select(F.lit("all").alias("category"), F.lit(0).alias("rank"))
    ranked = found.withColumn("rank", F.lit(1)).unionByName(whole)
    return ranked.select((F.row_number().over(Window.orderBy("rank", "category")) - 1).alias("place"), "category")

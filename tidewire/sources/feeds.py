"""Feed documents to items."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import language as L
from ..functions import text as T
from ..functions.dates import in_bounds, parse_feed_date

KEPT = 15


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue of sources from a quoted CSV file with a header."""
    return spark.read.csv(path, header=True, quote='"', escape='"')


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results of a model's batch as JSON lines; malformed lines are told apart by ``malformed``."""
    rows = spark.read.schema("custom_id string, result string, malformed string").option("columnNameOfCorruptRecord", "malformed").json(path)
    return rows.withColumn("good", F.col("malformed").isNull() & F.col("custom_id").isNotNull())


def items(feeds: DataFrame, as_of) -> DataFrame:
    """Items of feeds (source_name, url, xml), RSS or Atom, the first 15 kept of each.

    Untitled items, advertising, items over seven days old and, in a feed with any
    dates, undated ones are dropped.  A date out of bounds counts as now and as
    estimated.  Returns source_name, place, title, link, published, estimated,
    summary and image.
    """
    atom = F.contains(F.col("xml"), F.lit("<feed")) & F.contains(F.col("xml"), F.lit("<entry"))
    block = lambda tag: F.regexp_extract_all("xml", F.lit(f"(?is)<{tag}[ >].*?</{tag}>"), F.lit(0))
    rows = feeds.select("source_name", "url", atom.alias("atom"), F.posexplode(F.when(atom, block("entry")).otherwise(block("item"))).alias("place", "item"))
    tag = lambda name: T.extract_tag("item", name)
    some = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c], F.lit(""))
    link = F.when(F.col("atom"), some(T.extract_attr("item", "link", "href"), tag("link"))).otherwise(tag("link"))
    date = F.when(F.col("atom"), some(tag("updated"), tag("published"))).otherwise(some(tag("pubDate"), tag("dc:date")))
    summary = F.when(F.col("atom"), some(tag("summary"), tag("content"))).otherwise(some(tag("description"), tag("content:encoded")))
    rows = rows.select(
        "source_name",
        "place",
        F.substring(T.strip_html(tag("title")), 1, 500).alias("title"),
        some(T.sanitize_url(link), F.col("url")).alias("link"),
        parse_feed_date(date).alias("date"),
        F.substring(T.strip_html(summary), 1, 1000).alias("summary"),
        T.image_url("item").alias("image"),
    )
    dated = F.bool_or(F.col("date").isNotNull()).over(Window.partitionBy("source_name"))
    good = F.coalesce(in_bounds("date", as_of), F.lit(False))
    rows = rows.withColumn("dated", dated).where("title <> '' and (date is not null or not dated)")
    rows = rows.where(F.col("date").isNull() | (F.col("date") >= as_of - F.expr("interval 7 days")))
    rows = rows.where(~L.is_ad("title", "summary", "link") & (F.col("date").isNotNull() | ~L.is_financial_ad("title")))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("source_name").orderBy("place"))).where(F.col("n") <= KEPT)
    return rows.select("source_name", "place", "title", "link", F.when(good, F.col("date")).otherwise(as_of).alias("published"), (~good).alias("estimated"), "summary", "image")


def error_kind(status, name, message) -> F.Column:
    """Kind of a fetch's failure, by HTTP status, else by the exception's name and message; ok without one."""
    status, name, message = F.col(status), F.coalesce(F.col(name), F.lit("")), F.coalesce(F.col(message), F.lit(""))
    by_status = (
        F.when(status == 403, "http_403").when(status == 404, "http_404").when(status == 429, "http_429").when(status >= 500, "http_5xx").otherwise("http_other")
    )
    return (
        F.when(status.isNotNull() & ~status.between(200, 299), by_status)
        .when(name == "AbortError", "timeout")
        .when(F.contains(message, F.lit("ENOTFOUND")) | F.contains(message, F.lit("getaddrinfo")), "dns")
        .when(F.contains(message, F.lit("ECONNREFUSED")), "connection_refused")
        .when((name != "") | (message != ""), "unknown")
        .otherwise("ok")
    )


def collectable(catalog: DataFrame) -> DataFrame:
    """Sources of a catalogue (type, url) that are feeds with a web address."""
    kind = F.coalesce(F.col("type"), F.lit(""))
    return catalog.where((F.contains(kind, F.lit("RSS")) | F.contains(kind, F.lit("Atom"))) & F.startswith(F.coalesce(F.col("url"), F.lit("")), F.lit("http")))


def first_phase(fetches: DataFrame) -> DataFrame:
    """For each source its first fetch with an item, in the order direct, relay, alt; without one, its last failure.

    fetches: (source_name, phase, items, ...).
    """
    order = F.array_position(F.array(*map(F.lit, ("direct", "relay", "alt"))), F.col("phase"))
    best = Window.partitionBy("source_name").orderBy((F.col("items") > 0).desc(), F.when(F.col("items") > 0, order).otherwise(-order))
    return fetches.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


def counts(fetches: DataFrame) -> DataFrame:
    """One row: how many sources were attempted, how many gave an item, and the items."""
    return fetches.agg(F.count("*").alias("attempted"), F.count_if(F.col("items") > 0).alias("succeeded"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"))


def diagnostics(fetches: DataFrame) -> DataFrame:
    """Sources by outcome (kind), with the names of each."""
    return fetches.groupBy("kind").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source_name")), "|").alias("sources"))

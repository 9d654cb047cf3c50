"""Articles packed into a model's requests, which are asked for while the month's budget lasts."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import cut
from . import scoring

#: Fixed value: articles of a request.
PACKED = 25


def numbered(rows: DataFrame, by: str, order: str) -> DataFrame:
    """``rows`` with _number: each row's number, from 0, among those of its ``by`` in the order of ``order``, which tells them apart.

    The numbers are those of one sort of everything, but no group is sorted in one task: rows
    lie in contiguous slices of (by, order), are numbered inside their slice, and the sizes
    of the slices before are added.  Null keys are a group of their own.
    """
    sliced = cut(rows.repartitionByRange(by, order).withColumn("_slice", F.spark_partition_id()), "slices")
    sizes = sliced.groupBy(F.col(by).alias("_by"), F.col("_slice").alias("_of")).agg(F.count("*").alias("_size"))
    before = Window.partitionBy("_by").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    own = F.row_number().over(Window.partitionBy(by, "_slice").orderBy(order)) - 1
    found = sliced.withColumn("_own", own).join(sizes, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_slice") == F.col("_of")))
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_before") + F.col("_own")).alias("_number"))


def packed(articles: DataFrame, by: str = "batch", order: str = "id", size: int = PACKED) -> DataFrame:
    """Articles with the request of their batch they go into, and their place in it, both from 0."""
    rows = numbered(articles, by, order)
    return rows.select(*[F.col(f"`{c}`") for c in articles.columns], F.floor(F.col("_number") / size).alias("request"), (F.col("_number") % size).cast("int").alias("place"))


def submitted(packed_articles: DataFrame, usage: DataFrame, budget: float, by: str = "batch", size: int = PACKED) -> DataFrame:
    """One row for each request: batch, request, articles, and why it isn't sent (null if it is).

    usage: (batch, counters of scoring.TOKEN_RATES) of the month that a batch is asked for
    in; without a row nothing is spent yet.  A batch is refused whole where one of its
    requests is too large, then where the cost has reached the budget.
    """
    requests = packed_articles.groupBy(F.col(by).alias("batch"), "request").agg(F.count("*").alias("articles"))
    largest = requests.groupBy(F.col("batch").alias("_batch")).agg(F.max("articles").alias("_largest"))
    spent = usage.select(F.col("batch").alias("_month"), scoring.month_cost().alias("_cost"))
    rows = requests.join(largest, F.col("batch").eqNullSafe(F.col("_batch"))).join(spent, F.col("batch").eqNullSafe(F.col("_month")), "left")
    open_ = scoring.within_budget(F.coalesce("_cost", F.lit(0.0)), F.lit(float(budget)))
    reason = F.when(F.col("_largest") > size, "chunk_too_large").when(~open_, "budget_gate")
    return rows.select("batch", "request", "articles", reason.alias("reason"))

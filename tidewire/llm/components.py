"""Connected components of an undirected graph given as a table of links."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, forget


def _state(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h")).first()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Give every vertex of ``links`` the smallest vertex it is connected with.

    Returns (vertex, component), a table that ``forget`` takes.  Links may repeat, run
    either way or be loops; a link with a null end is left out.  A vertex that has no
    link but loops has no row.  An empty table gives an empty result.

    Alternates the large-star and small-star steps until nothing changes.  Each
    step groups by vertex with map-side minima, so a vertex with very many links
    costs one row for each task, and sends each row to one join.  Each round's
    links are written to the shared folder, which ends the lineage there; those of
    the round before are then deleted.
    """
    edges = (
        links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("v") != F.col("u")))
        .distinct()
    )
    edges = cut(edges, "links")
    before = _state(edges)
    while before["n"]:
        # large star: each larger neighbour of a vertex goes to the vertex's minimum
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(
            edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
        )
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = (
            both.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        )
        # small star: a vertex and its smaller neighbours go to their minimum
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        after = (
            small.select(F.col("u").alias("v"), F.col("m").alias("u"))
            .where("v != u")
            .unionByName(least.select("v", F.col("m").alias("u")))
            .distinct()
        )
        after = cut(after, "links")
        # each vertex has one link, to its component's minimum, once the table is a set of stars
        now = _state(after)
        forget(edges)
        edges = after
        if now == before:
            break
        before = now
    stars = edges.select(F.col("v").alias("vertex"), F.col("u").alias("component"))
    out = stars.unionByName(edges.select(F.col("u").alias("vertex"), F.col("u").alias("component")).distinct())
    out._tidewire_path = edges._tidewire_path
    return out


def merged_labels(labels: DataFrame, links: DataFrame, id: str = "doc_id") -> DataFrame:
    """Labels (id, component) after further links (a, b): the components that links join become one.

    Only links between different components are followed.  Where there are some, the old
    labels' files are deleted, so the old table can't be used afterwards.
    """
    of = lambda end: labels.select(F.col(id).alias(end), F.col("component").alias(f"{end}_component"))
    between = links.join(of("a"), "a").join(of("b"), "b").where("a_component != b_component").select("a_component", "b_component")
    joined = connected_components(between, "a_component", "b_component")
    if joined.isEmpty():
        forget(joined)
        return labels
    after = labels.join(joined.withColumnRenamed("component", "low").withColumnRenamed("vertex", "component"), "component", "left")
    after = cut(after.select(id, F.coalesce("low", "component").alias("component")), "labels")
    forget(joined, labels)
    return after

"""Centroid clustering of integer vectors with Hamerly's bounds."""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, forget

MOST = 1 << 27  # size of a component; distances of 64 of them fit 64 bits
SLACK = 1e-9  # what bounds are loosened by, relatively, for rounding
STATE = "vec_id long, v array<int>, cluster int, upper double, lower double, distance long, scanned boolean"


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of vectors and centroids in exact 64-bit integers."""
    return (v * v).sum(axis=1)[:, None] - 2 * (v @ centroids.T) + (centroids * centroids).sum(axis=1)


@dataclass
class Step:
    """What a round knows of its centroids: they, how far each has moved, half the way from each to the nearest other."""

    centroids: np.ndarray
    moved: np.ndarray
    half: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray, before: np.ndarray | None = None) -> Step:
        k = len(centroids)
        apart = np.sqrt(distances(centroids, centroids).astype(np.float64))
        np.fill_diagonal(apart, math.inf)
        moved = np.zeros(k) if before is None else np.sqrt(((centroids - before) ** 2).sum(axis=1).astype(np.float64))
        return cls(centroids, moved * (1 + SLACK), apart.min(axis=1, initial=math.inf) / 2 * (1 - SLACK))

    def others(self) -> np.ndarray:
        """For each centroid the farthest move of another one."""
        if len(self.moved) < 2:
            return np.zeros(len(self.moved))
        first, second = np.sort(self.moved)[::-1][:2]
        return np.where((self.moved == first) & ((self.moved == first).sum() == 1), second, first)

    def scan(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid by a full exact scan, of equals the smaller number, with both bounds."""
        d = distances(v, self.centroids)
        cluster = d.argmin(axis=1)
        upper = np.sqrt(d[np.arange(len(d)), cluster].astype(np.float64)) * (1 + SLACK)
        lower = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64)) * (1 - SLACK) if d.shape[1] > 1 else np.full(len(d), math.inf)
        return cluster, upper, lower

    def assign(self, v: np.ndarray, cluster: np.ndarray | None = None, upper: np.ndarray | None = None, lower: np.ndarray | None = None):
        """Clusters, bounds and which vectors needed a full scan.

        An upper bound below the lower one, or below half the way to the next centroid,
        proves that the centroid is the nearest, and the only one.  Where the loosened
        bound doesn't, the exact distance takes its place; what is still open is scanned.
        """
        if cluster is None:
            return *self.scan(v), np.ones(len(v), dtype=bool)
        cluster, upper, lower = cluster.copy(), (upper + self.moved[cluster]) * (1 + SLACK), (lower - self.others()[cluster]) * (1 - SLACK)
        bar = np.maximum(lower, self.half[cluster])
        open_ = np.flatnonzero(upper >= bar)
        upper[open_] = np.sqrt(self.own(v[open_], cluster[open_]).astype(np.float64)) * (1 + SLACK)
        open_ = open_[upper[open_] >= bar[open_]]
        if len(open_):
            cluster[open_], upper[open_], lower[open_] = self.scan(v[open_])
        scanned = np.zeros(len(v), dtype=bool)
        scanned[open_] = True
        return cluster, upper, lower, scanned

    def own(self, v: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """Exact squared distance of each vector to its centroid."""
        apart = v - self.centroids[cluster]
        return (apart * apart).sum(axis=1)


def assigned(rows: DataFrame, step: Step, dims: int, fresh: bool) -> DataFrame:
    """Vectors with cluster, bounds, exact distance and whether a full scan was needed; fresh ones have no bounds yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
            known = () if fresh else (batch.column("cluster").to_numpy().astype(np.int64), batch.column("upper").to_numpy(), batch.column("lower").to_numpy())
            cluster, upper, lower, scanned = step.assign(v, *known)
            made = [pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(step.own(v, cluster)), pa.array(scanned)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), *made], [part.split()[0] for part in STATE.split(", ")])

    return rows.select("vec_id", "v", *([] if fresh else ["cluster", "upper", "lower"])).mapInArrow(run, STATE)


def integers(vectors: DataFrame, dims: int, scale: float) -> DataFrame:
    """Vectors (vec_id, v: array<int>) of ``dims`` finite components as floor(scale * x), none beyond MOST in size."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where(f"v is not null and size(v) = {dims} and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), x * F.lit(scale)))).cast("int"))
    return rows.select("vec_id", whole.alias("v"))


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, seed: str = "1:") -> DataFrame:
    """Assign vectors to k centroids that move ``rounds`` times, exactly.

    vectors needs vec_id and embedding; other columns are ignored.  Kept are vectors with
    exactly ``dims`` components, none null or non-finite, as integers floor(scale * x);
    components beyond 2^27 in size count as that, so that every distance fits 64 bits.
    The centroids begin as the kept vectors with the smallest sha256 of the seed and
    vec_id, in that order, of equal ones the smaller vector; a null vec_id comes last.
    With fewer vectors there are fewer centroids.  In each round every vector goes to the
    nearest centroid (ties: the smaller number), and each centroid that has vectors to
    the floor of their mean; then vectors are assigned once more.

    Returns for each kept row vec_id, cluster, distance (squared), cluster_inertia and
    inertia (sums of distances over its cluster and over all, at most 2^63 - 1),
    centroid_sha256 (of its final centroid) and scanned (whether the last assignment
    had to scan all centroids).  Rows that share a vec_id or repeat one are vectors of
    their own.  An empty table gives an empty result.

    A vector carries an upper bound of its distance and one lower bound of the distance to
    any other centroid from round to round, in a table written once a round.  Sums are
    added up inside tasks first; k rows of ``dims`` sums reach the driver.
    """
    spark = vectors.sparkSession
    rows = integers(vectors, dims, scale)
    first = rows.orderBy(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(k).collect()
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scanned boolean"
    if not first:
        return spark.createDataFrame([], out)
    centroids, before, held = np.array([r["v"] for r in first], dtype=np.int64), None, None
    for _ in range(rounds):
        made = cut(assigned(rows if held is None else held, Step.of(centroids, before), dims, held is None), "assigned")
        if held is not None:
            forget(held)
        held, before, centroids = made, centroids, centroids.copy()
        sums = held.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(dims)])
        for row in sums.collect():
            centroids[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dims)]
    made = cut(assigned(rows if held is None else held, Step.of(centroids, before), dims, held is None).drop("v", "upper", "lower"), "assigned")
    if held is not None:
        forget(held)
    inertia = {r["cluster"]: int(r["sum"]) for r in made.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()}
    most = lambda x: min(x, (1 << 63) - 1)
    marks = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = [(i, most(x), most(sum(inertia.values())), marks[i]) for i, x in inertia.items()]
    # at most k rows
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return made.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scanned")

"""Embedding vectors: exact top-k by the threshold algorithm, and near-duplicates by sign hashing."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import connected_components
from .shared import cut, in_small_batches

BLOCK = 2048  # vectors packed into one row
QUERIES = 512  # queries packed into one row
SHARE = 1 << 22  # components of the blocks that one task holds
TASKS = 64  # pieces of a small search, at least, if there are groups of queries for them
GROUP = 1024  # vectors of one bucket compared in one piece


def usable(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Rows (vec_id, v: array<double>) whose id and vector are there and hold finite numbers only."""
    v = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), v.alias("v"))
    return rows.where("vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


def _matrix(rows, size: int, dtype) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones are filled up with zeros."""
    out = np.zeros((len(rows), size), dtype=dtype)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


# ------------------------------------------------------------------ exact top-k


class Lists:
    """A block of integer vectors with their ids, and which of the id's rows each is, in the order of each dimension."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, turns: np.ndarray | None = None):
        self.ids = ids
        self.turns = np.ones(len(ids), dtype=np.int64) if turns is None else turns
        self.matrix = matrix
        self.order = np.argsort(matrix, axis=0, kind="stable")
        self.sorted = np.take_along_axis(matrix, self.order, axis=0)

    def search(self, query: np.ndarray, own: int, k: int, best: list[tuple[int, int]], step: int = 64, turn: int = 1) -> list[tuple[int, int]]:
        """The k best of ``best`` and the block, as (-score, id), for one query, without its own row.

        Sorted access goes down all lists together, from the end where the product
        with the query is largest.  Every vector met is scored in full.  No vector
        not yet met can score more than the sum of the products at the present
        depth; once that is below the kth score the rest is left.
        """
        n, dims = self.matrix.shape
        up = query >= 0
        met = np.zeros(n, dtype=bool)
        at, used = 0, np.flatnonzero(query)
        if not len(used):
            used = np.arange(min(1, dims))
        while at < n:
            stop = min(n, at + step)
            met_now = np.zeros(n, dtype=bool)
            for positive, rows in ((True, self.order[n - stop : n - at]), (False, self.order[at:stop])):
                columns = used[up[used] == positive]
                met_now[rows[:, columns].ravel()] = True
            new = np.flatnonzero(met_now & ~met)
            met |= met_now
            if len(new):
                score = self.matrix[new] @ query
                bar = best[-1][0] if len(best) == k else None
                good = new if bar is None else new[-score <= bar]
                values = score if bar is None else score[-score <= bar]
                more = [(-s, i) for s, i, t in zip(values.tolist(), self.ids[good].tolist(), self.turns[good].tolist()) if i != own or t != turn]
                best = sorted(best + more)[:k]
            at = stop
            edge = np.where(up, self.sorted[n - at if at < n else 0], self.sorted[at - 1])
            if len(best) == k and int(edge @ query) < -best[-1][0]:
                break
            step *= 2
        return best


def _packed(name: str, dims: int, kind: type):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["vec_id", "turn"], kind="stable")
        matrix = _matrix(rows["v"], dims, kind)
        ids, turns = (rows[c].to_numpy(np.int64).tobytes() for c in ("vec_id", "turn"))
        return pd.DataFrame({name: [rows[name].iloc[0]], "ids": [ids], "turns": [turns], "matrix": [matrix.tobytes()]})

    return run


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0) -> DataFrame:
    """The k highest integer inner products of each query with all other vectors, exactly.

    vectors needs vec_id and embedding; other columns are ignored.  Components become
    floor(scale * x).  Queries are the rows whose vec_id is divisible by ``every``;
    candidates are all rows but the query's own, also those that share its vec_id or
    repeat it.  Returns query_id, rank (from 1, for each query row), vec_id and score;
    equal scores go by smaller vec_id.  Vectors that are null, empty
    or hold null or non-finite components take no part.  Shorter vectors count as
    filled up with zeros.  Sums are exact as long as they fit 64 bits.  An empty table
    gives an empty result.

    Candidates are packed into blocks, queries into groups, both in the narrowest integers that hold
    the components.  A task holds the blocks of one share, of bounded size, with their sorted lists;
    groups of queries pass it one after the other and meet each of its blocks.  A group's
    best scores go from one block to the next, so later blocks stop sooner.  Groups are
    copied once for each share; nothing is gathered in the driver, whatever its number.
    """
    spark = vectors.sparkSession
    rows = usable(vectors).select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"))
    rows = cut(rows.withColumn("turn", F.row_number().over(Window.partitionBy("vec_id").orderBy("v")).cast("long")), "integers")
    schema = "query_id long, rank int, vec_id long, score long"
    low, high = F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.count_if(F.col("vec_id") % every == 0).alias("queries"), low, high).first()
    if not size["queries"]:
        return spark.createDataFrame([], schema)
    dims = size["dims"]
    kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= size["low"] and size["high"] <= np.iinfo(t).max)
    blocks, groups = -(-size["n"] // BLOCK), -(-size["queries"] // QUERIES)
    pack = lambda rows, name, n: (
        rows.withColumn(name, F.pmod(F.xxhash64("vec_id", "turn"), F.lit(n)).cast("int"))
        .groupBy(name)
        .applyInPandas(_packed(name, dims, kind), f"{name} int, ids binary, turns binary, matrix binary")
    )
    shares = -(-blocks // max(1, SHARE // (BLOCK * dims)))
    # few shares are held by several tasks each, between which the groups are dealt
    slices = max(1, min(groups, -(-TASKS // shares)))
    candidates = pack(rows, "block", blocks).withColumn("share", F.col("block") % shares).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    queries = pack(rows.where(F.col("vec_id") % every == 0), "group", groups).toDF("group", "query_ids", "query_turns", "query_matrix")
    queries = queries.withColumn("slice", F.col("group") % slices).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, Lists] = {}
        best: dict[tuple[int, int], list[tuple[int, int]]] = {}
        at = None

        def found() -> pd.DataFrame:
            return pd.DataFrame([(*own, i, -s) for own, those in best.items() for s, i in those], columns=["query_id", "turn", "vec_id", "score"])

        for batch in batches:
            for share, group, query_ids, query_turns, query_matrix, block, ids, turns, matrix in batch[columns].itertuples(index=False):
                if at != (share, group):
                    if best:
                        yield found()
                    if at is None or at[0] != share:
                        held = {}
                    at, best = (share, group), {}
                    own_rows = list(zip(np.frombuffer(query_ids, np.int64).tolist(), np.frombuffer(query_turns, np.int64).tolist()))
                    wanted = np.frombuffer(query_matrix, kind).reshape(-1, dims).astype(np.int64)
                if block not in held:
                    held[block] = Lists(np.frombuffer(ids, np.int64), np.frombuffer(matrix, kind).reshape(-1, dims).astype(np.int64), np.frombuffer(turns, np.int64))
                for own, query in zip(own_rows, wanted):
                    best[own] = held[block].search(query, own[0], k, best.get(own, []), turn=own[1])
        if best:
            yield found()

    columns = ["share", "group", "query_ids", "query_turns", "query_matrix", "block", "ids", "turns", "matrix"]
    # the packed rows are far larger than their files, so sizes must not choose the join: a share's blocks are the side that is kept
    keys, tasks = ["share", "slice"], shares * slices
    met = queries.repartition(tasks, *keys).hint("merge").join(candidates.repartition(tasks, *keys), keys).select(columns)
    found = in_small_batches(met).mapInPandas(run, "query_id long, turn long, vec_id long, score long")
    return found.selectExpr("query_id", "row_number() over (partition by query_id, turn order by score desc, vec_id) as rank", "vec_id", "score").where(F.col("rank") <= k)


# ------------------------------------------------------------------ near-duplicates


def _planes(tables: int, bits: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables, bits, dims))


def plan_tables(n: int, least: float, recall: float = 0.995) -> tuple[int, int]:
    """Bits of a hash, so that buckets of unlike vectors stay near 256, and tables for the recall at cosine ``least``."""
    bits = max(6, math.ceil(math.log2(max(n, 1) / 256)))
    same = (1 - math.acos(least) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - same))), bits


def _signed(tables: int, bits: int, dims: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = _planes(tables, bits, dims, seed).reshape(tables * bits, dims)
        weight = np.int64(1) << np.arange(bits, dtype=np.int64)
        for batch in batches:
            m = _matrix(batch["v"], dims, np.float64)
            m /= np.maximum(np.abs(m).max(axis=1, keepdims=True), 1e-300)
            marks = ((m @ planes.T) >= 0).reshape(len(m), tables, bits) @ weight
            yield pd.DataFrame({"vec_id": batch["vec_id"], "n": batch["n"], "v": batch["v"], "marks": list(marks)})

    return run


def _unit(values, dims: int) -> np.ndarray:
    m = _matrix(values, dims, np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _linked_within(left, right, table: int, least: float):
    """Which of two sets of a bucket's vectors link, counted in the first table that brings them together."""
    near = left[2] @ right[2].T >= least
    rows, columns = np.nonzero(near)
    keep = left[0][rows] != right[0][columns]
    if table:
        keep &= ~(left[3][rows, :table] == right[3][columns, :table]).any(axis=1)
    return rows[keep], columns[keep]


def _pieces(dims: int, tables: int, least: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        table = int(rows["table"].iloc[0])
        sides = []
        for side in (0, 1):
            part = rows[rows["side"] == side]
            sides.append(
                (
                    part["vec_id"].to_numpy(np.int64),
                    part["n"].to_numpy(np.int64),
                    _unit(part["v"], dims),
                    np.array(part["marks"].tolist(), dtype=np.int64).reshape(len(part), tables),
                )
            )
        alone = not len(sides[1][0])
        left, right = sides[0], sides[0] if alone else sides[1]
        a, b = _linked_within(left, right, table, least)
        ids = np.concatenate([left[0], right[0]])
        links = np.bincount(a, weights=right[1][b], minlength=len(ids)).astype(np.int64)
        shift = 0 if alone else len(left[0])
        if not alone:
            links += np.bincount(b + shift, weights=left[1][a], minlength=len(ids)).astype(np.int64)
        # smallest id reachable inside the piece: a spanning star in the place of all its pairs
        label = ids.copy()
        a, b = a, b + shift
        while len(a):
            before = label.copy()
            np.minimum.at(label, a, before[b])
            np.minimum.at(label, b, before[a])
            if (label == before).all():
                break
        use = links > 0
        return pd.DataFrame({"vec_id": ids[use], "links": links[use], "low": label[use]})

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.9, recall: float = 0.995, seed: int = 10) -> DataFrame:
    """Link vectors whose cosine, in double precision, is ``least`` or more, and group them.

    vectors needs vec_id and embedding; other columns are ignored.  Returns one row
    for each row of vectors: vec_id, n_links (other vectors linked directly),
    component_id (smallest vec_id reachable by links) and kept (vec_id = component_id).
    Vectors that are null, zero or hold null or non-finite components link with
    nothing.  A row with a null vec_id has component_id null, kept false and no
    links.  Rows that share a vec_id are vectors of their own, each with its links;
    rows that repeat one are linked with it.

    Equal vectors are merged into one with a count.  Several tables hash a vector by
    the signs of its products with random hyperplanes; vectors of one bucket are
    compared as matrices, large buckets in pieces of bounded size, every two pieces
    once.  A pair is counted in the first table that brings it together.  A piece
    returns counts and one row for each linked vector, not its pairs.
    """
    rows = usable(vectors).where("exists(v, x -> x != 0)")
    same = rows.groupBy("v").agg(F.min("vec_id").alias("smallest"), F.count("*").alias("n"))
    # (a number for each distinct vector; written, so that it stays)
    same = cut(same.withColumn("leader", F.monotonically_increasing_id()), "distinct")
    size = same.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).first()
    tables, bits = plan_tables(size["n"], least, recall)
    dims = size["dims"] or 1
    signed = same.selectExpr("leader as vec_id", "n", "v").mapInPandas(
        _signed(tables, bits, dims, seed), "vec_id long, n long, v array<double>, marks array<long>"
    )
    signed = cut(signed.withColumn("v", F.col("v").cast("array<float>")) if _single(vectors) else signed, "signed")
    spots = signed.select("vec_id", F.posexplode("marks").alias("table", "mark"))
    sizes = spots.groupBy("table", "mark").agg(F.count("*").alias("m")).where("m > 1")
    sizes = sizes.select("table", "mark", F.ceil(F.col("m") / GROUP).cast("int").alias("parts"))
    placed = spots.join(sizes, ["table", "mark"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "table"), F.col("parts")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "vec_id", "table", "mark", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), (F.col("part") > F.col("other")).cast("int").alias("side")
    )
    pieces = met.join(signed, "vec_id").groupBy("table", "mark", "p", "q")
    found = cut(pieces.applyInPandas(_pieces(dims, tables, least), "vec_id long, links long, low long"), "links")
    whole = same.select("leader", "smallest", "n").join(found.groupBy("vec_id").agg(F.sum("links").alias("links")).withColumnRenamed("vec_id", "leader"), "leader", "left")
    components = connected_components(found, "vec_id", "low").withColumnRenamed("vertex", "leader")
    whole = whole.join(components, "leader", "left").withColumn("component", F.coalesce("component", "leader"))
    low = whole.groupBy("component").agg(F.min("smallest").alias("component_id"))
    whole = whole.join(low, "component").select("leader", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    groups = same.select("v", "leader").join(whole, "leader").drop("leader")
    # every row by its vector; one that takes no part has none
    v = F.col("embedding").cast("array<double>")
    good = F.expr("vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0)")
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).withColumn("v", F.when(good, F.col("v"))).join(groups, "v", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    )


def _single(vectors: DataFrame) -> bool:
    return vectors.schema["embedding"].dataType.simpleString() == "array<float>"

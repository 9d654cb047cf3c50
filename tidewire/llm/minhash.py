"""Near-duplicate documents by one-permutation MinHash.

Each document's set of word shingles is hashed once; the hash range is cut into
bins and the smallest hash in each bin is kept.  Empty bins take the value of a
filled bin chosen by a hash of (bin, attempt), the same for every document
(optimal densification).  Runs of bins make bands; documents that share a band
form a bucket.  In a bucket only stars are proposed - a centre with each other
member - so that a bucket of m documents gives m - 1 pairs, not m^2.
Buckets that span several components after that are compared whole, block by block,
and only pairs that a bound on the difference of their sets cannot rule out go on;
members of very large ones are first dealt to buckets of longer, finer bands.
Every proposed pair is confirmed on the full sets.

Texts move once: the sets of the documents that share a bucket are made then and
written, and every later step starts from those and from the labels found so far.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .components import merged_labels
from .shared import cut, forget, in_small_batches, trimmed

PROFILE = "doc_id long, n_shingles long, set_hi long, set_lo long, bands array<long>"
#: Characters whose shingles are held at once, about; a longer text is held whole.
SLICE = 500_000
#: Members of a bucket that are compared with as many others in one piece of work, about.
BLOCK = 512
#: Members of the largest bucket that is compared whole without finer bands.
WHOLE = 4096
#: Rows of a finer band, and the chance that a pair at the threshold shares none.
FINER, MISSED = 8, 1e-6
SETS = "doc_id long, n long, sketch binary, shingles binary"
#: Counters of a sketch.
CELLS = 256
#: Pairs whose sketches are subtracted at once.
AT_ONCE = 16_384


def densified_minima(sets: np.ndarray, first: np.ndarray, bins: int) -> np.ndarray:
    """One row of ``bins`` minima for each non-empty sorted set; empty sets give zeros."""
    n = len(first) - 1
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    doc = np.repeat(np.arange(n), np.diff(first))
    cell = doc * bins + (sets >> shift).astype(np.int64)
    lead = np.ones(len(cell), dtype=bool)
    lead[1:] = cell[1:] != cell[:-1]
    out = np.zeros(n * bins, dtype=np.uint64)
    full = np.zeros(n * bins, dtype=bool)
    out[cell[lead]] = sets[lead]
    full[cell[lead]] = True
    out, full = out.reshape(n, bins), full.reshape(n, bins)
    row, hole = np.nonzero(~full & (np.diff(first) > 0)[:, None])
    attempt = np.zeros(len(row), dtype=np.uint64)
    dense = out.copy()
    while len(row):
        attempt += np.uint64(1)
        source = (kernel.mix64(hole.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + attempt) % np.uint64(bins)).astype(np.int64)
        found = full[row, source]
        dense[row[found], hole[found]] = out[row[found], source[found]]
        row, hole, attempt = row[~found], hole[~found], attempt[~found]
    return dense


def band_keys(minima: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of each row of minima; the band's number is part of it."""
    n, bins = minima.shape
    rows = bins // bands
    keys = np.zeros((n, bands), dtype=np.uint64) + kernel.mix64(np.arange(1, bands + 1, dtype=np.uint64))
    cells = kernel.mix64(minima).reshape(n, bands, rows)
    for k in range(rows):
        keys = kernel.mix64(keys * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, k])
    return keys


def _profiles(words: int, bins: int, bands: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in kernel.slices(batch["text"], SLICE):
                some = batch.iloc[part]
                sets, first = kernel.shingle_sets(some["text"].tolist(), words)
                sizes = np.diff(first)
                keys = band_keys(densified_minima(sets, first, bins), bands).view(np.int64)
                marks = []
                for seed in (0x243F6A8885A308D3, 0x13198A2E03707344):
                    total = np.zeros(len(sets) + 1, dtype=np.uint64)
                    np.cumsum(kernel.mix64(sets ^ np.uint64(seed)), out=total[1:])
                    marks.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
                yield pd.DataFrame(
                    {
                        "doc_id": some["doc_id"].astype("Int64").array,
                        "n_shingles": sizes,
                        "set_hi": marks[0],
                        "set_lo": marks[1],
                        "bands": [k if s else None for k, s in zip(keys, sizes)],
                    }
                )

    return run


def _sets(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in kernel.slices(batch["text"], SLICE):
                some = batch.iloc[part]
                sets, first = kernel.shingle_sets(some["text"].tolist(), words)
                yield pd.DataFrame(
                    {
                        "doc_id": some["doc_id"].array,
                        "n": np.diff(first),
                        "sketch": [c.tobytes() for c in sketches(sets, first)],
                        "shingles": [sets[a:b].tobytes() for a, b in zip(first[:-1], first[1:])],
                    }
                )

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            linked = []
            for x, y in zip(batch["left"], batch["right"]):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int(np.count_nonzero(y[at] == x))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[np.array(linked, dtype=bool), ["a", "b"]]

    return run


def confirm_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the proposed pairs (a, b) of doc_id, those whose full sets are similar enough; a written table.

    sets: (doc_id, n, sketch, shingles).  Where a doc_id has several sets, any of them
    may confirm a pair.  Pairs whose sizes alone rule them out move no set.
    """
    size = sets.groupBy("doc_id").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    end = lambda x: size.select(F.col("doc_id").alias(x), F.col("low").alias(f"{x}_low"), F.col("high").alias(f"{x}_high"))
    near = pairs.join(end("a").hint("merge"), "a").join(end("b").hint("merge"), "b")
    for x, y in (("a", "b"), ("b", "a")):
        near = near.where(F.lit(100) * F.col(f"{x}_high") >= F.lit(percent) * F.col(f"{y}_low"))
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right"))
    both = near.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return cut(both.select("a", "b", "left", "right").mapInPandas(trimmed(_confirm(percent)), "a long, b long").distinct(), "links")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.select("key", "doc_id").join(labels.hint("merge"), "doc_id")


def _stars(members: DataFrame, seed: int) -> DataFrame:
    """Pairs of each bucket's centre with its members of other components.

    members: (key, doc_id, component).  The centre is the smallest doc_id with seed 0, so
    that the buckets of a group agree on it, else one chosen by a hash.
    """
    rank = F.xxhash64(F.lit(seed), "key", "doc_id") if seed else F.col("doc_id")
    centres = members.groupBy("key").agg(
        F.min(F.struct(rank.alias("rank"), "doc_id", "component")).alias("c"),
        F.min("component").alias("low"),
        F.max("component").alias("high"),
    ).where("low != high").select("key", F.col("c.doc_id").alias("centre"), F.col("c.component").alias("centre_component"))
    return (
        members.join(centres.hint("merge"), "key")
        .where("component != centre_component")
        .select(F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b"))
        .distinct()
    )


def sketches(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Counts of each set's members by a hash, 255 at most.

    The counts of two sets differ, added up over all cells, by no more than the number of
    members that only one of the sets has.
    """
    n = len(first) - 1
    cell = (kernel.mix64(sets ^ np.uint64(0xA4093822299F31D0)) % np.uint64(CELLS)).astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(n), np.diff(first)) * CELLS + cell, minlength=n * CELLS)
    return np.minimum(counts, 255).astype(np.uint8).reshape(n, CELLS)


def _possible(doc, n, component, sketch, far, percent: int, closest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of one piece of work that may be similar enough.

    far: None where all members meet, or which of two blocks each is in, where only the
    blocks meet.
    """
    left = right = np.arange(len(doc))
    if far is not None:
        left, right = np.flatnonzero(~far), np.flatnonzero(far)
    some = component[left][:, None] != component[right][None, :]
    some &= 100 * np.minimum(n[left][:, None], n[right][None, :]) >= percent * np.maximum(n[left][:, None], n[right][None, :])
    if far is None:
        some = np.triu(some, 1)
    i, j = np.nonzero(some)
    i, j = left[i], right[j]
    apart = np.zeros(len(i), dtype=np.int64)
    for k in range(0, len(i), AT_ONCE):
        apart[k : k + AT_ONCE] = np.abs(sketch[i[k : k + AT_ONCE]] - sketch[j[k : k + AT_ONCE]]).sum(axis=1, dtype=np.int64)
    both = n[i] + n[j]
    keep = apart * (100 + percent) <= both * (100 - percent)
    i, j, apart, both = i[keep], j[keep], apart[keep], both[keep]
    if closest and len(i) > 1:
        low, high = np.minimum(component[i], component[j]), np.maximum(component[i], component[j])
        order = np.lexsort((apart / both, high, low))
        lead = np.ones(len(order), dtype=bool)
        lead[1:] = (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)
        i, j = i[order[lead]], j[order[lead]]
    return i, j


def _compared(percent: int, closest: bool):
    """Rows in order of (key, x, y) to possible pairs; a piece of work may go on in the next batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            at = _borders(batch)
            rest = batch.iloc[at[-2] :]
            yield from _pieces(batch, at[:-1], percent, closest)
        if rest is not None and len(rest):
            yield from _pieces(rest, _borders(rest), percent, closest)

    return run


def _borders(batch: pd.DataFrame) -> np.ndarray:
    marks = [batch[c].to_numpy() for c in ("key", "x", "y")]
    new = np.ones(len(batch), dtype=bool)
    new[1:] = np.any([m[1:] != m[:-1] for m in marks], axis=0)
    return np.append(np.flatnonzero(new), len(batch))


def _pieces(batch: pd.DataFrame, at: np.ndarray, percent: int, closest: bool) -> Iterator[pd.DataFrame]:
    doc, n, component, x, y, block = (batch[c].to_numpy() for c in ("doc_id", "n", "component", "x", "y", "block"))
    raw = batch["sketch"].tolist()
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for start, end in zip(at[:-1], at[1:]):
        own = component[start:end]
        if end - start < 2 or (own == own[0]).all():
            continue
        sketch = np.frombuffer(b"".join(raw[start:end]), dtype=np.uint8).reshape(-1, CELLS).astype(np.int16)
        far = None if x[start] == y[start] else block[start:end] == y[start]
        i, j = _possible(doc[start:end], n[start:end], own, sketch, far, percent, closest)
        out.append((doc[start:end][i], doc[start:end][j]))
    if out:
        a, b = (np.concatenate(side) for side in zip(*out))
        yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _open_buckets(members: DataFrame) -> DataFrame:
    """Buckets that span several components: (key, m, hi, lo); hi and lo tell the members.  A bucket of two was compared by its star."""
    buckets = members.groupBy("key").agg(
        F.min("component").alias("low"),
        F.max("component").alias("high"),
        F.count("*").alias("m"),
        F.bit_xor(F.xxhash64(F.lit(11), "doc_id")).alias("hi"),
        F.bit_xor(F.xxhash64(F.lit(12), "doc_id")).alias("lo"),
    )
    return buckets.where("low != high and m > 2").select("key", "m", "hi", "lo")


def _whole(members: DataFrame, sets: DataFrame, percent: int, closest: bool) -> DataFrame:
    """Pairs of members of other components in every bucket that spans several, but for those whose sketches rule them out.

    members: (key, doc_id, component).  In each bucket the component with the most members
    is set apart from the odd rest: its members are among themselves connected already and
    meet only odd ones.  Both are cut into blocks of about BLOCK, and each two blocks of which
    one is odd are one piece of work.  Buckets with the same members are compared once.
    closest: only the pair with the nearest sketches of each two components in a piece of work.
    """
    once = _open_buckets(members).groupBy("m", "hi", "lo").agg(F.min("key").alias("key")).select("key")
    own = members.join(once.hint("merge"), "key")
    parts = own.groupBy("key", "component").agg(F.count("*").alias("held"))
    parts = parts.groupBy("key").agg(F.max(F.struct("held", "component")).alias("most"), F.sum("held").alias("m"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    parts = parts.select(
        "key", F.col("most.component").alias("main"), blocks(F.col("m") - F.col("most.held")).alias("odd_blocks"), blocks(F.col("most.held")).alias("main_blocks")
    )
    h = F.xxhash64(F.lit(13), "doc_id")
    is_main = F.col("component") == F.col("main")
    placed = (
        own.join(parts.hint("merge"), "key")
        .withColumn("block", F.when(is_main, F.col("odd_blocks") + F.pmod(h, F.col("main_blocks"))).otherwise(F.pmod(h, F.col("odd_blocks"))).cast("int"))
        .withColumn("last", F.when(is_main, F.col("odd_blocks")).otherwise(F.col("odd_blocks") + F.col("main_blocks")) - 1)
    )
    work = (
        placed.join(sets.select("doc_id", "n", "sketch").hint("merge"), "doc_id")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
        .select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "doc_id", "n", "component", "sketch")
    )
    work = work.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return work.mapInPandas(trimmed(_compared(percent, closest)), "a long, b long").distinct()


def finer_tables(percent: int) -> int:
    """How many bands of FINER rows leave a pair at the threshold without a common one with a chance of MISSED at most; a power of two."""
    same = (percent / 100) ** FINER
    return 1 << math.ceil(math.log2(math.log(MISSED) / math.log1p(-same)))


def _finer(tables: int):
    """Sets to the keys of their finer bands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 512):
                some = batch.iloc[start : start + 512]
                sets = np.frombuffer(b"".join(some["shingles"]), dtype=np.uint64)
                first = np.concatenate([[0], np.cumsum(some["n"].to_numpy())])
                # another hash of the shingles, so that these bands say more than those before
                own = np.concatenate([np.sort(kernel.mix64(sets[a:b] ^ np.uint64(0x452821E638D01377))) for a, b in zip(first[:-1], first[1:])])
                keys = band_keys(densified_minima(own, first, FINER * tables), tables).view(np.int64)
                yield pd.DataFrame({"doc_id": some["doc_id"].array, "bands": list(keys)})

    return run


def _finished(members: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, stars: int, whole: int | None) -> DataFrame:
    """Labels after ``stars`` rounds of stars and comparing whole the buckets of ``whole`` members at most (None: all)."""
    for k in range(stars + 2):
        now = _labelled(members, labels)
        if k < stars:
            pairs = _stars(now, k)
        else:
            if whole is not None:
                fit = now.groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") <= whole).select("key")
                now = now.join(fit.hint("merge"), "key")
            pairs = _whole(now, sets, percent, closest=k == stars)
        pairs = cut(pairs, "pairs")
        if pairs.isEmpty():
            forget(pairs)
            if k < stars:
                continue  # no bucket spans two components: the rounds that follow find the same
            break
        links = confirm_links(pairs, sets, percent)
        labels = merged_labels(labels, links)
        forget(pairs, links)
    return labels


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, bins: int = 128, bands: int = 32, rounds: int = 2
) -> DataFrame:
    """Group documents whose sets of word shingles have a Jaccard similarity of ``percent`` or more.

    docs needs doc_id and text; other columns are ignored.  Returns, for each row of
    docs, doc_id, n_shingles, component_id (smallest doc_id reachable by links) and
    kept (doc_id = component_id).

    A null or empty text and one without words has no shingles and no links.  A text
    of fewer words than a shingle has its whole sequence as its one shingle.  Rows
    that share a doc_id are one document with the links of any of its rows; a row
    with a null doc_id is returned with component_id null and kept false.

    Equal sets are merged first, through their size and a 128-bit digest of the set,
    so copies cost one row each.  Of the rest, those that share a bucket have their sets
    written once.  In each of ``rounds`` rounds every bucket that spans several components
    proposes a star around one member with the members of other components.  The centre
    is the smallest doc_id first and then chosen by a hash of bucket and document, so the
    buckets of one group try different centres.  What still spans several components then is finished: first the
    nearest pair of each two components, then every pair that is still of two
    components and may be similar.  Members of buckets of more than WHOLE members go through
    finer bands before that, of which a similar pair shares one but with a chance of MISSED.
    """
    profile = cut(in_small_batches(docs.select("doc_id", "text")).mapInPandas(trimmed(_profiles(words, bins, bands)), PROFILE), "profiles")
    some = profile.where("n_shingles > 0 and doc_id is not null")
    by_set = ["set_hi", "set_lo", "n_shingles"]
    groups = some.groupBy(*by_set).agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).where("leader != last").drop("last")
    copies = cut(some.select("doc_id", *by_set).join(groups.hint("merge"), by_set).where("doc_id != leader").select("doc_id", "leader", *by_set), "copies")
    leaders = some.join(copies.select("doc_id", *by_set).hint("merge"), ["doc_id", *by_set], "left_anti")
    # a bucket of one document proposes nothing; the others are few, and all rounds start from them
    every = leaders.select(F.explode("bands").alias("key"), "doc_id")
    shared = every.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low != high").select("key")
    members = cut(every.join(shared.hint("merge"), "key").select("key", "doc_id").distinct(), "members")
    named = members.select("doc_id").distinct()
    sets = docs.select("doc_id", "text").join(named.hint("merge"), "doc_id", "left_semi").mapInPandas(trimmed(_sets(words)), SETS)
    sets = cut(sets.where("n > 0"), "sets")
    labels = cut(named.withColumn("component", F.col("doc_id")), "labels")
    labels = _finished(members, sets, labels, percent, rounds, WHOLE)
    left = _labelled(members, labels)
    large = _open_buckets(left).where(F.col("m") > WHOLE).select("key")
    large = cut(left.join(large.hint("merge"), "key").select("doc_id").distinct(), "large")
    if not large.isEmpty():
        finer = sets.join(large.hint("merge"), "doc_id").mapInPandas(trimmed(_finer(finer_tables(percent))), "doc_id long, bands array<long>")
        finer = finer.select(F.explode("bands").alias("key"), "doc_id").distinct()
        shared = finer.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low != high").select("key")
        finer = cut(finer.join(shared.hint("merge"), "key").select("key", "doc_id"), "members")
        labels = _finished(finer, sets, labels, percent, rounds, None)
        forget(finer)
    # the copies follow their leaders; a document with several sets may join several groups
    stars = copies.select(F.col("doc_id").alias("a"), F.col("leader").alias("b"))
    ends = stars.select(F.col("a").alias("vertex")).unionByName(stars.select(F.col("b").alias("vertex"))).distinct()
    alone = ends.join(labels.hint("merge"), ends["vertex"] == labels["doc_id"], "left_anti").select(F.col("vertex").alias("doc_id"), F.col("vertex").alias("component"))
    labels_all = cut(labels.unionByName(alone), "labels")
    forget(labels, members, sets, large)
    labels = merged_labels(labels_all, stars)
    found = profile.select("doc_id", "n_shingles").join(labels.hint("merge"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")
    )

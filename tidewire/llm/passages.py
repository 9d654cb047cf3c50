"""Passages that repeat across documents, by prefix-partitioned suffix trees over words.

Every word begins a suffix of its document.  A node of the suffix tree of all
documents at a depth of ``window`` words or more with several leaves is a repeated
passage.  The tree is never built in one place:

1. Documents are packed into blocks of bounded size, written once as a bucketed
   table; later steps come back to their block without moving its texts again.
2. A suffix whose first ``window`` words occur in no other block can't reach a deep
   node there.  Blocks send short fingerprints of their distinct windows; those met
   once are pruned.  Fingerprints may collide, which only keeps a suffix too long.
3. The suffixes that are left are split by their first words.  A prefix of one word
   is made longer - 2, 4, 8 words, at last the window - where too many suffixes share
   it; prefixes are dealt to groups that fit in memory.  A block sends a suffix once for
   each distinct window, with its smallest doc_id, so a passage that all documents
   share gives one leaf a block.
4. A group orders its suffixes by their words (a symbol is 16 bits of a word's hash)
   and takes the common prefix of each two neighbours.  From these the group's
   subtree is read: the internal nodes of ``window`` words or more are the intervals
   of leaves whose common prefixes are as long.  The tree is cut at that depth, as
   what is below adds nothing to what is covered.  64 bits of a hash of all the words
   confirm the leaves of a node.
5. Blocks learn which of their suffixes begin below a node with a smaller doc_id
   elsewhere; following suffixes chain to maximal repeats, the spans that go.
"""
from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .shared import cut, in_small_batches, remove, shared_dir, trimmed

LEVELS = (1, 2, 4, 8)  # words of a prefix; the last resort is the window itself
MOST_BITS = 16  # of a prefix cell; what is known of cells is bounded by this, whatever the input
SYMBOL = np.uint64(48)  # a word's symbol is what is left of its hash after this shift
LAST = np.int64(2**63 - 1)  # stands for a null doc_id, which counts as the largest


def _planes(values: np.ndarray) -> bytes:
    """Bytes of 64-bit integers, all first bytes, then all second ones, and so on: high ones compress."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()


def _integers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).reshape(-1).view(np.uint64)


def _rising(values: np.ndarray) -> bytes:
    return _planes(np.diff(values, prepend=np.uint64(0)))


def _risen(data: bytes) -> np.ndarray:
    return np.cumsum(_integers(data), dtype=np.uint64)


class _Block:
    """The distinct windows of a block, its documents in the order of their ids."""

    def __init__(self, ids, texts, window: int):
        ids = np.asarray(ids, dtype=np.int64)
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order]
        self.words = kernel.split_words([texts[i] for i in self.order])
        self.hashes = kernel.word_hashes(self.words)
        self.starts = kernel.window_starts(self.words, window)
        self.window = window

    def distinct(self) -> None:
        every = kernel.window_hashes(self.hashes, self.window)[self.starts] if len(self.starts) else np.zeros(0, np.uint64)
        self.values, self.first, self.of = np.unique(every, return_index=True, return_inverse=True)
        # the words confirm what equal hashes say; where they don't, windows are told apart by all their words
        first = self.starts[self.first][self.of] if len(self.starts) else self.starts
        if any((self.hashes[self.starts + k] != self.hashes[first + k]).any() for k in range(self.window if len(self.starts) else 0)):
            keys = [self.hashes[self.starts + k] for k in range(self.window)]
            order = np.lexsort((*keys, every))
            new = np.ones(len(order), dtype=bool)
            new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
            self.first, self.of = order[new], np.empty(len(order), dtype=np.int64)
            self.of[order] = np.cumsum(new) - 1
            self.values = every[self.first]
        self.least = self.ids[self.words.doc[self.starts[self.first]]]

    def prefixes(self, at: np.ndarray, size: int, seed: int) -> np.ndarray:
        """Hashes of the first words of the suffixes that begin at words ``at``."""
        h = np.full(len(at), seed, dtype=np.uint64)
        for k in range(size):
            h = (h ^ self.hashes[at + k]) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        return kernel.mix64(h)


def _cells(block: _Block, at: np.ndarray, window: int, bits: int) -> Iterator[np.ndarray]:
    for level, size in enumerate([*(s for s in LEVELS if s < window), window]):
        yield (block.prefixes(at, size, 100 + level) >> np.uint64(64 - bits)).astype(np.int64)


def _pack(window: int, chars: int, bits: int):
    """Rows of about ``chars`` characters: ids, texts and how many suffixes have each prefix."""

    def made(number: int, part: list, ids: list, texts: list) -> pa.RecordBatch:
        block = _Block(ids, texts, window)
        counts = []
        for level, cell in enumerate(_cells(block, block.starts, window, bits)):
            found, n = np.unique(cell, return_counts=True)
            counts.append(np.stack([found + (level << bits), n]))
        prefixes = np.concatenate(counts, axis=1)
        return pa.RecordBatch.from_pydict(
            {
                "block": pa.array([(part[0] << 32) + number], pa.int64()),
                "ids": pa.array([ids], pa.list_(pa.int64())),
                "texts": pa.array([texts], pa.list_(pa.string())),
                "prefixes": pa.array([_planes(prefixes.ravel())], pa.binary()),
                "windows": pa.array([len(block.starts)], pa.int64()),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = [TaskContext.get().partitionId()]
        ids, texts, size, number = [], [], 0, 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(int(LAST) if i is None else i)
                texts.append(text)
                size += len(text or "")
                if size >= chars:
                    yield made(number, part, ids, texts)
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield made(number, part, ids, texts)

    return run


def _summed(parts: list[np.ndarray]) -> np.ndarray:
    """Counts by cell of several pairs of rows (cells, counts)."""
    both = np.concatenate(parts, axis=1)
    cell, of = np.unique(both[0], return_inverse=True)
    n = np.zeros(len(cell), dtype=np.int64)
    np.add.at(n, of, both[1])
    return np.stack([cell, n])


def _dealt(block: "_Block", at: np.ndarray, window: int, bits: int, open_: np.ndarray, parts: int) -> np.ndarray:
    """The group of each suffix: by its shortest prefix that is not shared by too many."""
    group = np.full(len(at), -1, dtype=np.int64)
    sizes = [*(s for s in LEVELS if s < window), window]
    for level, size in enumerate(sizes):
        h = block.prefixes(at, size, 100 + level)
        closed = (group < 0) if level == len(sizes) - 1 else (group < 0) & ~open_[level][(h >> np.uint64(64 - bits)).astype(np.int64)]
        group[closed] = (kernel.mix64(h[closed]) % np.uint64(parts)).astype(np.int64)
    return group


def _symbols(block: "_Block", at: np.ndarray, window: int) -> list[np.ndarray]:
    """The first ``window`` words of each suffix as symbols, four to an integer, so that integers in turn order the suffixes."""
    out = []
    for start in range(0, window, 4):
        packed = np.zeros(len(at), dtype=np.uint64)
        for k in range(start, min(start + 4, window)):
            packed |= (block.hashes[at + k] >> SYMBOL) << np.uint64(48 - 16 * (k - start))
        out.append(packed)
    return out


def _common(keys: list[np.ndarray], window: int) -> np.ndarray:
    """How many words each of the ordered suffixes has in common with the one before; 0 for the first."""
    n = len(keys[0])
    common = np.zeros(n, dtype=np.int64)
    same = np.ones(max(n - 1, 0), dtype=bool)
    for k in range(window):
        symbol = (keys[k // 4] >> np.uint64(48 - 16 * (k % 4))) & np.uint64(0xFFFF)
        same &= symbol[1:] == symbol[:-1]
        common[1:] += same
    return common


def _fingerprints(window: int, group_bits: int, kept_bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, ids, texts in zip(batch["block"], batch["ids"], batch["texts"]):
                block = _Block(ids, texts, window)
                block.distinct()
                short = block.values >> np.uint64(64 - kept_bits)
                group = (block.values >> np.uint64(64 - group_bits)).astype(np.int64)
                found, at = np.unique(group, return_index=True)
                ends = np.append(at[1:], len(short))
                yield pd.DataFrame({"block": number, "part": found, "marks": [_rising(short[a:b]) for a, b in zip(at, ends)]})

    return run


def _met_elsewhere(rows: pd.DataFrame) -> pd.DataFrame:
    """For each block's fingerprints whether another block has them."""
    marks = [_risen(m) for m in rows["marks"]]
    _, of, n = np.unique(np.concatenate(marks), return_inverse=True, return_counts=True)
    cuts = np.cumsum([len(m) for m in marks])[:-1]
    masks = [np.packbits(x).tobytes() for x in np.split(n[of] > 1, cuts)]
    return pd.DataFrame({"block": rows["block"], "part": rows["part"], "n": [len(m) for m in marks], "mask": masks})


def _leaves(window: int, bits: int, open_: np.ndarray, parts: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, ids, texts, masks in zip(batch["block"], batch["ids"], batch["texts"], batch["masks"]):
                block = _Block(ids, texts, window)
                block.distinct()
                masks = sorted(masks, key=lambda m: m["part"])
                keep = np.concatenate([np.unpackbits(np.frombuffer(m["mask"], np.uint8), count=m["n"]) for m in masks]) if len(masks) else np.zeros(0, np.uint8)
                left = np.flatnonzero(keep)
                at = block.starts[block.first[left]]
                group = _dealt(block, at, window, bits, open_, parts)
                keys = _symbols(block, at, window)
                order = np.lexsort((*keys[::-1], group))
                left, group, keys = left[order], group[order], [k[order] for k in keys]
                found, lead = np.unique(group, return_index=True)
                for g, x, y in zip(found.tolist(), lead, np.append(lead[1:], len(group))):
                    of = left[x:y]
                    row = {"block": number, "part": g, "place": of.astype(np.uint32).tobytes(), "words": _rising(keys[0][x:y])}
                    row["words"] += b"".join(_planes(k[x:y]) for k in keys[1:])
                    yield pd.DataFrame([row | {"check": block.values[of].tobytes(), "least": _planes(block.least[of])}])

    return run


def _deep_nodes(window: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """For each block the suffixes below a node of ``window`` words or more that has a smaller doc_id from another block."""
        place = [np.frombuffer(x, np.uint32) for x in rows["place"]]
        keys: list[list[np.ndarray]] = [[] for _ in range(0, window, 4)]
        for own, words in zip(place, rows["words"]):
            size = 8 * len(own)
            for k, key in enumerate(keys):
                part = words[k * size : (k + 1) * size]
                key.append(_integers(part) if k else _risen(part))
        flat = [np.concatenate(k) for k in keys]
        check = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["check"]])
        least = np.concatenate([_integers(x) for x in rows["least"]]).view(np.int64)
        order = np.lexsort((check, *flat[::-1]))
        deep = _common([k[order] for k in flat], window) >= window
        deep[1:] &= check[order][1:] == check[order][:-1]
        node = np.cumsum(~deep) - 1  # an interval of deep neighbours is one node
        heads = np.flatnonzero(~deep)
        low = np.minimum.reduceat(least[order], heads) if len(heads) else least
        behind = np.empty(len(order), dtype=bool)
        behind[order] = least[order] > low[node]
        cuts = np.cumsum([len(p) for p in place])[:-1]
        return pd.DataFrame({"block": rows["block"], "places": [_rising(np.sort(p[b]).astype(np.uint64)) for p, b in zip(place, np.split(behind, cuts))]})

    return run


def _results(window: int, texts_too: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, texts, places in zip(batch["ids"], batch["texts"], batch["places"]):
                block = _Block(ids, texts, window)
                block.distinct()
                words = block.words
                behind = np.zeros(len(block.values), dtype=bool)
                for p in places if places is not None else ():
                    behind[_risen(p).astype(np.int64)] = True
                repeated = behind[block.of] | (block.ids[words.doc[block.starts]] > block.least[block.of])
                cover = np.zeros(len(words.doc) + 1, dtype=np.int64)
                at = block.starts[repeated]
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
                covered = np.cumsum(cover)[:-1] > 0
                yield _told(block, covered, texts_too)

    return run


def _told(block: _Block, covered: np.ndarray, texts_too: bool) -> pd.DataFrame:
    words, n = block.words, block.words.n_docs
    # the bytes of kept words, each with the separator after it turned into a space
    mark = np.zeros(len(words.buf) + 1, dtype=np.int8)
    kept = ~covered
    mark[words.starts[kept]] += 1
    mark[words.ends[kept] + 1] -= 1
    use = np.cumsum(mark[:-1]) > 0
    out = words.buf.copy()
    out[words.ends[kept]] = 0x20
    flat = out[use].tobytes()
    place = np.concatenate([[0], np.cumsum(use)])[words.offsets]
    texts = [flat[a : b - 1] if b > a else b"" for a, b in zip(place[:-1], place[1:])]
    removed = np.concatenate([[0], np.cumsum(covered)])
    edge = np.zeros(len(covered) + 2, dtype=np.int8)
    edge[1:-1] = covered
    head = np.diff(edge)[:-1] == 1
    head[words.first[:-1][words.counts > 0]] |= covered[words.first[:-1][words.counts > 0]]
    heads = np.flatnonzero(head)
    stop = ~covered
    ends = np.append(np.flatnonzero(stop), len(covered))
    last = np.minimum(ends[np.searchsorted(ends, heads)], words.first[words.doc[heads] + 1]) if len(heads) else heads
    own = np.searchsorted(words.doc[heads], np.arange(n + 1))
    lead = words.first[words.doc[heads]] if len(heads) else heads
    spans = np.stack([heads - lead, last - lead], axis=1) if len(heads) else np.zeros((0, 2), np.int64)
    rows = {
        "doc_id": pd.array([None if i == LAST else int(i) for i in block.ids], dtype="Int64"),
        "n_words": words.counts,
        "n_removed": removed[words.first[1:]] - removed[words.first[:-1]],
        "kept_sha256": [hashlib.sha256(t).hexdigest() for t in texts],
        "spans": [[{"start": int(a), "end": int(b)} for a, b in spans[x:y]] for x, y in zip(own[:-1], own[1:])],
    }
    if texts_too:
        rows["kept"] = [t.decode("utf-8", "replace") for t in texts]
    return pd.DataFrame(rows)


def remove_repeats(docs: DataFrame, window: int = 13, texts: bool = True, block_chars: int = 4_000_000, group_windows: int = 2_000_000) -> DataFrame:
    """Remove words of passages that also occur in a document with a smaller doc_id.

    docs needs doc_id and text; other columns are ignored.  A word goes if it lies in a
    run of ``window`` words of its document whose sequence also begins somewhere in a
    document with a smaller doc_id; runs are judged on the input.  Returns for each
    row doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one
    space), spans (start, end: maximal runs of removed words, end exclusive) and, with
    texts, kept (the kept words joined by one space).

    A null or empty text has no words.  A text shorter than the window keeps all.
    Rows that share a doc_id don't remove from each other.  A null doc_id counts as
    larger than any other.  An empty table gives an empty result.

    Blocks hold about ``block_chars`` characters, or one longer document; a group's suffixes
    are about ``group_windows`` at most, even if none could be pruned.  The result is written
    to the shared folder; the blocks are deleted.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()["chars"]
    likely = max(1, size // 5)
    bits = min(MOST_BITS, max(10, math.ceil(math.log2(likely / group_windows + 1)) + 5))
    name = f"tidewire_blocks_{uuid.uuid4().hex}"
    packed = in_small_batches(docs).mapInArrow(trimmed(_pack(window, block_chars, bits)), "block long, ids array<long>, texts array<string>, prefixes binary, windows long")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / block_chars / 8))
    folder = f"{shared_dir(spark)}/{name}"
    (
        packed.write.bucketBy(buckets, "block")
        .option("path", folder)
        .option("compression", "zstd")
        .format("parquet")
        .saveAsTable(name)
    )
    blocks = spark.table(name)

    # a cell that a task holds so few suffixes of can't open it: all tasks together miss an eighth of the bound at most
    tasks = blocks.select("prefixes").rdd.getNumPartitions()
    least = group_windows // 2 // (8 * max(tasks, 1))

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums of a task's blocks, but for cells of few; they are brought together whenever a million entries have gathered."""
        parts, held = [], 0
        for batch in batches:
            for p in batch["prefixes"]:
                parts.append(_integers(p).view(np.int64).reshape(2, -1))
                held += parts[-1].shape[1]
                if held > 1 << 20:
                    parts = [_summed(parts)]
                    held = parts[0].shape[1]
        if parts:
            cell, n = _summed(parts)
            yield pd.DataFrame({"cell": cell[n > least], "n": n[n > least]})

    cells = blocks.select("prefixes").mapInPandas(added, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    levels = len([s for s in LEVELS if s < window]) + 1
    total = blocks.agg(F.coalesce(F.sum("windows"), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-2 * total // group_windows))
    open_ = np.zeros((levels, 1 << bits), dtype=bool)
    for r in cells.where(F.col("n") > group_windows // 2).collect():  # bounded: levels times 2^MOST_BITS
        open_[r["cell"] >> bits, r["cell"] & ((1 << bits) - 1)] = True

    group_bits = max(1, math.ceil(math.log2(max(total, 1) / group_windows + 1)))
    kept_bits = min(64, max(group_bits, math.ceil(math.log2(total + 1)) + 12))
    held = blocks.select("block", "ids", "texts")
    marks = held.mapInPandas(trimmed(_fingerprints(window, group_bits, kept_bits)), "block long, part long, marks binary")
    masks = marks.groupBy("part").applyInPandas(_met_elsewhere, "block long, part long, n long, mask binary")
    masks = masks.groupBy("block").agg(F.collect_list(F.struct("part", "n", "mask")).alias("masks"))
    leaves = held.join(masks, "block").mapInPandas(
        trimmed(_leaves(window, bits, open_, parts)), "block long, part long, place binary, words binary, check binary, least binary"
    )
    places = leaves.groupBy("part").applyInPandas(_deep_nodes(window), "block long, places binary")
    places = places.groupBy("block").agg(F.collect_list("places").alias("places"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>" + (", kept string" if texts else "")
    found = held.join(places, "block", "left").select("ids", "texts", "places").mapInPandas(trimmed(_results(window, texts)), schema)
    found = cut(found, "passages")
    spark.sql(f"drop table {name}")
    remove(spark, folder)
    return found

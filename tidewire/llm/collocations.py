"""Phrase collocations by sorted suffixes, after Berberich and Bedathur's suffix-sigma.

Every word begins a suffix of its piece of text, cut after ``most`` words.  The counts of
all phrases are the counts of the suffixes' prefixes:

1. Tasks count the words of each language and take a thin sample of suffixes.  From the
   sample come the borders of ranges of (language, suffix); the frequent words set bits
   of a filter of fixed size.
2. Tasks cut suffixes at infrequent words, as no frequent phrase holds one (a bit set for
   another word only leaves a suffix longer), add up equal ones of a chunk and deal them
   to the ranges: by language and first word, and where one word begins very many
   suffixes, by the words after it.  Suffixes that go to a range travel as compressed
   blocks, in which neighbours' common words cost next to nothing.
3. Each range sorts its suffixes in descending order.  Those that share a prefix follow each
   other, so one stack of the open prefixes' counts, one entry for each length, counts all of
   them in one pass.  Prefixes that a range's border may cut are given out whatever their
   count, and summed afterwards.
4. The parts of each frequent phrase are frequent too; joins bring their counts to it.

A suffix is its words with a zero byte between; zero bytes inside words are escaped, so the
order of bytes keeps equal prefixes together.
"""
from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut, forget, in_small_batches, trimmed

CHUNK = 4 << 20  # bytes of text counted together
THIN = 500  # one suffix of so many is in the sample
FILTER_BITS = 1 << 26
BLOCK = 1 << 14  # suffixes in a block, at most
LONG = 256  # bytes; what two suffixes share beyond is compared pair by pair

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BETWEEN = _BREAK.copy()
_BETWEEN[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _escaped(data: bytes) -> bytes:
    if b"\0" in data or b"\x01" in data:
        return data.replace(b"\x01", b"\x01\x02").replace(b"\0", b"\x01\x01")
    return data


def _plain(suffix: bytes, words: int) -> str:
    """The first words of a suffix as a phrase."""
    data = b" ".join(suffix.split(b"\0", words)[:words])
    if b"\x01" in data:
        data = data.replace(b"\x01\x01", b"\0").replace(b"\x01\x02", b"\x01")
    return data.decode("utf-8", "replace")


class Chunk:
    """The words of some texts: joined by zero bytes, numbered in their order, with the end of each one's piece."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(_escaped(b"\n".join(texts) + b"\n"), np.uint8)
        data = _LOWER[data]
        inside = ~_BETWEEN[data]
        edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.n = len(starts)
        self.lengths = ends - starts
        piece = np.cumsum(_BREAK[data], dtype=np.int32)[starts]
        sizes = np.diff(np.concatenate([[0], np.flatnonzero(np.diff(piece)) + 1, [self.n]])) if self.n else np.zeros(0, np.int64)
        self.stop = np.repeat(np.cumsum(sizes), sizes)
        offsets = np.zeros(self.n + 1, dtype=np.int64)
        np.cumsum(self.lengths, out=offsets[1:])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
        self.ids, self.words = words.indices.to_numpy(), words.dictionary
        data[ends] = 0
        inside[ends] = True
        self.joined = data[inside]
        self.at = offsets[:-1] + np.arange(self.n)

    def suffixes(self, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last byte of suffixes of so many words."""
        last = starts + sizes - 1
        return self.at[starts], self.at[last] + self.lengths[last]

    def bytes_of(self, start: int, stop: int) -> bytes:
        return self.joined[start:stop].tobytes()


def gathered(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """Slices of ``data`` as an array of binaries."""
    sizes = stops - starts
    offsets = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offsets[1:])
    at = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])


def packed(suffixes: pa.Array, counts: np.ndarray) -> bytes:
    """Suffixes (large binaries) and their counts as a compressed block."""
    n, columns = len(suffixes), []
    offsets = np.frombuffer(suffixes.buffers()[1], np.int64)[suffixes.offset : suffixes.offset + n + 1]
    for values in (np.diff(offsets), counts):
        # all first bytes, then all second ones: the high ones are zeros
        columns.append(np.ascontiguousarray(values, dtype="<u4").view(np.uint8).reshape(n, 4).T.tobytes())
    raw = b"".join([*columns, np.frombuffer(suffixes.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].tobytes()])
    return struct.pack("<IQ", n, len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(block: bytes) -> tuple[pa.Array, np.ndarray]:
    """Suffixes and counts of a block."""
    n, size = struct.unpack_from("<IQ", block)
    raw = np.frombuffer(pa.decompress(block[12:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    sizes, counts = (np.ascontiguousarray(raw[4 * n * k : 4 * n * (k + 1)].reshape(4, n).T).view("<u4").ravel().astype(np.int64) for k in (0, 1))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(raw[8 * n :])]).cast(pa.binary()), counts


def _parts(text: bytes) -> Iterator[bytes]:
    """A text in parts of about CHUNK, cut where pieces end; a longer piece stays whole."""
    while len(text) > CHUNK:
        held = np.flatnonzero(_BREAK[np.frombuffer(text, np.uint8, CHUNK)])
        if not len(held):
            held = np.flatnonzero(_BREAK[np.frombuffer(text, np.uint8)])[:1]
        if not len(held):
            break
        stop = int(held[-1]) + 1
        yield text[:stop]
        text = text[stop:]
    yield text


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Chunk]]:
    """The texts of a task by language, some megabytes at a time."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for part in _parts(text):
                held.setdefault(lang, []).append(part)
                size += len(part)
                if size >= CHUNK:
                    yield from ((name, Chunk(texts)) for name, texts in held.items())
                    held, size = {}, 0
    yield from ((name, Chunk(texts)) for name, texts in held.items())


def _counted(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of words, and a sample of suffixes."""
        for lang, chunk in _chunks(batches):
            if not chunk.n:
                continue
            starts = np.arange(zlib.crc32(chunk.bytes_of(0, 4096)) % min(THIN, chunk.n), chunk.n, THIN)
            sample = gathered(chunk.joined, *chunk.suffixes(starts, np.minimum(most, chunk.stop[starts] - starts)))
            counts = np.concatenate([np.bincount(chunk.ids, minlength=len(chunk.words)), np.zeros(len(sample), np.int64)])
            rows = [pa.repeat(lang, len(counts)), pa.concat_arrays([chunk.words, sample]).cast(pa.binary()), pa.array(counts), pa.array(counts == 0)]
            yield pa.RecordBatch.from_arrays(rows, ["lang", "suffix", "n", "sampled"])

    return run


def _cell(lang: str, bits: int):
    prefix = zlib.crc32(lang.encode() + b"\0")
    return lambda word: zlib.crc32(word, prefix) & (bits - 1)


def truncated(chunk: Chunk, frequent: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's distinct suffixes in ascending order: one start, words and count of each.

    frequent: whether each word of the dictionary is.  A suffix ends before the first one
    that isn't, with its piece, or after ``most`` words.
    """
    n = chunk.n
    rank = np.zeros(len(frequent), dtype=np.int64)
    order = pc.sort_indices(chunk.words).to_numpy()
    order = order[frequent[order]]
    rank[order] = np.arange(1, len(order) + 1)
    ids = rank[chunk.ids]
    stop = np.where(ids == 0, np.arange(n), n)
    stop = np.minimum.accumulate(stop[::-1])[::-1] if n else stop
    sizes = np.minimum(np.minimum(chunk.stop, stop) - np.arange(n), most)
    starts = np.flatnonzero(sizes > 0)
    sizes = sizes[starts]
    bits = max(1, int(len(order)).bit_length())
    each = 62 // bits
    padded = np.concatenate([ids, np.zeros(most, np.int64)])
    keys = []
    for k in range(most):
        value = np.where(sizes > k, padded[starts + k], 0)
        if k % each:
            keys[-1] = (keys[-1] << bits) | value
        else:
            keys.append(value)
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.any([key[order][1:] != key[order][:-1] for key in keys], axis=0)
    first = np.flatnonzero(new)
    return starts[order[first]], sizes[order[first]], np.diff(np.append(first, len(order)))


def _dealt(most: int, filter_: np.ndarray, bits: int, borders: list[tuple[bytes, bytes]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of the suffixes of chunks with their counts, and the range they lie in."""
        for lang, chunk in _chunks(batches):
            cell = _cell(lang, bits)
            cells = np.fromiter((cell(w) for w in chunk.words.to_pylist()), np.int64, len(chunk.words))
            starts, sizes, counts = truncated(chunk, (filter_[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool), most)
            if not len(starts):
                continue
            begin, end = chunk.suffixes(starts, sizes)
            name, every = lang.encode(), range(len(starts))
            low, high = bisect_left(borders, (name,)), bisect_left(borders, (name + b"\0",))
            places = [bisect_left(every, border, key=lambda i: chunk.bytes_of(begin[i], end[i])) for _, border in borders[low:high]]
            edges = [0, *places, len(starts)]
            rows = []
            for part, (first, last) in enumerate(zip(edges, edges[1:]), low):
                for i in range(first, last, BLOCK):
                    at = slice(i, min(last, i + BLOCK))
                    rows.append((part, packed(gathered(chunk.joined, begin[at], end[at]), counts[at])))
            parts, blocks = pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([parts, pa.repeat(lang, len(rows)), blocks], ["part", "lang", "block"])

    return run


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffixes of blocks, some thousands in a batch."""

    def batch() -> pa.RecordBatch:
        langs = pa.concat_arrays([pa.repeat(lang, len(n)) for lang, _, n in held])
        return pa.RecordBatch.from_arrays([langs, pa.concat_arrays([x for _, x, _ in held]), pa.array(np.concatenate([n for _, _, n in held]))], ["lang", "suffix", "n"])

    held, rows = [], 0
    for got in batches:
        for lang, block in zip(got.column("lang").to_pylist(), got.column("block").to_pylist()):
            held.append((lang, *unpacked(block)))
            rows += len(held[-1][2])
            if rows >= BLOCK:
                yield batch()
                held, rows = [], 0
    if held:
        yield batch()


def shared_words(data: np.ndarray, offsets: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each suffix, and how many of its first words are also those of the one before it.

    same: whether the one before it has the same language.
    """
    starts, stops = offsets[:-1], offsets[1:]
    sizes = stops - starts
    shorter = np.minimum(sizes, np.concatenate([[0], sizes[:-1]]))
    common = np.zeros(len(sizes), dtype=np.int64)
    going, k = np.flatnonzero(same), 0
    while len(going) and k < LONG:
        going = going[shorter[going] > k]
        going = going[data[starts[going] + k] == data[starts[going - 1] + k]]
        k += 1
        common[going] = k
    for i in going:
        a, b = (data[starts[j] + k : starts[j] + shorter[i]] for j in (i, i - 1))
        differ = np.flatnonzero(a != b)
        common[i] = k + (differ[0] if len(differ) else len(a))
    marks = np.concatenate([[0], np.cumsum(data == 0)])
    shared = marks[starts + common] - marks[starts]
    # the word that ends there is shared, too, if it ends in both
    ends = lambda at, stop: (at == stop) | (data[np.minimum(at, len(data) - 1)] == 0)
    before = np.maximum(np.arange(len(sizes)) - 1, 0)
    whole = same & (common > 0) & ends(starts + common, stops) & ends(starts[before] + common, stops[before])
    return marks[stops] - marks[starts] + 1, shared + whole


def _stacked(most: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of all prefixes of sorted suffixes; those open at the first or the last row have any count.

        The stack holds for each length the count of the open prefix, those of the last
        suffix; it goes from batch to batch.
        """
        last: tuple[str, bytes] | None = None
        stack: list[tuple[int, bool]] = []  # count, and whether the prefix was open at the first row

        def closed(found: list[tuple[str, bytes, int, int]]) -> pa.RecordBatch:
            rows = [[x[0] for x in found], [_plain(x[1], x[2]) for x in found], [x[3] for x in found]]
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int64())], ["lang", "phrase", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            langs, suffixes, n = batch.column("lang").cast(pa.string()), batch.column("suffix").cast(pa.binary()), batch.column("n").to_numpy()
            carried = last is not None
            if carried:
                langs = pa.concat_arrays([pa.array([last[0]]), langs])
                suffixes = pa.concat_arrays([pa.array([last[1]], pa.binary()), suffixes])
                n = np.concatenate([[0], n])
            offsets = np.frombuffer(suffixes.buffers()[1], np.int32)[suffixes.offset : suffixes.offset + len(suffixes) + 1].astype(np.int64)
            data = np.frombuffer(suffixes.buffers()[2], np.uint8)
            names = langs.dictionary_encode().indices.to_numpy()
            same = np.concatenate([[False], names[1:] == names[:-1]])
            words, shared = shared_words(data, offsets, same)
            found, now = [], []
            for k in range(1, most + 1):
                rows = np.flatnonzero(words >= k)
                if not len(rows):
                    continue
                weights = n[rows]
                if carried and rows[0] == 0:
                    weights = np.concatenate([[stack[k - 1][0]], weights[1:]])
                starts = np.flatnonzero(shared[rows] < k)
                sums = np.add.reduceat(weights, starts)
                edge = rows[0] == 0 and (stack[k - 1][1] if carried else True)
                is_open = rows[-1] == len(words) - 1
                if is_open:
                    now.append((int(sums[-1]), bool(edge and len(sums) == 1)))
                out = sums >= least
                out[0] |= edge
                if is_open:
                    out[-1] = False
                for i in np.flatnonzero(out):
                    row = rows[starts[i]]
                    found.append((langs[row].as_py(), data[offsets[row] : offsets[row + 1]].tobytes(), k, int(sums[i])))
            last, stack = (langs[-1].as_py(), suffixes[-1].as_py()), now
            if found:
                yield closed(found)
        if last is not None:
            yield closed([(*last, k + 1, count) for k, (count, _) in enumerate(stack)])

    return run


def phrase_counts(docs: DataFrame, most: int = 5, least: int = 100, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """Counts of all phrases of 1 to ``most`` words with ``least`` or more occurrences, and each language's words.

    Returns (lang, phrase, n) and (lang, words), both from written tables.  See
    ``collocations`` for what counts.  filter_bits: a power of two.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).where("text is not null")
    rows = in_small_batches(rows)
    schema = "lang string, suffix binary, n long"
    counted = rows.mapInArrow(trimmed(_counted(most)), schema + ", sampled boolean")
    counted = cut(counted.groupBy("lang", "suffix", "sampled").agg(F.sum("n").alias("n")), "words")
    words = cut(counted.where("not sampled").groupBy("lang").agg(F.sum("n").alias("words")), "languages")

    cells = counted.where(f"not sampled and n >= {least}").selectExpr(f"crc32(cast(lang as binary) || X'00' || suffix) & {filter_bits - 1} as cell")
    cells = cells.selectExpr("cell div 8 as byte", "shiftleft(1, cast(cell % 8 as int)) as bit")
    # at most a row for each byte of the filter
    cells = cells.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toPandas()
    filter_ = np.zeros(filter_bits // 8, dtype=np.uint8)
    filter_[cells["byte"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.uint8)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a bounded sample: only where the ranges' borders lie depends on it
    sample = counted.where("sampled").select("lang", "suffix").orderBy(F.xxhash64("lang", "suffix"), "lang", "suffix").limit(100 * parts).collect()
    sample = sorted((r["lang"].encode(), bytes(r["suffix"])) for r in sample)
    borders = sorted({sample[i * len(sample) // parts] for i in range(1, parts)}) if sample else []
    forget(counted)

    shipped = spark.sparkContext.broadcast((filter_, borders))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _dealt(most, shipped.value[0], filter_bits, shipped.value[1])(batches)

    dealt = rows.mapInArrow(trimmed(deal), "part int, lang string, block binary").repartitionById(len(borders) + 1, "part")
    dealt = dealt.mapInArrow(_opened, schema).sortWithinPartitions(F.col("lang").desc(), F.col("suffix").desc())
    found = dealt.mapInArrow(trimmed(_stacked(most, least)), "lang string, phrase string, n long")
    found = found.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return cut(found, "phrases"), words


def collocations(docs: DataFrame, most: int = 5, least: int = 100, percent: int = 100, top: int = 2000, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Each language's phrases of 2 to ``most`` words whose parts meet more often than chance would have them.

    docs needs text and lang; other columns are ignored.  A-Z are lower-cased, texts are
    split at ``.,;:!?`` and line ends into pieces, those at spaces and tabs into words.  A
    null lang counts as ``und``; a null or empty text has no words.  Repeated rows count
    each time.  A very long text is worked on in parts that end where pieces end.

    A candidate has a >= ``least`` occurrences inside pieces.  Each cut into two parts,
    with l and r occurrences, gives floor(1000 * a * n / (l * r)), n being the language's
    words; the least of them is the score, of ties that of the smallest first part.  A
    candidate inside a longer one that has ``percent`` of its occurrences or more is dropped.

    Returns the first ``top`` of each language by score and a, both descending, then phrase
    ascending in the order of bytes: lang, rank, phrase, a, l, r, n, score.  An empty table
    gives an empty result.
    """
    counts, words = phrase_counts(docs, most, least, filter_bits)
    parts = counts.withColumn("w", F.split("phrase", " ")).withColumn("k", F.size("w"))
    candidates = parts.where("k > 1")
    join = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("n").alias("a"), "cut", join(F.lit(1), F.col("cut")).alias("left"), join(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    of = lambda part, count: counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(count))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    # at most some hundred languages: a row each
    cuts = cuts.join(words.withColumnRenamed("words", "n"), "lang")
    cuts = cuts.withColumn("score", F.expr("cast((cast(1000 * a as decimal(18,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(18,0))) as long)"))
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("s"))
    # what a phrase two words longer absorbs, the one between absorbs: it has as many occurrences or more
    longer = candidates.where("k > 2").select("lang", "n", F.explode(F.array(join(F.lit(1), F.col("k") - 1), join(F.lit(2), F.col("k") - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(f"most is null or 100 * most < {percent} * a")
    order = Window.partitionBy("lang").orderBy(F.col("s.score").desc(), F.col("a").desc(), "phrase")
    kept = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return kept.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "s.l", "s.r", "n", "s.score")

"""Media columns: texts kept as WAV files in a column, and spectral fingerprints of what is stored.

A text's UTF-8 bytes are the samples of a mono file of 8 bits.  Its fingerprint comes from
a short-time Fourier transform: the strongest local peaks of each frame, paired with the
next peaks after them, each pair coded by its two bins and the frames between them and
stored with its time, as one array.

The transform's table holds whole numbers.  Every sum stays below 2^53, so products of
matrices in double precision are exact, and equal texts have equal peaks in any batch, on
any machine.
"""
from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_small_batches, trimmed

PAD = 255  # no byte of UTF-8
UNIT = 576  # a payload's length is a positive multiple of this
RATE = 8000
HOP = 144
FRAME = 2 * HOP
BINS = FRAME // 2 + 1
SCALE = 512  # of the table's entries
FLOOR = float(1 << 29)  # of a peak's power; above what rounding the table can add
PEAKS = 3  # of a frame
FAN = 3  # later peaks that a peak is paired with
REACH = 32  # frames between the two peaks of a pair, at most
AT_ONCE = 2048  # frames transformed together


def _table() -> np.ndarray:
    at = np.arange(FRAME)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * at / FRAME)
    turn = 2 * np.pi * np.outer(at, np.arange(BINS)) / FRAME
    return np.rint(SCALE * hann[:, None] * np.concatenate([np.cos(turn), np.sin(turn)], axis=1))


def padded(data: bytes) -> bytes:
    """Bytes filled up with PAD to a positive multiple of UNIT."""
    return data + bytes([PAD]) * (-len(data) % UNIT or (0 if data else UNIT))


def written(payload: bytes) -> bytes:
    """A WAV file with the payload as its samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(RATE)
        file.writeframes(payload)
    return out.getvalue()


def read(media: bytes) -> bytes:
    """The samples of a WAV file."""
    with wave.open(io.BytesIO(media), "rb") as file:
        return file.readframes(file.getnframes())


def powers(samples: np.ndarray, first: int, last: int, table: np.ndarray) -> np.ndarray:
    """Power of each bin in the frames first .. last - 1; frame i begins at sample i * HOP."""
    frames = np.lib.stride_tricks.sliding_window_view(samples[first * HOP : (last + 1) * HOP], FRAME)[::HOP]
    both = (frames.astype(np.float64) - 128.0) @ table
    return both[:, :BINS] ** 2 + both[:, BINS:] ** 2


def peaks(samples: np.ndarray, edges: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame and bin of every spectral peak in a batch of payloads laid end to end.

    edges holds the place of each payload's first hop, and of the end.  A peak is above
    its two lower and not below its two upper bins, above the frame before and not below
    the one after; the strongest PEAKS of a frame count, of equals the lower bins.  Frames
    that reach over two payloads are none.
    """
    total = len(samples) // HOP - 1
    real = np.ones(max(total, 0) + 1, dtype=bool)
    real[edges[1:] - 1] = False
    at, bins = [], []
    for start in range(0, total, AT_ONCE):
        stop = min(total, start + AT_ONCE)
        low, high = max(0, start - 1), min(total, stop + 1)
        power = powers(samples, low, high, table)
        power[~real[low:high]] = 0
        around = np.zeros((stop - start + 2, BINS + 4))
        around[low - start + 1 : high - start + 1, 2:-2] = power
        mid = around[1:-1, 2:-2]
        good = (mid > FLOOR) & (mid > around[:-2, 2:-2]) & (mid >= around[2:, 2:-2])
        for shift in (1, 2):
            good &= (mid > around[1:-1, 2 - shift : BINS + 2 - shift]) & (mid >= around[1:-1, 2 + shift : BINS + 2 + shift])
        left = np.where(good, mid, 0.0)
        for _ in range(PEAKS):
            best = left.argmax(axis=1)
            rows = np.flatnonzero(left[np.arange(len(left)), best] > 0)
            at.append(rows + start)
            bins.append(best[rows])
            left[rows, best[rows]] = 0
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, bins = np.concatenate(at), np.concatenate(bins)
    order = np.lexsort((bins, at))
    return at[order], bins[order]


def landmarks(payloads: list[bytes], table: np.ndarray) -> list[np.ndarray]:
    """The time-coded pairs of each payload: frame << 32 | bin << 16 | later bin << 8 | frames between, in order."""
    hops = np.array([len(p) // HOP for p in payloads], dtype=np.int64)
    edges = np.concatenate([[0], np.cumsum(hops)])
    at, bins = peaks(np.frombuffer(b"".join(payloads), np.uint8), edges, table)
    of = np.searchsorted(edges, at, side="right") - 1
    later = np.searchsorted(at, at, side="right")
    codes, owner = [], []
    for k in range(FAN):
        to = later + k
        have = np.flatnonzero(to < len(at))
        to = to[have]
        have, to = (x[(of[to] == of[have]) & (at[to] - at[have] <= REACH)] for x in (have, to))
        codes.append(((at[have] - edges[of[have]]) << 32) | (bins[have] << 16) | (bins[to] << 8) | (at[to] - at[have]))
        owner.append(of[have])
    codes, owner = np.concatenate(codes), np.concatenate(owner)
    order = np.lexsort((codes, owner))
    return np.split(codes[order], np.searchsorted(owner[order], np.arange(1, len(payloads))))


def _groups(texts: list[bytes | None], most: int) -> Iterator[tuple[int, int]]:
    start, total = 0, 0
    for i, text in enumerate(texts):
        total += UNIT + len(text or b"")
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def store(docs: DataFrame, keep: bool = True, most: int = 1 << 20) -> DataFrame:
    """Store every whole text as a WAV file and fingerprint what is read back from it.

    docs needs doc_id and text; other columns are ignored.  Returns for each row doc_id,
    n_bytes (of the text), payload_bytes, payload_sha256 and tail_crc32 (of the last 32
    bytes) of the samples as read back, media_bytes and media_sha256 of the file, feature
    (the number of landmarks and a digest of them) and, with keep, media (the file) and
    landmarks (array<long>, see ``landmarks``).

    A null text counts as empty: one unit of padding.  A row with a null doc_id is kept.
    Repeated rows are stored one by one, with equal values.  A very long text is
    transformed in parts of AT_ONCE frames, so memory beyond the text and its file is
    bounded.  Of equally strong peaks the lower bins count.  An empty table gives an
    empty result.  most: bytes of the texts handled together.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    if keep:
        schema += ", media binary, landmarks array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for start, stop in _groups(texts, most):
                some = [text or b"" for text in texts[start:stop]]
                files = [written(padded(text)) for text in some]
                payloads = [read(file) for file in files]
                marks = landmarks(payloads, table)
                columns = [
                    ids.slice(start, stop - start),
                    pa.array([len(t) for t in some], pa.int64()),
                    pa.array([len(p) for p in payloads], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                    pa.array([zlib.crc32(p[-32:]) for p in payloads], pa.int64()),
                    pa.array([len(f) for f in files], pa.int64()),
                    pa.array([hashlib.sha256(f).hexdigest() for f in files]),
                    pa.array([f"{len(m)}:{hashlib.sha256(m.astype('<i8').tobytes()).hexdigest()}" for m in marks]),
                ]
                if keep:
                    columns += [pa.array(files, pa.binary()), pa.array(marks, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [part.split()[0] for part in schema.split(", ")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return in_small_batches(rows).mapInArrow(trimmed(run), schema)


def texts(stored: DataFrame) -> DataFrame:
    """The texts (doc_id, text) that ``store`` keeps in its files; a null text comes back as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            back = [read(file).rstrip(bytes([PAD])).decode("utf-8", "replace") for file in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.string())], ["doc_id", "text"])

    return in_small_batches(stored.select("doc_id", "media")).mapInArrow(trimmed(run), "doc_id long, text string")

"""Byte-level BPE by dynamic programming over prefixes.

The BPE encoding of a byte string is the one token sequence in which every two
neighbours could stand side by side: no merge across their border would have
come before the merges that made them.  So each prefix of a string has exactly
one last token, and the table of last tokens holds the encodings of all prefixes
at once.  Appending bytes extends the table; an edit recomputes it from the
edited place until it agrees with what was there before.
"""
from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from .kernel import slices
from .shared import in_small_batches, trimmed

NEVER = 1 << 62
CACHED_PIECES = 300_000
CACHED_PAIRS = 400_000

#: A space with other white space, or an end of the text, beside it.
_UNEVEN = re.compile(r"\s | \s|^ | $")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks from the lines ``base64 rank`` of a tiktoken file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class Vocabulary:
    """Ranks, what stands at either end of each token while it is being made, and which neighbours are valid."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: token for token, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._ends: dict[bytes, tuple | None] = {}
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            if self.ends(token):
                self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()

    def ends(self, token: bytes) -> tuple | None:
        """The first and the last part of the token over its merges, each with the rank that makes the next one.

        None if the token's bytes don't merge into it.
        """
        if token in self._ends:
            return self._ends[token]
        parts = [token[i : i + 1] for i in range(len(token))]
        firsts, lasts = [], []
        while len(parts) > 1:
            at, rank = -1, NEVER
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], NEVER)
                if r < rank:
                    at, rank = i, r
            if at < 0:
                break
            if at == 0:
                firsts.append((parts[0], rank))
            if at == len(parts) - 2:
                lasts.append((parts[-1], rank))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        found = None
        if len(parts) == 1:
            found = (*firsts, (token, NEVER)), (*lasts, (token, NEVER))
        self._ends[token] = found
        return found

    def valid(self, left: int, right: int) -> bool:
        """Whether the merges that make both tokens come before any merge across their border."""
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        found = self.pairs[left << 32 | right] = self._settles(self.bytes_of[left], self.bytes_of[right])
        return found

    def _settles(self, left: bytes, right: bytes) -> bool:
        a, b = self.ends(left)[1], self.ends(right)[0]
        i = j = 0
        while True:
            (x, x_next), (y, y_next) = a[i], b[j]
            across = self.ranks.get(x + y, NEVER)
            # of equal ranks the leftmost pair merges first
            if across < x_next and across <= y_next and across < NEVER:
                return False
            if x_next == NEVER and y_next == NEVER:
                return True
            if x_next <= y_next:
                i += 1
            else:
                j += 1


class PrefixTable:
    """For every prefix of ``data`` the id and the length of its last token."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[tuple[int, int]] = [(-1, 0)]
        self.append(data)

    def _extend(self, end: int) -> None:
        """Fill the table up to a prefix of ``end`` bytes."""
        last, vocabulary = self.last, self.vocabulary
        known, done = vocabulary.pairs.get, len(last) - 1
        start = max(0, done - vocabulary.longest)
        shift = start + 1
        # all tokens that end at a place, the longest first
        for at, token in vocabulary.automaton.iter(self.data[start:end].decode("latin-1")):
            i = at + shift
            if i <= done:
                continue
            j = i - token[1]
            if j:
                if j < 0:
                    continue
                left = last[j][0]
                fits = known(left << 32 | token[0])
                if fits is None:
                    fits = vocabulary.valid(left, token[0])
                if not fits:
                    continue
            last.append(token)
            done = i
        if done < end:
            raise ValueError(f"no token ends at byte {done + 1}")

    def append(self, more: bytes) -> None:
        """Add bytes at the end; what is there stays."""
        self.data += more
        self._extend(len(self.data))

    def replace(self, start: int, end: int, more: bytes) -> int:
        """Put ``more`` in the place of data[start:end]; returns the number of entries computed anew."""
        old, shift = self.last, len(more) - (end - start)
        self.data = self.data[:start] + more + self.data[end:]
        self.last = old[: start + 1]
        self._extend(start + len(more))
        size, same = len(self.data), 0
        # an entry depends on no more than the bytes and entries of one longest token before it
        while len(self.last) <= size and same <= self.vocabulary.longest:
            i = len(self.last)
            self._extend(i)
            same = same + 1 if self.last[i] == old[i - shift] else 0
        done = len(self.last)
        self.last += old[done - shift :]
        return done - start - 1

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the prefix of ``end`` bytes, or of all."""
        i = len(self.data) if end is None else end
        last, found = self.last, []
        while i:
            token, size = last[i]
            found.append(token)
            i -= size
        return found[::-1]


def _shared_prefixes(ordered: list[bytes]) -> list[int]:
    """The length of the prefix that each entry shares with the one before, as far as 64 bytes go."""
    if not ordered:
        return []
    wide = np.array(ordered, dtype="S64").view(np.uint8).reshape(len(ordered), 64)
    differ = np.ones((len(ordered), 65), dtype=bool)
    differ[1:, :64] = (wide[1:] != wide[:-1]) | (wide[1:] == 0)
    differ[0, 0] = True
    return differ.argmax(axis=1).tolist()


class Encoder:
    """Encodes and decodes texts; a text is split by ``pattern`` and each match encoded by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.pattern = regex.compile(pattern)
        self._four = {i: i.to_bytes(4, "little") for i in ranks.values()}
        self._known: dict[str, bytes] = {}

    def pieces(self, wanted: set[bytes]) -> dict[bytes, list[int]]:
        """Ids of each match.  A match that is a token as a whole is that token.

        The others are taken in order, so each starts from the table of the prefix it
        shares with the one before.
        """
        ranks = self.vocabulary.ranks
        found = {data: [ranks[data]] for data in wanted if data in ranks}
        table = PrefixTable(self.vocabulary)
        rest = sorted(wanted - found.keys())
        for data, shared in zip(rest, _shared_prefixes(rest)):
            table.data = data
            del table.last[shared + 1 :]
            table._extend(len(data))
            found[data] = table.ids()
        return found

    def _matches(self, chunk: str) -> list[bytes]:
        """UTF-8 of the pattern's matches in a chunk."""
        return [m.encode("utf-8", "replace") for m in self.pattern.findall(chunk)]

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Packed ids of each chunk."""
        matches = {chunk: self._matches(chunk) for chunk in chunks}
        ids = self.pieces({m for ms in matches.values() for m in ms})
        four = self._four
        return {chunk: b"".join([four[i] for m in ms for i in ids[m]]) for chunk, ms in matches.items()}

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        Where a single space has no white space beside it, a match always begins at
        it.  The chunks between such places are encoded apart and remembered, up to a
        bound besides those of the call.
        """
        split = [_BETWEEN.split(t) if _UNEVEN.search(t) else t.split(" ") for t in texts]
        lead = {chunks[0] for chunks in split}
        rest = set().union(*(chunks[1:] for chunks in split))
        if len(self._known) > CACHED_PIECES:
            self._known = {c: self._known[c] for c in rest if c in self._known}
        new = self._learn({" " + c for c in rest if c not in self._known})
        self._known.update((c[1:], ids) for c, ids in new.items())
        first, known = self._learn(lead), self._known
        return [first[chunks[0]] + b"".join(map(known.__getitem__, chunks[1:])) for chunks in split]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed([text])[0], dtype="<u4").tolist()

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


_ENCODERS: dict[bytes, Encoder] = {}


def encoder(raw: bytes, pattern: str) -> Encoder:
    """The worker's encoder for a rank file's bytes; made once in each process."""
    key = hashlib.blake2b(raw + pattern.encode()).digest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(read_ranks(raw), pattern)
    return _ENCODERS[key]


def encode(docs: DataFrame, raw: bytes, pattern: str, keep_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode its ids again.

    docs needs doc_id and text; other columns are ignored.  raw holds the bytes of a
    tiktoken rank file, read once by the caller.  Returns for each row doc_id,
    n_tokens, ids_sha256 (over the ids as little-endian unsigned 32-bit integers),
    decoded_sha256 (over the decoded bytes) and, with keep_ids, ids (array<long>).
    A null text counts as empty: no tokens.  Repeated rows are encoded one by one.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(raw)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>" if keep_ids else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = encoder(shipped.value, pattern)
        for batch in batches:
            for part in slices(batch["text"]):
                some = batch.iloc[part]
                packed = tool.packed(["" if text is None else text for text in some["text"]])
                ids = [np.frombuffer(p, dtype="<u4") for p in packed]
                rows = {
                    "doc_id": some["doc_id"].astype("Int64").array,
                    "n_tokens": [len(i) for i in ids],
                    "ids_sha256": [hashlib.sha256(p).hexdigest() for p in packed],
                    "decoded_sha256": [hashlib.sha256(tool.decode_bytes(i.tolist())).hexdigest() for i in ids],
                }
                if keep_ids:
                    rows["ids"] = [i.astype(np.int64) for i in ids]
                yield pd.DataFrame(rows)

    return in_small_batches(docs.select("doc_id", "text")).mapInPandas(trimmed(run), schema)

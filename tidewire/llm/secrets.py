"""Secrets in texts and in what is encoded inside them.

A worklist holds layers of text.  Each layer is scanned, then unwrapped: URL
escapes and Unicode escapes are replaced in place, base64 runs are decoded from each
of four places, also across line ends, and the compressed streams in them inflated.
Bytes that are no UTF-8 are replaced, and NUL bytes are also read as UTF-16.  What
comes out is a new layer.
A layer seen before is not taken again, so the list ends.  Each layer knows where
its characters came from, and every finding is told as a span of the first text.
"""
from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame

from .kernel import slices
from .shared import in_small_batches, trimmed

KINDS = ("assign", "access", "hex")
#: Bytes of an inflated stream that are held and scanned at once; a longer one makes several layers.
MOST_INFLATED = 64 << 20
#: Bytes of the end of such a layer that the next one begins with, at least: more where a run of signs
#: of which encoded text and secrets are made goes on over its end.
OVERLAP = 1 << 20
_ENCODED = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-%\\&#;{}\r\n\0")
_BREAKS = bytes(b in _ENCODED for b in range(256))
#: Streams inside streams that are inflated piece by piece; what the last of them holds is then gathered.
NESTED = 100

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
# a sign escaped many times becomes one escaped once, so that many layers of it cost one
_PERCENT = re.compile(r"%(?:25){2,}(?=25)|(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};)+")
_ONE_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\[uUx]([0-9A-Fa-f]+)|&#[xX]([0-9A-Fa-f]+);|&#([0-9]+);")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]{16,})*(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)?={0,2}")
_LINE_END = re.compile(r"[\x20\t]*\r?\n[\x20\t]*")
_STREAM = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Findings in one layer, by start, then kind.

    A pattern's matches of one kind don't overlap, and one that is too short still
    uses up its characters.
    """
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


class Layer:
    """A text and the spans of the layer above that its characters stand for."""

    def __init__(self, text: str, above: "Layer | None" = None, whole: tuple[int, int] | None = None):
        self.text = text
        self.above = above
        self.whole = whole  # the one span above that all of it stands for
        self.pieces: list[tuple[int, int, int, int]] = []  # own start, own end, start above, end above

    def lift(self, start: int, end: int) -> tuple[int, int]:
        """The span of the first text that a span of this layer stands for."""
        layer = self
        while layer.above is not None:
            start, end = layer.whole or (layer._above(start, 0), layer._above(end, 1))
            layer = layer.above
        return start, end

    def _above(self, place: int, is_end: int) -> int:
        """Where a border of a span falls above; a border inside a replaced piece moves to its outer side."""
        at = bisect_right(self.pieces, (place - is_end, 1 << 60)) - 1
        if at < 0:
            return place
        own_start, own_end, start, end = self.pieces[at]
        if place - is_end >= own_end:
            return end + place - own_end
        return end if is_end else start


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match that decodes put in place; None if there is none."""
    out, size, at, pieces = [], 0, 0, []
    for m in pattern.finditer(layer.text):
        plain = decode(m[0])
        if plain is None:
            continue
        out.append(layer.text[at : m.start()])
        size += m.start() - at
        pieces.append((size, size + len(plain), m.start(), m.end()))
        out.append(plain)
        size += len(plain)
        at = m.end()
    if not pieces:
        return None
    out.append(layer.text[at:])
    new = Layer("".join(out), layer)
    new.pieces = pieces
    return new


def _percent(run: str) -> str | None:
    if run.startswith("%2525"):
        return "%25"
    return binascii.unhexlify(run.replace("%", "")).decode("utf-8", "replace")


def _escapes(run: str) -> str | None:
    codes = []
    for m in _ONE_ESCAPE.finditer(run):
        code = int(m[4]) if m[4] else int(m[1] or m[2] or m[3], 16)
        if code > 0x10FFFF:
            return None
        codes.append(code)
    plain = "".join(map(chr, codes))
    try:
        return plain.encode("utf-16-le", "surrogatepass").decode("utf-16-le")
    except UnicodeDecodeError:
        return None


def _tool(data: bytes):
    """What inflates the gzip, zlib, bzip2 or xz stream that data begins with; None if it is none of these."""
    if data[:2] == b"\x1f\x8b" or (data[:1] == b"\x78" and len(data) > 2 and (data[0] << 8 | data[1]) % 31 == 0):
        return zlib.decompressobj(47)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _inflated(packed: Iterator[bytes]) -> Iterator[bytes]:
    """What a stream and all members that follow it inflate to, in pieces of 1 MiB at most, as far as it is whole."""
    data, tool = b"", None
    for more in packed:
        data += more
        while data or tool is not None:
            if tool is None:
                data = data.lstrip(b"\0")  # padding between members
                tool = _tool(data)
                if tool is None:
                    return
            try:
                plain = tool.decompress(data, OVERLAP)
            except (zlib.error, OSError, EOFError, lzma.LZMAError):
                return
            if plain:
                yield plain
            if tool.eof:
                data, tool = tool.unused_data, None
                if not data:
                    break
            elif isinstance(tool, (bz2.BZ2Decompressor, lzma.LZMADecompressor)):
                data = b""
                if tool.needs_input:
                    break
            else:
                data = tool.unconsumed_tail
                if not data and not plain:
                    break


def _noted(lead: bytes, rest: Iterator[bytes], taken: list[bytes]) -> Iterator[bytes]:
    """lead and rest; taken gets the pieces of rest as long as it is not emptied."""
    yield lead
    for piece in rest:
        if taken:
            taken.append(piece)
        yield piece


def _unwrapped(data: bytes) -> Iterator[bytes]:
    """What the stream at the start of data holds, in pieces; streams inside a stream are unwrapped, too.

    What a stream holds that fits in one piece is unwrapped from memory, so only long
    streams nest, and only NESTED of them before one is gathered.  Contents met before, as in a
    stream that holds itself, end it.
    """
    pieces, nested = iter([data]), 0
    seen: set[bytes] = set()
    while True:
        lead = next(pieces, None)
        if lead is None:
            return
        if _tool(lead) is None:
            yield lead
            break
        taken = [lead]
        inner = _inflated(_noted(lead, pieces, taken))
        plain = next(inner, None)
        if plain is None:  # only looks like a stream, as text that begins with "x " does
            yield from taken
            break
        taken[:] = []
        after = next(inner, None)
        if after is not None and nested == NESTED:
            plain, after, nested = b"".join(chain([plain, after], inner)), None, 0
        if after is not None:
            pieces, nested = chain([plain, after], inner), nested + 1
            continue
        mark = hashlib.blake2b(plain).digest()
        if mark in seen:
            return
        seen.add(mark)
        pieces, nested = iter([plain]), 0
    yield from pieces


def _views(data: bytes) -> Iterator[str]:
    """The bytes as text; those with NUL bytes as UTF-16, too."""
    yield data.decode("utf-8", "replace")
    if b"\0" in data:
        yield data.decode("utf-16-le", "replace")
        yield data.decode("utf-16-be", "replace")
        yield data.replace(b"\0", b"").decode("utf-8", "replace")


def _carried(held: bytearray) -> int:
    """From where on a part is scanned again with the next: OVERLAP from the end, or earlier, where the run of
    encoded signs begins that holds that place, so that no run is cut, however long."""
    at = max(len(held) - min(OVERLAP, MOST_INFLATED // 2), 0)
    return held[:at].translate(_BREAKS).rfind(b"\0") + 1


def _texts(data: bytes) -> Iterator[str]:
    """The bytes and every compressed stream in them as texts, long streams in parts that overlap."""
    yield from _views(data)
    at = 0
    while m := _STREAM.search(data, at):
        held, fresh, full = bytearray(), 0, MOST_INFLATED
        for piece in _unwrapped(data[m.start() :]):
            held += piece
            fresh += len(piece)
            if len(held) >= full:
                yield from _views(bytes(held))
                del held[: _carried(held)]
                # (a run that fills a part is scanned again only when it has doubled)
                fresh, full = 0, max(MOST_INFLATED, 2 * len(held))
        if fresh:
            yield from _views(bytes(held))
        at = m.start() + 1


def _base64_layers(layer: Layer) -> Iterator[Layer]:
    places = [(m.start(), m.end(), m[0]) for m in _BASE64.finditer(layer.text)]
    if "\n" in layer.text:
        places += [(m.start(), m.end(), _LINE_END.sub("", m[0])) for m in _WRAPPED.finditer(layer.text) if "\n" in m[0]]
    for start, end, run in places:
        run = run.rstrip("=").replace("-", "+").replace("_", "/")
        # a run may be glued to the word before it, so it is read from each place of a group of four
        for skip in range(4):
            some = run[skip:]
            some = some[: len(some) - (len(some) % 4 == 1)]
            for text in _texts(base64.b64decode(some + "=" * (-len(some) % 4))):
                if text:
                    yield Layer(text, layer, (start, end))


def all_spans(text: str) -> list[Span]:
    """Findings in a text and in all its layers, as spans of the text, by start, then kind."""
    found: set[Span] = set()
    seen: set[bytes] = set()
    work: list[Layer | Iterator[Layer]] = [Layer(text)]
    while work:
        layer = work.pop()
        if not isinstance(layer, Layer):  # layers still to be made, one at a time
            more = next(layer, None)
            work += [layer, more] if more else []
            continue
        # the same text at another place is another layer: its findings are other spans
        mark = hashlib.blake2b(repr(layer.lift(0, len(layer.text))).encode() + layer.text.encode("utf-8", "surrogatepass")).digest()
        if mark in seen:
            continue
        seen.add(mark)
        found.update((kind, *layer.lift(start, end)) for kind, start, end in base_spans(layer.text))
        if "%" in layer.text:
            work += filter(None, [_replaced(layer, _PERCENT, _percent)])
        if "\\" in layer.text or "&#" in layer.text:
            work += filter(None, [_replaced(layer, _ESCAPE, _escapes)])
        work.append(_base64_layers(layer))
    return sorted(found, key=_order)


def told(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Find secrets in every whole text, encoded layers included.

    docs needs doc_id and text; other columns are ignored.  Returns for each row
    doc_id, base and spans: arrays of (kind, start, end) in code points, end
    exclusive.  base holds what the patterns find in the text itself; spans adds
    what they find in its layers.  A null text counts as empty; repeated rows are
    scanned one by one.  A text is held and scanned whole, whatever its length, and an
    empty table gives an empty result.  Layers are unwrapped until nothing new comes out;
    streams are scanned to their end in parts of MOST_INFLATED bytes that overlap.
    """
    span = "array<struct<kind:string,start:long,end:long>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch["text"]):
                some = batch.iloc[part]
                texts = ["" if t is None else t for t in some["text"]]
                rows = {"doc_id": some["doc_id"].astype("Int64").array}
                for name, find in (("base", base_spans), ("spans", all_spans)):
                    rows[name] = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] for t in texts]
                yield pd.DataFrame(rows)

    return in_small_batches(docs.select("doc_id", "text")).mapInPandas(trimmed(run), f"doc_id long, base {span}, spans {span}")


def redact(docs: DataFrame) -> DataFrame:
    """The rows of docs with every finding of their texts replaced by ``[secret]``.

    All columns and rows are kept; a null text stays null.  Overlapping findings
    become one replacement.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.copy()
            batch["text"] = [t if t is None else redacted(t) for t in batch["text"]]
            yield batch

    return in_small_batches(docs).mapInPandas(trimmed(run), docs.schema)


def redacted(text: str) -> str:
    out, at = [], 0
    for start, end in _merged(all_spans(text)):
        out += [text[at:start], "[secret]"]
        at = end
    return "".join([*out, text[at:]])


def _merged(spans: list[Span]) -> list[list[int]]:
    found: list[list[int]] = []
    for _, start, end in spans:
        if found and start < found[-1][1]:
            found[-1][1] = max(found[-1][1], end)
        else:
            found.append([start, end])
    return found

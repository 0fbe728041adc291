"""Secret scans with a recursive decoding worklist.

The text is the first layer. Each layer is scanned for secrets, then searched for encoded parts: lines with URL or
Unicode escapes, and base64 runs, each line for itself and joined over line ends. The bytes of both may be compressed in
turn. Escapes of escapes, of both kinds in any order, are resolved in one pass from left to right, in time proportional to
the line: no secret can hold an escape, so what it is part of half resolved it is part of in the end.
A secret that ends a line's run may be reported with and without what the next line adds. What a part decodes to is a
new layer on the worklist, with the place in the text that each of its characters came from, so a secret found at any
depth is reported where it stands in the text. Everything in a compressed stream stands where the stream does. Layers
already seen at a place are not taken again there, which ends cycles such as streams that decompress to themselves; all
other decoding makes a layer shorter, so the worklist runs empty.

Memory is bounded by stretches, not by texts or streams: both are cut at characters that no pattern, escape or base64
run can hold, so nothing stands across a cut. Streams in streams are decompressed one into the other, never joined. Only
a run without any such character is held whole, as one byte a character.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import prepare
from .batches import doc_columns, map_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: The longest runs, as the greedy patterns take them, with their least lengths.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_VALUE = 6
KINDS = ("assign", "access", "hex")

#: A URL escape (a byte) or a Unicode escape (a character): groups hold the digits, those of the last are decimal.
_ESCAPE = re.compile(r"%([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_OPENERS = re.compile(r"[%\\&]")
#: Characters of the longest escape.
_LONGEST = 10
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")
#: Runs of any length that go on over line ends.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t\r]*+\n[ \t\r]*+[A-Za-z0-9+/_-]++)++={0,2}")
_LINE = re.compile(r"[^\n]+")
#: The same for bytes.
_BYTES = [re.compile(p.pattern.encode(), p.flags & re.IGNORECASE) for p in (ASSIGN, ACCESS, HEX)]
_ESCAPE_BYTES = re.compile(_ESCAPE.pattern.encode())
_PLAIN = str.maketrans("-_", "+/", " \t\r\n")
_LEAST = 12
#: Characters of a text or a decompressed stream that make one layer, unless no border comes in them.
PIECE = 1_000_000
#: Borders: whatever isn't in a secret, an escape, a base64 run, its line ends, or between a secret's name and value.
_BORDER = re.compile(r"""[^A-Za-z0-9+/_=.\- \t\r\n"':%\\&#;{}]""")
_INNER = bytes(b for b in range(256) if not _BORDER.match(chr(b)))
_IS_BORDER = bytes(b not in _INNER for b in range(256))
_ZSTD = b"\x28\xb5\x2f\xfd"
_MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\0|\x28\xb5\x2f\xfd")
#: Bytes that a decompressor gets at a time.
FED = 65_536
#: What decoded bytes must hold to give anything: the name of an assigned secret, an escape, or a run of characters that
#: a base64 part, an access key or a hex number may be. All patterns are ASCII, so any bytes can be read as Latin-1.
_HINT = re.compile(rb"[A-Za-z0-9+/_-]{12}|[A-Za-z0-9+/_-][ \t\r]*\n[ \t\r]*[A-Za-z0-9+/_-]|%[0-9A-Fa-f]{2}|\\[uUx]|&#|(?i:passw|secret|token|api_?key)")


def _resolved(text: str) -> tuple[str, list[int], list[int]]:
    """A text with its escapes and those that they make resolved, and where each character begins and ends in it.

    URL escapes are read as Latin-1, one character a byte, so that compressed bytes stay what they are.
    """
    out: list[str] = []
    first: list[int] = []
    last: list[int] = []
    open_at: list[int] = []
    k, n = 0, len(text)
    while k < n:
        if not open_at:  # up to the next opener nothing can change
            m = _OPENERS.search(text, k)
            stop = m.start() if m else n
            out += text[k:stop]
            first += range(k, stop)
            last += range(k + 1, stop + 1)
            k = stop
            if k == n:
                break
        out.append(text[k])
        first.append(k)
        k += 1
        last.append(k)
        while True:
            if out[-1] in "%\\&":
                open_at.append(len(out) - 1)
                break
            while open_at and len(out) - open_at[-1] > _LONGEST:
                open_at.pop()
            if not open_at or (m := _ESCAPE.fullmatch("".join(out[open_at[-1] :]))) is None:
                break
            at = open_at.pop()
            code = int(m.group(m.lastindex), 10 if m.lastindex == 7 else 16)
            if code >= 0x110000 or 0xD800 <= code < 0xE000:
                break
            out[at:], first[at + 1 :], last[at:] = [chr(code)], [], [last[-1]]
    return "".join(out), first, last


def _resolved_bytes(data: bytes) -> bytes:
    """The same for bytes. A character beyond Latin-1 is in no pattern, so any byte beyond ASCII will do."""
    text = _resolved(data.decode("latin-1"))[0]
    return text.encode("latin-1") if max(text, default="") <= "\xff" else "".join([c if c <= "\xff" else "\x80" for c in text]).encode("latin-1")


def scan(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end), leftmost and without overlap within a kind."""
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= ASSIGN_VALUE:
            yield 0, m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            yield 1, m.start(), m.end()
    for m in HEX.finditer(text):
        yield 2, m.start(), m.end()


def _decompressor(data: bytes) -> object | None:
    """A decompressor for the bytes' format, by its magic number."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:1] == b"\x78" and len(data) > 2 and (data[0] << 8 | data[1]) % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    if data[:4] == _ZSTD:
        return zstandard.ZstdDecompressor().decompressobj()
    return None


class Feed:
    """Bytes that come in pieces, with a look ahead; ``given`` counts what was taken."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.held, self.at, self.given = iter(pieces), b"", 0, 0

    def ahead(self, n: int) -> bytes:
        while len(self.held) - self.at < n and (piece := next(self.pieces, None)) is not None:
            self.held, self.at = self.held[self.at :] + piece, 0
        return self.held[self.at : self.at + n]

    def take(self, n: int) -> bytes:
        if self.at == len(self.held):
            self.ahead(1)
        part = self.held[self.at : self.at + n]
        self.at += len(part)
        self.given += len(part)
        return part

    def back(self, data: bytes) -> None:
        self.held, self.at = data + self.held[self.at :], 0
        self.given -= len(data)


def _fed(data: bytes, begin: int = 0, end: int | None = None) -> Iterator[bytes]:
    stop = len(data) if end is None else end
    return (data[k : min(k + FED, stop)] for k in range(begin, stop, FED))


class Streams:
    """Compressed streams that stand end to end: pieces of what they hold, each with its stream's number.

    Afterwards ``end`` is where the last one ends, null if it is damaged or cut off; what came before damage counts.
    """

    def __init__(self, pieces: Iterable[bytes]):
        self.feed, self.end = Feed(pieces), 0

    def _skipped(self) -> None:
        """Go over zstd's skippable frames and the zeros that may fill up between streams."""
        while head := self.feed.ahead(8):
            if len(head) == 8 and 0x50 <= head[0] <= 0x5F and head[1:4] == b"\x2a\x4d\x18":
                left = 8 + int.from_bytes(head[4:], "little")
                while left and (part := self.feed.take(min(left, FED))):
                    left -= len(part)
            elif head[:1] == b"\0":
                self.feed.take(1)
            else:
                return

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        number = 0
        while (own := _decompressor(self.feed.ahead(8))) is not None:
            try:
                for piece in self._pieces(own):
                    if piece:
                        yield number, piece
            except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError):
                self.end = None
                return
            if not own.eof:
                self.end = None
                return
            self.feed.back(own.unused_data)
            self.end = self.feed.given
            self._skipped()
            number += 1

    def _pieces(self, own: object) -> Iterator[bytes]:
        # a few bytes of zstd may make 128 KB, and its decompressor has no limit
        limited = self.feed.ahead(4) != _ZSTD
        while not own.eof and (part := self.feed.take(FED if limited else FED // 256)):
            piece = own.decompress(part, PIECE) if limited else own.decompress(part)
            while piece:
                yield piece
                if own.eof or not limited:
                    break
                piece = own.decompress(getattr(own, "unconsumed_tail", b""), PIECE)


class Layer:
    """Text with the start and end in the document of each character."""

    def __init__(self, text: str, start: np.ndarray, end: np.ndarray, via: str):
        self.text, self.start, self.end, self.via = text, start, end, via

    def span(self, a: int, b: int) -> tuple[int, int]:
        return int(self.start[a]), int(self.end[b - 1])


def _escapes(layer: Layer, line: re.Match) -> Layer | None:
    """A line of a layer with its escapes resolved."""
    if not _ESCAPE.search(layer.text, line.start(), line.end()):
        return None
    text, first, last = _resolved(line.group())
    return Layer(text, layer.start[line.start() + np.array(first)], layer.end[line.start() - 1 + np.array(last)], layer.via + "escapes/")


Found = dict[tuple[int, int, int], str]


def _decoded(run: str) -> Iterator[tuple[int, bytes]]:
    """(shift, bytes) of a base64 run without line ends.

    What stands before the coded part, a path or a word, may belong to the alphabet too. So a run is decoded from each
    of its first four characters, one of which is in step with the part.
    """
    for shift in range(4 if len(run) >= _LEAST else 0):
        n = len(run) - shift
        n -= n % 4 == 1
        yield shift, binascii.a2b_base64(run[shift : shift + n] + "=" * (-n % 4))


def _streams(data: bytes) -> Iterator[tuple[int, int]]:
    """Where compressed streams begin and end in some bytes. They may begin at any byte."""
    done = 0
    for x in _MAGIC.finditer(data):
        begin = x.start()
        if begin < done:
            continue
        streams = Streams(_fed(data, begin))
        some = False
        for _ in streams:
            some = True
        if some:
            if streams.end is not None:
                done = begin + streams.end
            yield begin, len(data) if streams.end is None else done


def _base64(layer: Layer, m: re.Match, seen: set, found: Found) -> Iterator[Layer]:
    """Layers of a run on one line or over several; what is compressed in it goes to ``found`` at once."""
    run = m.group().rstrip("=")
    at = np.arange(m.start(), m.start() + len(run))
    if "\n" in run:
        raw = np.frombuffer(run.encode(), np.uint8)
        at = at[raw > 0x20]
    via = layer.via + "base64/"
    for shift, data in _decoded(run.translate(_PLAIN)):
        if _HINT.search(data):
            j = np.arange(len(data))
            yield Layer(data.decode("latin-1"), layer.start[at[shift + j * 8 // 6]], layer.end[at[shift + (j * 8 + 7) // 6]], via)
        for begin, end in _streams(data):
            a = int(layer.start[at[shift + begin * 8 // 6]])
            b = int(layer.end[m.end() - 1 if end == len(data) else at[shift + (end * 8 - 1) // 6]])
            _unpacked(lambda data=data, begin=begin, end=end: _fed(data, begin, end), Place(a, b, seen, found), via)


def _escaped_streams(layer: Layer, seen: set, found: Found) -> None:
    """What is compressed in the bytes that a layer's escapes stood for."""
    data = "".join([c if c <= "\xff" else "?" for c in layer.text]).encode("latin-1")
    for begin, end in _streams(data) if _MAGIC.search(data) else ():
        _unpacked(lambda begin=begin, end=end: _fed(data, begin, end), Place(*layer.span(begin, end), seen, found), layer.via)


class Place:
    """A part of the document that compressed data stands at: what was seen and found there."""

    def __init__(self, a: int, b: int, seen: set, found: Found):
        self.a, self.b, self.all_seen, self.found = a, b, seen, found

    def new(self, pieces: Iterable[bytes]) -> bool:
        """Whether data was not seen here before."""
        digest = hashlib.sha256()
        for piece in pieces:
            digest.update(piece)
        key = self.a, self.b, digest.digest()
        if key in self.all_seen:
            return False
        self.all_seen.add(key)
        return True

    def scan(self, data: bytes, via: str) -> None:
        for kind, pattern in enumerate(_BYTES):
            key = self.a, kind, self.b
            if key not in self.found and any(kind or m.end(2) - m.start(2) >= ASSIGN_VALUE for m in pattern.finditer(data)):
                self.found[key] = via

    def done(self) -> bool:
        """Whether every kind was found, so that nothing below can add to it."""
        return all((self.a, kind, self.b) in self.found for kind in range(len(_BYTES)))


def _unpacked(coded: Callable[[], Iterable[bytes]], place: Place, via: str) -> None:
    """Scan what compressed streams hold, at any depth. Each layer is a generator of those below it."""
    work = [_stream_layers(coded, place, via)]
    while work and not place.done():
        if (below := next(work[-1], None)) is None:
            work.pop()
        else:
            work.append(below)


def _stream_layers(coded: Callable[[], Iterable[bytes]], place: Place, via: str) -> Iterator[Iterator]:
    """``coded`` gives the streams' bytes, each time anew: they are hashed, decompressed, and again for streams in them."""
    if not place.new(coded()):
        return
    via += "compressed/"
    nested: list[int] = []

    def text() -> Iterator[bytes]:
        last = -1
        for number, piece in Streams(coded()):
            if number != last:
                last = number
                if _decompressor(piece) is not None:
                    nested.append(number)
            yield piece

    yield _byte_layers(text(), place, via)
    for number in nested:
        own = lambda number=number: (piece for n, piece in Streams(coded()) if n == number)
        held, size = [], 0
        for piece in own():
            held.append(piece)
            size += len(piece)
            if size > PIECE:
                break
        yield _stream_layers(own if size > PIECE else lambda data=b"".join(held): _fed(data), place, via)


def _byte_layers(pieces: Iterable[bytes], place: Place, via: str) -> Iterator[Iterator]:
    """Scan bytes and give the layers of their escapes and base64 runs."""
    for data in _stretches(pieces):
        if not _HINT.search(data):
            continue
        place.scan(data, via)
        if _ESCAPE_BYTES.search(data):
            for line in [_resolved_bytes(x) for x in data.split(b"\n") if _ESCAPE_BYTES.search(x)]:
                if place.new([b"resolved ", line]):  # a stream of the very same bytes is another layer
                    yield _byte_layers([line], place, via + "escapes/")
                    for begin, end in _streams(line):
                        yield _stream_layers(lambda line=line, begin=begin, end=end: _fed(line, begin, end), place, via + "escapes/")
        text = data.decode("latin-1")
        for runs in (_BASE64, _WRAPPED) if b"\n" in data else (_BASE64,):
            for m in runs.finditer(text):
                run = m.group().rstrip("=").translate(_PLAIN)
                if len(run) < _LEAST or not place.new([run.encode()]):
                    continue
                for _, own in _decoded(run):
                    if _HINT.search(own):
                        yield _byte_layers([own], place, via + "base64/")
                    for begin, end in _streams(own):
                        yield _stream_layers(lambda own=own, begin=begin, end=end: _fed(own, begin, end), place, via + "base64/")


def _stretches(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """Bytes up to a border, PIECE at least."""
    held = bytearray()
    for piece in pieces:
        cut = piece.translate(_IS_BORDER).rfind(1) + 1 if len(held) + len(piece) >= PIECE else 0
        held += piece[:cut] if cut else piece
        if cut:
            yield bytes(held)
            held = bytearray(piece[cut:])
    if held:
        yield bytes(held)


def _parts(text: str) -> Iterator[tuple[int, int]]:
    """The same for a text, as places."""
    a = 0
    while a < len(text):
        m = _BORDER.search(text, a + PIECE)
        b = m.end() if m else len(text)
        yield a, b
        a = b


def find_secrets(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, via) sorted; via is empty for what stands in the text itself, else the layers it was under."""
    found = {(s, k, e): "" for k, s, e in scan(text)}
    if _OPENERS.search(text) or _BASE64.search(text) or "\n" in text and _WRAPPED.search(text):
        for a, b in _parts(text):
            n = np.arange(a, b + 1)
            _decode_all(Layer(text[a:b], n[:-1], n[1:], ""), found)
    return sorted((s, k, e, via) for (s, k, e), via in found.items())


def _decode_all(first: Layer, found: Found) -> None:
    work, seen, own = deque([first]), set(), set()
    while work:
        layer = work.popleft()
        key = hashlib.sha256(layer.text.encode(errors="surrogatepass") + (layer.start[:1].tobytes() + layer.end[-1:].tobytes())).digest()
        if key in own:
            continue
        own.add(key)
        if layer.via:
            for k, s, e in scan(layer.text):
                a, b = layer.span(s, e)
                found.setdefault((a, k, b), layer.via)
        if _ESCAPE.search(layer.text):
            lines = [x for line in _LINE.finditer(layer.text) if (x := _escapes(layer, line)) is not None]
            for x in lines:
                _escaped_streams(x, seen, found)
            work.extend(lines)
        for runs in (_BASE64, _WRAPPED) if "\n" in layer.text else (_BASE64,):
            for m in runs.finditer(layer.text):
                work.extend(_base64(layer, m, seen, found))


SPANS = "doc_id long, kinds array<string>, starts array<long>, ends array<long>, via array<string>"


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id and parallel arrays kinds, starts, ends (code points, end exclusive), via, ordered by start and kind.

    A narrow map over whole texts, however long; a null or empty text has none, in an empty table there are none;
    repeated rows and null ids are scanned each for itself; spans of one start come by kind, then by end. Further columns
    are not read, whatever their names.
    """
    prepare(docs.sparkSession)

    def convert(batch: pa.RecordBatch) -> dict:
        found = [find_secrets(t) for t in batch.column("text").to_pylist()]
        column = lambda k, kind: pa.array([[(KINDS[x[k]] if k == 1 else x[k]) for x in f] for f in found], pa.list_(kind))
        return {"doc_id": batch.column("doc_id"), "kinds": column(1, pa.string()), "starts": column(0, pa.int64()), "ends": column(2, pa.int64()), "via": column(3, pa.string())}

    return map_batches(doc_columns(docs), lambda: convert, SPANS)


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 (what stands in the text itself), spans (all)."""
    found = secret_spans(docs).select("doc_id", F.arrays_zip("kinds", "starts", "ends", "via").alias("s"))
    base = F.filter("s", lambda x: x["via"] == "")
    named = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kinds"], x["starts"].cast("string"), x["ends"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda x: x["kinds"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(named(base), 256).alias("base_sha256"), named("s").alias("spans"))

"""Secret scans against a plain recursive scanner, and on large layers."""

import base64
import bz2
import gzip
import lzma
import random
import re
import resource
import time
import urllib.parse
import zlib

import pytest
import zstandard

import veritrail.llm.secret_worklist as m
from veritrail.llm.secret_worklist import find_secrets, secret_digests

SECRET = 'password = "hunter2secret"'
PACKS = {b"\x1f\x8b": gzip.decompress, b"BZ": bz2.decompress, b"\xfd7": lzma.decompress, b"\x28\xb5": lambda d: zstandard.ZstdDecompressor().decompressobj().decompress(d), b"x\x9c": zlib.decompress}


def b64(x):
    return base64.b64encode(x).decode()


def kinds_under(data, seen):
    """Kinds of secrets in some bytes and in what they decode to: whole strings, plain recursion, no places."""
    if data in seen:
        return set()
    seen.add(data)
    text = data.decode("latin-1")
    found = {k for k, _, _ in m.scan(text)}
    for magic, unpack in PACKS.items():
        if data.startswith(magic):
            try:
                found |= kinds_under(unpack(data), seen)
            except Exception:  # not a stream
                pass
    if re.search("%[0-9A-Fa-f]{2}", text):
        for line in text.split("\n"):
            found |= kinds_under(urllib.parse.unquote_to_bytes(line), seen) if "%" in line else set()
    if "\\u" in text:
        for line in text.split("\n"):
            found |= kinds_under(re.sub(r"\\u00([0-7][0-9a-f])", lambda x: chr(int(x[1], 16)), line).encode("latin-1"), seen) if "\\u" in line else set()
    for run in re.findall(r"[A-Za-z0-9+/_-]{12,}", text):
        run = run.replace("-", "+").replace("_", "/")
        for shift in range(4):
            own = run[shift:]
            own = own[: len(own) - (len(own) % 4 == 1)]
            found |= kinds_under(base64.b64decode(own + "=" * (-len(own) % 4)), seen)
    return found


def nested(r):
    data = r.choice([SECRET, "token: abcdefgh", "AKIA" + "ABCDEFGH12345678", "0123456789abcdef01234567", "nothing"]).encode()
    for _ in range(r.randrange(1, 5)):
        data = "".join(r.choice("ab c\n,") for _ in range(r.randrange(0, 60))).encode() + b"\n," + data + b",\n" + b"xy z" * r.randrange(0, 8)
        way = r.randrange(7)
        if way < 4:
            data = (gzip.compress, zlib.compress, bz2.compress, lzma.compress)[way](data)
            data = b64(data).encode() if r.random() < 0.7 else b64((gzip.compress, bz2.compress)[r.randrange(2)](data)).encode()
        elif way == 4:
            data = b64(data).encode()
        elif way == 5:
            data = urllib.parse.quote_from_bytes(data, safe="").encode()
        else:
            data = "".join(f"\\u{c:04x}" for c in data).encode() if len(data) < 3000 else b64(data).encode()
    return data


@pytest.mark.parametrize("piece", [40, 300, 1_000_000])
def test_random_nestings_match_plain_recursion(monkeypatch, piece):
    """The same kinds are found under the text, whatever the size of the pieces that streams are taken in."""
    monkeypatch.setattr(m, "PIECE", piece)
    monkeypatch.setattr(m, "FED", max(piece, 256))
    r = random.Random(7)
    some = 0
    for _ in range(120):
        data = nested(r)
        want = kinds_under(data, set())
        got = {k for _, k, _, _ in find_secrets(data.decode("latin-1"))}
        assert want <= got, (want, got, data)
        some += bool(want)
    assert some > 60


WAYS = {
    "url": lambda d: "".join(f"%{c:02X}" for c in d).encode(),
    "quoted": lambda d: urllib.parse.quote_from_bytes(d, safe="").encode(),
    "hex": lambda d: "".join(f"\\x{c:02x}" for c in d).encode(),
    "unicode": lambda d: "".join(f"\\u{c:04x}" for c in d).encode(),
    "braces": lambda d: "".join(f"\\u{{{c:x}}}" for c in d).encode(),
    "entity": lambda d: "".join(f"&#{c};" for c in d).encode(),
    "base64": lambda d: b64(d).encode(),
    "gzip": gzip.compress,
    "bz2": bz2.compress,
    "zlib": zlib.compress,
    "xz": lzma.compress,
    "zstd": zstandard.compress,
}
TEXTUAL = ("url", "quoted", "hex", "unicode", "braces", "entity", "base64")


@pytest.mark.parametrize("chain", [
    ("gzip", "url"), ("bz2", "url"), ("gzip", "quoted"), ("gzip", "hex"), ("zlib", "unicode"), ("xz", "braces"), ("zstd", "entity"),
    ("gzip", "url", "base64"), ("url", "gzip", "base64"), ("gzip", "url", "gzip", "base64"), ("bz2", "hex", "url"), ("gzip", "hex", "bz2", "url", "quoted"),
    ("url", "url", "url"), ("hex", "url"), ("url", "hex"), ("entity", "url", "unicode"), ("base64", "url"), ("base64", "gzip", "hex", "base64"),
])
def test_chains_of_encodings_are_placed(chain):
    data = SECRET.encode()
    for way in chain:
        data = WAYS[way](data)
    text = f"é before, {data.decode()}, after"
    a, b = text.index(data.decode()), text.index(", after")
    found = [(s, e) for s, k, e, _ in find_secrets(text) if k == 0]
    if not set(chain) & {"gzip", "bz2", "zlib", "xz", "zstd", "base64"}:
        # the closing quote isn't part of the secret
        quote = b'"'
        for way in chain:
            quote = WAYS[way](quote)
        assert found == [(a, b - len(quote))]
    else:
        assert found and all(a <= s < e <= b for s, e in found) and max(e - s for s, e in found) >= (b - a) // 2


def plain_layers(text, places, seen, out):
    """All spans under a text by whole-string recursion: escapes from left to right until none is left, base64, streams."""
    key = (text, places[0], places[-1])
    if not text or key in seen:
        return
    seen.add(key)
    for k, s, e in m.scan(text):
        out.add((places[s][0], k, places[e - 1][1]))
    for line in re.finditer(r"[^\n]+", text):
        own, at = line.group(), places[line.start() : line.end()]
        if not m._ESCAPE.search(own):
            continue
        while (x := min(m._ESCAPE.finditer(own), key=lambda y: y.end(), default=None)) is not None:
            code = int(x[x.lastindex], 10 if x.lastindex == 7 else 16)
            own, at = own[: x.start()] + chr(code) + own[x.end() :], [*at[: x.start()], (at[x.start()][0], at[x.end() - 1][1]), *at[x.end() :]]
        plain_layers(own, at, seen, out)
        plain_streams(own.encode("latin-1"), at, seen, out)
    for run in re.finditer(r"[A-Za-z0-9+/_-]{12,}={0,2}", text):
        own = run.group().rstrip("=")
        for shift in range(4):
            part = own[shift:]
            part = part[: len(part) - (len(part) % 4 == 1)].replace("-", "+").replace("_", "/")
            data = base64.b64decode(part + "=" * (-len(part) % 4))
            at = [(places[run.start() + shift + k * 8 // 6][0], places[run.start() + shift + (k * 8 + 7) // 6][1]) for k in range(len(data))]
            plain_layers(data.decode("latin-1"), at, seen, out)
            plain_streams(data, [*at[:-1], (at[-1][0], places[run.end() - 1][1])], seen, out)


def plain_streams(data, places, seen, out):
    for magic, unpack in PACKS.items():
        for x in re.finditer(re.escape(magic), data):
            try:
                inner = unpack(data[x.start() :])
            except Exception:  # not a stream
                continue
            if inner:
                here = (places[x.start()][0], places[-1][1])
                plain_layers(inner.decode("latin-1"), [here] * len(inner), seen, out)
                plain_streams(inner, [here] * len(inner), seen, out)


def test_places_match_plain_recursion():
    """All spans with their places, streams at the end of what they stand in."""
    r = random.Random(9)
    some = 0
    for _ in range(150):
        data = r.choice([SECRET, "token: abcdefgh", "AKIA" + "ABCDEFGH12345678", "0123456789abcdef01234567", "nothing"]).encode()
        chain = []
        for _ in range(r.randrange(1, 4)):
            way = r.choice(list(WAYS) if not chain or chain[-1] in TEXTUAL else TEXTUAL)
            if len(data) > 4000:
                way = "base64"
            data = WAYS[way](data if chain and chain[-1] not in TEXTUAL else b"x, " + data)
            chain.append(way)
        if chain[-1] not in TEXTUAL:
            data = WAYS["url"](data)
        text = "a, " + data.decode("latin-1")
        want: set = set()
        plain_layers(text, [(k, k + 1) for k in range(len(text))], set(), want)
        got = {(s, k, e) for s, k, e, _ in find_secrets(text)}
        assert got == want, (chain, text)
        some += bool(want)
    assert some > 90


def test_escapes_of_escapes_take_linear_time():
    for part in ("25", "5Cx25"):
        text = "%" + part * 50_000 + "41" + " password = hunter%32secret"
        began = time.time()
        found = find_secrets(text[: 100_000] + " " + text[-60:])
        assert time.time() - began < 10 and any(k == 0 for _, k, _, _ in found)


def test_long_runs_stay_whole(monkeypatch):
    """A base64 run far longer than a piece, inside a stream, with the secret at any place of it."""
    monkeypatch.setattr(m, "PIECE", 5_000)
    filler = "".join(random.Random(1).choice("abcdefghijklmnop qrs,tuvw") for _ in range(20_000))
    for at in (0, 3_700, 3_750, 9_999, 20_000):
        run = b64((filler[:at] + SECRET + filler[at:]).encode())
        for inner in (run, "\n".join(run[k : k + 76] for k in range(0, len(run), 76))):
            coded = b64(gzip.compress(f"before {inner} after".encode()))
            assert [x[:3] for x in find_secrets(f"é {coded} e") if x[1] == 0] == [(2, 0, 2 + len(coded))]


def test_a_long_text_is_cut_at_borders_only(monkeypatch):
    text = " ".join(f"w{k}, {b64(SECRET.encode())} {urllib.parse.quote(SECRET)}\n" for k in range(60))
    whole = find_secrets(text)
    for piece in (1, 50, 333):
        monkeypatch.setattr(m, "PIECE", piece)
        assert find_secrets(text) == whole


def test_streams_in_streams_do_not_take_memory():
    """200 MB of text in a stream in a stream."""
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    pack = zlib.compressobj(9)
    data = b"".join([pack.compress(b"no secret, " * 100_000) for _ in range(180)]) + pack.compress(SECRET.encode())
    data += pack.flush()
    coded = b64(gzip.compress(data))
    assert [x[:3] for x in find_secrets(coded) if x[1] == 0] == [(0, 0, len(coded))]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000


def test_a_stream_that_holds_itself_ends(monkeypatch):
    blob = gzip.compress(b"x")
    monkeypatch.setattr(m, "_decompressor", lambda data: Echo() if data[:2] == b"\x1f\x8b" else None)

    class Echo:
        eof, unused_data = False, b""

        def decompress(self, data, limit=0):
            self.eof = True
            return blob if data else b""

    assert find_secrets(b64(blob)) == []


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, SECRET, "a", "b"), (1, SECRET, "a", "b"), (None, SECRET, "a", "b"), (2, None, "a", "b"), (3, "", "a", "b"), (4, "é, " * 400_000 + b64(SECRET.encode()), "a", "b")]
    got = sorted((x.doc_id or 0, x.n_assign, x.spans) for x in secret_digests(spark.createDataFrame(rows, "doc_id long, text string, spans string, kinds string")).collect())
    assert got[:3] == [(0, 1, "assign:0:25")] + [(1, 1, "assign:0:25")] * 2
    assert got[3:5] == [(2, 0, ""), (3, 0, "")] and got[5][2].startswith("assign:12000")

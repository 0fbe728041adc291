"""Operators 1, 2 and 8 against the libraries, and the block format by round trip."""

import base64
import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from veritrail.llm.bpe_tree import TreeEncoder, bpe_digests
from veritrail.llm.batches import ChunkMemory
from veritrail.llm.token_blocks import _Encoder, pack_blocks, parts_at_spaces, read_segment, segment_image, token_blocks, unpack_blocks
from veritrail.llm.token_counts import Merges, count_symbols, token_counts

ALPHABET = ["a", "b", " ", "  ", "\n", "\t", "<|endoftext|>", "é", "é", "\x1c", "\x85", " ", "　", "1", "23", "!!", "'s", "'re", "Σ", "日本", "<|startoftext|>", "aaaaaaa", "​", "ſ", "İ", "The", "Word,"]


def texts():
    r = random.Random(1)
    own = ["".join(r.choice(ALPHABET) for _ in range(r.randrange(0, 40))) for _ in range(400)]
    return [*own, "", None, "a" * 20_000 + "b", "ab" * 3000, "!" * 999, " " * 300, "é" * 3001, "word " * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x") for k, t in enumerate(texts())]
    rows += [(3, rows[3][1], "x"), (None, "null id", "x")]  # a repeated row, a null id
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
@pytest.mark.parametrize("high", [1, 2, 300, 50_000, 2**32])
def test_blocks_round_trip(n, high):
    rng = np.random.default_rng(n)
    a = rng.integers(0, high, n).astype(np.uint32)
    if n:
        a[rng.integers(0, n, 3)] = 2**32 - 1
    starts, area = pack_blocks(a)
    assert (unpack_blocks(starts, area, n) == a).all()
    assert len(starts) == -(-n // 256) + 1 and starts[-1] == len(area)


def test_outliers_do_not_widen_a_block():
    a = np.arange(256, dtype=np.uint32) % 8
    plain = len(pack_blocks(a)[1])
    a[[3, 77]] = 2**31
    assert len(pack_blocks(a)[1]) == plain + 2 * 5


def test_segment_keeps_documents_apart():
    own = [np.array(x, np.uint32).tobytes() for x in ([], [1, 2], [3])]
    doc_ids, lengths, ids = read_segment(segment_image([5, None, 7], own))
    assert doc_ids == [5, None, 7] and lengths.tolist() == [0, 2, 1] and ids.tolist() == [1, 2, 3]


def test_token_blocks_match_library(docs):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = sorted(map(tuple, token_blocks(docs).collect()), key=lambda r: r[1])
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start = 0
    assert len(got) == len(rows)
    for row, (doc_id, text) in zip(got, rows, strict=True):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], np.uint32)
        assert row == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_counts_match_library(docs):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = sorted(token_counts(docs).collect(), key=str)
    want = []
    for r in docs.collect():
        n = len(t.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 1024))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_overlapping_pairs_merge_from_the_left():
    m = Merges(P.path("byte_bpe_50k.json"))
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own = ["a" * n for n in range(1, 70)] + ["aab" * n for n in range(1, 30)]
    assert count_symbols([x.encode() for x in own], m).tolist() == [len(t.encode(x).ids) for x in own]


def test_bpe_tree_matches_library(docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in docs.collect():
        ids = t.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, np.uint32).tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe_digests(docs).collect()), key=str) == sorted(want, key=str)


def test_tree_equals_direct_encoding():
    e = TreeEncoder(P.path("byte_bpe_multi_50k.tiktoken"))
    r = random.Random(5)
    for _ in range(500):
        piece = "".join(r.choice(["a", "aa", "ab", "é", "日", "ion", "th", "e", "n"]) for _ in range(r.randrange(1, 60))).encode()
        assert e.tree(piece) == e.direct(piece) == e._direct_long(piece)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    for op in (token_blocks, token_counts, bpe_digests):
        assert op(none).collect() == []


def test_looking_up_costs_what_the_texts_hold():
    """Not what is remembered: set operations with a subclass of dict would walk all its keys for each text."""
    seen = []
    memory = ChunkMemory(lambda chunks: (seen.extend(chunks), [len(c) for c in chunks])[1])

    class Counted(type(memory.first)):
        walked = 0

        def __iter__(self):
            Counted.walked += len(self)
            return super().__iter__()

    memory.first, memory.later = Counted(None, 4), Counted(None, 4)
    texts = [f"w{k} w{k + 1} w{k + 2}" for k in range(50)]
    got = [memory.values([t])[0] for t in texts]
    assert got == [[len(p) + (j > 0) for j, p in enumerate(t.split(" "))] for t in texts]
    assert Counted.walked == 0
    assert memory.values(texts[-1:]) == got[-1:] and len(seen) < 200


def test_other_tokenizers_go_through_the_library(tmp_path, docs):
    """A tokenizer whose normaliser keeps case and white space isn't cut at spaces."""
    spec = json.loads(Tokenizer.from_file(P.path("word_bpe_49k.json")).to_str())
    assert parts_at_spaces(spec)
    spec["normalizer"] = {"type": "NFC"}
    assert not parts_at_spaces(spec)
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    t = Tokenizer.from_file(path)
    texts = ["Ab  ab\tAB", "", "x<|endoftext|>y Z"]
    assert _Encoder(path).texts(pa.array(texts), b"\2\0\0\0") == [np.array([*t.encode(x, add_special_tokens=False).ids, 2], np.uint32).tobytes() for x in texts]
    with pytest.raises(ValueError, match="byte-level"):
        Merges(P.path("word_bpe_49k.json"))


def test_special_strings_with_a_space_are_refused(tmp_path):
    spec = json.load(open(P.path("byte_bpe_50k.json"), encoding="utf-8"))
    spec["added_tokens"][0]["content"] = "<|end of text|>"
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="white space"):
        Merges(str(path))

"""Operator 13 against a plain form: both libraries on whole texts, all links of each group, counts by document."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

import veritrail.llm.token_alignment as m


def byte_of_letter():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = {chr(b): b for b in own}, 256
    for b in range(256):
        if b not in own:
            table[chr(spare)] = b
            spare += 1
    return table


@pytest.fixture(scope="module")
def brute():
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    of = byte_of_letter()

    def groups(text):
        if not text:
            return None
        ia, ib, own = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
        ba = [bytes(of[c] for c in a.id_to_token(x)) for x in ia]
        bb = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ib]
        if b"".join(ba) != own or b"".join(bb) != own:
            return None
        ends_a, ends_b = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        cut, out = sorted(set(ends_a) & set(ends_b)), []
        for lo, hi in zip([0, *cut], cut, strict=False):
            out.append(([x for x, e in zip(ia, ends_a, strict=True) if lo < e <= hi], [x for x, e in zip(ib, ends_b, strict=True) if lo < e <= hi]))
        return out

    def run(rows):
        found = [(k, groups(t)) for k, t in rows]
        held = [Counter((x, y) for ga, gb in g or [] for x in ga for y in gb) for _, g in found]
        n = Counter(p for h in held for p in h)
        top = defaultdict(int)
        for (x, _), k in n.items():
            top[x] = max(top[x], k)
        out = []
        for (k, g), h in zip(found, held, strict=True):
            said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g or [])
            sizes = [sum(len(ga) for ga, _ in g or []), sum(len(gb) for _, gb in g or []), len(g or []), sum(len(ga) * len(gb) for ga, gb in g or [])]
            out.append((k, *sizes, sum(c for p, c in h.items() if n[p] == top[p[0]]), sum(c * n[p] for p, c in h.items()), hashlib.sha256(said.encode()).hexdigest() if g else ""))
        return sorted(out, key=str)

    return run


def texts():
    r = random.Random(5)
    syllables = ["th", "onre", "été", "größe", "wh", "Ça", "ing", "12", "2024", "!!", "://", "日本語", "🙂", "x" * 30]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 4)))
    words = [word() for _ in range(200)]
    gap = lambda: r.choice([" ", " ", " ", " ", "  ", "\n", "\t", " \n ", " ", "　"])
    out = ["".join(r.choice(words) + gap() for _ in range(r.randrange(1, 60))) for _ in range(60)]
    out += [" " + out[0], out[1], out[1], "", None, " ", "\n", "a▁b", "▁", "</s> <s><|endoftext|> <0x41> <unk>", "\x00 \x1f", "﻿x", "é é", "don't we'll", "a" * 5000, "ab" * 3000 + " " + "日本" * 1000]
    return out


def test_matches_plain_form(spark, brute, monkeypatch):
    rows = [(k, t) for k, t in enumerate(texts())] + [(None, "null id here"), (3, "a repeated id"), (3, "a repeated id")]
    want = brute(rows)
    assert len({w[-1] for w in want}) > 60 and any(w[1] != w[3] for w in want)
    own = [(k, t, 7, "x") for k, t in rows]
    docs = spark.createDataFrame(own, "doc_id long, text string, a long, `groups` string").repartition(3)
    assert sorted(map(tuple, m.token_alignment(docs).collect()), key=str) == want


def test_size_of_blocks_and_slices_does_not_matter(spark, brute, monkeypatch):
    rows = [(k, t) for k, t in enumerate(texts())]
    monkeypatch.setattr(m, "BLOCK_BYTES", 700)
    monkeypatch.setattr(m, "EXPANDED", 2)
    path = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    first = m.Aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    parts = [list(m.align_block(first, k, [x for x, _ in some], [t for _, t in some], True)) for k, some in enumerate([rows[:5], rows[5:9], rows[9:]])]
    spark_rows = [r for batches in parts for b in batches for r in b.to_pylist()]
    table = spark.createDataFrame([tuple(r.values()) for r in spark_rows], m._ROWS)
    want = brute(rows)
    assert sorted(map(tuple, m.scored(table).collect()), key=str) == want
    assert sorted(map(tuple, m.token_alignment(path).collect()), key=str) == want


def test_groups_as_text_and_lexicon(spark):
    docs = spark.createDataFrame([(1, "the thing"), (2, "the")], "doc_id long, text string")
    first = m.aligned(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), digests=False)
    said = {r.doc_id: r.groups for r in m.scored(first).collect()}
    assert said[1].split(";")[0] == said[2]
    a, b = map(int, said[2].split("|"))
    assert (a, b, 2, True) in {tuple(r) for r in m.lexicon(first).collect()}


def test_library_where_ids_are_not_in_merge_order(tmp_path):
    import json

    spec = json.load(open(P.path("byte_bpe_50k.json"), encoding="utf-8"))
    x, y = list(spec["model"]["vocab"])[300:302]
    v = spec["model"]["vocab"]
    v[x], v[y] = v[y], v[x]
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    own, usual = m.ByteLevel(str(path)), m.ByteLevel(P.path("byte_bpe_50k.json"))
    assert own.library and not usual.library
    some = [t for t in texts() if t]
    assert [[own.bytes[k] for k in ids] for ids in own(some)] == [[usual.bytes[k] for k in ids] for ids in usual(some)]


def test_empty_table(spark):
    assert m.token_alignment(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_blocks_without_tokens(spark, brute):
    rows = [(1, ""), (2, None), (3, "▁")]
    assert sorted(map(tuple, m.token_alignment(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect())) == brute(rows)

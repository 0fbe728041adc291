"""Operator 3 against a comparison of all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

import veritrail.llm.simhash_anchors as m
from veritrail.llm.graph import components


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps):
    """Smallest index reachable over pairs within four bits."""
    a, label = np.array(fps, np.uint64), list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for k in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[k]) <= 4):
            x, y = root(k), root(j)
            label[max(x, y)] = min(x, y)
    return [root(k) for k in range(len(fps))]


def test_matches_all_pairs(spark):
    r = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(r.choice(words) for _ in range(r.randrange(1, 200))) for _ in range(60)]
    texts = []
    for t in base:
        texts += [t] * r.randrange(1, 4)
        for _ in range(3):
            w = t.split()
            w[r.randrange(len(w))] = "other"
            texts.append(" ".join(w).upper())
    texts += ["", None, " \t\n", "one", "one", "É É", "é é"]
    rows = [(k, t, "x") for k, t in enumerate(texts)]
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()}
    fps = [fingerprint(t) for t in texts]
    want = linked(fps)
    assert got == {k: (f"{fps[k]:016x}", want[k]) for k in range(len(texts))}


@pytest.mark.parametrize(("blocks", "residents"), [(3, 16_384), (2, 16_384), (3, 2)])
def test_links_are_complete(spark, monkeypatch, blocks, residents):
    monkeypatch.setattr(m, "RESIDENTS", residents)
    r = random.Random(3)
    fps = set()
    for _ in range(150):
        x = r.getrandbits(64)
        fps.add(x)
        for _ in range(10):
            for _ in range(r.randrange(1, 6)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    own = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    want = linked([x % (1 << 64) for x in own])
    nodes = spark.createDataFrame([(x,) for x in own], "fp long").repartition(4)
    got = dict(map(tuple, components(m.near_links(nodes, 4, blocks)).collect()))
    assert all(got.get(x, x) == own[want[k]] for k, x in enumerate(own))


def test_every_pair_meets_at_an_anchor():
    r = random.Random(4)
    for blocks in (2, 3):
        codes = m.coverings(blocks)
        for _ in range(200):
            x = r.getrandbits(64)
            y = x
            for b in r.sample(range(64), 4):
                y ^= 1 << b
            fx, fy = np.array([x], np.uint64), np.array([y], np.uint64)
            assert any(c.homes(fx)[0] in np.concatenate([k for k, _ in c.visits(fy)]) for c in codes)


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(500)] + [(900, 901), (7, 7)], "a long, b long")
    got = dict(map(tuple, components(links).collect()))
    assert all(got[k] == 0 for k in range(501)) and got[901] == got[900] == 900


def test_empty_and_null_ids(spark):
    assert m.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = m.near_duplicates(spark.createDataFrame([(None, "a b c d e"), (9, "a b c d e"), (None, "zz")], "doc_id long, text string")).collect()
    assert sorted(str(x.component_id) for x in rows) == ["9", "9", "None"]

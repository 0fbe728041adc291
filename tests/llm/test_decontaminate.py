"""Operator 4 against plain Python."""

import hashlib
import random
import re

import veritrail.llm.decontaminate as m
from veritrail.llm.word_hashes import Words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            n = min(10, len(v))
            for k in range(len(v) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[k : k + n]:
                        hit.update(range(j, j + n))
                        if item_id is not None:
                            found.add(item_id)
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def data():
    r = random.Random(6)
    vocabulary = ["the", "of", "Ärger", "x1", "été", "a", "b", "ñu", "日本"]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 25)))) for k in range(12)]
    items += [(20, "short one"), (21, "SHORT one!"), (None, "no id at all"), (22, ""), (23, None), (20, "short one"), (24, "of of of of of of of of of of of of")]
    docs = []
    for k in range(60):
        parts = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 30)))]
        if k % 2:
            parts.append((r.choice(items)[1] or "").upper().replace(" ", " - "))
        parts.append("tail; words")
        docs.append((k, r.choice(["\n", ", ", "_"]).join(parts)))
    return [*docs, (60, ""), (61, None), (3, docs[3][1]), (62, "of " * 3000), (None, "short one")], items


def test_matches_plain_python(spark):
    docs, items = data()
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, hits string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, m.contamination(d, b).collect()), key=str) == brute(docs, items)


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_WINDOWS", 10)
    docs, items = data()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, m.contamination(d, b).collect()), key=str) == brute(docs, items)


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert m.contamination(d, b).first()["contaminated"] is False
    assert m.contamination(d.limit(0), b).collect() == []


def test_words_and_hashes():
    texts = ["Ab1 é-x", "", "--", "ab1  É"]
    w = Words([t.encode() for t in texts])
    assert [[w.word(k).decode() for k in range(w.first[j], w.first[j + 1])] for j in range(4)] == [words(t) for t in texts]
    assert w.hash[0] == w.hash[3] and len(set(w.hash.tolist())) == 4

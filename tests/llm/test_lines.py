"""Operator 6 against plain Python."""

import hashlib
import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest

from veritrail.llm.line_templates import Lines, drop_lines, line_digests, recurring_lines


def templates_of(form):
    """A line's templates: each band behind the first three tokens left open."""
    wide = len(form) // 5
    if not wide:
        return [form]
    return [(k, form[:k], form[k + wide :], len(form)) for k in range(3, len(form), wide)]


def brute(docs):
    """Line numbers to drop by document."""
    held, lines, drop = defaultdict(set), [], defaultdict(set)
    for doc_id, text in docs:
        for k, line in enumerate((text or "").split("\n")):
            w = re.findall(r"[^ \t\x0b\x0c\r]+", line)
            if len(w) >= 3 and doc_id is not None:
                form = tuple("<*>" if any("0" <= c <= "9" for c in x) else x for x in w)
                lines.append((doc_id, k, form))
                for t in templates_of(form):
                    held[t].add(doc_id)
    for doc_id, k, form in lines:
        again = [min(held[t]) for t in templates_of(form) if len(held[t]) > 1]
        if again and min(again) != doc_id:
            drop[doc_id].add(k)
    return drop


def data():
    r = random.Random(7)
    vocabulary = ["alpha", "beta", "gamma", "été", "delta"]
    long = " ".join(r.choice(vocabulary) for _ in range(60))
    docs = []
    for k in range(80):
        lines = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(0, 6))]
        if k % 3 == 0:
            lines.append(f"Copyright (c) 20{k:02d} all rights reserved by nobody at all {r.choice(vocabulary)} end of line")
        if k % 5 == 0:
            lines.insert(0, long)
        docs.append((k, "\n".join(lines)))
    return [*docs, (80, ""), (81, None), (82, docs[0][1]), (None, long), (83, "one two\none two"), (84, "one two"), (85, "again and again\nagain and again")]


def test_matches_plain_python(spark):
    docs = data()
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, leaf string").repartition(4)
    want = brute(docs)
    got = line_digests(d).collect()
    assert len(got) == len(docs)
    by = dict(docs)
    for x in got:
        gone = want.get(x.doc_id, set())
        assert x.dropped == sorted(gone) and x.n_dropped == len(gone)
        text = by[x.doc_id]
        assert x.n_lines == (0 if text is None else len(text.split("\n")))
        kept = None if text is None else "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone)
        assert x.text_sha256 == (None if kept is None else hashlib.sha256(kept.encode()).hexdigest())


def test_repeated_passage_goes_from_all_but_the_first(spark):
    passage = " ".join(f"word{'abcdefgh'[k % 8]}" for k in range(55))
    docs = [(k, f"own line number {'abcdefghij'[k]} here and nowhere else {'abcdefghij'[k] * 3}\n{passage}") for k in range(6)]
    out = {r.doc_id: r.text for r in drop_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert passage in out[0] and all(passage not in out[k] for k in range(1, 6)) and all(t.startswith("own line") for t in out.values())


def test_a_line_repeated_in_one_document_only_stays(spark):
    d = spark.createDataFrame([(1, "again and again\nagain and again"), (2, "something else entirely")], "doc_id long, text string")
    assert all(r.dropped == [] for r in drop_lines(d).collect())


def test_columns_and_empty_table(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string, n_lines int, dropped string")
    out = drop_lines(d)
    assert out.collect() == [] and out.columns == ["doc_id", "text", "lang", "n_lines", "dropped"]


def test_unique_lines_of_a_large_leaf_stay(spark):
    """Four tokens, three of them shared: the last one alone tells the lines apart, each from thousands of others."""
    words = ["".join(chr(97 + (k * 7919 + 13) // 26**j % 26) for j in range(6)) for k in range(4000)]
    assert len(set(words)) == len(words)
    docs = [(k, "\n".join(f"posted by user {w}" for w in words[k * 40 : k * 40 + 40])) for k in range(100)]
    assert all(x.dropped == [] for x in drop_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect())


@pytest.mark.parametrize("leaf_forms", [8192, 60, 20, 5, 1])
def test_the_size_of_a_leaf_does_not_matter(spark, leaf_forms):
    """Forms in one leaf that are chained, each a token away from the next, and forms that lie far apart."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(8))
    rows, form = [], [word() for _ in range(9)]
    for k in range(180):
        form[r.randrange(9)] = word()
        rows.append((k // 3, "posted by user " + " ".join(form)))
    rows += [(r.randrange(60), "posted by user " + " ".join(word() for _ in range(9))) for _ in range(60)]
    rows += [(70 + k, "posted by user " + " ".join([*form[:4], word(), word(), *form[6:]])) for k in range(9)]
    docs = [(k, "\n".join(t for i, t in rows if i == k)) for k in range(80)]
    got = recurring_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), leaf_forms=leaf_forms).collect()
    own = Lines(["\n".join(t for _, t in rows).encode()], templates=True)
    form_of = dict(zip(own.form.view(np.int64).tolist(), [t for _, t in rows], strict=True))
    held = defaultdict(set)
    for i, t in rows:
        for x in templates_of(tuple(t.split())):
            held[x].add(i)
    want = {t: min(m) for _, t in rows if (m := [min(held[x]) for x in templates_of(tuple(t.split())) if len(held[x]) > 1])}
    assert 20 < len(want) < 200
    assert {form_of[x.form]: x.keep for x in got} == want


def test_many_lines_in_one_text(spark):
    """100,000 lines, half of which go: time in proportion to them."""
    lines = [f"line of words {a}{b}{c}{e}{g}" for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghij" for e in "abcdefghij" for g in "abcdefghij"]
    docs = spark.createDataFrame([(1, "\n".join(lines[::2])), (2, "\n".join(lines))], "doc_id long, text string")
    began = time.time()
    out = {x.doc_id: x for x in drop_lines(docs).collect()}
    assert out[2].text == "\n".join(lines[1::2]) and out[2].dropped == list(range(0, 100_000, 2)) and out[1].dropped == []
    assert time.time() - began < 60


def test_short_lines_and_no_first(spark):
    d = spark.createDataFrame([(1, "Menu\nits own words here"), (2, "Menu\nother words stand there"), (2, "Menu\nother words stand there")], "doc_id long, text string")
    assert all(x.dropped == [] for x in drop_lines(d).collect())
    assert [x.dropped for x in drop_lines(d, min_tokens=1).orderBy("doc_id").collect()] == [[], [0], [0]]
    assert [x.text for x in drop_lines(d, min_tokens=1, keep_first=False).orderBy("doc_id").collect()] == ["its own words here"] + ["other words stand there"] * 2


def test_names_used_inside_and_very_long_texts(spark):
    long = " ".join(f"w{'abcdefghij'[k % 10]}{'abcdefg'[k % 7]}" for k in range(900_000))
    d = spark.createDataFrame([(1, long, 1, "a", "b", "c"), (2, "short line of words\n" + long, 2, "d", "e", "f")], "doc_id long, text string, row int, gone string, text_key string, leaf string")
    out = {x.doc_id: x for x in drop_lines(d).collect()}
    assert out[1].text == long and out[2].text == "short line of words" and (out[2].row, out[2].gone, out[2].text_key, out[2].leaf) == (2, "d", "e", "f")

"""Segmentation against plain Python models on random lines."""

import random


from veritrail.operators import segment as S

SCHEMA = "doc_id long, line_no int, text string, is_bullet boolean, is_bold boolean, is_heading boolean, font_size double, page int"


def random_lines(seed, n_docs=40):
    r = random.Random(seed)
    words = ["Alpha", "beta", "Skills", "work experience", "Projects:", "gamma delta epsilon zeta eta theta", "ends.", "Über", "Languages", "x" * 200]
    return [(d, k, r.choice(words), r.random() < 0.4, r.random() < 0.3, r.random() < 0.1, r.choice([10.0, 10.0, 11.0, 13.0]), r.choice([1, 1, 2])) for d in range(n_docs) for k in range(r.randrange(1, 25))]


def by_doc(rows):
    out = {}
    for x in rows:
        out.setdefault(x[0], []).append(x)
    return out


def entry_numbers(flags):
    out, n, started, bullet, bold = [], 0, False, False, False
    for is_bullet, is_bold in flags:
        if is_bullet:
            if not started:
                n, started = n + 1, True
            bullet = True
        else:
            if not started or bullet or (is_bold and bold):
                n, started, bullet, bold = n + 1, True, False, False
            bold = bold or is_bold
        out.append(n)
    return out


def pack(rows, limit):
    if sum(len(t) + 1 for t, _ in rows) <= limit:
        return [rows]
    head = [x for x in rows[:3] if not x[1]]
    parts, held, size = [], [], 0
    for x in rows:
        n = len(x[0]) + 1
        if held and size + n > limit:
            parts.append(held)
            held, size = list(head), sum(len(t) + 1 for t, _ in head)
        held, size = [*held, x], size + n
    return [*parts, held]


def test_entries(spark):
    rows = random_lines(1)
    got = {(x.doc_id, x.line_no): x.entry for x in S.entries(spark.createDataFrame(rows, SCHEMA), "doc_id").collect()}
    for d, own in by_doc(rows).items():
        assert [got[d, k] for k in range(len(own))] == entry_numbers([(x[3], x[4]) for x in own])


def test_entries_of_the_fixtures(spark):
    flags = {0: [(False, True), (False, False), (True, False), (True, False), (False, True), (True, False)], 1: [(False, True), (False, True)]}
    rows = [(d, k, "t", b, bold, False, 10.0, 1) for d, own in flags.items() for k, (b, bold) in enumerate(own)]
    got = sorted((x.doc_id, x.line_no, x.entry) for x in S.entries(spark.createDataFrame(rows, SCHEMA), "doc_id").collect())
    assert [x[2] for x in got] == [1, 1, 1, 1, 2, 2, 1, 2]


def test_packing(spark):
    rows = random_lines(2)
    got = S.packed(spark.createDataFrame(rows, SCHEMA), ["doc_id"], 300).collect()
    parts = {}
    for x in sorted(got, key=lambda x: (x.doc_id, x.part_index)):
        parts.setdefault(x.doc_id, []).append([(y.text, y.is_bullet) for y in x.part])
    for d, own in by_doc(rows).items():
        assert parts[d] == pack([(x[2], x[3]) for x in own], 300)


def test_packing_of_the_fixture(spark):
    rows = [(1, k, t, b, False, False, 10.0, 1) for k, (t, b) in enumerate([("aaaa", False), ("bbbb", True), ("cccc", True)])]
    got = sorted(S.packed(spark.createDataFrame(rows, SCHEMA), ["doc_id"], 10).collect(), key=lambda x: x.part_index)
    assert [[y.text for y in x.part] for x in got] == [["aaaa", "bbbb"], ["aaaa", "cccc"]]


def test_wrapped_lines(spark):
    known = {h for h, _ in S.heading_aliases()}

    def model(own):
        out = []
        for d, k, text, bullet, bold, heading, size, page in own:
            last = out[-1] if out else None
            if last and last[7] == page and not bullet and last[2][-1:] not in (*".!?:;",) and not text[:1].isupper() and abs(last[6] - size) < 0.6 and last[2].strip().upper().rstrip(":") not in known:
                last[2] += " " + text
            else:
                out.append([d, k, text, bullet, bold, heading, size, page])
        return [(x[1], x[2]) for x in out]

    rows = random_lines(3)
    got = {}
    for x in S.merge_wrapped(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(x.doc_id, []).append((x.line_no, x.text))
    for d, own in by_doc(rows).items():
        assert sorted(got[d]) == model(own)


def test_chunks_keep_every_line(spark):
    rows = random_lines(4)
    lines = spark.createDataFrame(rows, SCHEMA)
    chunks = S.chunks(lines).collect()
    text = {}
    for c in chunks:
        text.setdefault(c.doc_id, []).append(c.text)
    for x in S.content(S.sections(lines)).collect():
        assert any(x.text in t for t in text[x.doc_id])
    for d in text:
        own = sorted(c.chunk_index for c in chunks if c.doc_id == d)
        assert own == list(range(1, len(own) + 1))
    assert len({c.chunk_id for c in chunks}) == len(chunks)
    assert all(c.embedding_text == f"[{c.section}]\n{c.text}" for c in chunks)
    whole = {x.doc_id: x.text for x in S.rebuilt(spark.createDataFrame(chunks)).collect()}
    assert all(c.text in whole[c.doc_id] for c in chunks)


def test_windows_do_not_gather_the_corpus(spark):
    plan = S.entries(spark.createDataFrame(random_lines(5), SCHEMA), "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert "CartesianProduct" not in S.sections(spark.createDataFrame(random_lines(5), SCHEMA))._jdf.queryExecution().executedPlan().toString()

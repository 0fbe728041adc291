"""Operator 11 against tries of plain tuples, at every size of block and number of tasks, and against its SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

import veritrail.llm.prefix_trie as m


def plain(seqs):
    """(conv_id, depth, parent, ...) of the nodes over {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    words = lambda k: len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = (len(members[k]) - 1) * words(k) + sum(saved[x] for x in children[k])
    out = []
    for k, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(seqs[c]) == len(k))
        out.append((min(own), len(k), min(members[k[:-1]]) if k else None, len(own), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def ordered(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append((turn is not None, turn or 0, digest, role, text))
    return {c: [x[3:] for x in sorted(turns)] for c, turns in own.items()}


def rebuilt(rows):
    own, out = ordered(rows), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def conversations(seed):
    r = random.Random(seed)
    said = ["", None, "a", "a b", " ", "b  c\td", "é ü", "x" * 2000, "a b c d e"]
    turn = lambda: (r.choice(["user", "assistant", None]), r.choice(said))
    stock = [[turn() for _ in range(r.randrange(1, 7))] for _ in range(8)]
    rows = []
    for c in range(160):
        if c == 40:
            continue  # a base that is absent
        turns = list(r.choice(stock)) if r.random() < 0.6 else [turn() for _ in range(r.randrange(1, 6))]
        if r.random() < 0.3:
            turns = turns[: r.randrange(1, len(turns) + 1)]
        rows += [(c, k if k or r.random() < 0.9 else None, *t) for k, t in enumerate(turns)]
    rows += [(7, 0, "user", "a tie"), (7, 0, "user", "a tie"), (None, 0, "user", "no id"), (60, None, None, None), (1000, 0, "u", "a b"), (10**12 + 1, 0, "u", "only")]
    rows += [(900, k, "user", f"turn {k // 3}") for k in range(400)] + [(901, k, "user", f"turn {k // 3}") for k in range(500)]
    r.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("openings", [False, True])
def test_matches_plain_tries(spark, openings):
    rows = conversations(1)
    df = spark.createDataFrame([(*x, "k", 1) for x in rows], SCHEMA + ", key string, depth int")
    got = sorted(map(tuple, m.prefix_trie(df, openings).collect()), key=str)
    assert got == plain((rebuilt if openings else ordered)(rows))


@pytest.mark.parametrize(("rows_of_block", "cut"), [(1, 1), (2, 1), (3, 17), (7, 5), (64, 3), (8192, 1)])
def test_blocks_and_tasks_do_not_matter(spark, monkeypatch, rows_of_block, cut):
    """The forest of sorted rows cut into tasks at random, merged by Spark."""
    monkeypatch.setattr(m, "BLOCK_ROWS", rows_of_block)
    rows = conversations(2)
    own = m.sequences(spark.createDataFrame(rows, SCHEMA), True).collect()
    order = sorted((bytes(x.key), x.conv_id, x.words) for x in own)
    r = random.Random(cut)
    edges = [0, *sorted(r.sample(range(len(order)), cut)), len(order)]

    class Batch:
        def __init__(self, some):
            self.some = some

        def column(self, name):
            return [x[("key", "conv_id", "words").index(name)] for x in self.some]

    monkeypatch.setattr(Batch, "column", lambda self, name, f=Batch.column: type("C", (), {"to_pylist": lambda _: f(self, name)})())
    found = []
    for part, (i, j) in enumerate(zip(edges, edges[1:], strict=False)):
        monkeypatch.setattr(m, "TaskContext", type("T", (), {"get": staticmethod(lambda part=part: type("P", (), {"partitionId": lambda _: 2 * part})())}))
        found += [tuple(x.values()) for b in m._forests([Batch(order[i:j])]) for x in b.to_pylist()]
    monkeypatch.undo()
    monkeypatch.setattr(m, "stored", lambda df, name: spark.createDataFrame(found, m._FOREST) if name == "prefix-forest" else df)
    assert sorted(map(tuple, m.trie(m.sequences(spark.createDataFrame(rows, SCHEMA))).collect()), key=str) == plain(rebuilt(rows))


def test_many_tasks(spark):
    rows = conversations(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = sorted(map(tuple, m.prefix_trie(spark.createDataFrame(rows, SCHEMA), True).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain(rebuilt(rows))


def test_sql(spark):
    rows = [x for x in conversations(4) if x[0] not in (900, 901)]
    want = plain(rebuilt(rows))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(m.ORACLE).fetchall(), key=str) == want


def test_turnless_and_empty(spark):
    assert m.prefix_trie(spark.createDataFrame([], SCHEMA), True).collect() == []
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)  # its base, 20, is absent
    rows = [(c, 0, "user", "gone")]
    assert [tuple(x) for x in m.prefix_trie(spark.createDataFrame(rows, SCHEMA), True).collect()] == plain({c: []}) == plain(rebuilt(rows))

"""Operator 12 against one document after the other on a ring in plain Python."""

import random
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import pytest
import xxhash

import veritrail.llm.hash_ring as m

U = 1 << 64


def signed(x):
    return x - U if x >> 63 else x


def node_hash(k):
    # columns are hashed one after the other, the hash so far being the seed
    return xxhash.xxh64_intdigest(k.to_bytes(8, "little"), xxhash.xxh64_intdigest(b"node", 42))


def plain(rows, shards, nodes, slack=0.0):
    """doc_id, size, crc, shard, slot."""
    placed = sorted((node_hash(k) >> 48, signed(node_hash(k)), k // nodes) for k in range(shards * nodes))
    ends, lap = [x[0] for x in placed], [x[2] for x in placed]
    arcs = defaultdict(list)
    for doc_id, text in rows:
        h = 42 if doc_id is None else xxhash.xxh64_intdigest(str(doc_id).encode(), 42)
        data = (text or "").encode()
        arcs[bisect_left(ends, h >> 48) % len(ends)].append((signed(h), doc_id is not None, doc_id or 0, zlib.crc32(data), len(data) + 1))
    total = len(rows)
    share = [-int(-total * (1 + slack) // shards) if slack else total // shards + (s < total % shards) for s in range(shards)]
    held, out = Counter(), []
    waiting = {a: sorted(own) for a, own in arcs.items()}
    for k in range(shards):
        for a in sorted(waiting):
            asks = list(dict.fromkeys(lap[a:] + lap[:a]))
            s, rest = asks[k], []
            for x in waiting[a]:
                if held[s] < share[s]:
                    out.append((x[2] if x[1] else None, x[4], x[3], s, held[s]))
                    held[s] += 1
                else:
                    rest.append(x)
            waiting[a] = rest
    assert not any(waiting.values())
    return sorted(out, key=str)


def documents(n):
    r = random.Random(6)
    rows = [(r.randrange(-50, 10**9), r.choice(["", None, "é", "some text", "x" * 5000, "t" * r.randrange(50)])) for _ in range(n)]
    return rows + [(None, "no id")] * 90 + [(5, "hot")] * 200 + [(5, f"v{k % 7}") for k in range(60)]


@pytest.mark.parametrize(("shards", "nodes", "slack"), [(16, 64, 0.0), (5, 3, 0.0), (1, 1, 0.0), (7, 8, 0.3)])
def test_matches_one_after_the_other(spark, shards, nodes, slack):
    rows = documents(500)
    own = [(*x, 1, "a", "b", 2) for x in rows]
    docs = spark.createDataFrame(own, "doc_id long, text string, size int, arc string, shard string, at int").repartition(3)
    got = m.shard_documents(docs, shards, nodes, slack).collect()
    assert sorted(((x.doc_id, x.size, x.text_crc32, x.shard, x.slot) for x in got), key=str) == plain(rows, shards, nodes, slack)
    n = Counter(x.shard for x in got)
    assert all(sorted(x.slot for x in got if x.shard == s) == list(range(k)) for s, k in n.items())
    assert {(x.law, x.grown_shard) for x in got} == {("rows", None)}
    if not slack:
        assert max(n[s] for s in range(shards)) - min(n[s] for s in range(shards)) <= 1
    else:
        assert max(n.values()) <= -int(-len(rows) * (1 + slack) // shards)


def test_partitions_do_not_matter(spark):
    docs = spark.createDataFrame(documents(300), "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [sorted(map(str, m.shard_documents(docs.repartition(k)).collect())) for k in (1, 6)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got[0] == got[1] == sorted(map(str, m.shard_documents(docs.coalesce(1)).collect()))


def test_one_more_shard_moves_few(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'x' as text")
    shard = lambda n, slack: {x.doc_id: x.shard for x in m.shard_documents(docs, n, slack=slack).collect()}
    for slack, most in ((0.0, 0.3), (0.25, 0.1)):
        a, b = shard(16, slack), shard(17, slack)
        assert sum(a[k] != b[k] for k in a) / len(a) < most
        assert sum(s == 16 for s in b.values()) / len(b) > 0.03


def test_carried_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a", "z"), (2, None, "y")], "doc_id long, text string, shard string")
    assert {(x.doc_id, x.row.shard) for x in m.shard_documents(docs, carry=True).collect()} == {(1, "z"), (2, "y")}
    assert m.shard_documents(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        m.ring(spark, 0)


def test_no_python_on_executors(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = m.shard_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))

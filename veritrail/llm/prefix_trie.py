"""The prefix trie of conversations: which openings are shared, by how many, and what sharing them would save.

A conversation is one row: its key, the 16-byte digests of its turns end to end, so that the order of keys is an order
by turns and a prefix of the conversation is a prefix of the key. Rows are dealt by ranges of (key, conv_id) and sorted;
copies of one conversation spread over as many ranges as they fill.

Neighbours in that order share a longest common prefix (LCP). Within a block of neighbours the LCPs are edges; a
union-find takes them from the deepest to the shallowest, and each merge of components makes a node where conversations
branch. Between a component's depth and that of the merge it goes into lie its nodes with one child.

Nodes that hold neither the first nor the last row of their block are finished there. All others are prefixes of these
two rows: the block's forest contracted to two paths. Their numbers are sums over blocks, once each node is counted as
new in one block only, so the paths are merged by one aggregation over prefix digests. Where a task begins, its first
row's neighbour is in another task; the difference this makes depends on the LCP over the boundary alone and is added
in the same aggregation.

Digests are the first 16 bytes of SHA-256; that two different turns or prefixes share one is not to be expected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import prepare, stored
from .batches import kept

#: Bytes of a turn's digest.
WIDTH = 16
#: Rows of a block, and turns of its rows together after which it is closed.
BLOCK_ROWS, BLOCK_TURNS = 8192, 1 << 18
WORD = r"[^\x20\x09-\x0D]+"

# kind: 0 finished node, 1 a node's part in one block, 2 first and last row of a task
_FOREST = "kind int, part int, block int, node binary, up binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, keys array<binary>, words array<array<int>>"
_SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int32()), ("node", pa.binary()), ("up", pa.binary()), *[(n, pa.int64()) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], ("ends", pa.string()), ("keys", pa.list_(pa.binary())), ("words", pa.list_(pa.list_(pa.int32())))])
_NO_ENDS = hashlib.sha256(b"").hexdigest()

Row = tuple[bytes, int, list[int]]


def sequences(conversations: DataFrame, openings: bool = False) -> DataFrame:
    """conv_id, key, words: the turns' digests end to end, and the words of each turn.

    Turns are ordered by ``turn``, null first, and turns with one number by digest; a null role or text is empty. With
    ``openings`` every conversation c is rebuilt: the first h turns of conversation c - c % 20 (all if fewer, none if it is
    absent), then its own after its first h; h is crc32 of the decimal id modulo 4. Rows with a null conv_id take no part.
    One row holds a conversation's digests, 20 bytes a turn.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    c = F.col("conv_id").cast("long")
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * WIDTH)
    turns = conversations.select((c - c % 20).alias("base"), c.alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words")).alias("t")).where("conv_id is not null")
    # a conversation and the one it opens with meet by base: at most 20 conversations
    own = turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    if openings:
        lent = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, 3))).over(Window.partitionBy("base"))
        h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
        own = own.withColumn("lent", F.coalesce(lent, F.slice("own", 1, 0))).withColumn("own", F.concat(F.slice("lent", F.lit(1), h), F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))))
    return own.select("conv_id", F.unhex(F.array_join("own.digest", "")).alias("key"), F.col("own.words").alias("words"))


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two keys begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // WIDTH


def prefix_digests(key: bytes) -> list[bytes]:
    """The digest of every prefix of a key, from none of its turns to all."""
    running, out = hashlib.sha256(), []
    for k in range(len(key) // WIDTH + 1):
        running.update(key[WIDTH * (k - 1) : WIDTH * k] if k else b"")
        out.append(running.digest()[:WIDTH])
    return out


class _Component:
    """Neighbouring rows that share their first ``top`` turns.

    ``sons`` are the children counted here; ``orphans`` are finished nodes whose parent is the node at ``top``.
    """

    __slots__ = ("first", "last", "least", "leaves", "n", "orphans", "saved", "sons", "top")

    def __init__(self, first: int, last: int, top: int, n: int, least: int, leaves: int):
        self.first, self.last, self.top, self.n, self.least, self.leaves = first, last, top, n, least, leaves
        self.saved = self.sons = 0
        self.orphans: list[list] = []


class BlockForest:
    """The nodes of a block of sorted rows, given the turns that its first row shares with the row before it in the task
    and its last one with the row after it (-1 where there is none)."""

    def __init__(self, rows: list[Row], before: int, after: int):
        self.rows, self.before = rows, before
        self.depth = [len(key) // WIDTH for key, _, _ in rows]
        self.paths = prefix_digests(rows[0][0]), prefix_digests(rows[-1][0])
        #: conv_id, depth, parent's conv_id, parent's digest if it isn't finished, members, children, leaves, saved, ends
        self.closed: list[list] = []
        #: digest, parent's digest, and the same numbers as parts
        self.open: list[list] = []
        keys = [key for key, _, _ in rows]
        shared = [common_turns(a, b) for a, b in zip(keys, keys[1:], strict=False)]
        root, of = list(range(len(rows))), []
        for k, (_, conv, _) in enumerate(rows):
            follows = shared[k] if k < len(shared) else after
            of.append(_Component(k, k, self.depth[k], 1, conv, int(follows < self.depth[k])))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        for edge in np.argsort(-np.array(shared, np.int64), kind="stable").tolist():
            a, b, at = find(edge), find(edge + 1), shared[edge]
            x, y = of[a], of[b]
            new = _Component(x.first, y.last, at, x.n + y.n, min(x.least, y.least), x.leaves + y.leaves)
            for part in (x, y):
                self.raise_to(part, at, new)
            root[b] = a
            of[a], of[b] = new, None
        self.raise_to(of[find(0)], -1, None)

    def raise_to(self, c: _Component, floor: int, into: _Component | None) -> None:
        """Emit the nodes of a component above ``floor``, where it becomes a part of ``into``."""
        first, key_words = c.first, self.rows[c.first][2]
        opens = first == 0 or c.last == len(self.rows) - 1
        path = self.paths[0] if first == 0 else self.paths[1]
        son, orphans = None, c.orphans
        for d in range(c.top, floor, -1):
            if d < c.top:
                c.sons = int(self.new(c, d + 1))
            if d:
                c.saved += (c.n - self.new(c, d)) * key_words[d - 1]
            ends = self.ends(c, d)
            if opens:
                self.open.append([path[d], path[d - 1] if d else None, c.least, d, c.n, c.sons, c.leaves, c.saved, ",".join(map(str, ends)) if ends else None])
                for x in orphans:
                    x[3] = path[d]
                orphans = []
            else:
                said = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest() if ends else _NO_ENDS
                son = [c.least, d, None, None, c.n, c.sons, c.leaves, c.saved, said]
                for x in orphans:
                    x[2] = c.least
                self.closed.append(son)
                orphans = [son]
        if into:
            if c.top > floor:
                into.sons += self.new(c, floor + 1)
            else:
                into.sons += c.sons
            into.saved += c.saved
            if len(into.orphans) < len(orphans):
                into.orphans, orphans = orphans, into.orphans
            into.orphans += orphans

    def new(self, c: _Component, depth: int) -> bool:
        """Whether the node at a depth of this component isn't known from the row before the block."""
        return c.first > 0 or depth > self.before

    def ends(self, c: _Component, depth: int) -> list[int]:
        """The conversations that end at a node: they come first in its component, by id."""
        out, k = [], c.first
        while depth == c.top and k <= c.last and self.depth[k] == depth:
            out.append(self.rows[k][1])
            k += 1
        return out


def _batch(kind: int, part: int, block: int, **columns: list) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    columns |= {"kind": [kind] * n, "part": [part] * n, "block": [block] * n}
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)


_NUMBERS = ("n_convs", "n_children", "n_leaves", "saved_tokens", "ends")


def _block_rows(forest: BlockForest, part: int, block: int) -> Iterator[pa.RecordBatch]:
    if forest.closed:
        conv, depth, parent, up, *numbers = zip(*forest.closed, strict=True)
        yield _batch(0, part, block, conv_id=conv, depth=depth, parent_conv_id=parent, up=up, **dict(zip(_NUMBERS, numbers, strict=True)))
    node, up, conv, depth, *numbers = zip(*forest.open, strict=True)
    yield _batch(1, part, block, node=node, up=up, conv_id=conv, depth=depth, **dict(zip(_NUMBERS, numbers, strict=True)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Row]]:
    rows: list[Row] = []
    turns = 0
    for batch in batches:
        for key, conv, words in zip(*(batch.column(c).to_pylist() for c in ("key", "conv_id", "words")), strict=True):
            rows.append((key, conv, words))
            turns += len(words)
            if len(rows) >= BLOCK_ROWS or turns >= BLOCK_TURNS:
                yield rows
                rows, turns = [], 0
    if rows:
        yield rows


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept(("prefix_trie",), object)
    part, before, rows, block, first = TaskContext.get().partitionId(), -1, None, 0, None
    for following in _blocks(batches):
        first = first or following[0]
        if rows:
            after = common_turns(rows[-1][0], following[0][0])
            yield from _block_rows(BlockForest(rows, before, after), part, block)
            before, block = after, block + 1
        rows = following
    if rows:
        yield from _block_rows(BlockForest(rows, before, -1), part, block)
        yield _batch(2, part, 0, keys=[[first[0], rows[-1][0]]], words=[[first[2], rows[-1][2]]])


def _boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is counted twice where one task's last row and the next one's first share turns."""
    for batch in batches:
        for last, first, words in zip(*(batch.column(c).to_pylist() for c in ("last", "first", "words")), strict=True):
            n = common_turns(last, first)
            saved = [0] * (n + 2)
            for d in range(n, 0, -1):
                saved[d] = saved[d + 1] + words[d - 1]
            saved[0] = saved[1]
            went_on = len(last) == n * WIDTH
            depths = range(n + 1)
            path = prefix_digests(first[: n * WIDTH])
            yield pa.RecordBatch.from_arrays(
                [pa.array(path, pa.binary()), pa.array([-int(d < n) for d in depths], pa.int64()), pa.array([-int(went_on)] * (n + 1), pa.int64()), pa.array(saved[: n + 1], pa.int64())],
                names=["node", "n_children", "n_leaves", "saved_tokens"],
            )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node, which come one behind the other; only one piece is held."""
    node, running = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([running.hexdigest()])], names=["node", "ends_sha256"])
    for batch in batches:
        for own, piece in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if own != node:
                if running:
                    yield row()
                node, running = own, hashlib.sha256(piece.encode())
            else:
                running.update(b"," + piece.encode())
    if running:
        yield row()


def trie(rows: DataFrame) -> DataFrame:
    """The nodes over (conv_id, key, words) as ``sequences`` gives them; ids must be distinct.

    conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens
    and ends_sha256. (conv_id, depth) names a node. No rows give no nodes.
    """
    spark = prepare(rows.sparkSession)
    ordered = rows.select("key", "conv_id", "words").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    forest = stored(ordered.mapInArrow(_forests, _FOREST), "prefix-forest")
    parts = forest.where("kind = 1")
    # one row a task: the only window without a partition
    edges = forest.where("kind = 2").select("part", "keys", "words")
    over = Window.orderBy("part")
    boundaries = edges.select(F.lag(F.col("keys")[1]).over(over).alias("last"), F.col("keys")[0].alias("first"), F.col("words")[0].alias("words")).where("last is not null")
    twice = boundaries.mapInArrow(_boundaries, "node binary, n_children long, n_leaves long, saved_tokens long")
    own = parts.select("node", "up", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.struct("part", "block").alias("place"))
    total = lambda c: F.sum(c).cast("long").alias(c)
    merged = own.unionByName(twice, allowMissingColumns=True).groupBy("node").agg(F.max("up").alias("up"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *map(total, ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.min("place").alias("place"))
    pieces = parts.where("ends is not null").select("node", "part", "block", "ends")
    ends = pieces.repartition("node").sortWithinPartitions("node", "part", "block").mapInArrow(_hashed, "node binary, ends_sha256 string")
    merged = stored(merged.join(ends, "node", "left"), "prefix-paths")
    # a parent's id, asked for by node and block, so that one with very many children is many keys
    ids = parts.select(F.col("node").alias("up"), "part", "block").join(merged.select(F.col("node").alias("up"), F.col("conv_id").alias("parent")), "up")
    columns = ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")
    finished = forest.where("kind = 0")
    inner = finished.where("up is null").select("conv_id", "depth", F.col("parent_conv_id").alias("parent"), *columns[2:], F.col("ends").alias("ends_sha256"))
    hanging = finished.where("up is not null").select("up", "part", "block", *columns, F.col("ends").alias("ends_sha256"))
    paths = merged.where("up is not null").select("up", "place.part", "place.block", *columns, F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"))
    joined = hanging.unionByName(paths).join(ids, ["up", "part", "block"]).drop("up", "part", "block")
    root = merged.where("up is null").select(*columns, F.lit(None).cast("long").alias("parent"), F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"))
    return inner.unionByName(joined).unionByName(root).select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), *columns[2:], "ends_sha256")


def prefix_trie(conversations: DataFrame, openings: bool = False) -> DataFrame:
    """The trie of whole conversations (``openings``: rebuilt as ``sequences`` says), one row a node.

    A node at depth d is a distinct sequence of the first d turns (role and text). conv_id: smallest member; n_convs:
    members, which begin with it; n_leaves: nodes without a child in its subtree, itself included; saved_tokens: over the
    subtree, (members - 1) times the words of the node's last text; ends_sha256: of the decimal ids of the members that
    end here, ascending and joined by commas (the hash of nothing if none does).

    Null conv_ids take no part; null roles and texts are empty; repeated turns count each; turns with one number are
    ordered by digest. A text of any length is one digest. Conversations without turns are members of the root. Further
    columns are not read. No conversation, no node. A hash over one node's ids is one stream by its nature: its ids come
    as pieces of a block each, and one piece is held at a time.
    """
    return trie(sequences(conversations, openings))



#: The rebuilt conversations' nodes in SQL: prefixes as lists, crc32 bit by bit, subtrees by all ancestors of a node.
ORACLE = r"""
WITH t AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, sha256(concat(strlen(r), ':', r, x))) AS turns,
    xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(c::VARCHAR, ''), lambda b: [ascii(b), 0, 0, 0, 0, 0, 0, 0]))),
      lambda v, b: xor(xor(v, b) >> 1, 3988292384 * (xor(v, b) & 1))), 4294967295) % 4 AS h
  FROM t GROUP BY c
), built AS (
  SELECT o.c, list_concat(coalesce(b.turns, [])[1:o.h], o.turns[o.h + 1:]) AS turns FROM own o LEFT JOIN own b ON b.c = o.c - o.c % 20
), p AS (
  SELECT c, turns, unnest(range(len(turns) + 1)) AS d FROM built
), node AS (
  SELECT d, turns[1:d] AS k, min(c) AS conv_id, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(turns) = d), '') AS ends
  FROM p GROUP BY d, turns[1:d]
), child AS (
  SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL
), valued AS (
  SELECT node.*, coalesce(child.n, 0) AS n_children, CASE WHEN node.d = 0 THEN 0 ELSE (node.n - 1) * len(regexp_extract_all(node.k[node.d].x, '[^\x20\x09-\x0D]+')) END AS own
  FROM node LEFT JOIN child ON child.d = node.d AND child.k = node.k
), up AS (
  SELECT k, own, n_children, unnest(range(d + 1)) AS a FROM valued
), below AS (
  SELECT a AS d, k[1:a] AS k, sum(own) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves FROM up GROUP BY a, k[1:a]
)
SELECT v.conv_id, v.d AS depth, q.conv_id AS parent_conv_id, v.n AS n_convs, v.n_children, b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM valued v JOIN below b ON b.d = v.d AND b.k = v.k LEFT JOIN node q ON q.d = v.d - 1 AND q.k = v.k[1:v.d - 1]
"""

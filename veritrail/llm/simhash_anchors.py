"""SimHash near-duplicates by anchor-point covering.

The 64 bits are cut into blocks; of two fingerprints that differ in at most d bits, some block differs in at most
t = d // blocks. The anchors of a block are the words of a covering code: a perfect Hamming code on the first 2^r - 1
bits times all words on the rest, so every block word has its *home* anchor at distance 1 or less. By the triangle
inequality, whoever lies within t of a word lies within 1 + t of its home. So each fingerprint is a resident of one
anchor per block and a visitor of every anchor within 1 + t, and residents are compared with visitors per anchor. The
search is exact.

Replicas and comparisons trade off. With 3 blocks (r = 4, t = 1) a fingerprint makes about 46 rows and meets 3.3e-4
of all fingerprints; with 2 blocks (r = 5, t = 2) about 344 rows and 2.6e-6 of all. `blocks_for` picks by the number of
distinct fingerprints; both are complete.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import prepare, stored
from .batches import doc_columns, kept, map_batches
from .graph import components, forest

WORDS = 4
BITS = 4
SEED = 42
#: Residents of one anchor that one task compares; an anchor with more is dealt out in parts of this size.
RESIDENTS = 16_384
#: Pairs compared in one numpy step.
STEP = 2_000_000
ROWS = 65_536


def fingerprint(text: str, words: int = WORDS) -> int:
    """Bits set in over half of the shingle hashes, repeats included. No words: zero."""
    own = text.encode().lower().split()  # bytes: lower() changes A-Z only, split() cuts at 0x20 and 0x09-0x0D only
    if not own:
        return 0
    n = max(1, len(own) - words + 1)
    joined = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(words, len(own)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, stops, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 8192):
        ones += np.unpackbits(h[k : k + 8192].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the 64 bits as a long). A null text has no words."""
    prepare(docs.sparkSession)

    def convert(batch: pa.RecordBatch) -> dict:
        kept(("simhash",), dict)  # what an operator before this one kept goes
        fps = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": pa.array(fps.view(np.int64))}

    return map_batches(doc_columns(docs), lambda: convert, "doc_id long, fp long")


class Covering:
    """Anchors of one block of ``width`` bits from bit ``shift`` on."""

    def __init__(self, number: int, shift: int, width: int, r: int, within: int):
        self.number, self.shift, self.width, self.r = number, np.uint64(shift), width, r
        self.code = (1 << r) - 1
        self.masks = [np.uint64(sum(1 << (c - 1) for c in range(1, self.code + 1) if c >> k & 1)) for k in range(r)]
        # flips of up to `within` bits, to be applied to a word; those that give a code word lead to anchors
        flips = [(), *(c for n in range(1, within + 1) for c in combinations(range(width), n))]
        self.flip = np.array([sum(1 << b for b in f) for f in flips], np.uint64)
        syndrome = [0] * len(flips)
        for k, f in enumerate(flips):
            for b in f:
                syndrome[k] ^= b + 1 if b < self.code else 0
        of = np.array(syndrome)
        self.by_syndrome = [self.flip[of == s] for s in range(1 << r)]

    def words(self, fps: np.ndarray) -> np.ndarray:
        return fps >> self.shift & np.uint64((1 << self.width) - 1)

    def syndromes(self, words: np.ndarray) -> np.ndarray:
        """The place (from 1) of the code bit to flip, 0 for a code word."""
        s = np.zeros(len(words), np.int64)
        for k, mask in enumerate(self.masks):
            s |= (np.bitwise_count(words & mask) & 1).astype(np.int64) << k
        return s

    def key(self, anchors: np.ndarray) -> np.ndarray:
        return (anchors | np.uint64(self.number << 40)).view(np.int64)

    def homes(self, fps: np.ndarray) -> np.ndarray:
        words = self.words(fps)
        s = self.syndromes(words)
        return self.key(words ^ np.where(s > 0, np.uint64(1) << np.maximum(s - 1, 0).astype(np.uint64), np.uint64(0)))

    def visits(self, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """keys and fingerprints: every anchor within reach of each."""
        words = self.words(fps)
        s = self.syndromes(words)
        for value, flip in enumerate(self.by_syndrome):
            if len(at := np.flatnonzero(s == value)):
                yield self.key((words[at][:, None] ^ flip[None, :]).ravel()), np.repeat(fps[at], len(flip))


def coverings(blocks: int, bits: int = BITS) -> list[Covering]:
    edges = [64 * k // blocks for k in range(blocks + 1)]
    r = 5 if blocks <= 2 else 4
    return [Covering(k, a, b - a, r if b - a >= (1 << r) - 1 else 3, 1 + bits // blocks) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


#: Distinct fingerprints from which two wide blocks cost less than three narrow ones.
MANY = 200_000_000


def blocks_for(n: int, many: int = MANY) -> int:
    return 3 if n < many else 2


class Matcher:
    """Compares residents with visitors in rows sorted by key, residents first."""

    def __init__(self, bits: int, limit: int | None):
        self.bits, self.limit = bits, limit
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []
        self.held = 0

    def link(self, residents: np.ndarray, visitors: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        """Visitor k meets residents first[k] .. first[k] + count[k] - 1."""
        done = np.concatenate(([0], np.cumsum(count)))
        k = 0
        while k < len(visitors):
            stop = max(k + 1, int(np.searchsorted(done, done[k] + STEP, "right")) - 1)
            n = count[k:stop]
            v = np.repeat(visitors[k:stop], n)
            r = residents[np.repeat(first[k:stop] - (done[k:stop] - done[k]), n) + np.arange(done[stop] - done[k])]
            near = (np.bitwise_count((v ^ r).view(np.uint64)) <= self.bits) & (r < v)
            if near.any():
                self.a.append(r[near])
                self.b.append(v[near])
                self.held += int(near.sum())
                if self.held > STEP:
                    self.fold()
            k = stop

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate(self.a), np.concatenate(self.b)) if self.a else (np.zeros(0, np.int64),) * 2
        a, b = forest(a, b) if len(a) else (a, b)
        self.a, self.b, self.held = [a], [b], 0
        return a, b

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links as rows (key null, a, b); rows of anchors over the limit come back as (key, a = fp, b = 1 or 0)."""
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def rows(key: np.ndarray | None, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()) if key is None else pa.array(key), pa.array(a), pa.array(b)], names=["key", "a", "b"])

        residents, of_key, over = np.zeros(0, np.int64), None, False  # what is carried of the last key
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "home")))
            n += batch.num_rows
            if n < ROWS:
                continue
            residents, of_key, over, out = self.block(held, residents, of_key, over)
            held, n = [], 0
            if out:
                yield rows(*out)
        if held:
            *_, out = self.block(held, residents, of_key, over)
            if out:
                yield rows(*out)
        a, b = self.fold()
        for k in range(0, len(a), ROWS):
            yield rows(None, a[k : k + ROWS], b[k : k + ROWS])

    def block(self, held: list[tuple[np.ndarray, ...]], residents: np.ndarray, of_key: int | None, over: bool) -> tuple:
        key, fp, home = (np.concatenate(x) for x in zip(*held, strict=True))
        home = home.astype(bool)
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        n_home = np.add.reduceat(home.astype(np.int64), starts)
        carried = len(residents) if of_key == key[0] else 0
        if of_key != key[0]:
            over = False
        pool = np.concatenate((residents[:carried], fp[home]))
        n_home[0] += carried
        first = np.concatenate(([0], np.cumsum(n_home)))[:-1]
        group = np.repeat(np.arange(len(starts)), np.diff(np.concatenate((starts, [len(key)]))))
        out = None
        is_over = np.zeros(len(starts), bool)
        if self.limit is not None:
            is_over = n_home > self.limit
            is_over[0] |= over
            if is_over.any():
                at = is_over[group]
                k, a, b = key[at], fp[at], home[at].astype(np.int64)
                if is_over[0] and carried and not over:  # the carried residents of a key that turns out to be over
                    k, a, b = np.concatenate((np.full(carried, key[0]), k)), np.concatenate((residents[:carried], a)), np.concatenate((np.ones(carried, np.int64), b))
                out = k, a, b
        v = np.flatnonzero(~home & ~is_over[group] & (n_home[group] > 0))
        self.link(pool, fp[v], first[group[v]], n_home[group[v]])
        last = pool[first[-1] :] if not is_over[-1] else np.zeros(0, np.int64)
        return last, key[-1], bool(is_over[-1]), out


def _matched(rows: DataFrame, keys: list[str], bits: int, limit: int | None) -> DataFrame:
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, F.desc("home"))
    key = F.col("key") if len(keys) == 1 else F.xxhash64(*keys)
    return ordered.select(key.alias("key"), "fp", "home").mapInArrow(lambda it: Matcher(bits, limit).run(it), "key long, a long, b long")


def near_links(nodes: DataFrame, bits: int = BITS, blocks: int = 3) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp): they connect just those that pairs within ``bits`` connect.

    An anchor hands on a forest of its links, not its pairs. Anchors with very many residents come back from the first
    pass undone and are dealt out again: residents in parts, visitors to each part.
    """

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = coverings(blocks, bits)
        make = lambda key, fp, home: pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp.view(np.int64)), pa.array(np.full(len(key), home))], names=["key", "fp", "home"])
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for code in codes if len(fps) else ():
                yield make(code.homes(fps), fps, True)
                for key, visitor in code.visits(fps):
                    yield make(key, visitor, False)

    rows = nodes.select("fp").mapInArrow(dealt, "key long, fp long, home boolean")
    first = stored(_matched(rows, ["key"], bits, RESIDENTS), "anchor-links")
    again = first.where("key is not null").select("key", F.col("a").alias("fp"), (F.col("b") == 1).alias("home"))
    parts = again.groupBy("key").agg(F.ceil(F.count_if("home") / RESIDENTS).cast("int").alias("n"))
    sized = again.join(parts, "key")
    part = F.when(F.col("home"), F.array(F.expr("pmod(xxhash64(fp), n)").cast("int"))).otherwise(F.expr("sequence(0, n - 1)"))
    rest = _matched(sized.select("key", "fp", "home", F.explode(part).alias("part")), ["key", "part"], bits, None)
    return first.where("key is null").select("a", "b").unionByName(rest.select("a", "b"))


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS, many: int = MANY) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links, itself included).

    Copies share a fingerprint and collapse to one node before anything is compared. Texts without words share
    fingerprint zero. Rows with a null doc_id take part; a component of such rows alone has a null component_id. Repeated
    rows come back repeated; texts may be of any length; further columns are not read. ``many``: see ``MANY``; both ways
    give the same result.
    """
    own = stored(fingerprints(docs, words), "fingerprints")
    nodes = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-nodes")
    links = near_links(nodes, bits, blocks_for(nodes.count(), many))
    root = components(links).withColumnRenamed("node", "fp")
    linked = root.join(nodes, "fp")
    lowest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    known = root.join(lowest, "root").select("fp", "component_id")
    # stored, so that the last join has nothing but its two exchanges below it and a frequent fingerprint can be split
    of_node = stored(nodes.join(known, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "fingerprint-components")
    return own.join(of_node, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

"""Benchmark decontamination as a prefix-filtered set join.

The sets to find are the windows of the benchmark: ten consecutive words of an item, or all words of a shorter one. A
window's elements are its shingles (three words, or fewer in shorter windows). A window occurs only if all its shingles
do, so a prefix of one is enough: its rarest shingle, by counts over all documents. Places of that shingle in a document
are joined with the windows that have it as prefix; the window must fit between the document's ends when laid there
(length and position), and then its words are compared one by one.

The benchmark, not the corpus, is held in memory: in blocks of at most ``BLOCK_WINDOWS`` windows, each a broadcast of
bounded size. Documents are scanned in place and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import prepare, stored
from .batches import map_batches
from .word_hashes import Words, shingles

WINDOW = 10
SHINGLE = 3
BLOCK_WINDOWS = 200_000
#: Documents whose words are hashed together.
TOGETHER = 1 << 20


def _groups(texts: list[bytes]) -> Iterator[slice]:
    """Runs of texts of about TOGETHER bytes."""
    k = size = 0
    for stop, t in enumerate(texts, 1):
        size += len(t)
        if size >= TOGETHER or stop == len(texts):
            yield slice(k, stop)
            k, size = stop, 0


class Lookup:
    """A set of hashes: a bitmap rules most values out before the binary search."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.some = np.zeros(1 << 20, bool)
        self.some[self.values & np.uint64(0xFFFFF)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h that hold a value of the set, and which value each holds."""
        at = np.flatnonzero(self.some[h & np.uint64(0xFFFFF)])
        if not len(self.values) or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
        hit = self.values[k] == h[at]
        return at[hit], k[hit]


class Windows:
    """The distinct windows of some items."""

    def __init__(self, items: list[tuple[str | None, str]], window: int, shingle: int):
        found: dict[bytes, set] = defaultdict(set)
        hashes: dict[bytes, np.ndarray] = {}
        for item_id, text in items:
            w = Words([(text or "").encode()])
            n = min(window, len(w.hash))
            for k in range(len(w.hash) - n + 1 if n else 0):
                words = w.joined(k, n)
                hashes[words] = w.hash[k : k + n]
                found[words].add(item_id)
        self.words = list(found)
        self.items = [sorted(x for x in found[g] if x is not None) for g in self.words]
        self.length = np.array([len(hashes[g]) for g in self.words], np.int64)
        self.shingle = np.minimum(self.length, shingle)
        self.elements = [shingles(hashes[g], int(n)) for g, n in zip(self.words, self.shingle, strict=True)]
        self.hashes = np.zeros((len(self.words), window), np.uint64)
        for k, g in enumerate(self.words):
            self.hashes[k, : self.length[k]] = hashes[g]

    def by_size(self) -> dict[int, Lookup]:
        return {int(n): Lookup(np.concatenate([e for e, m in zip(self.elements, self.shingle, strict=True) if m == n])) for n in np.unique(self.shingle)}

    def prefixes(self, counts: dict[tuple[int, int], int]) -> dict[int, tuple]:
        """By shingle size: the rarest shingles, and for each the windows it is the prefix of and its place in them."""
        out = {}
        for n in map(int, np.unique(self.shingle)):
            own = np.flatnonzero(self.shingle == n)
            place = np.array([min(range(len(self.elements[k])), key=lambda j: (counts.get((n, int(self.elements[k][j])), 0), j)) for k in own], np.int64)
            rarest = np.array([self.elements[k][j] for k, j in zip(own, place, strict=True)], np.uint64)
            look = Lookup(rarest)
            which = np.searchsorted(look.values, rarest)
            order = np.argsort(which, kind="stable")
            starts = np.searchsorted(which[order], np.arange(len(look.values) + 1))
            out[n] = look, starts, own[order], place[order]
        return out


def _shingle_counts(docs: DataFrame, lookups: object) -> dict[tuple[int, int], int]:
    """How often each shingle of the benchmark block occurs in all documents: no more rows than the block has shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lookups.value
        counts = {n: np.zeros(len(look.values), np.int64) for n, look in own.items()}
        for batch in batches:
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            for part in _groups(texts):
                w = Words(texts[part])
                for n, look in own.items():  # a shingle across two texts may be counted: rarity is an order, not a result
                    _, k = look.find(shingles(w.hash, n))
                    counts[n] += np.bincount(k, minlength=len(counts[n]))
        for n, look in own.items():
            at = np.flatnonzero(counts[n])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, np.int32)), pa.array(look.values[at].view(np.int64)), pa.array(counts[n][at])], names=["size", "shingle", "n"])

    rows = docs.select("text").mapInArrow(run, "size int, shingle long, n long").groupBy("size", "shingle").agg(F.sum("n").alias("n"))
    return {(r["size"], r["shingle"] & (1 << 64) - 1): r["n"] for r in rows.toLocalIterator()}


def _mark(w: Words, windows: Windows, prefixes: dict[int, tuple], hits: np.ndarray, items: list[set]) -> None:
    """Mark the words of w that stand in an occurrence of a window, and collect the items by text."""
    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    for n, (look, starts, own, place) in prefixes.items():
        at, k = look.find(shingles(w.hash, n))
        count = starts[k + 1] - starts[k]
        pos = np.repeat(at, count)
        which = np.repeat(starts[k] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        window, begin = own[which], pos - place[which]
        d = doc[pos] if len(pos) else pos
        fits = (begin >= w.first[d]) & (begin + windows.length[window] <= w.first[d + 1])
        window, begin, d = window[fits], begin[fits], d[fits]
        for j in range(windows.hashes.shape[1]):
            inside = windows.length[window] > j
            same = ~inside
            same[inside] = w.hash[begin[inside] + j] == windows.hashes[window[inside], j]
            window, begin, d = window[same], begin[same], d[same]
        for g, b, x in zip(window.tolist(), begin.tolist(), d.tolist(), strict=True):
            m = int(windows.length[g])
            if w.joined(b, m) == windows.words[g]:
                hits[b : b + m] = True
                items[x].update(windows.items[g])


def _blocks(benchmark: DataFrame, block: int) -> Iterator[list[tuple]]:
    """Items in blocks of about ``block`` windows at most (an item's windows are fewer than its characters)."""
    own = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // block) or 1
    if n == 1:
        yield list(map(tuple, own.collect()))
        return
    dealt = stored(own.withColumn("block", F.expr(f"pmod(xxhash64(text), {n})")), "benchmark-blocks")
    for k in range(n):
        yield list(map(tuple, dealt.where(F.col("block") == k).select("item_id", "text").collect()))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document.

    A null or empty text has no words; an item without words has no window; an empty benchmark hits nothing. Repeated
    items and windows count once, repeated documents each for itself. Item ids may be of any type and are listed as
    strings; an item with a null id hits words but is not listed. Of equally rare shingles the first is the prefix. Texts
    of any length are one row of a batch. Columns of docs named in ``carry`` pass through, no others are read.
    """
    spark = prepare(docs.sparkSession)
    state = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.lit(None).cast("binary").alias("hits"), F.array().cast("array<string>").alias("items"), *carry)
    source = state
    for number, items in enumerate(_blocks(benchmark, BLOCK_WINDOWS * 8)):
        if number:
            state = stored(state, "contamination")
        windows = Windows(items, window, shingle)
        counts = _shingle_counts(source, spark.sparkContext.broadcast(windows.by_size())) if windows.words else {}
        held = spark.sparkContext.broadcast((windows, windows.prefixes(counts)))

        def make(held: object = held) -> object:
            windows, prefixes = held.value

            def convert(batch: pa.RecordBatch) -> dict:
                texts = [t.encode() for t in batch.column("text").to_pylist()]
                old, listed, marked = batch.column("hits").to_pylist(), batch.column("items").to_pylist(), []
                for part in _groups(texts):
                    w = Words(texts[part])
                    hits, found = np.zeros(len(w.hash), bool), [set(x) for x in listed[part]]
                    _mark(w, windows, prefixes, hits, found)
                    for k, (x, before) in enumerate(zip(found, old[part], strict=True)):
                        own = hits[w.first[k] : w.first[k + 1]]
                        if before is not None:
                            own = own | np.unpackbits(np.frombuffer(before, np.uint8), count=len(own)).astype(bool)
                        marked.append((len(own), int(own.sum()), np.packbits(own).tobytes(), sorted(x)))
                return {
                    "doc_id": batch.column("doc_id"),
                    "text": batch.column("text"),
                    "hits": pa.array([m[2] for m in marked], pa.binary()),
                    "items": pa.array([m[3] for m in marked], pa.list_(pa.string())),
                    "n_words": pa.array([m[0] for m in marked], pa.int64()),
                    "n_hit": pa.array([m[1] for m in marked], pa.int64()),
                    "items_sha256": pa.array([hashlib.sha256(",".join(m[3]).encode()).hexdigest() for m in marked]),
                }

            return convert

        state = map_batches(state.select("doc_id", "text", "hits", "items", *carry), make, "doc_id long, text string, hits binary, items array<string>, n_words long, n_hit long, items_sha256 string", carry)
    return state.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), *carry)


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM iw WHERE len(w) > 0)),
dg AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
m AS (SELECT doc_id, k, n, item_id FROM dg JOIN win USING (g, n)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

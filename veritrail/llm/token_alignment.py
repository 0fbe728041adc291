"""Alignment of the tokens of two tokenizers over the same bytes.

Both id lists of a text get their cumulative byte ends. Two dictionaries lead from an end to the number of tokens that
lie before it; the ends that stand in both cut the text into groups, and the sorted common ends slice both id lists.
Within a slice every token of one side is linked with every token of the other.

Neither tokenizer has a token over a space between two other characters, so texts are cut there, and a distinct chunk
of a block of documents is encoded and aligned once. A link's weight is the number of documents that hold its id pair
anywhere in the corpus. That needs the whole corpus first, so there are two passes:

1. each task takes its documents in blocks of bounded text; per block it gives the distinct id pairs with the number of
   the block's documents that hold them, each chunk's links, and each document's chunks
2. Spark adds up the pairs' counts and finds the highest of each id; every block gets the counts of its own pairs back
   and sums them over its chunks and documents

So no row for a document's pair ever moves: what is shuffled is a block's distinct pairs and its packed documents.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import prepare, stored
from .batches import CUT, by_bytes, doc_columns, kept
from .token_counts import byte_letters

#: Bytes of text after which a block of documents is closed; a longer document makes a longer block.
BLOCK_BYTES = 4 << 20
#: Links of one slice that are expanded one by one; beyond, equal pairs are counted instead.
EXPANDED = 4096

_ROWS = "block long, pair int, a int, b int, n_docs int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, packed binary"
_SCHEMA = pa.schema([("block", pa.int64()), ("pair", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("n_docs", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("packed", pa.binary())])


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum())), n


def _lengths(pieces: list[bytes]) -> np.ndarray:
    return np.array([len(x) for x in pieces], np.int64)


class ByteLevel:
    """Ids of chunks, each with a space before it, by a byte-level BPE of the tokenizers library.

    Where the ids stand in the order of the merges, the rank encoder of tiktoken gives the same ids faster; any other
    byte-level vocabulary goes through its own library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("not a byte-level BPE with the usual pre-tokens and no normaliser")
        vocab, special = spec["model"]["vocab"], {x["content"] for x in spec.get("added_tokens", [])}
        of_letter = {c: b for b, c in enumerate(byte_letters())}
        own = {bytes(map(of_letter.__getitem__, piece)): k for piece, k in vocab.items() if piece not in special}
        self.bytes = [b""] * (1 + max(vocab.values()))
        for x, k in own.items():
            self.bytes[k] = x
        self.length = _lengths(self.bytes)
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if made == list(range(len(own) - len(made), len(own))):
            self.ranked, self.library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={}), None
        else:
            self.library = Tokenizer.from_file(path)
            self.library.encode_special_tokens = True

    def __call__(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks end to end, and how many each has."""
        if self.library:
            return _flat([e.ids for e in self.library.encode_batch([" " + x for x in chunks], add_special_tokens=False)])
        if any(x[:1].isspace() or x[-1:].isspace() or not x for x in chunks):
            return _flat([self.ranked.encode_ordinary(" " + x) for x in chunks])
        # without white space at their edges they may stand in one text: tokens end where chunks do
        ids = np.array(self.ranked.encode_ordinary(" " + " ".join(chunks)), np.int64)
        stops = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum([1 + len(x.encode()) for x in chunks])) + 1
        return ids, np.diff(stops, prepend=0)


class Pieces:
    """Ids of chunks by a sentencepiece model, which puts the space before a chunk itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(k) for k in range(self.library.get_piece_size())]
        if any(regex.search("[^▁]▁", x) for x in pieces):
            raise ValueError("a piece holds a space behind another character, so chunks depend on each other")
        self.bytes = [bytes([int(x[3:5], 16)]) if self.library.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(pieces)]
        self.length = _lengths(self.bytes)

    def __call__(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat(self.library.encode(chunks, num_threads=1))


def ragged(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each range, one range behind the other."""
    ends = np.cumsum(length)
    return np.repeat(first - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ascending ends of two lists, the numbers of elements of both before each common end."""
    of_a, of_b = dict(zip(a.tolist(), range(1, len(a) + 1), strict=True)), dict(zip(b.tolist(), range(1, len(b) + 1), strict=True))
    common = sorted(of_a.keys() & of_b.keys())
    return np.fromiter(map(of_a.__getitem__, common), np.int64, len(common)), np.fromiter(map(of_b.__getitem__, common), np.int64, len(common))


def slice_links(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """slice, pair as ``a << 32 | b`` and how often it stands there, of the slices of two id lists that end at the cuts."""
    n_a, n_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
    first_a, first_b, n = cut_a - n_a, cut_b - n_b, n_a * n_b
    small = np.flatnonzero(n <= EXPANDED)
    owner = np.repeat(small, n[small])
    within = ragged(np.zeros(len(small), np.int64), n[small])
    pairs = a[first_a[owner] + within // n_b[owner]] << 32 | b[first_b[owner] + within % n_b[owner]]
    owners, codes, times = [owner], [pairs], [np.ones(len(pairs), np.int64)]
    for k in np.flatnonzero(n > EXPANDED).tolist():
        (x, nx), (y, ny) = (np.unique(ids[f : f + m], return_counts=True) for ids, f, m in ((a, first_a[k], n_a[k]), (b, first_b[k], n_b[k])))
        codes.append((x[:, None] << 32 | y).ravel())
        times.append((nx[:, None] * ny).ravel())
        owners.append(np.full(len(codes[-1]), k))
    return np.concatenate(owners), np.concatenate(codes), np.concatenate(times)


#: What is known of a chunk: its groups, each with a semicolon behind it; n_a, n_b, n_groups and n_links as 64-bit
#: integers; its distinct links; how often each stands in it, if any does more than once. Packed into bytes, since a
#: worker holds hundreds of thousands of them.
Chunk = tuple[str, bytes, bytes, bytes]
#: A chunk of which a tokenizer changes bytes.
CHANGED: Chunk = ("", b"", b"", b"")

_NONE = np.zeros(0, np.int64)


class Aligner:
    """Alignment of chunks by two encoders."""

    def __init__(self, a: str, b: str):
        self.a, self.b = ByteLevel(a), Pieces(b)
        a_ids, b_ids = (list(map(str, range(len(x.bytes)))) for x in (self.a, self.b))
        #: Ids as they stand in groups: of a within a slice and at its end, then the same of b.
        self.said = [x + end for ids, ends in ((a_ids, ",|"), (b_ids, ",;")) for end in ends for x in ids]
        self.known: dict[str, Chunk] = {}

    def chunks(self, chunks: list[str]) -> list[Chunk]:
        if not chunks:
            return []
        own = [b" " + x.encode() for x in chunks]
        length = np.fromiter(map(len, own), np.int64, len(own))
        (a, n_a), (b, n_b) = self.a(chunks), self.b(chunks)
        stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
        good = np.ones(len(chunks), bool)
        for side, ids, n, stop in ((self.a, a, n_a, stop_a), (self.b, b, n_b, stop_b)):
            pieces = list(map(side.bytes.__getitem__, ids.tolist()))
            ends = np.concatenate(([0], np.cumsum(side.length[ids])))
            if not ((ends[stop] - ends[stop - n] == length).all() and b"".join(pieces) == b"".join(own)):
                good &= [b"".join(pieces[i:j]) == x for (i, j), x in zip(pairwise([0, *stop.tolist()]), own, strict=True)]
        if not good.all():
            found = iter(self.chunks([x for x, g in zip(chunks, good, strict=True) if g]))
            return [next(found) if g else CHANGED for g in good]
        # chunks end where both sides have an end, so one pass over all of them cuts each as if it stood alone
        cut_a, cut_b = common_ends(np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b]))
        of_slice = np.searchsorted(stop_a, cut_a)
        which, codes, times = slice_links(a, b, cut_a, cut_b)
        n_links = np.bincount(of_slice[which], times, len(chunks)).astype(np.int64)
        distinct, code = np.unique(codes, return_inverse=True)
        both, at = np.unique(of_slice[which] * len(distinct) + code, return_inverse=True)
        total = np.bincount(at, times, len(both)).astype(np.int64)
        edges = np.searchsorted(both // len(distinct), np.arange(len(chunks) + 1))
        plain = np.maximum.reduceat(total, edges[:-1]) == 1
        links, total = distinct[both % len(distinct)].tobytes(), total.tobytes()
        # the ids of both sides in the order of their slices
        size_a, size_b, order = len(self.a.bytes), len(self.b.bytes), np.empty(len(a) + len(b), np.int64)
        a[cut_a - 1] += size_a
        b[cut_b - 1] += size_b
        order[np.arange(len(a)) + np.repeat(np.concatenate(([0], cut_b[:-1])), np.diff(cut_a, prepend=0))] = a
        order[np.arange(len(b)) + np.repeat(cut_a, np.diff(cut_b, prepend=0))] = b + 2 * size_a
        said = list(map(self.said.__getitem__, order.tolist()))
        sizes = np.stack((n_a, n_b, np.bincount(of_slice, minlength=len(chunks)), n_links), 1).astype("<i8").tobytes()
        spans = zip(pairwise([0, *(stop_a + stop_b).tolist()]), pairwise((8 * edges).tolist()), range(0, len(sizes), 32), plain.tolist(), strict=True)
        return [("".join(said[i:j]), sizes[s : s + 32], links[k:m], b"" if ones else total[k:m]) for (i, j), (k, m), s, ones in spans]

    def block(self, chunks: list[str]) -> list[Chunk]:
        """The same, looking first among the chunks of the block before."""
        before = self.known
        found = {x: before[x] for x in chunks if x in before}
        missing = [x for x in chunks if x not in found]
        edged = [x for x in missing if x[:1].isspace() or x[-1:].isspace()]
        if edged:
            apart = set(edged)
            missing = [x for x in missing if x not in apart]
        for some in (missing, edged):
            for k in range(0, len(some), 25_000):
                found.update(zip(some[k : k + 25_000], self.chunks(some[k : k + 25_000]), strict=True))
        self.known = found
        return [found[x] for x in chunks]


class _Numbered(dict):
    """Numbers for keys in the order in which they first come."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of small numbers, compressed: the length of each, then their bytes plane by plane."""
    head = np.array([len(x) for x in arrays], "<u4")
    planes = [np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head.tobytes() + b"".join(planes))


def _unpacked(packed: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int.from_bytes(raw[:4], "little")
    out, at = [], 4 + 4 * n
    for size in np.frombuffer(raw, "<u4", n, 4).tolist():
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * size, at).reshape(8, size).T).view("<i8").ravel())
        at += 8 * size
    return out


def _table(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)


def align_block(aligner: Aligner, block: int, doc_ids: list[int | None], texts: list[str | None], digests: bool) -> Iterator[pa.RecordBatch]:
    """Rows of a block: its distinct pairs, its documents, and one row with the links of its chunks."""
    number = _Numbered()
    parts = [list(map(number.__getitem__, CUT.split(t))) if t else [] for t in texts]
    found = aligner.block(list(number))
    n = len(found)
    groups, sizes, links, times = zip(*found, strict=True) if found else ((), (), (), ())
    if CHANGED in found:
        bad = np.array([not x for x in sizes])
        parts = [[] if p and bad[p].any() else p for p in parts]
        sizes = [x or bytes(32) for x in sizes]
    sizes = np.frombuffer(b"".join(sizes), "<i8").reshape(-1, 4)
    n_parts = np.fromiter(map(len, parts), np.int64, len(parts))
    flat, doc = np.fromiter(chain.from_iterable(parts), np.int64, int(n_parts.sum())), np.repeat(np.arange(len(parts)), n_parts)
    totals = [np.bincount(doc, sizes[flat, k], len(parts)).astype(np.int64) for k in range(4)]
    # frequent chunks get small numbers, so that the steps between a document's numbers are small
    order, rank = np.argsort(-np.bincount(flat, minlength=n), kind="stable"), np.empty(n, np.int64)
    rank[order] = np.arange(n)
    both, often = np.unique(doc * max(1, n) + rank[flat], return_counts=True)
    owner, chunk = both // max(1, n), both % max(1, n)
    # the distinct pairs of the block, and the links of its chunks by number of the pair
    places = order.tolist()
    n_links = np.fromiter((len(links[k]) for k in places), np.int64, n) // 8
    first = np.cumsum(n_links) - n_links
    codes, of_link = np.unique(np.frombuffer(b"".join([links[k] for k in places]), np.int64), return_inverse=True)
    weights = np.ones(len(of_link), np.int64)
    for at in [at for at, k in enumerate(places) if times[k]]:
        weights[first[at] : first[at] + n_links[at]] = np.frombuffer(times[places[at]], np.int64)
    # documents that hold a pair, each once
    held = np.repeat(owner, n_links[chunk]) * max(1, len(codes)) + of_link[ragged(first[chunk], n_links[chunk])]
    held.sort()
    held = held[np.diff(held, prepend=-1) > 0]
    n_docs = np.bincount(held % max(1, len(codes)), minlength=len(codes))
    used = np.flatnonzero(n_docs)
    yield _table(len(used), block=pa.array(np.full(len(used), block), pa.int64()), pair=pa.array(used, pa.int32()), a=pa.array(codes[used] >> 32, pa.int32()), b=pa.array(codes[used] & 0xFFFFFFFF, pa.int32()), n_docs=pa.array(n_docs[used], pa.int32()))
    said = ["".join(map(groups.__getitem__, p))[:-1] for p in parts]
    if digests:
        said = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in said]
    edges = np.searchsorted(owner, np.arange(len(parts) + 1)).tolist()
    packed = [_packed(np.diff(chunk[i:j], prepend=0), often[i:j]) if j > i else None for i, j in pairwise(edges)]
    yield _table(len(parts), block=pa.array([block] * len(parts), pa.int64()), doc_id=pa.array(doc_ids, pa.int64()), groups=pa.array(said), packed=pa.array(packed, pa.binary()), **{n: pa.array(totals[k]) for k, n in enumerate(("n_a", "n_b", "n_groups", "n_links"))})
    yield _table(1, block=pa.array([block], pa.int64()), n_links=pa.array([-1], pa.int64()), packed=pa.array([_packed(n_links, of_link, weights)], pa.binary()))


def aligned(docs: DataFrame, a: str, b: str, digests: bool = True) -> DataFrame:
    """The stored first pass over whole texts: rows of pairs (``pair`` set), of documents and of blocks (``n_links`` -1)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part, nth = kept(("token_alignment", a, b), lambda: Aligner(a, b)), TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        texts: list[str | None] = []
        held = 0
        for batch in batches:
            for some in by_bytes(batch, BLOCK_BYTES):
                ids += some.column("doc_id").to_pylist()
                texts += some.column("text").to_pylist()
                held += pc.sum(pc.binary_length(some.column("text"))).as_py() or 0
                if held >= BLOCK_BYTES:
                    yield from align_block(aligner, part << 32 | nth, ids, texts, digests)
                    ids, texts, held, nth = [], [], 0, nth + 1
        if ids:
            yield from align_block(aligner, part << 32 | nth, ids, texts, digests)

    return stored(doc_columns(docs).mapInArrow(run, _ROWS), "token-alignment")


def lexicon(first_pass: DataFrame) -> DataFrame:
    """a, b, n_docs (documents that hold the pair linked), best (no other pair of this a has more)."""
    counts = first_pass.where("pair is not null").groupBy("a", "b").agg(F.sum("n_docs").cast("long").alias("n_docs"))
    # partners of one id are at most the other vocabulary's size
    return counts.withColumn("best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a")))


def _sum_block(packed: pa.Table, counted: pa.Table) -> pa.Table:
    about = packed.filter(pc.less(packed.column("n_links"), 0))
    docs = packed.filter(pc.greater_equal(packed.column("n_links"), 0))
    n_links, of_link, weights = _unpacked(about.column("packed")[0].as_py())
    size = 1 + max(of_link.max(initial=0), counted.column("pair").to_numpy().max(initial=0))
    n_docs, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    at = counted.column("pair").to_numpy()
    n_docs[at], best[at] = counted.column("n_docs").to_numpy(), counted.column("best").to_numpy(zero_copy_only=False)
    # integers throughout: differences of running sums are exact
    ends = np.cumsum(n_links)
    sums = []
    for value in (best, n_docs):
        running = np.concatenate(([0], np.cumsum(weights * value[of_link])))
        sums.append(running[ends] - running[ends - n_links])
    n_best, count_sum = [], []
    for x in docs.column("packed").to_pylist():
        steps, times = _unpacked(x) if x else (_NONE, _NONE)
        chunk = np.cumsum(steps)
        n_best.append(int(sums[0][chunk] @ times))
        count_sum.append(int(sums[1][chunk] @ times))
    return docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64())).append_column("groups", docs.column("groups"))


def scored(first_pass: DataFrame) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups."""
    pairs = first_pass.where("pair is not null").select("block", "pair", "a", "b")
    counted = pairs.join(lexicon(first_pass), ["a", "b"]).select("block", "pair", "n_docs", "best")
    packed = first_pass.where("pair is null").select(F.col("block").alias("own"), "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "packed")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return packed.groupBy("own").cogroup(counted.groupBy("block")).applyInArrow(_sum_block, out)


def token_alignment(docs: DataFrame, a: str | None = None, b: str | None = None, digests: bool = True) -> DataFrame:
    """Per document, for a byte-level BPE ``a`` and a sentencepiece model ``b`` over a space and the text:

    doc_id, n_a, n_b (tokens), n_groups, n_links (token pairs that share a group), n_best (links whose pair no other pair
    of the same a id exceeds in documents), count_sum (documents of the pair, over all links), groups: ``a1,a2|b1;a3|b2``,
    or its sha256 if ``digests``.

    A null or empty text has no tokens, nor has one of whose bytes a tokenizer changes any (``b`` writes a space as
    U+2581, so it changes that character): numbers are 0 and groups is ''. Special strings are plain text. Rows with a
    null or repeated doc_id are documents of their own, also for the counts; further columns are not read; an empty table
    gives an empty result. A long text makes a longer block. Links of a slice are counted by distinct pair where they
    are many, so a slice takes as much memory as it has distinct pairs.
    """
    return scored(aligned(docs, a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model"), digests))

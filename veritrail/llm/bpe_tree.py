"""Byte-level BPE as a tree reduction over a monoid of encodings.

A pre-token is halved down to short leaves, which are merged directly. Two neighbouring encodings are joined by
re-encoding a window of tokens around their border; the window grows until the tokens outside provably stay.

Why that proof is local. Call tokens x, y *compatible* if the direct encoding of their joined bytes is [x, y]. A
sequence of tokens in which all neighbours are compatible is the encoding of its bytes: suppose some merge crosses a
border between neighbours x and y, and take the first one. Until then each token's bytes have evolved on their own, and
the merges inside x and y came in the order in which they would come on the bytes of x and y alone, because that
order (lowest rank, then leftmost) does not depend on what stands around. So the same crossing merge would be the next
one there too, and x, y would not be compatible. Inside the halves and inside the window all neighbours are compatible
already, hence only the two borders of the window need the test.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from ..runtime import prepare
from .batches import REMEMBERED, EachChunk, Memory, doc_columns, kept, map_batches
from .token_counts import PRE_TOKEN

LEAF_BYTES = 8
NONE = 1 << 62
#: Tokens that a join takes together without halving again, when decoding.
LEAF_TOKENS = 512


class TreeEncoder:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.bytes_of[rank] = piece
        self.pairs: dict[tuple[int, int], bool] = {}
        self.leaves = Memory(self.direct)

    def direct(self, piece: bytes) -> list[int]:
        """Merge the lowest-ranked neighbours, leftmost first, until none has a rank."""
        n = len(piece)
        if n > 64:
            return self._direct_long(piece)
        get, cut = self.ranks.get, list(range(n + 1))
        rank = [get(piece[k : k + 2], NONE) for k in range(n - 1)]  # of the parts between cuts k, k + 1 and k + 2
        while rank and (best := min(rank)) != NONE:
            k = rank.index(best)
            del cut[k + 1], rank[k]
            if k < len(rank):
                rank[k] = get(piece[cut[k] : cut[k + 2]], NONE)
            if k:
                rank[k - 1] = get(piece[cut[k - 1] : cut[k + 1]], NONE)
        return [self.ranks[piece[a:b]] for a, b in pairwise(cut)]

    def _direct_long(self, piece: bytes) -> list[int]:
        """The same with a heap over a linked list: long windows stay near-linear."""
        n = len(piece)
        end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(k: int) -> None:
            if end[k] < n and (rank := self.ranks.get(piece[k : end[end[k]]])) is not None:
                heapq.heappush(heap, (rank, k, end[k], end[end[k]]))

        for k in range(n):
            offer(k)
        while heap:
            _, k, mid, stop = heapq.heappop(heap)
            if not alive[k] or end[k] != mid or end[mid] != stop:
                continue
            alive[mid] = False
            end[k] = stop
            if stop < n:
                prev[stop] = k
            offer(k)
            if prev[k] >= 0:
                offer(prev[k])
        return [self.ranks[piece[k : end[k]]] for k in range(n) if alive[k]]

    def compatible(self, x: int, y: int) -> bool:
        known = self.pairs.get((x, y))
        if known is None:
            if len(self.pairs) > 2 * REMEMBERED:
                self.pairs.clear()
            known = self.pairs[x, y] = self.direct(self.bytes_of[x] + self.bytes_of[y]) == [x, y]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the joined bytes of two encodings."""
        if not left or not right or self.compatible(left[-1], right[0]):
            return left + right
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = self.direct(b"".join(self.bytes_of[t] for t in left[-a:] + right[:b]))
            left_stays = a == len(left) or self.compatible(left[-a - 1], window[0])
            right_stays = b == len(right) or self.compatible(window[-1], right[b])
            if left_stays and right_stays:
                return left[: len(left) - a] + window + right[b:]
            a, b = a if left_stays else 2 * a, b if right_stays else 2 * b

    def tree(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF_BYTES:
            return self.leaves[piece]
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pre-token; one that is a token as a whole is that token, as in the library."""
        rank = self.ranks.get(piece)
        return [rank] if rank is not None else self.tree(piece)

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids, concatenated up the tree."""
        if len(ids) <= LEAF_TOKENS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class _Chunks:
    """Chunks to ids as bytes, by distinct pre-token."""

    def __init__(self, encoder: TreeEncoder):
        self.encoder = encoder
        self.known = Memory(lambda piece: array("I", encoder.encode(piece.encode())).tobytes())

    def __call__(self, chunk: str) -> bytes:
        self.known.age()
        self.encoder.leaves.age()
        return b"".join(map(self.known.__getitem__, PRE_TOKEN.findall(chunk)))


class Codec:
    """An encoder with its memories, and the bytes of ids."""

    def __init__(self, path: str):
        self.encoder = TreeEncoder(path)
        self.memory = EachChunk(_Chunks(self.encoder), 3 * REMEMBERED // 2)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [b"".join(x) for x in self.memory.values(texts)]

    def decode(self, ids: bytes | None) -> bytes:
        return self.encoder.decode(np.frombuffer(ids or b"", np.uint32).tolist())


RANKS = "byte_bpe_multi_50k.tiktoken"


def encode_texts(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id and ids (unsigned 32-bit little-endian, as binary) of every whole text; a null text counts as empty."""
    path = ranks or public_tokenizers.path(RANKS)
    prepare(docs.sparkSession)

    def make() -> object:
        codec = kept(("bpe_tree", path), lambda: Codec(path))
        return lambda batch: {"doc_id": batch.column("doc_id"), "ids": pa.array(codec.encode(batch.column("text").to_pylist()), pa.binary())}

    return map_batches(doc_columns(docs), make, "doc_id long, ids binary")


def decode_ids(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, ids and bytes (binary) of encoded texts; null ids count as none."""
    path = ranks or public_tokenizers.path(RANKS)
    prepare(encoded.sparkSession)

    def make() -> object:
        codec = kept(("bpe_tree", path), lambda: Codec(path))
        return lambda batch: {"doc_id": batch.column("doc_id"), "ids": batch.column("ids"), "bytes": pa.array([codec.decode(x) for x in batch.column("ids").to_pylist()], pa.binary())}

    return map_batches(encoded.select("doc_id", "ids"), make, "doc_id long, ids binary, bytes binary")


def bpe_digests(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, decode the ids, digest both. Nothing is shuffled.

    Both steps run in one Python worker, which holds the vocabulary once. Repeated rows and null ids are encoded each for
    itself; an empty or null text has no ids and the digest of no bytes; a text of any length is encoded whole. Further
    columns are not read; an empty table gives an empty result.
    """
    path = ranks or public_tokenizers.path(RANKS)
    prepare(docs.sparkSession)

    def make() -> object:
        codec = kept(("bpe_tree", path), lambda: Codec(path))

        def convert(batch: pa.RecordBatch) -> dict:
            n, digests, decoded = [], [], []
            texts = batch.column("text").to_pylist()
            for k in range(0, len(texts), 100):
                for ids in codec.encode(texts[k : k + 100]):
                    n.append(len(ids) // 4)
                    digests.append(hashlib.sha256(ids).hexdigest())
                    decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            return {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}

        return convert

    return map_batches(doc_columns(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

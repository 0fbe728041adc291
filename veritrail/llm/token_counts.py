"""Token counts by rank-synchronous merging of ragged arrays.

Distinct pre-tokens of a batch lie end to end in one array of symbols. In each round every sequence applies its own
lowest-rank pair at all of its places at once; sequences without a known pair leave. A symbol can only occur in pairs
of higher rank than the merge that made it (checked when the merges are loaded), so merging all places of the lowest
pair in one round gives what the library's one-at-a-time order gives.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..runtime import prepare
from .batches import REMEMBERED, ChunkMemory, doc_columns, kept, map_batches

#: The byte-level pre-token pattern with white space by its Unicode property, as the libraries have it.
PRE_TOKEN = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))

NO_PAIR = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Merges:
    """Merge ranks as sorted pair keys."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("not a byte-level BPE with the usual pre-tokens and no normaliser")
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        made = {a + b: rank for rank, (a, b) in reversed(list(enumerate(pairs)))}
        if any(made.get(x, -1) >= rank for rank, pair in enumerate(pairs) for x in pair):
            raise ValueError("a merge uses a symbol that a later merge makes")
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.of_byte = np.array([vocab[x] for x in byte_letters()], np.int64)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        if any(regex.search(r"\s", x) for x in self.special):
            raise ValueError("a special string holds white space, so texts can't be cut there")

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_PAIR)


def count_symbols(pieces: list[bytes], merges: Merges) -> np.ndarray:
    """The symbols that remain of each piece once no pair has a rank."""
    counts = np.zeros(len(pieces), np.int64)
    lengths = np.array([len(p) for p in pieces], np.int64)
    owner = np.flatnonzero(lengths)
    lengths = lengths[owner]
    symbols = merges.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
    while len(owner):
        ends = np.cumsum(lengths)
        starts = ends - lengths
        rank = np.full(len(symbols), NO_PAIR)
        if len(symbols) > 1:
            rank[:-1] = merges.rank(symbols[:-1], symbols[1:])
        rank[ends - 1] = NO_PAIR
        lowest = np.minimum.reduceat(rank, starts)
        row = np.repeat(np.arange(len(owner)), lengths)
        hit = (rank == lowest[row]) & (rank != NO_PAIR)
        # x x x: places of one pair that overlap are taken every other one, from the left
        at = np.flatnonzero(hit)
        if len(at):
            new_run = np.ones(len(at), bool)
            new_run[1:] = np.diff(at) > 1
            first = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            symbols[at] = merges.result[rank[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        lengths = lengths - np.bincount(row[at], minlength=len(owner))
        done = lowest == NO_PAIR
        counts[owner[done]] = lengths[done]
        keep &= ~done[row]
        symbols, owner, lengths = symbols[keep], owner[~done], lengths[~done]
    return counts


class Counter:
    """Tokens of chunks: special strings count one each, as the library finds them before anything else."""

    def __init__(self, path: str):
        self.merges, self.known = Merges(path), {}
        self.special = regex.compile("|".join(map(regex.escape, self.merges.special))) if self.merges.special else None

    def __call__(self, chunks: list[str]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        extra, pre = [0] * len(chunks), []
        for k, chunk in enumerate(chunks):
            if self.special and (parts := self.special.split(chunk))[1:]:
                extra[k] = len(parts) - 1
                pre.append([y for x in parts for y in PRE_TOKEN.findall(x)])
            else:
                pre.append(PRE_TOKEN.findall(chunk))
        if missing := list(set(chain.from_iterable(pre)).difference(self.known)):
            missing.sort(key=len)  # alike lengths finish in alike rounds
            for k in range(0, len(missing), 50_000):
                some = missing[k : k + 50_000]
                self.known.update(zip(some, count_symbols([x.encode() for x in some], self.merges).tolist(), strict=True))
        return [n + sum(map(self.known.__getitem__, p)) for n, p in zip(extra, pre, strict=True)]


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every whole text; a null text counts as empty.

    A narrow map: nothing is shuffled, repeated rows and null ids are counted each for itself. A text of any length is cut at
    spaces that no pre-token spans. Further columns are not read; an empty table gives an empty result.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    prepare(docs.sparkSession)

    def make() -> object:
        memory = kept(("token_counts", path), lambda: ChunkMemory(Counter(path)))

        def convert(batch: pa.RecordBatch) -> dict:
            texts = batch.column("text").to_pylist()
            n = [sum(x) for x in memory.values(texts)]
            return {"doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())}

        return convert

    return map_batches(doc_columns(docs), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

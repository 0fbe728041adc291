"""Arrow helpers and the cut of texts into chunks that tokenizers treat independently."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries of one generation of a worker's memory; two generations stay below a hundred MB.
REMEMBERED = 150_000

# A space between two characters that are not white space. No match of the usual pre-token patterns holds one
# anywhere but at its start, so cutting there changes no match.
CUT = re.compile(r" (?<=\S )(?=\S)")


def doc_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns an operator reads, so that further columns, whatever their names, can't clash with its own."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def spread(text: Column, chars: int, pieces: int = 10) -> Column:
    """At most about ``chars`` characters of a text: all of it, or pieces of one size from its beginning to its end."""
    size = max(1, chars // pieces)
    at = lambda k: F.floor((F.length(text) - size) * k / (pieces - 1)).cast("int") + 1
    return F.when(F.length(text) <= chars, text).otherwise(F.concat_ws("\n", *[F.substring(text, at(k), F.lit(size)) for k in range(pieces)]))


def boxed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text, the columns named in ``more`` that docs has, and ``row``: all columns of docs, out of the way of others."""
    return docs.select("doc_id", "text", *(c for c in more if c in docs.columns), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``mapInArrow`` with a function from a batch to columns by name. ``make`` runs once in each task.

    Columns named in ``carry`` pass through unchanged behind those of ``schema``.
    """
    fields = T.StructType(T.StructType.fromDDL(schema).fields + [df.schema[c] for c in carry])
    names = fields.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert = make()
        for batch in batches:
            if batch.num_rows:
                out = convert(batch) | {c: batch.column(c) for c in carry}
                yield pa.RecordBatch.from_arrays([out[n] for n in names], names=names)

    return df.mapInArrow(run, fields)


def by_bytes(batch: pa.RecordBatch, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``size`` bytes of text; a longer text makes a slice of its own."""
    k = held = 0
    for stop, n in enumerate(pc.binary_length(batch.column("text")).to_pylist(), 1):
        held += n or 0
        if held >= size or stop == batch.num_rows:
            yield batch.slice(k, stop - k)
            k, held = stop, 0


_kept: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept in this Python worker for its next task, until another operator's turn comes.

    Workers outlive a stage; one slot keeps the memories of several operators from adding up, and what it held goes
    back to the system. So an operator that keeps nothing large takes its turn too.
    """
    if key not in _kept:
        _kept.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
        _kept[key] = make()
    return _kept[key]


class Memory(dict):
    """Values by key, found when first asked for. What was not asked for during a generation or two is forgotten."""

    def __init__(self, find: Callable[[str], object], limit: int = REMEMBERED):
        self.find, self.limit, self.old = find, limit, {}

    def __missing__(self, key: str) -> object:
        value = self.old.get(key)
        if value is None:
            value = self.find(key)
        self[key] = value
        return value

    def age(self) -> None:
        """Begin a new generation if this one is full."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


class EachChunk:
    """What ``one`` gives for chunks of text, remembered within one Python worker."""

    def __init__(self, one: Callable[[str], object], limit: int = REMEMBERED):
        self.first, self.later = Memory(one, limit), Memory(lambda chunk: one(" " + chunk), limit)

    def values(self, texts: list[str]) -> list[list]:
        """For each text the values of its chunks, in order."""
        self.first.age()
        self.later.age()
        first, later = self.first, self.later.__getitem__
        return [[first[p[0]], *map(later, p[1:])] for p in map(CUT.split, texts)]


class ChunkMemory:
    """The same for a ``compute`` that takes many distinct chunks at once and returns a value for each."""

    def __init__(self, compute: Callable[[list[str]], Iterable]):
        self.compute, self.first, self.later = compute, Memory(None), Memory(None)

    def values(self, texts: list[str]) -> list[list]:
        """For each text the values of its chunks, in order."""
        parts = [CUT.split(t) for t in texts]
        self.first.age()
        self.later.age()
        for memory, lead, some in ((self.first, "", (p[:1] for p in parts)), (self.later, " ", (p[1:] for p in parts))):
            # one lookup a chunk: set operations with a dict's subclass or with the old generation would walk all of it
            missing = list({x for p in some for x in p if x not in memory})
            old = memory.old
            memory.update([(x, old[x]) for x in missing if x in old])
            if order := [x for x in missing if x not in old]:
                memory.update(zip(order, self.compute([lead + x for x in order]), strict=True))
        first, later = self.first, self.later
        return [[first[p[0]], *map(later.__getitem__, p[1:])] for p in parts]

"""Line dedup by a fixed-depth template tree.

A line of n tokens goes to the leaf (n, its first three tokens); tokens that hold a digit are variable fields and count
as ``<*>``. The tokens behind the first three are cut into bands of a fifth of n, and each band left open makes a template
of the line: lines of a leaf that agree outside one band, at 80 % of their tokens or more, share it. Lines under five
tokens have one template, without an open band. A template that occurs in two documents or more is recurring; a line with a
recurring template stays in the smallest document of its recurring templates and is dropped from all others: so the
corpus keeps every line once, and copies of a document don't erase each other. Of lines in a chain, each like the next,
at least one stays. ``keep_first=False`` drops recurring lines from all documents. Lines under three tokens are left
alone, they coincide by chance; ``min_tokens`` says so, and down to 1 every line takes part.

A template is a key that a line has or hasn't, whatever else is in its leaf: no order of lines and no size of a leaf
changes it. What moves is small: per distinct line form the 8-byte keys of its templates (six at most); per line its
leaf and form. Texts are joined once with the places to drop. With N line forms a line passes for a copy by accident with a
chance of at most 6 N / 2^64.

Forms are dealt by leaf and templates found where they arrive. A leaf with more than ``LEAF_FORMS`` forms is dealt out in
parts, and its templates are found by an aggregation over keys instead, in which no task sees a whole leaf.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import prepare, stored
from .batches import kept
from .word_hashes import mixed

DEPTH = 3
#: One in so many of a line's tokens may lie in the open band.
OPEN = 5
MIN_TOKENS = 3
#: Forms of a leaf that one task takes together, and of all leaves that it takes at once.
LEAF_FORMS, TOGETHER_FORMS = 8192, 50_000
#: Bytes of text taken apart together.
TOGETHER = 1 << 20
#: Lines whose forms a task sums up before it hands them on.
HELD_LINES = 400_000

_SPACES = bytes(0x20 if b in b"\t\x0b\x0c\r" else b for b in range(256))
_FIELD = np.uint64(0x5DEECE66D1234567)
_BASE, _INVERSE = 0x100000001B3, pow(0x100000001B3, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """Powers from 0 on, kept while this operator has its turn; those for a very long text are not kept."""
    tables = kept(("line_templates",), dict)
    if len(tables.get(base, ())) >= n:
        return tables[base][:n]
    p = np.full(max(n, TOGETHER + TOGETHER // 4), base, np.uint64)
    p[0] = 1
    p = np.cumprod(p, dtype=np.uint64)
    if n <= 2 * TOGETHER:
        tables[base] = p
    return p[:n]


def _running(x: np.ndarray) -> np.ndarray:
    """Sums of all before each place."""
    out = np.zeros(len(x) + 1, x.dtype)
    np.cumsum(x, out=out[1:])
    return out


class Lines:
    """Lines of some texts with enough tokens: text and line number, leaf and form; with ``templates``, their keys too."""

    def __init__(self, texts: list[bytes], min_tokens: int = MIN_TOKENS, templates: bool = False):
        raw = b"\n".join([*texts, b""]).translate(_SPACES)
        a = np.frombuffer(raw, np.uint8)
        blank = (a == 0x20) | (a == 0x0A)
        inside = np.zeros(len(a) + 1, np.int8)
        inside[1:] = ~blank
        edge = np.diff(inside)
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = _running((a.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(a)))
        token = mixed((total[stop] - total[start]) * _powers(_INVERSE, len(a) + 1)[start])
        digits = _running(((a >= 0x30) & (a <= 0x39)).astype(np.int64))
        token[digits[stop] > digits[start]] = _FIELD
        line_end = np.flatnonzero(a == 0x0A)
        first = np.searchsorted(start, np.concatenate(([0], line_end[:-1] + 1)) if len(line_end) else np.zeros(0, np.int64))
        n = np.diff(np.concatenate((first, [len(start)])))
        text_end = np.cumsum([len(t) + 1 for t in texts]) - 1
        text_of = np.searchsorted(text_end, line_end)
        own = np.flatnonzero(n >= min_tokens)
        self.n_lines = np.bincount(text_of, minlength=len(texts))
        self.text, self.n = text_of[own], n[own]
        first = first[own]
        self.number = own - np.searchsorted(text_of, self.text)
        place = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
        by_place = mixed(token + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        sums = _running(by_place)
        whole = sums[first + self.n] - sums[first] + self.n.astype(np.uint64)
        self.form = mixed(whole)
        leaf = self.n.astype(np.uint64)
        for k in range(DEPTH):
            there = self.n > k
            leaf[there] = mixed(leaf[there] * np.uint64(31) + token[first[there] + k])
        self.leaf = mixed(leaf)
        if templates:
            wide = self.n // OPEN
            self.n_keys = np.where(wide > 0, -((DEPTH - self.n) // np.maximum(1, wide)), 1)
            line = np.repeat(np.arange(len(own)), self.n_keys)
            band = np.arange(len(line)) - np.repeat(np.cumsum(self.n_keys) - self.n_keys, self.n_keys)
            begin = np.minimum(DEPTH + band * wide[line], self.n[line])
            stop = np.where(wide[line] > 0, np.minimum(begin + wide[line], self.n[line]), begin)
            open_band = sums[first[line] + stop] - sums[first[line] + begin]
            self.keys = mixed(whole[line] - open_band + np.where(wide[line] > 0, band + 1, 0).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + self.leaf[line])


def _groups(texts: list[bytes]) -> Iterator[slice]:
    k = size = 0
    for stop, t in enumerate(texts, 1):
        size += len(t)
        if size >= TOGETHER or stop == len(texts):
            yield slice(k, stop)
            k, size = stop, 0


def _forms(batches: Iterator[pa.RecordBatch], min_tokens: int) -> Iterator[pa.RecordBatch]:
    """Line forms with the keys of their templates and their lowest and highest doc_id; summed up within the task first."""
    held: list[tuple] = []
    size = 0

    def flushed() -> pa.RecordBatch:
        leaf, form, doc, n_keys, keys = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((form, leaf))
        begins = np.flatnonzero(np.append(True, (form[order][1:] != form[order][:-1]) | (leaf[order][1:] != leaf[order][:-1])))
        first = order[begins]
        low, high = np.minimum.reduceat(doc[order], begins), np.maximum.reduceat(doc[order], begins)
        n = n_keys[first]
        ends = np.cumsum(n)
        own = keys[np.repeat((np.cumsum(n_keys) - n_keys)[first] - ends + n, n) + np.arange(ends[-1])]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(own.view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(leaf[first].view(np.int64)), pa.array(form[first].view(np.int64)), lists, pa.array(low), pa.array(high)], names=["leaf", "form", "keys", "low", "high"])

    for batch in batches:
        texts, doc_ids = [t.encode() for t in batch.column("text").to_pylist()], batch.column("doc_id").to_numpy()
        for part in _groups(texts):
            x = Lines(texts[part], min_tokens, templates=True)
            if len(x.form):
                held.append((x.leaf, x.form, doc_ids[x.text + part.start], x.n_keys, x.keys))
                size += len(x.form)
            if size > HELD_LINES:
                yield flushed()
                held, size = [], 0
    if held:
        yield flushed()


def _leaf_sizes(batches: Iterator[pa.RecordBatch], min_tokens: int) -> Iterator[pa.RecordBatch]:
    """(leaf, n): forms of a leaf within the task; one that comes again after many others may count again."""
    held: list[np.ndarray] = []
    size = 0

    def flushed() -> pa.RecordBatch:
        distinct = np.unique(np.concatenate(held), axis=0)
        leaf, n = np.unique(distinct[:, 0], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(leaf.view(np.int64)), pa.array(n)], names=["leaf", "n"])

    for batch in batches:
        texts = [t.encode() for t in batch.column("text").to_pylist()]
        for part in _groups(texts):
            x = Lines(texts[part], min_tokens)
            held.append(np.stack((x.leaf, x.form), axis=1))
            size += len(x.leaf)
            if size > HELD_LINES:
                yield flushed()
                held, size = [], 0
    if held:
        yield flushed()


def _places(batches: Iterator[pa.RecordBatch], min_tokens: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.encode() for t in batch.column("text").to_pylist()]
        for part in _groups(texts):
            x = Lines(texts[part], min_tokens)
            at = pa.array(x.text + part.start)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("text_key").take(at), pa.array(x.number.astype(np.int32)), pa.array(x.leaf.view(np.int64)), pa.array(x.form.view(np.int64))], names=["doc_id", "text_key", "line", "leaf", "form"])


#: ``keys`` is set where a leaf is split: its templates are still to be found.
FOUND = "leaf long, form long, keep long, high long, keys array<long>"


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From forms sorted by leaf: those of whole leaves with a recurring template, and all of split leaves as they are."""
    names = ["leaf", "form", "keep", "high", "keys"]
    held: list[pa.RecordBatch] = []

    def found() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table.column("keys").chunk(0)
        key, line = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        low, high = table.column("low").to_numpy()[line], table.column("high").to_numpy()[line]
        order = np.argsort(key, kind="stable")
        begins = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        n = np.diff(np.append(begins, len(key)))
        first, last = np.repeat(np.minimum.reduceat(low[order], begins), n), np.repeat(np.maximum.reduceat(high[order], begins), n)
        keep = np.full(len(lists), np.iinfo(np.int64).max)
        again = first != last
        np.minimum.at(keep, line[order][again], first[again])
        at = np.unique(line[order][again])
        return pa.RecordBatch.from_arrays([pa.array(table.column(c).to_numpy()[at]) for c in ("leaf", "form")] + [pa.array(keep[at]), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.list_(pa.int64()))], names=names)

    for batch in batches:
        parts = batch.column("parts").to_numpy()
        if (split := np.flatnonzero(parts > 1)).size:
            some = batch.take(pa.array(split))
            yield pa.RecordBatch.from_arrays([some.column(c) for c in ("leaf", "form", "low", "high", "keys")], names=names)
        whole = batch.take(pa.array(np.flatnonzero(parts == 1)))
        if whole.num_rows and held and sum(b.num_rows for b in held) >= TOGETHER_FORMS:
            # what is held ends where its last leaf ends: at most LEAF_FORMS rows of this batch and those behind it
            last = held[-1].column("leaf")[-1].as_py()
            n = int(np.argmax(np.append(whole.column("leaf").to_numpy() != last, True)))
            held.append(whole.slice(0, n))
            whole = whole.slice(n)
            if whole.num_rows:
                yield found()
                held = []
        if whole.num_rows:
            held.append(whole)
    if held:
        yield found()


def recurring_lines(docs: DataFrame, min_tokens: int = MIN_TOKENS, leaf_forms: int | None = None) -> DataFrame:
    """leaf, form, keep: the line forms with a template that occurs in two documents or more, and the document they stay in.

    Forms are summed up in each task and dealt once, by leaf, or by leaf and part where a leaf has many. Which leaves those
    are is found in a pass of its own, which moves counts only. Both ways find the same.
    """
    prepare(docs.sparkSession)
    most = leaf_forms or LEAF_FORMS
    sizes = docs.select("text").mapInArrow(lambda it: _leaf_sizes(it, min_tokens), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n"))
    # stored, so that its size is known when the join is planned: one in `most` forms at most
    large = stored(sizes.where(F.col("n") > most).select("leaf", F.ceil(F.col("n") / most).cast("int").alias("parts")), "large-leaves")
    own = docs.select("doc_id", "text").mapInArrow(lambda it: _forms(it, min_tokens), "leaf long, form long, keys array<long>, low long, high long")
    own = own.join(large, "leaf", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.expr("cast(pmod(xxhash64(form), parts) as int)"))
    forms = own.repartition("leaf", "part").groupBy("leaf", "part", "form").agg(F.first("keys").alias("keys"), F.first("parts").alias("parts"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = stored(forms.sortWithinPartitions("leaf", "part").mapInArrow(_recurring, FOUND), "line-templates")
    small = found.where("keys is null").select("leaf", "form", "keep")
    split = found.where("keys is not null")
    if split.isEmpty():
        return small
    keys = split.select("leaf", "form", F.col("keep").alias("low"), "high", F.explode("keys").alias("key"))
    again = stored(keys.groupBy("key").agg(F.min("low").alias("keep"), F.max("high").alias("last")).where("keep <> last").drop("last"), "line-keys")
    return small.unionByName(keys.join(again, "key").groupBy("leaf", "form").agg(F.min("keep").alias("keep")))


def drop_lines(docs: DataFrame, min_tokens: int = MIN_TOKENS, keep_first: bool = True) -> DataFrame:
    """The rows of docs with recurring lines taken out of ``text``, and n_lines, dropped (line numbers from 0).

    All columns of docs stay, but for own columns named n_lines or dropped, which give way. Null texts stay null with no
    lines; a text all of whose lines go becomes empty, its row stays. Rows with a null doc_id lose no lines and make no
    template recur. Equal rows are treated alike; a line repeated within one document alone stays. A text of any length or
    number of lines is one row of a batch.
    """
    prepare(docs.sparkSession)
    # the row in one column: no other name can clash with those used here
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"), F.struct(*docs.columns).alias("row"))
    base = rows.where("doc_id is not null and text is not null").select("doc_id", "text", "text_key")
    again = stored(recurring_lines(base, min_tokens), "recurring-lines")
    lines = base.mapInArrow(lambda it: _places(it, min_tokens), "doc_id long, text_key long, line int, leaf long, form long")
    gone = lines.join(again, ["leaf", "form"]).where("doc_id <> keep" if keep_first else "true").groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("line")).alias("gone"))
    out = rows.join(gone, ["doc_id", "text_key"], "left")
    parts = F.split("text", "\n", -1)
    # gone lines as 2k and all lines as 2k + 1, sorted: a line stays if the one before it isn't its own 2k
    marks = F.sort_array(F.concat(F.transform("gone", lambda k: 2 * k), F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: 2 * k + 1)))
    before = F.concat(F.array(F.lit(-1)), marks)
    stays = F.filter(F.zip_with(marks, before, lambda m, b: F.when(m % 2 == 1, b != m - 1)), lambda x: x.isNotNull())
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.zip_with(parts, stays, lambda x, s: F.when(s, x)), "\n"))
    return out.select(
        *[kept.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "dropped")],
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.coalesce("gone", F.array().cast("array<int>")).alias("dropped"),
    )


def line_digests(docs: DataFrame, min_tokens: int = MIN_TOKENS, keep_first: bool = True) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped, text_sha256 (of what stays; null for a null text)."""
    out = drop_lines(docs.select("doc_id", "text"), min_tokens, keep_first)
    return out.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))

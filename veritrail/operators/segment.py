"""From lines to sections, entries, parts and chunks.

Lines carry (doc_id, line_no, text, is_bullet, is_bold, is_heading, font_size, page); an operator needs only the columns
it names. Documents are the unit of parallelism: windows are partitioned by document. Two steps must see lines in
sequence; a pass over one document's or one entry's lines finds where its groups start, and Spark slices them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import text as T
from ..runtime import prepare
from ..functions.tables import ENTRY_SECTIONS, SECTION_HEADINGS, SECTION_ORDER, heading_aliases

MAX_ENTRY, MAX_FLAT = 900, 600


def _by_line(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("line_no")


def _earlier(*keys: str) -> Window:
    return _by_line(*keys).rowsBetween(Window.unboundedPreceding, -1)


def marked_bullets(lines: DataFrame) -> DataFrame:
    """B1: text without its list glyph, and is_bullet."""
    return lines.withColumns({"text": T.bullet_text(F.col("text")), "is_bullet": T.is_bullet(F.col("text"))})


def merge_wrapped(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """rejoin lines that a page broke. A line goes on the one before if both are of one page and size, it is no
    bullet and doesn't begin upper case, and the text so far neither ends a sentence nor is a known heading.

    The tests look at the merged text, so each document's lines are gone through once, in order.
    """
    fields = [c for c in lines.columns if c != key]
    rows = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", *[c for c in fields if c != "line_no"]))).alias("rows"))
    each = rows.select(key, "rows", *[F.col("rows")[c].alias(f"_{c}") for c in ("text", "is_bullet", "font_size", "page")])
    text = F.array_join(F.transform("own", lambda x: x["text"]), " ")
    return _groups(each, "rows", _unbroken).select(key, F.col("own")[0].withField("text", text).alias("x")).select(key, "x.*")


def _unbroken(texts: list, bullets: list, sizes: list, pages: list) -> list[int]:
    """Places of the lines that don't go on the one before."""
    starts: list[int] = []
    merged: str | None = ""  # of the open group, while it may still be a heading
    for k, text in enumerate(texts):
        if starts:
            head, last, letter = starts[-1], texts[k - 1], text[:1] if text is not None else ""
            if (
                last is not None
                and text is not None
                and pages[head] == pages[k]
                and bullets[k] is False
                and last[-1:] not in _ENDS
                and not (letter.upper() == letter and letter.lower() != letter)
                and sizes[head] is not None
                and sizes[k] is not None
                and abs(sizes[head] - sizes[k]) < 0.6
                and not (merged is not None and T.heading_of(merged) in _KNOWN)
            ):
                merged = f"{merged} {text}" if merged is not None and len(merged) < _LONGEST else None
                continue
        starts.append(k)
        merged = text
    return starts


_ENDS = (".", "!", "?", ":", ";")
_KNOWN = {h for hs in SECTION_HEADINGS.values() for h in hs}
#: No text of this length is a known heading, whatever marks and spaces stand around it.
_LONGEST = 1000


def _groups(df: DataFrame, rows: str, find: Callable[..., list[int]]) -> DataFrame:
    """df exploded into groups of its array ``rows``: at (from 0) and own, the group's elements.

    ``find`` gets the values of df's columns that begin with an underscore and gives the places where groups start.
    """
    prepare(df.sparkSession)
    given = [c for c in df.columns if c.startswith("_")]
    kept = [c for c in df.columns if c not in given]
    schema = ST.StructType([df.schema[c] for c in kept] + [ST.StructField("starts", ST.ArrayType(ST.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = [find(*x) for x in zip(*(batch.column(c).to_pylist() for c in given), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(starts, pa.list_(pa.int32()))], names=[*kept, "starts"])

    found = df.mapInArrow(run, schema).select("*", F.posexplode("starts").alias("at", "start"))
    stop = F.coalesce(F.get("starts", F.col("at") + 1), F.size(rows))
    return found.withColumn("own", F.slice(rows, F.col("start") + 1, stop - F.col("start"))).drop("starts", "start")


def alias_table(spark: object) -> DataFrame:
    return spark.createDataFrame(heading_aliases(), "norm string, canonical string")


def sections(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """F2 with D2: section_seq and section of each content line; heading lines are consumed.

    A known heading opens its section. After the first known one, a short line that is no bullet and has a heading
    style, or is much larger than body text, or bold and larger, opens OTHER. What stands before is HEADER.
    """
    aliases = F.broadcast(alias_table(lines.sparkSession))
    known = lines.withColumn("norm", T.heading(F.col("text"))).join(aliases, "norm", "left")
    body = F.percentile(F.when(~F.col("is_bold") & (F.col("font_size") > 0), F.col("font_size")), F.lit(0.5)).over(Window.partitionBy(key))
    seen = F.coalesce(F.max(F.col("canonical").isNotNull()).over(_earlier(key)), F.lit(False))
    short = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")) <= 5
    larger = lambda by: F.coalesce(F.col("font_size") >= F.col("body") + by, F.lit(False))
    looks = seen & ~F.col("is_bullet") & short & (F.col("is_heading") | larger(2.0) | (F.col("is_bold") & larger(1.0)))
    opened = known.withColumn("body", body).withColumn("opens", F.coalesce(F.col("canonical"), F.when(looks, "OTHER")))
    named = opened.withColumns({
        "section_seq": F.count("opens").over(_by_line(key)).cast("int"),
        "section": F.coalesce(F.last("opens", ignorenulls=True).over(_by_line(key)), F.lit("HEADER")),
        "unknown_heading": F.col("canonical").isNull() & F.col("opens").isNotNull(),
    })
    return named.drop("norm", "canonical", "body")


def content(sectioned: DataFrame) -> DataFrame:
    return sectioned.where("opens is null").drop("opens", "unknown_heading")


def entries(lines: DataFrame, *keys: str) -> DataFrame:
    """entry number (from 1) within ``keys``. A line that is no bullet starts an entry right after a bullet, or if
    it is bold and a bold line was seen since the last bullet."""
    run = lines.withColumn("_run", F.sum(F.col("is_bullet").cast("int")).over(_by_line(*keys)))
    plain_bold = F.col("is_bold") & ~F.col("is_bullet")
    bold_before = F.coalesce(F.max(plain_bold).over(_earlier(*keys, "_run")), F.lit(False))
    after_bullet = F.coalesce(F.lag("is_bullet").over(_by_line(*keys)), F.lit(False))
    first = F.row_number().over(_by_line(*keys)) == 1
    starts = first | (~F.col("is_bullet") & (after_bullet | (F.col("is_bold") & bold_before)))
    return run.withColumn("_starts", starts.cast("int")).withColumn("entry", F.sum("_starts").over(_by_line(*keys)).cast("int")).drop("_run", "_starts")


def packed(lines: DataFrame, keys: list[str], max_chars: Column | int) -> DataFrame:
    """parts of at most max_chars of each entry (``keys``): rows (keys, part_index, part), part = its lines.

    A part after the first begins with the entry's heading lines: those of its first three that are no bullets. A line
    longer than the limit is a part of its own. No more than an entry is gathered.
    """
    limit = max_chars if isinstance(max_chars, Column) else F.lit(max_chars)
    rows = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_no", "text", "is_bullet"))).alias("rows"))
    rows = rows.withColumn("head", F.filter(F.slice("rows", 1, 3), lambda x: ~x["is_bullet"]))
    sizes = lambda c: F.transform(c, lambda x: F.coalesce(F.length(x["text"]), F.lit(0)) + 1)
    parts = _groups(rows.withColumns({"_sizes": sizes("rows"), "_head": sizes("head"), "_limit": limit}), "rows", _full)
    part = F.when(F.col("at") == 0, F.col("own")).otherwise(F.concat("head", "own"))
    return parts.select(*keys, (F.col("at") + 1).alias("part_index"), part.alias("part"))


def _full(sizes: list[int], head: list[int], limit: int) -> list[int]:
    """Places of the lines that don't fit into the part so far."""
    starts, size = [0], 0
    if sum(sizes) <= limit:
        return starts
    for k, n in enumerate(sizes):
        if k and size + n > limit:
            starts.append(k)
            size = sum(head)
        size += n
    return starts


def part_text(part: Column) -> Column:
    """Lines as text, bullets marked."""
    return F.array_join(F.transform(part, lambda x: F.when(x["is_bullet"], F.concat(F.lit("- "), x["text"])).otherwise(x["text"])), "\n")


def chunks(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sections, entries, parts, numbered chunks (F5), with the text to show and the text to embed."""
    own = content(sections(lines, key))
    several = F.col("section").isin(*ENTRY_SECTIONS)
    with_entries = entries(own, key, "section_seq").withColumn("item_index", F.when(several, F.col("entry")).otherwise(1))
    keys = [key, "section_seq", "section", "item_index"]
    parts = packed(with_entries, keys, F.when(several, MAX_ENTRY).otherwise(MAX_FLAT))
    text = parts.withColumn("text", part_text(F.col("part"))).where(F.trim("text") != "")
    order = Window.partitionBy(key).orderBy("section_seq", "item_index", "part_index")
    name = own.where("section_seq = 0 and section = 'HEADER'").groupBy(key).agg(F.min_by("text", "line_no").alias("candidate_name"))
    numbered = text.withColumn("chunk_index", F.row_number().over(order)).join(name, key, "left")
    return numbered.select(
        key, "section_seq", "section", "item_index", "part_index", "chunk_index",
        F.concat_ws("_", F.col(key).cast("string"), F.lower("section"), "section_seq", "item_index", "part_index").alias("chunk_id"),
        "text", F.concat(F.lit("["), F.col("section"), F.lit("]\n"), F.col("text")).alias("embedding_text"),
        F.coalesce("candidate_name", F.lit("")).alias("candidate_name"), F.length("text").alias("char_count"), F.size("part").alias("line_count"),
    )


def flat_chunks(docs: DataFrame, max_chars: int = MAX_FLAT) -> DataFrame:
    """Documents without structure: their lines packed; (doc_id, part_index, text). Blank parts go.

    The parts are those of ``packed``; as a document is one row, they are made where it stands and nothing is shuffled.
    """
    prepare(docs.sparkSession)
    schema = ST.StructType([docs.schema["doc_id"], ST.StructField("part_index", ST.IntegerType()), ST.StructField("text", ST.StringType())])
    return docs.where("text is not null").select("doc_id", "text").mapInArrow(lambda it: _flat(it, max_chars), schema).where(F.trim("text") != "")


def _flat(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, place, texts = [], [], []
        for k, text in enumerate(batch.column("text").to_pylist()):
            lines = text.split("\n")
            sizes = [len(x) + 1 for x in lines]
            starts = _full(sizes, sizes[:3], limit)
            for i, (start, end) in enumerate(zip(starts, [*starts[1:], len(lines)], strict=True)):
                row.append(k)
                place.append(i + 1)
                texts.append("\n".join(lines[start:end] if not i else lines[:3] + lines[start:end]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(place, pa.int32()), pa.array(texts, pa.string())], names=["doc_id", "part_index", "text"])


def rebuilt(chunked: DataFrame, key: str = "doc_id") -> DataFrame:
    """One text per document: sections in their fixed order, later ones by first appearance, chunks in theirs."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, SECTION_ORDER)), F.col("section")), F.lit(0))
    ranked = chunked.withColumn("_place", F.when(place == 0, 100).otherwise(place)).withColumn("_first", F.min("chunk_index").over(Window.partitionBy(key, "section")))
    by_section = ranked.groupBy(key, "section", "_place", "_first").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n").alias("body"))
    block = F.concat(F.lit("## "), F.col("section"), F.lit("\n"), F.col("body"))
    return by_section.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_first", block.alias("block")))), lambda x: x["block"]), "\n\n").alias("text")).withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))


def size_report(chunked: DataFrame) -> DataFrame:
    """N, least, median, 90th percentile by nearest rank, most, below 40, above 1200."""
    n = F.col("char_count")
    counts = chunked.groupBy("char_count").agg(F.count("*").alias("c"))  # sizes are few, so the one window stays small
    upto = counts.withColumn("upto", F.sum("c").over(Window.orderBy("char_count").rowsBetween(Window.unboundedPreceding, 0)))
    total = chunked.agg(F.count("*").alias("n"), F.min(n).alias("smallest"), F.floor(F.percentile(n, F.lit(0.5))).cast("int").alias("median"), F.max(n).alias("largest"), F.count_if(n < 40).alias("below_40"), F.count_if(n > 1200).alias("above_1200"))
    p90 = upto.crossJoin(F.broadcast(total.select("n"))).where(F.col("upto") >= F.least(F.col("n"), F.floor(F.col("n") * 0.9) + 1)).agg(F.min("char_count").alias("p90"))
    return total.crossJoin(F.broadcast(p90))

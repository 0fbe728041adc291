"""Shards from a consistent-hash ring with virtual nodes and bounded loads.

Each shard stands on the ring at several places, its virtual nodes. A document goes to the next virtual node clockwise
of its id's hash; all documents of one arc between two nodes prefer the same shards in the same order, the order in which
shards come clockwise. A shard takes no more than its share. Documents that find it full continue clockwise to the next
shard that they haven't asked yet.

Only counts of arcs take part in that: each round every arc offers what it has left to its next shard, and a shard takes
offers in the arcs' order until it is full. Arcs and rounds are bounded by the shards and their nodes, whatever the
corpus. Then each document's place in its arc, in the order of hashes, says which of the arc's pieces it is in, and with
that its shard and its slot there.

Places come from one sort by ranges: a document's place is its index in its task and what earlier tasks hold of its arc.
Rows alike in all that is returned are told apart by their place in the input, so that any number of them with one id
spreads over tasks. All of it is DataFrame operations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import stored

#: Cells of the ring; positions of documents and nodes are the first bits of their hashes.
CELL_BITS = 16
#: Virtual nodes of a shard, and of all shards at most. What depends on the ring alone is of this size.
NODES, ALL_NODES = 64, 4096
#: Bits that ``monotonically_increasing_id`` leaves for the index within a task.
INDEX_BITS = 33


def _cell(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 64 - CELL_BITS).cast("int")


def ring(spark: SparkSession, shards: int, nodes: int = NODES) -> DataFrame:
    """arc, shard, first, last: the virtual nodes clockwise, each at the end of its arc of cells.

    The first arc begins behind the last node and goes on past cell 0 (``last`` is over the number of cells then). Of
    nodes in one cell all but the first have an arc without cells (first > last). The ring depends on its two numbers
    alone, so windows over all of it are small.
    """
    if shards < 1 or nodes < 1 or shards * nodes > ALL_NODES:
        raise ValueError(f"at least one shard with one node, and at most {ALL_NODES} nodes, stand on the ring")
    own = spark.range(0, shards * nodes, 1, 1).select(F.floor(F.col("id") / nodes).cast("int").alias("shard"), F.xxhash64(F.lit("node"), "id").alias("hash"))
    placed = own.select("shard", "hash", _cell(F.col("hash")).alias("last"))
    over = Window.orderBy("last", "hash", "shard")
    before, end = F.lag("last").over(over), F.max("last").over(Window.partitionBy())
    numbered = placed.select("shard", "last", F.row_number().over(over).alias("nth"), before.alias("before"), end.alias("end"))
    wraps = F.col("before").isNull()
    return numbered.select((F.col("nth") - 1).alias("arc"), "shard", (F.coalesce("before", "end") + 1).alias("first"), F.when(wraps, F.col("last") + (1 << CELL_BITS)).otherwise(F.col("last")).alias("last"))


def cells(spark: SparkSession, shards: int, nodes: int = NODES) -> DataFrame:
    """cell, arc of every cell of the ring."""
    return ring(spark, shards, nodes).where("first <= last").select(F.explode(F.sequence("first", "last")).alias("c"), "arc").select((F.col("c") % (1 << CELL_BITS)).alias("cell"), "arc")


def preferences(spark: SparkSession, shards: int, nodes: int = NODES) -> DataFrame:
    """arc, asks: all shards in the order in which an arc's documents ask them, clockwise."""
    lap = F.sort_array(F.collect_list(F.struct("arc", "shard")).over(Window.partitionBy()))
    arcs = ring(spark, shards, nodes).select("arc", lap.alias("lap")).select("arc", F.col("lap.shard").alias("lap"))
    return arcs.select("arc", F.array_distinct(F.concat(F.slice("lap", F.col("arc") + 1, F.size("lap")), F.col("lap"))).alias("asks"))


def pieces(counts: DataFrame, shards: int, nodes: int = NODES, slack: float = 0.0) -> DataFrame:
    """arc, start, n, shard, slot: where the documents of each arc go, by their places in it, from (arc, n).

    Without slack a shard's share is the documents by the shards, rounded up for the first of them as the remainder
    says, so counts are at most one apart; with slack it is (1 + slack) times the mean, rounded up, and fewer documents
    have to go on. Round k asks each arc's k-th shard, so all of a shard's own documents come before any that went on.
    """
    spark = counts.sparkSession
    left = stored(counts.join(F.broadcast(preferences(spark, shards, nodes)), "arc").select("arc", "asks", F.lit(0).cast("long").alias("start"), "n"), "ring-offers")
    total = left.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = (F.lit(total // shards) + (F.col("shard") < total % shards).cast("long")) if not slack else F.lit(-int(-total * (1 + slack) // shards))
    over = Window.partitionBy("shard").orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    taken: list[DataFrame] = []
    while not left.isEmpty():
        offers = left.select("arc", "asks", "start", "n", F.col("asks")[len(taken)].alias("shard"))
        if taken:
            offers = offers.join(reduce(DataFrame.unionByName, taken).groupBy("shard").agg(F.sum("n").alias("used")), "shard", "left")
        else:
            offers = offers.withColumn("used", F.lit(None).cast("long"))
        asked = offers.select("*", share.alias("share"), (F.coalesce("used", F.lit(0)) + F.coalesce(F.sum("n").over(over), F.lit(0))).alias("slot"))
        took = F.greatest(F.lit(0).cast("long"), F.least("n", F.col("share") - F.col("slot")))
        answered = stored(asked.select("arc", "asks", "start", "n", "shard", "slot", took.alias("took")), "ring-round")
        taken.append(answered.where("took > 0").select("arc", "start", F.col("took").alias("n"), "shard", "slot"))
        left = answered.where("took < n").select("arc", "asks", (F.col("start") + F.col("took")).alias("start"), (F.col("n") - F.col("took")).alias("n"))
    return reduce(DataFrame.unionByName, taken) if taken else left.select("arc", "start", "n", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16, nodes: int = NODES, slack: float = 0.0, carry: bool = False) -> DataFrame:
    """Every document's shard: doc_id, size (UTF-8 bytes of the text and 1), text_crc32, law, shard, slot, grown_shard.

    Slots of a shard have no gap from 0. ``law`` is ``rows``: without slack, counts of shards are at most one apart.
    Loads decide too, so ``grown_shard`` is null. A null text has no bytes. Equal ids share an arc and may still part at
    a full shard, as null ids (an arc of their own hash) and repeated rows do; texts of any length count by their bytes.
    The result depends on the rows alone, not on their order or partitions. With ``carry`` all columns of docs come along in
    ``row``, whatever their names, ready to be written by shard. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = [F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(F.col("doc_id").cast("string")).alias("hash")]
    more = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    # cells are as many as CELL_BITS says, so their table may go to all tasks
    placed = docs.select(*own, F.monotonically_increasing_id().alias("nth"), *more).withColumn("cell", _cell(F.col("hash"))).join(F.broadcast(cells(spark, shards, nodes)), "cell").drop("cell")
    keys = ("arc", "hash", "doc_id", "text_crc32", "size", "nth")
    dealt = stored(placed, "shard-rows").repartitionByRange(*keys).sortWithinPartitions(*keys)
    index = F.col("at") % (1 << INDEX_BITS)
    ordered = stored(dealt.select("doc_id", "size", "text_crc32", "arc", F.monotonically_increasing_id().alias("at"), *(["row"] if carry else [])).withColumn("task", (F.col("at") - index).cast("long")), "shard-places")
    runs = ordered.groupBy("task", "arc").agg(F.min("at").alias("begin"), F.count("*").alias("n"))
    earlier = Window.partitionBy("arc").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    runs = stored(runs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "shard-runs")
    parts = pieces(runs.groupBy("arc").agg(F.sum("n").alias("n")), shards, nodes, slack)
    # what each run has of each piece: a few rows for every run
    met = runs.join(parts.select("arc", "start", (F.col("start") + F.col("n")).alias("stop"), "shard", "slot"), "arc").where("before < stop and start < before + n")
    place_of = F.col("begin") - F.col("before")
    spans = met.select("task", "arc", "shard", (F.greatest("start", "before") + place_of).alias("low"), (F.least("stop", F.col("before") + F.col("n")) + place_of).alias("high"), (F.col("slot") - F.col("start") - place_of).alias("shift"))
    found = ordered.join(spans, ["task", "arc"]).where("low <= at and at < high")
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("at") + F.col("shift")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *(["row"] if carry else []))

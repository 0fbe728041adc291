"""Quality by compression: a text is like the labelled texts whose zstandard dictionary shrinks it more.

Two dictionaries are built, from texts labelled good and from texts labelled bad. A text is compressed with each, all of
it, in pieces of ``PIECE`` bytes: in a longer piece a text's own words would take the dictionary's place. The difference of the two sizes, normalised by the text's size, is calibrated to a probability by a logistic curve fitted
on labelled texts that went into neither dictionary. Nothing else about a text counts, neither its length nor how well
it shrinks at all.

Fitting takes a bounded sample of labelled rows (``SAMPLE`` of each class, those with the smallest hash of their id):
every other one lends at most ``DICT_TEXT`` characters to a dictionary, in pieces from all of its text; the rest are compressed on executors, and only
their differences are collected. Scoring is a narrow map over all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import prepare
from .batches import crc_of_id, doc_columns, map_batches, spread

#: Labelled rows of each class that the fit may read.
SAMPLE = 3000
#: Characters of one text that go into a dictionary, and bytes of one dictionary, at most.
DICT_TEXT, DICT_BYTES = 20_000, 1 << 21
#: At lower levels the matches found in a dictionary of this size are too coarse to tell the classes apart.
LEVEL = 9
#: Bytes that are compressed together.
PIECE = 2048
THRESHOLD = 0.7
#: Bytes that count as every text's own, so that the shortest texts don't swing.
LEAST_BYTES = 20


def dictionary(texts: list[str], limit: int) -> bytes:
    """Texts end to end, as raw dictionary content, up to ``limit`` bytes: the last one is cut."""
    return b"\n".join([t.encode() for t in texts])[:limit]


class Difference:
    """The normalised difference of a text's sizes with the bad and with the good dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        plain = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        self.ways = [zstandard.ZstdCompressor(**plain, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for d in (good, bad)]

    def __call__(self, texts: list[str]) -> np.ndarray:
        raw = [t.encode() for t in texts]
        size = lambda c, t: sum(len(c.compress(t[k : k + PIECE])) for k in range(0, len(t), PIECE))
        good, bad = (np.array([size(c, t) for t in raw], float) for c in self.ways)
        return (bad - good) / (np.array([len(t) for t in raw], float) + LEAST_BYTES)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Slope and offset by Newton's method with a small ridge, so that separable classes converge too."""
    x, w = np.column_stack((10 * x, np.ones(len(x)))), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(2), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w * (10, 1)


class Model:
    """Dictionaries and curve; without both classes the share of good labels is every text's score."""

    def __init__(self, prior: float, good: bytes = b"", bad: bytes = b"", curve: np.ndarray | None = None):
        self.prior, self.good, self.bad, self.curve = prior, good, bad, curve

    def scorer(self) -> object:
        if self.curve is None:
            return lambda texts: np.full(len(texts), self.prior)
        difference = Difference(self.good, self.bad)
        return lambda texts: 1 / (1 + np.exp(-np.clip(difference(texts) * self.curve[0] + self.curve[1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, dict_text: int = DICT_TEXT, dict_bytes: int = DICT_BYTES) -> Model:
    """A model from at most ``sample`` rows of each class among the labels that ``learn`` admits.

    A document whose labels disagree teaches nothing; of rows with one id the text that sorts first teaches. A class of one
    text serves for dictionary and curve.
    """
    spark = docs.sparkSession
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(learn & F.col("quality").isin(0, 1))
    own = own.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    picked = [own.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    of_class = Window.partitionBy("quality")  # over 2 x sample rows at most, so the broadcast has a fixed bound too
    ids = picked[0].unionByName(picked[1]).withColumns({"n": F.row_number().over(of_class.orderBy(F.xxhash64("doc_id"), "doc_id")), "of": F.count("*").over(of_class)})
    rows = doc_columns(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality", "n", "of").agg(F.min("text").alias("text"))
    lent = rows.where("n % 2 = 1").select("doc_id", "quality", spread(F.col("text"), dict_text).alias("text"), "n").collect()
    lent.sort(key=lambda r: (r["n"], r["doc_id"], r["text"]))
    texts = [[r["text"] for r in lent if r["quality"] == q] for q in (1, 0)]
    prior = (len(texts[0]) + 1) / (len(texts[0]) + len(texts[1]) + 2)
    limit = min(dict_bytes, *(len(dictionary(t, dict_bytes)) for t in texts))  # of one size, so that neither gains by it
    if not limit:
        return Model(prior)
    good, bad = (dictionary(t, limit) for t in texts)
    held = spark.sparkContext.broadcast((good, bad))

    def make() -> object:
        difference = Difference(*held.value)
        return lambda batch: {"quality": batch.column("quality"), "x": pa.array(difference(batch.column("text").to_pylist()), pa.float64())}

    curve = map_batches(rows.where("n % 2 = 0 or of = 1").select("quality", "text"), make, "quality int, x double").collect()
    if len({r["quality"] for r in curve}) < 2:
        return Model(prior)
    curve.sort(key=lambda r: (r["quality"], r["x"]))
    return Model(prior, good, bad, logistic(np.array([r["x"] for r in curve]), np.array([float(r["quality"]) for r in curve])))


def quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = THRESHOLD, sample: int = SAMPLE, dict_text: int = DICT_TEXT, dict_bytes: int = DICT_BYTES) -> DataFrame:
    """doc_id, held_out, score, predicted of every document. Labels of held-out ids (crc32 mod folds = held) are not read.

    A null text counts as empty; an empty text has a score like any other, and so has one of any length. Without usable
    labels of both classes every score is the share of good labels (one half without any). A null id is never held out nor
    learnt from; repeated rows are scored each for itself, and equal texts alike. Further columns are not read. The fit
    reads at most ``sample`` documents of each label; a dictionary has at most ``dict_text`` characters of one text and
    ``dict_bytes`` bytes.
    """
    spark = prepare(docs.sparkSession)
    held_out = crc_of_id(F.col("doc_id")) % folds == held
    model = spark.sparkContext.broadcast(fit(docs, labels, ~held_out, sample, dict_text, dict_bytes))

    def make() -> object:
        score = model.value.scorer()
        return lambda batch: {"doc_id": batch.column("doc_id"), "score": pa.array(score(batch.column("text").to_pylist()), pa.float64())}

    out = map_batches(doc_columns(docs), make, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

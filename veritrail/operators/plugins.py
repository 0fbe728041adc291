"""Extension points: embedders, rerankers and search functions that a user brings.

An embedder or scorer is a plain function over a list of texts. It runs in an iterator of Arrow batches, so a model is
loaded once per task, and only the columns it needs reach Python.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import prepare

Embed = Callable[[list[str]], list[list[float]]]
Score = Callable[[list[str], list[str]], list[float]]


def hash_embedder(dims: int = 128) -> Callable[[], Embed]:
    """The deterministic embedder, as a plug-in: word counts by md5 bucket at length one."""

    def load() -> Embed:
        def embed(texts: list[str]) -> list[list[float]]:
            out = []
            for text in texts:
                v = [0.0] * dims
                for word in text.lower().split():
                    v[int(hashlib.md5(word.encode()).hexdigest(), 16) % dims] += 1
                n = sum(x * x for x in v) ** 0.5
                out.append([x / n for x in v] if n else v)
            return out

        return embed

    return load


def embedded(texts: DataFrame, id_col: str, text_col: str, load: Callable[[], Embed]) -> DataFrame:
    """L1: (id, embedding) by an embedder; ``load`` makes it, once in each task."""
    prepare(texts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = load()
        for batch in batches:
            yield pd.DataFrame({id_col: batch[id_col], "embedding": embed(batch[text_col].fillna("").tolist())})

    own = texts.select(id_col, text_col)
    return own.mapInPandas(run, f"{id_col} {own.schema[id_col].dataType.simpleString()}, embedding array<double>")


def scorer(load: Callable[[], Score]) -> Callable[[Column, Column], Column]:
    """L2: a reranker's logit as a column of (query, text), for ``retrieval.rerank``."""

    @F.pandas_udf("double")
    def score(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = load()
        for query, text in pairs:
            yield pd.Series(own(query.fillna("").tolist(), text.fillna("").tolist()), dtype="float64")

    return score


def shared_words() -> Score:
    """A small scorer: distinct words in common, less two."""
    return lambda queries, texts: [float(len(set(q.lower().split()) & set(t.lower().split()))) - 2 for q, t in zip(queries, texts, strict=True)]


def compared(searches: dict[str, Callable[[], DataFrame]], n: int) -> DataFrame:
    """L3: hits (query_id, doc_id, rank) of several search functions, cut to n, under the name of each."""
    out = None
    for name, search in searches.items():
        own = search().where(F.col("rank") <= n).select(F.lit(name).alias("config"), "query_id", "doc_id", "rank")
        out = own if out is None else out.unionByName(own)
    return out

"""Disparate-impact audit of shortlists. Attributes enter here and nowhere else."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RELIABLE, FOUR_FIFTHS = 10, 0.80


def groups(ranked: DataFrame, attributes: DataFrame, size: int, *keys: str) -> DataFrame:
    """Per attribute value: total, selected (rank within size), mean score, selection rate, reliability.

    ``attributes`` is long: resume_id, attribute, value. Without ``keys`` shortlists are pooled (E19).
    """
    own = ranked.select(*keys, "resume_id", "rank", "score").join(attributes, "resume_id")
    out = own.groupBy(*keys, "attribute", F.col("value").cast("string").alias("value")).agg(F.count("*").alias("total"), F.count_if(F.col("rank") <= size).alias("selected"), F.avg("score").alias("mean_score"))
    return out.withColumns({"selection_rate": F.col("selected") / F.col("total"), "reliable": F.col("total") >= RELIABLE})


def impact(grouped: DataFrame, *keys: str) -> DataFrame:
    """Lowest over highest rate of the reliable groups; null below two of them or if nobody was selected."""
    rate = F.when(F.col("reliable"), F.col("selection_rate"))
    own = grouped.groupBy(*keys, "attribute").agg(F.min(rate).alias("low"), F.max(rate).alias("high"), F.count(rate).alias("n"))
    ratio = F.when((F.col("n") >= 2) & (F.col("high") > 0), F.col("low") / F.col("high"))
    return own.select(*keys, "attribute", ratio.alias("impact_ratio"), F.coalesce(ratio < FOUR_FIFTHS, F.lit(False)).alias("flagged"))


def relative_rates(grouped: DataFrame, *keys: str) -> DataFrame:
    """A group's rate beside the highest of its attribute."""
    high = F.max("selection_rate").over(Window.partitionBy(*keys, "attribute"))
    return grouped.withColumn("relative", F.when(high > 0, F.col("selection_rate") / high))

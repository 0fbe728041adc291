"""Likely duplicates: rows of one batch with the same name and address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _form(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))


def likely_duplicates(people: DataFrame) -> DataFrame:
    """duplicate_of, the row with the smallest id of the same job_id (null equals null), name and email.

    Rows without a name or an email are nobody's duplicate. A hash partition by the three keys, no self join.
    """
    same = Window.partitionBy("job_id", _form("full_name"), _form("email"))
    root = F.min_by("resume_id", "id").over(same)
    known = (_form("full_name") != "") & (_form("email") != "")
    return people.withColumn("duplicate_of", F.when(known & (F.min("id").over(same) != F.col("id")), root))


def duplicate_groups(people: DataFrame) -> DataFrame:
    """D16 for tables of any size: (job_id, root, resume_id, place, n_members) of every row with likely duplicates.

    A group is its representative and its members' rows; no row holds a group, however many copies it has.
    """
    root = F.coalesce("duplicate_of", "resume_id")
    own = people.select("job_id", root.alias("root"), "resume_id", "id")
    sizes = own.groupBy("job_id", "root").agg(F.count("*").alias("n_members")).where("n_members > 1").select(F.col("job_id").alias("_job"), F.col("root").alias("_root"), "n_members")
    both = own.join(sizes, F.col("job_id").eqNullSafe(F.col("_job")) & (F.col("root") == F.col("_root"))).drop("_job", "_root")
    return both.withColumn("place", F.row_number().over(Window.partitionBy("job_id", "root").orderBy("id"))).select("job_id", "root", "resume_id", "place", "n_members")


def group_members(people: DataFrame) -> DataFrame:
    """D16 for a shortlist: other_ids, the ids of the other members of a row's group, in order. Each row carries its group,
    so this is for lists of a fixed length; ``duplicate_groups`` is for all."""
    root = Window.partitionBy("job_id", F.coalesce("duplicate_of", "resume_id"))
    everyone = F.array_sort(F.collect_list(F.struct("id", "resume_id")).over(root))
    others = F.transform(F.filter(everyone, lambda x: x["resume_id"] != F.col("resume_id")), lambda x: x["resume_id"])
    return people.withColumn("other_ids", others)


def duplicate_pressure(shortlist: DataFrame) -> DataFrame:
    """Shortlisted rows with another member of their group also on the list."""
    n = F.count("*").over(Window.partitionBy("job_id", F.coalesce("duplicate_of", "resume_id")))
    return shortlist.withColumn("crowded", n > 1)

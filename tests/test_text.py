"""Scalar functions against hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from veritrail.functions import text as T


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} {'string' if isinstance(values[n], str) else 'int'}" for n in names)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("line", "text", "bullet"), [("- Built 12 APIs", "Built 12 APIs", True), ("• x", "x", True), ("-", "-", False), ("- 2019", "2019", True), ("  plain", "plain", False), ("", "", False), ("⁃ y", "y", True)])
def test_bullets(spark, line, text, bullet):
    assert one(spark, T.bullet_text(F.col("t")), t=line) == text and one(spark, T.is_bullet(F.col("t")), t=line) is bullet


@pytest.mark.parametrize(("line", "heading"), [("## Work  Experience:", "WORK EXPERIENCE"), (" skills — ", "SKILLS"), ("Skills:", "SKILLS"), ("", "")])
def test_heading(spark, line, heading):
    assert one(spark, T.heading(F.col("t")), t=line) == heading


@pytest.mark.parametrize(("text", "tokens"), [("C++ and Node.js, CI/CD", ["c++", "node.js", "node", "js", "ci", "cd"]), (".NET the", ["net"]), ("", []), ("a-b well-known", ["a-b", "well-known", "well", "known"])])
def test_tokens(spark, text, tokens):
    assert one(spark, T.tokens(F.col("t")), t=text) == tokens


def test_forms(spark):
    assert one(spark, T.skill_surface(F.col("t")), t="  • Go ;") == "Go"
    assert one(spark, T.vocabulary_form(F.col("t")), t=" Power BI (DAX). ") == "power bi dax"
    assert one(spark, T.comparison_form(F.col("t")), t="C/C++ - dev") == "c c++ dev"
    assert one(spark, T.collection_key(F.col("t")), t="a/b c__") == "chunks_a_b_c"
    assert one(spark, T.error_status(F.col("t")), t="File is Encrypted") == "encrypted"


def test_numbers(spark):
    assert one(spark, T.month_index(F.col("y"), F.lit(None).cast("int")), y=2021) == 24252
    assert one(spark, T.valid_month(F.col("m")), m=13) is None and one(spark, T.valid_year(F.col("m"), 2025), m=1949) is None
    assert one(spark, T.years_of(F.col("m")), m=27) == 2.2  # half to even
    assert one(spark, T.sigmoid(F.col("m") * 1000), m=-1) == 0.0 and one(spark, T.sigmoid(F.col("m") * 0), m=1) == 0.5
    zero = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>").select(T.unit(F.col("v"))).collect()
    assert [r[0] for r in zero] == [[0.0, 0.0], [0.6, 0.8]]


def test_heading_of_one_string_is_the_column(spark):
    r = random.Random(4)
    texts = ["".join(r.choice(["#", " ", "a", "Work", "é", ":", "-", "–", "_", "\t", "  "]) for _ in range(r.randrange(0, 9))) for _ in range(400)]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(x.h == T.heading_of(x.t) for x in d.select("t", T.heading(F.col("t")).alias("h")).collect())

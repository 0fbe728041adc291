"""Text, vector and scalar expressions. All are column expressions, so they stay inside the JVM."""

from __future__ import annotations

import re

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import BULLETS, DEGREES, STOPWORDS

_GLYPHS = "[" + "".join(rf"\x{{{ord(c):04X}}}" for c in BULLETS) + "]"
TOKEN = r"[a-z0-9][a-z0-9+#.\-]*"


def bullet_text(text: Column) -> Column:
    """The line without its list glyph, left-trimmed; a glyph with nothing behind it stays."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), rf"^{_GLYPHS}\s*(?=\S)", "")


def is_bullet(text: Column) -> Column:
    return text.rlike(rf"^\s*{_GLYPHS}\s*\S")


def heading(text: Column) -> Column:
    """Upper case without leading #s and trailing marks, spaces collapsed."""
    bare = F.regexp_replace(F.trim(text), r"^#+", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^\s+|\s+$", ""), r"[:\-_–—]+$", "")
    return F.upper(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def heading_of(text: str) -> str:
    """The same for one string."""
    bare = re.sub(r"[:\-_–—]+\Z", "", re.sub(r"^#+", "", text.strip(" ")).strip(" \t\n\x0b\f\r"))
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", bare).strip(" ").upper()


def _stripped(text: Column, chars: str) -> Column:
    return F.regexp_replace(text, rf"^[{chars}]+|[{chars}]+$", "")


def skill_surface(text: Column) -> Column:
    return _stripped(F.regexp_replace(text, r"\s+", " "), r" .,;•\-")


def vocabulary_form(text: Column) -> Column:
    """Lower case; characters outside letters, digits and + # . / - become spaces."""
    return _stripped(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9+#./ \-]", " "), r"\s+", " "), r" .\-")


def comparison_form(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9+#. ]", " "), r"\s+", " "))


def tokens(text: Column) -> Column:
    """Technical tokens: c++ and c# survive, node.js also gives node and js, stop words go."""
    stop = F.array(*map(F.lit, STOPWORDS))
    bare = F.filter(F.transform(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), 1), lambda t: F.regexp_replace(t, r"^[.\-]+|[.\-]+$", "")), lambda t: (t != "") & ~F.array_contains(stop, t))
    parts = lambda t: F.filter(F.split(t, r"[.\-]"), lambda p: (F.length(p) > 1) & ~F.array_contains(stop, p))
    return F.flatten(F.transform(bare, lambda t: F.when(t.rlike(r"[.\-]"), F.concat(F.array(t), parts(t))).otherwise(F.array(t))))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    return F.when(norm(v) == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / norm(v)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def bucket128(token: Column) -> Column:
    """md5 of the token modulo 128: its low seven bits."""
    return (F.conv(F.substring(F.md5(token), 31, 2), 16, 10).cast("int") % 128).cast("int")


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content.cast("binary"), 256), 1, 16)


def error_status(message: Column) -> Column:
    return F.when(F.lower(message).rlike("password|encrypt"), "encrypted").otherwise("corrupt")


def month_index(year: Column, month: Column) -> Column:
    return year * 12 + F.coalesce(month, F.lit(1)) - 1


def valid_month(month: Column) -> Column:
    return F.when(month.between(1, 12), month)


def valid_year(year: Column, as_of: int, ahead: int = 1) -> Column:
    return F.when(year.between(1950, as_of + ahead), year)


def degree_rank(degree: Column) -> Column:
    return F.coalesce(reduce(lambda c, k: c.when(degree == DEGREES[k], k), range(1, len(DEGREES)), F.when(degree == DEGREES[0], 0)), F.lit(0))


def collection_key(model: Column) -> Column:
    return F.regexp_replace(F.substring(F.concat(F.lit("chunks_"), F.regexp_replace(model, "[^a-zA-Z0-9_-]", "_")), 1, 63), "[_-]+$", "")


def years_of(months: Column) -> Column:
    """Years to one digit, half to even."""
    return F.bround(months / 12, 1)


def cache_key(fingerprint: str, text: Column, length: int = 32) -> Column:
    """A content-addressed key: the schema or model it depends on, then the text."""
    return F.substring(F.sha2(F.concat(F.lit(fingerprint), F.lit("|"), text), 256), 1, length)

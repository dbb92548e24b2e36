"""Tallies of matches, exact occurrence counts, index statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.paths import dirname, extension
from siftline.functions.patterns import Pattern
from siftline.operators.search import match_records

AXES = ("file", "dir", "ext", "match")


def axis(by: str | Column) -> Column:
    if isinstance(by, Column):
        return by
    if by not in AXES:
        raise ValueError(f"unknown axis {by!r}; one of {', '.join(AXES)}")
    path = F.col("path")
    first = F.coalesce(F.get("submatches", F.lit(0))["text"], F.trim("line"))
    return {"file": path, "dir": dirname(path), "ext": extension(path), "match": first}[by]


def tally(matches: DataFrame, by: str | Column = "file", top: int = 0) -> DataFrame:
    """key, count, files of ``match`` records, most first, ties by key; ``top`` 0 gives all."""
    rows = matches.where("kind = 'match'").select(axis(by).alias("key"), "path")
    out = rows.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.count_distinct("path").alias("files")).orderBy(F.desc("count"), "key")
    return out.limit(top) if top > 0 else out


def total(tallied: DataFrame) -> int:
    """The matches of all keys."""
    return tallied.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]


def get(tallied: DataFrame, key: str) -> int:
    """The matches of one key, 0 if it has none."""
    return total(tallied.where(F.col("key") == key))


def summary(docs: DataFrame, p: Pattern, by: str | Column = "file", top: int = 0) -> DataFrame:
    return tally(match_records(docs, p), by, top)


def literal_count(docs: DataFrame, text: str) -> DataFrame:
    """path and n: occurrences of a literal anywhere in a file, overlapping ones too."""
    quoted = "(?=\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E)"
    return docs.where(F.contains("body", F.lit(text))).select("path", F.regexp_count("body", F.lit(quoted)).cast("long").alias("n"))


def literal_total(docs: DataFrame, text: str) -> DataFrame:
    return literal_count(docs, text).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"), F.count_distinct("path").alias("files"))


def literal_tally(docs: DataFrame, text: str, top: int = 20) -> DataFrame:
    """Heaviest files first, ties by path."""
    return literal_count(docs, text).groupBy("path").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "path").limit(top)

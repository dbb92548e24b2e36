"""Ranked search: definitions first, by fused ranks of several signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.paths import depth
from siftline.functions.patterns import Pattern
from siftline.operators.search import matching_lines
from siftline.sources.stored import written

#: What a declaration begins with, and what generated files say of themselves. Fixed values.
DECLARES = r"^\s*(?:export\s+|pub\s+|public\s+|static\s+|async\s+)*(?:def|class|func|fn|struct|enum|type|interface|trait|const|var|let|function|module)\s"
GENERATED = r"(?i)do not edit|generated by|@generated|(^|/)(gen|generated|vendor|dist|build)/|\.min\.|_pb2?\."
MIRRORED = r"(^|/)(mirror|third_party|node_modules)/"
#: Weights of the ranks, which sum to 3.75 / 61 at most; a definition's boost outweighs them all, and a
#: generated file's demotion all of these.
WEIGHTS = {"by_count": 1.5, "by_density": 1.0, "by_shape": 0.75, "by_depth": 0.5}
BOOST, DEMOTION = 0.125, 1.0
SMOOTHING = 60
#: A line's shape is its first runs of letters, digits, blanks and other characters: at most 4**SHAPE kinds.
SHAPE = 8


def shape(line: Column) -> Column:
    for kind, mark in (("[A-Za-z]+", "a"), ("[0-9]+", "9"), (r"\s+", " "), ("[^a9 ]", ".")):
        line = F.regexp_replace(line, kind, mark)
    return F.substring(line, 1, SHAPE)


def best_lines(hits: DataFrame) -> DataFrame:
    """path, count, width (characters of its matching lines) and ``best`` (use, line_number, line): each file's
    first declaration or, if it has none, its first match."""
    use = F.when(F.rlike("line", F.lit(DECLARES)), 0).otherwise(1)
    best = F.min(F.struct(use.alias("use"), "line_number", "line"))
    return hits.groupBy("path").agg(F.count(F.lit(1)).alias("count"), best.alias("best"), F.sum(F.length("line") + 1).alias("width"))


def ranked(docs: DataFrame, p: Pattern, top: int = 20) -> DataFrame:
    """rank, path, line_number, kind, count, snippet: the best line of each of the best files.

    Lines are reduced to one row per matching file. Every signal has few distinct values (densities in
    thousandths, shapes by powers of two of how many files share them), so ranks are places among those values: no
    order over all files is asked for but the last, of which Spark keeps ``top`` rows per task."""
    files = best_lines(matching_lines(docs, p))
    where = F.concat_ws("\n", "path", "best.line")
    kind = F.when(F.rlike("path", F.lit(MIRRORED)), "mirror").when(F.rlike(where, F.lit(GENERATED)), "gen").when(F.col("best.use") == 0, "def").otherwise("use")
    files = written(files.select("path", "count", "best.line_number", "best.line", "width", kind.alias("kind"), shape(F.col("best.line")).alias("shape")))
    # at most 4**SHAPE rows
    shared = files.groupBy("shape").agg(F.floor(F.log2(F.count(F.lit(1)))).alias("sharing"))
    files = files.join(F.broadcast(shared), "shape")
    signals = {
        "by_count": -F.col("count"), "by_density": F.expr("-(1000 * count div width)"),
        "by_shape": F.col("sharing"), "by_depth": depth(F.col("path")),
    }
    values = files.agg(*[F.sort_array(F.collect_set(s)).alias(name) for name, s in signals.items()])
    files = files.crossJoin(F.broadcast(values))  # one row
    score = sum((F.lit(w) / (F.array_position(name, signals[name]) + SMOOTHING) for name, w in WEIGHTS.items()), F.lit(0.0))
    score = score + F.when(F.col("kind") == "def", BOOST).when(F.col("kind").isin("gen", "mirror"), -DEMOTION).otherwise(0.0)
    files = files.withColumn("score", score).orderBy(F.desc("score"), "path").limit(top)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "path"))  # of ``top`` rows
    return files.select(place.alias("rank"), "path", "line_number", "kind", "count", F.trim("line").alias("snippet"))

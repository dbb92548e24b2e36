"""Documents to numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pieces(body: Column, separator: str = "\n", crlf: bool = False) -> Column:
    """The records of a text; what follows the last separator counts unless it is empty. ``crlf``
    takes a carriage return off the end of each."""
    parts = F.split(body, F.lit("\\n" if separator == "\n" else "\\x00"), F.lit(-1))
    out = F.transform(F.array(parts), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))[0]
    return F.transform(out, lambda x: F.regexp_replace(x, F.lit(r"\r\z"), F.lit(""))) if crlf else out


def explode_lines(docs: DataFrame, separator: str = "\n", crlf: bool = False) -> DataFrame:
    """doc_id, path, line_number (from 1), line."""
    out = docs.select("doc_id", "path", F.posexplode(pieces(F.col("body"), separator, crlf)).alias("at", "line"))
    return out.select("doc_id", "path", (F.col("at") + 1).cast("long").alias("line_number"), "line")


def line_offsets(docs: DataFrame) -> DataFrame:
    """Lines with ``byte_offset``, where each begins in its document."""
    ends = F.transform(pieces(F.col("body")), lambda x: F.octet_length(x) + 1)
    start = F.transform(ends, lambda _, i: F.aggregate(F.slice(ends, F.lit(1), i), F.lit(0).cast("long"), lambda a, b: a + b))
    rows = docs.select("doc_id", "path", F.posexplode(F.arrays_zip(pieces(F.col("body")).alias("line"), start.alias("byte_offset"))).alias("at", "z"))
    return rows.select("doc_id", "path", (F.col("at") + 1).cast("long").alias("line_number"), "z.line", "z.byte_offset")

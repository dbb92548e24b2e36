"""Search shapes over lines and documents. Document-level answers never make lines; line-level ones
drop documents without a chance of a match before they do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.patterns import Pattern, to_replacement
from siftline.operators.lines import explode_lines, pieces


def _records(p: Pattern):
    """The records of ``body`` as the pattern's options frame them."""
    return pieces(F.col("body"), "\0" if p.options.null_data else "\n", p.options.crlf)


def _lines(docs: DataFrame, p: Pattern) -> DataFrame:
    return explode_lines(docs, "\0" if p.options.null_data else "\n", p.options.crlf)


def _test(p: Pattern, invert: bool):
    return (lambda x: ~p.found_in(x)) if invert else p.found_in


def _worth(docs: DataFrame, p: Pattern, invert: bool = False) -> DataFrame:
    """The documents that may have an answer; lines without a match can be in any."""
    return docs if invert else docs.where(p.may_be_in(F.col("body")))


def matching_lines(docs: DataFrame, p: Pattern, invert: bool = False, max_count: int | None = None, prefilter: bool = True) -> DataFrame:
    """path, line_number, line of the lines that match (or, inverted, don't)."""
    rows, test = _worth(docs, p, invert or not prefilter), _test(p, invert)
    if max_count is not None:
        # cut inside the document's own array: no window, no shuffle
        numbered = F.transform(_records(p), lambda x, i: F.struct((i + 1).cast("long").alias("line_number"), x.alias("line")))
        hit = F.filter(numbered, lambda x: test(x["line"]))
        return rows.select("path", F.explode(F.slice(hit, F.lit(1), F.lit(max_count))).alias("l")).select("path", "l.*")
    return _lines(rows, p).where(test(F.col("line"))).select("path", "line_number", "line")


def _per_document(docs: DataFrame, p: Pattern, invert: bool = False):
    return F.filter(_records(p), _test(p, invert))


def files_with(docs: DataFrame, p: Pattern, invert: bool = False) -> DataFrame:
    """Paths with a line that matches (or, inverted, with one that doesn't)."""
    return _worth(docs, p, invert).where(F.exists(_records(p), _test(p, invert))).select("path").distinct()


def files_without(docs: DataFrame, p: Pattern, invert: bool = False) -> DataFrame:
    return docs.select("path").distinct().join(files_with(docs, p, invert), "path", "left_anti")


def count_lines(docs: DataFrame, p: Pattern, include_zero: bool = False, invert: bool = False, max_count: int | None = None) -> DataFrame:
    """path and n: matching lines of each file. Counted within the document's row, no shuffle."""
    n = F.size(_per_document(docs, p, invert))
    n = n if max_count is None else F.least(n, F.lit(max_count))
    out = docs.select("path", n.cast("long").alias("n"))
    return out if include_zero else out.where("n > 0")


def count_matches(docs: DataFrame, p: Pattern, invert: bool = False, max_count: int | None = None) -> DataFrame:
    """path and n: occurrences of each file, line by line. Lines without a match have none to count,
    so inverted it is lines that are counted."""
    if invert:
        return count_lines(docs, p, invert=True, max_count=max_count)
    lines = _records(p) if max_count is None else F.slice(_per_document(docs, p), F.lit(1), F.lit(max_count))
    n = F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + p.occurrences(x))
    return _worth(docs, p).select("path", n.alias("n")).where("n > 0")


def only_matching(docs: DataFrame, p: Pattern, replacement: str | None = None, max_count: int | None = None) -> DataFrame:
    """path, line_number, text, start, end (bytes within the line): one row per match. With a
    replacement, ``text`` is what would stand there instead."""
    rows = matching_lines(docs, p, max_count=max_count).select("path", "line_number", F.explode(p.spans(F.col("line"), replacement)).alias("m"))
    return rows.select("path", "line_number", F.col("m.text" if replacement is None else "m.shown").alias("text"), "m.start", "m.end")


def match_records(docs: DataFrame, p: Pattern, invert: bool = False, max_count: int | None = None, before: int = 0, after: int = 0) -> DataFrame:
    """path, line_number, line, kind, submatches. Context lines and lines chosen for having no match
    have no submatches."""
    none = F.array().cast("array<struct<text:string,start:int,end:int>>")
    if before or after:
        rows = with_context(docs, p, before, after, invert, max_count)
    else:
        rows = matching_lines(docs, p, invert, max_count).withColumn("kind", F.lit("match"))
    spans = none if invert else F.when(F.col("kind") == "match", p.spans(F.col("line"))).otherwise(none) if before or after else p.spans(F.col("line"))
    return rows.select("path", "line_number", "line", "kind", spans.alias("submatches"))


def vimgrep(docs: DataFrame, p: Pattern) -> DataFrame:
    """path, line_number, col (byte, from 1), line: one row per match."""
    rows = matching_lines(docs, p).select("path", "line_number", "line", F.explode(p.spans(F.col("line"))).alias("m"))
    return rows.select("path", "line_number", (F.col("m.start") + 1).cast("long").alias("col"), "line")


def replaced(docs: DataFrame, p: Pattern, replacement: str, max_count: int | None = None) -> DataFrame:
    return matching_lines(docs, p, max_count=max_count).withColumn("line", F.regexp_replace("line", F.lit(p.regex), F.lit(to_replacement(replacement))))


def passthru(docs: DataFrame, p: Pattern) -> DataFrame:
    """Every line with whether it matches."""
    return _lines(docs, p).select("path", "line_number", "line", p.found_in(F.col("line")).alias("is_match"))


def with_context(docs: DataFrame, p: Pattern, before: int = 0, after: int = 0, invert: bool = False, max_count: int | None = None) -> DataFrame:
    """Matches and the lines around them: path, line_number, line, kind, group_id. Groups are
    runs without a gap. The frame is of rows within one document. Beyond ``max_count`` a match of
    the file is as any other line."""
    per = Window.partitionBy("doc_id", "path").orderBy("line_number")
    rows = _lines(_worth(docs, p, invert), p).withColumn("hit", _test(p, invert)(F.col("line")))
    if max_count is not None:
        rows = rows.withColumn("hit", F.col("hit") & (F.sum(F.col("hit").cast("long")).over(per) <= max_count))
    rows = rows.withColumn("near", F.max("hit").over(per.rowsBetween(-after, before))).where("near")
    gap = F.col("line_number") - F.lag("line_number").over(per) > 1
    group = F.sum(F.coalesce(gap, F.lit(False)).cast("long")).over(per)
    return rows.select("path", "line_number", "line", F.when(F.col("hit"), "match").otherwise("context").alias("kind"), group.alias("group_id"))


def exists(docs: DataFrame, p: Pattern, invert: bool = False) -> bool:
    """Stops at the first hit."""
    return not _worth(docs, p, invert).where(F.exists(_records(p), _test(p, invert))).limit(1).isEmpty()


def absent(docs: DataFrame, p: Pattern, invert: bool = False) -> bool:
    return not exists(docs, p, invert)


def multiline_spans(docs: DataFrame, p: Pattern) -> DataFrame:
    """path, text, first_line, last_line of matches over whole texts."""
    rows = docs.where(p.may_be_in(F.col("body"))).where(F.rlike("body", F.lit(p.regex)))
    rows = rows.select("path", "body", F.explode(p.spans(F.col("body"))).alias("m"))
    newlines = lambda c: F.octet_length(c) - F.octet_length(F.translate(c, "\n", ""))
    head = F.expr("cast(substring(cast(body as binary), 1, m.start) as string)")
    first = (newlines(head) + 1).cast("long")
    return rows.select("path", F.col("m.text"), first.alias("first_line"), (first + newlines(F.rtrim(F.col("m.text"), F.lit("\n")))).alias("last_line"))


def json_lines(docs: DataFrame, p: Pattern) -> DataFrame:
    """``value``: one JSON record per matching line."""
    return match_records(docs, p).select(F.to_json(F.struct("path", "line_number", "line", "submatches")).alias("value"))


def json_stream(docs: DataFrame, p: Pattern, before: int = 0, after: int = 0, invert: bool = False, max_count: int | None = None) -> DataFrame:
    """path, seq, kind, value: for each file with a match a ``begin`` record, its ``match`` and
    ``context`` records and an ``end`` record, in the order of ``seq``; last, with a null path, one
    ``summary``. Files are independent, so nothing is put in order here."""
    rows = match_records(docs, p, invert, max_count, before, after)
    as_json = lambda kind, *data: F.to_json(F.struct(kind.alias("type"), F.struct(*data).alias("data")))
    body = rows.select("path", F.col("line_number").alias("seq"), "kind", as_json(F.col("kind"), "path", "line_number", "line", "submatches").alias("value"))
    hit = F.col("kind") == "match"
    files = rows.groupBy("path").agg(F.count_if(hit).alias("matched_lines"), F.sum(F.size("submatches").cast("long")).alias("matches"), F.max("line_number").alias("last"))
    record = lambda kind, seq, *data: F.struct(seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), as_json(F.lit(kind), *data).alias("value"))
    ends = F.array(record("begin", F.lit(0), "path"), record("end", F.col("last") + 1, "path", "matched_lines", "matches"))
    totals = (F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("matched_lines", "matches"))
    total = files.agg(F.count(F.lit(1)).alias("files"), *totals).select(F.lit(None).cast("string").alias("path"), record("summary", F.lit(0), "files", "matched_lines", "matches").alias("r"))
    return body.unionByName(files.select("path", F.explode(ends).alias("r")).select("path", "r.*")).unionByName(total.select("path", "r.*"))


def stats(docs: DataFrame, p: Pattern) -> DataFrame:
    """One row: files searched, files with matches, matched lines, matches, bytes."""
    lines, n = F.size(_per_document(docs, p)), F.aggregate(_records(p), F.lit(0).cast("long"), lambda a, x: a + p.occurrences(x))
    rows = docs.select(lines.cast("long").alias("l"), n.alias("n"), F.octet_length("body").cast("long").alias("b"))
    return rows.agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("l") > 0).alias("files_matched"), F.coalesce(F.sum("l"), F.lit(0)).alias("lines_matched"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("matches"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"),
    )


def formatted(
    rows: DataFrame, number: bool = True, separator: str = ":", max_columns: int | None = None, trim: bool = False, with_path: bool = True,
    context_separator: str = "-", preview: bool = False, path_separator: str | None = None, null: bool = False,
) -> DataFrame:
    """``value``: lines as a terminal shows them. Context lines, where ``kind`` tells them, have their
    own separator; a line over ``max_columns`` bytes is left out or, with ``preview``, cut to as
    many characters; ``null`` puts a NUL behind the path."""
    line = F.ltrim("line") if trim else F.col("line")
    if max_columns is not None:
        short = F.concat(F.substring(line, 1, max_columns), F.lit(" [... more]")) if preview else F.lit("[Omitted long line]")
        line = F.when(F.octet_length(line) > max_columns, short).otherwise(line)
    path = F.col("path") if path_separator is None else F.translate("path", "/", path_separator)
    number_ = F.col("line_number").cast("string")
    joined = lambda s: F.concat(*([path, F.lit("\0" if null else s)] if with_path else []), *([number_, F.lit(s)] if number else []), line)
    value = joined(separator)
    if "kind" in rows.columns:
        value = F.when(F.col("kind") == "context", joined(context_separator)).otherwise(value)
    return rows.select(value.alias("value"))


def headed(rows: DataFrame, number: bool = True, separator: str = ":") -> DataFrame:
    """path, seq, value: each file's path at ``seq`` 0 and then its lines without it, at their line numbers;
    files in groups are for ``orderBy("path", "seq")``."""
    line = F.concat(F.col("line_number").cast("string"), F.lit(separator), "line") if number else F.col("line")
    heads = rows.select("path").distinct().select("path", F.lit(0).cast("long").alias("seq"), F.col("path").alias("value"))
    return heads.unionByName(rows.select("path", F.col("line_number").alias("seq"), line.alias("value")))


def within_budget(rows: DataFrame, budget: int) -> DataFrame:
    """Of rows with ``value``, in their order, as many as ``budget`` bytes hold (a line break each)."""
    order = [c for c in ("path", "line_number", "seq") if c in rows.columns]
    # a row has a byte at least: more than ``budget`` rows never fit, and that bounds the one task
    first = rows.orderBy(*order).limit(budget) if order else rows.limit(budget)
    used = F.sum(F.octet_length("value").cast("long") + 1).over(Window.orderBy(*(order or [F.lit(0)])).rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("_used", used).where(F.col("_used") <= budget).drop("_used")


def in_order(rows: DataFrame, by: str = "path", reverse: bool = False) -> DataFrame:
    """Rows by path (folder by folder) or by ``modified``, then by line where there are lines."""
    if by not in ("path", "modified"):
        raise ValueError(f"can't sort by {by!r}; path or modified")
    if by == "modified" and by not in rows.columns:
        raise ValueError("the rows have no column modified")
    path = F.split("path", "/")
    keys = [path] if by == "path" else [F.col("modified"), path]
    lines = ["line_number"] if "line_number" in rows.columns else []
    return rows.orderBy(*(k.desc() if reverse else k.asc() for k in keys), *lines)

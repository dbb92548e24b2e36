"""Benchmark decontamination by winnowing (operator 6), of DataFrame functions alone.

A text's fingerprints are the smallest hash of its 5-word grams in every run of four, so any shared
span of eight words shares the fingerprint chosen within it: no long enough span is missed. Training
and benchmark fingerprints meet first; where they agree the hit is extended to its whole window of
words, which is compared word for word. Benchmark items of under eight words are one window each
and met by a hash of all their words.

While the benchmark has at most ``LITERALS`` fingerprints, they go into the plan as a set and most
document windows end there, without a row or a shuffle; only rows of windows move. Beyond that, the
distinct fingerprints of each document are joined with the benchmark's first, and only windows whose
fingerprints meet become rows; for that each text is written and moved once.

Defined cases: null and empty texts have no words, no hits and are clean; items without words or
without id have no windows; rows that share an item id are one item; repeated documents are kept;
an empty benchmark hits nothing; other columns are ignored, and kept by ``clean``, which takes out rows
with any item by default: ``report`` calls two items contamination, but one leaked passage is one too many
to train on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import materialise, without

WINDOW, GRAM = 8, 5
LITERALS = 60_000
BROADCAST_ROWS = 200_000
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL), BETWEEN), "")


def _window(start: str, length: str) -> str:
    return f"concat_ws(' ', slice(words, {start} + 1, {length}))"


def winnowed(rows: DataFrame) -> DataFrame:
    """Adds ``marks``: for each window of eight words, the fingerprint kept from it."""
    grams = f"if(size(words) >= {WINDOW}, transform(sequence(0, size(words) - {GRAM}), i -> xxhash64(slice(words, i + 1, {GRAM}))), array())"
    rows = rows.withColumn("grams", F.expr(grams).cast("array<bigint>"))
    run = WINDOW - GRAM + 1
    marks = f"if(size(grams) > 0, transform(sequence(1, size(grams) - {run - 1}), i -> array_min(slice(grams, i, {run}))), array())"
    return rows.withColumn("marks", F.expr(marks).cast("array<bigint>")).drop("grams")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, length, mark, window: one row for each distinct window of each item."""
    rows = winnowed(benchmark.select("item_id", words("text").alias("words")).where("item_id is not null and size(words) > 0"))
    long = f"transform(marks, (m, i) -> struct({WINDOW} as length, m as mark, {_window('i', str(WINDOW))} as window))"
    short = f"array(struct(size(words) as length, xxhash64(words) as mark, {_window('0', 'size(words)')} as window))"
    return rows.select("item_id", F.explode(F.expr(f"if(size(words) >= {WINDOW}, {long}, {short})")).alias("w")).select("item_id", "w.*").distinct()


def _prints(length: int) -> tuple[str, str, str]:
    """Of the document windows of one length: whether there are any, their starts, and the fingerprint at start s."""
    if length == WINDOW:
        return "size(marks) > 0", "sequence(0, size(marks) - 1)", "get(marks, s)"
    return f"size(words) >= {length}", f"sequence(0, size(words) - {length})", f"xxhash64(slice(words, s + 1, {length}))"


def _candidates(length: int, marks: list[int] | None) -> str:
    """The document windows of one length whose fingerprint the benchmark has, as structs: one of
    ``marks``, or (None) of the row's own ``met``."""
    some, found, value = _prints(length)
    if marks is None:
        member = f"array_contains(met, struct({length} as length, {value} as mark))"
    else:
        member = f"{value} IN ({', '.join(f'{m}L' if m > -(2**63) else 'bigint(-9223372036854775808)' for m in marks)})"
    return f"if({some}, transform(filter({found}, s -> {member}), s -> struct(s as start, {length} as length, {_window('s', str(length))} as window)), array())"


def _met(rows: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """row, met: the distinct fingerprints (length, mark) of each row that the benchmark has too."""
    each = []
    for n in lengths:
        some, found, value = _prints(n)
        each.append(f"if({some}, transform(array_distinct(transform({found}, s -> {value})), m -> struct({n} as length, m as mark)), array())")
    own = rows.select("row", F.explode(F.expr(f"concat(cast(array() as array<struct<length:int,mark:bigint>>), {', '.join(each)})")).alias("f")).select("row", "f.*")
    both = own.join(windows.select("length", "mark").distinct(), ["length", "mark"], "left_semi")
    return both.groupBy("row").agg(F.collect_list(F.struct("length", "mark")).alias("met"))


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, spans (start and length of hit windows) and items."""
    windows = materialise(benchmark_windows(benchmark))
    sizes = {r["length"]: (r["n"], r["m"]) for r in windows.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("mark").alias("m")).collect()}
    n_rows, n_marks = sum(n for n, _ in sizes.values()), sum(m for _, m in sizes.values())
    marks: dict[int, list[int]] = {}
    if n_marks <= LITERALS:  # the size that bounds both this collect and the plan
        for r in windows.select("length", "mark").distinct().collect():
            marks.setdefault(r["length"], []).append(r["mark"])
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    if sizes and not marks:
        rows = materialise(rows)  # its numbers are joined by
    rows = winnowed(rows.select("row", "doc_id", words("text").alias("words"))).withColumn("n_words", F.size("words").cast("long"))
    if sizes and not marks:
        rows = rows.join(_met(rows, windows, sorted(sizes)), "row", "left").withColumn("met", F.coalesce("met", F.expr("cast(array() as array<struct<length:int,mark:bigint>>)")))
    empty = "cast(array() as array<struct<start:int,length:int,window:string>>)"
    found = ", ".join([empty, *(_candidates(n, sorted(marks[n]) if marks else None) for n in sorted(sizes))])
    rows = rows.select("row", "doc_id", "n_words", F.explode_outer(F.expr(f"concat({found})")).alias("h")).select("row", "doc_id", "n_words", "h.*")
    known = windows.select("item_id", F.col("window").alias("known"), F.col("length").alias("known_length"))
    if n_rows <= BROADCAST_ROWS:
        known = F.broadcast(known)
    met = rows.join(known, (F.col("window") == F.col("known")) & (F.col("length") == F.col("known_length")), "left")
    hit = F.col("item_id").isNotNull()
    return met.groupBy("row", "doc_id", "n_words").agg(
        F.array_sort(F.collect_set(F.when(hit, F.struct("start", "length")))).alias("spans"), F.collect_set("item_id").alias("items")
    )


def report(docs: DataFrame, benchmark: DataFrame, least_items: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row."""
    #: words under the union of spans: each adds what reaches beyond all before it
    covered = """aggregate(spans, struct(0 as until, 0L as n),
        (a, s) -> struct(greatest(a.until, s.start + s.length) as until,
                         a.n + greatest(0, s.start + s.length - greatest(a.until, s.start)) as n), a -> a.n)"""
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return hits(docs, benchmark).select(
        "doc_id",
        "n_words",
        F.expr(covered).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        (F.size("items") >= least_items).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, least_items: int = 1) -> DataFrame:
    """The rows of ``docs``, all columns, with windows of fewer than ``least_items`` items. A row is
    judged by its own text, whatever ids it shares."""
    digest = F.unhex(F.md5("text"))
    bad = hits(docs.select(digest.alias("doc_id"), "text"), benchmark).where(F.size("items") >= least_items).select("doc_id")
    return without(docs, digest, bad)


_LETTERS = f"translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}')"
_WORDS = rf"regexp_extract_all({_LETTERS}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    k AS (SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[s : s + least(8, len(w)) - 1], ' ') AS g
          FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 6, 2))) AS s FROM b WHERE len(w) > 0)),
    l AS (SELECT DISTINCT n FROM k),
    v AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS g
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, l WHERE len(w) >= n)),
    h AS (SELECT doc_id, item_id, s, v.n FROM v JOIN k ON v.g = k.g AND v.n = k.n),
    p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM h) GROUP BY 1),
    i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
    FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)"""

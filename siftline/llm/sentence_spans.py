"""Substring deduplication by sliding spans of sentences (operator 10).

From every sentence, the run of at least ``RUN`` consecutive sentences that first reaches
``LEAST_WORDS`` words is hashed, and so is the run that first does backwards, so that a passage's last
sentences are covered like its first. The hashes, of 96 bits, are joined over the whole corpus; sentences covered by any span but the first of its kind are removed. First is the smallest (doc_id, place). A sentence
of at least ``LONE_WORDS`` words is also a span of its own, so a passage without inner stops isn't
lost. What decides a span is inside it, so a passage has the same spans wherever it stands.

A sentence ends at a line break, or at white space after a word with a stop behind its last letter.
ASCII case is ignored. Counting before joining keeps a span that any part of the rows shares to one
partial count per task; only spans met twice are joined back, the common ones by broadcast so that
their rows stay where they are.

Defined cases: null and empty texts have no sentences and stay as they are; a null id counts as the
largest; rows that share an id are treated alike; within a text only whole sentences go, with the
white space that follows them; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import IdFilter, discard, materialise, mix, power_tables, row_count, small_batches, span_hashes, spans_of, text_chunks

RUN = 2
LEAST_WORDS = 12
LONE_WORDS = 30
#: A span that more than one in ``COMMON`` rows hold is joined by broadcast. There are fewer than
#: ``COMMON`` such spans however large the table, which bounds what is broadcast.
COMMON = 2000
KEY = ["hash", "check"]

_codes = np.arange(256)
_BLANK = np.isin(_codes, [32, 9, 10, 11, 12, 13])
_LETTER = ((_codes >= 48) & (_codes <= 57)) | ((_codes >= 65) & (_codes <= 90)) | ((_codes >= 97) & (_codes <= 122)) | (_codes >= 128)
_STOP = np.isin(_codes, [33, 46, 63])


def sentences(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends, rows, word counts and hashes of all sentences of a run of texts."""
    starts, ends, rows = spans_of(~_BLANK[buf], offsets)
    n = len(starts)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64)
    at = np.arange(len(buf) + 1)
    letter = np.maximum.accumulate(np.where(_LETTER[buf], at[1:], 0))  # place after the last letter so far
    stops = np.concatenate([[0], np.cumsum(_STOP[buf])])
    breaks = np.concatenate([[0], np.cumsum(buf == 10)])
    behind = np.maximum(letter[ends - 1], starts)
    last = stops[ends] > stops[behind]
    last[:-1] |= (rows[1:] != rows[:-1]) | (breaks[starts[1:]] > breaks[ends[:-1]])
    last[-1] = True
    stop = np.flatnonzero(last)
    first = np.concatenate([[0], stop[:-1] + 1])
    return starts[first], ends[stop], rows[first], stop - first + 1, span_hashes(buf, starts[first], ends[stop])


def spans(docs: DataFrame, run_length: int = RUN, least_words: int = LEAST_WORDS, lone_words: int = LONE_WORDS) -> DataFrame:
    """hash and check (96 bits of the span), doc_id, place (first sentence), length (sentences) of every span."""

    def run(batches):
        for b in batches:
            for i, _, buf, offsets in text_chunks(b.column(1)):
                starts, ends, rows, words, hashes = sentences(buf, offsets)
                checks = span_hashes(buf, starts, ends, other=True)
                if not len(rows):
                    continue
                place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                total = np.concatenate([[0], np.cumsum(words)])
                until = np.maximum(np.searchsorted(total, total[:-1] + least_words), np.arange(len(rows)) + run_length)
                end = np.minimum(until, len(rows)) - 1
                whole = np.flatnonzero((until <= len(rows)) & (rows[end] == rows))
                until = until[whole]
                # the latest start from which the words up to a sentence's end suffice
                last = np.arange(len(rows))
                since = np.minimum(np.searchsorted(total, total[1:] - least_words, "right") - 1, last - run_length + 1)
                back = np.flatnonzero((since >= 0) & (rows[np.maximum(since, 0)] == rows))
                # runs that are both are one span
                back = back[~np.isin(since[back] * (len(rows) + 1) + back + 1, whole * (len(rows) + 1) + until)]
                whole, until = np.concatenate([whole, since[back]]), np.concatenate([until, back + 1])
                up, down = power_tables(len(rows) + 1)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(rows)], dtype=np.uint64)])
                run_hashes = mix((sums[until] - sums[whole]) * down[whole] + (until - whole).astype(np.uint64))
                # a second sum, over other hashes of the sentences
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(checks * up[: len(rows)], dtype=np.uint64)])
                run_checks = mix((sums[until] - sums[whole]) * down[whole])
                lone = words >= lone_words
                for hash_, check, pick, length in ((run_hashes, run_checks, whole, until - whole), (hashes[lone], checks[lone], np.flatnonzero(lone), np.ones(int(lone.sum())))):
                    if len(pick):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(hash_.view(np.int64)), pa.array((check >> np.uint64(32)).astype(np.uint32).view(np.int32)), b.column(0).take(pa.array(rows[pick] + i)), pa.array(place[pick].astype(np.int32)), pa.array(length.astype(np.int32))],
                            ["hash", "check", "doc_id", "place", "length"],
                        )

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, "hash long, check int, doc_id long, place int, length int")


def repeats(found: DataFrame) -> DataFrame:
    """doc_id and ``covered``: the sentences under spans that aren't the first of their kind (a written table)."""
    order = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "place")
    first = materialise(found.groupBy(*KEY).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    common = F.col("n") > row_count(found) / COMMON
    few, rest = F.broadcast(first.where(common).drop("n")), first.where(~common).drop("n")
    met = found.join(few, KEY).unionByName(found.join(few.select(*KEY), KEY, "left_anti").join(rest, KEY))
    later = met.where(order != F.col("first"))
    out = materialise(later.groupBy("doc_id").agg(F.collect_set(F.struct("place", "length")).alias("covered")))
    discard(first)
    return out


def deduplicate(docs: DataFrame, run_length: int = RUN, least_words: int = LEAST_WORDS, lone_words: int = LONE_WORDS) -> DataFrame:
    """doc_id, n_sentences, n_removed, removed (byte spans of the whole text) and the text that is left."""
    found = materialise(spans(docs, run_length, least_words, lone_words))
    marked = repeats(found)
    discard(found)
    shared = docs.sparkSession.sparkContext.broadcast(IdFilter.of(marked.where("doc_id is not null").select("doc_id"), row_count(marked)))
    texts = small_batches(docs.select("doc_id", "text"))
    schema = "doc_id long, n_sentences long, n_removed long, removed array<struct<begin:int,end:int>>, text string"

    def likely(batches):
        for b in batches:
            yield b.filter(IdFilter.may_have(shared.value, b.column(0)))

    def others(batches):
        yield from run(b.filter(pc.invert(IdFilter.may_have(shared.value, b.column(0)))) for b in batches)

    def run(batches):
        for b in batches:
            ids, texts, covered = b.column(0), b.column(1), b.column(2) if b.num_columns > 2 else None
            for i, j, buf, offsets in text_chunks(texts):
                starts, ends, rows, _, _ = sentences(buf, offsets)
                bounds = np.searchsorted(rows, np.arange(j - i + 1))
                n, removed, left = [], [], []
                for r in range(j - i):
                    s, e = starts[bounds[r] : bounds[r + 1]], ends[bounds[r] : bounds[r + 1]]
                    n.append(len(s))
                    marks = covered[i + r].as_py() if covered is not None else None
                    if not marks:
                        removed.append([])
                        left.append(texts[i + r].as_py())
                        continue
                    gone = np.zeros(len(s) + 1, bool)
                    for m in marks:
                        gone[m["place"] : m["place"] + m["length"]] = True
                    until = np.append(s[1:], offsets[r + 1])
                    keep = [buf[offsets[r] : s[0]].tobytes()] + [buf[s[k] : until[k]].tobytes() for k in range(len(s)) if not gone[k]]
                    removed.append([{"begin": int(s[k] - offsets[r]), "end": int(e[k] - offsets[r])} for k in np.flatnonzero(gone[:-1])])
                    left.append(b"".join(keep).decode())
                kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [ids[i:j], pa.array(n, pa.int64()), pa.array(map(len, removed), pa.int64()), pa.array(removed, kind), pa.array(left, pa.string())],
                    ["doc_id", "n_sentences", "n_removed", "removed", "text"],
                )

    # only texts that may lose something move
    moved = texts.mapInArrow(likely, "doc_id long, text string").join(marked.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return moved.select("doc_id", "text", "covered").mapInArrow(run, schema).unionByName(texts.mapInArrow(others, schema))

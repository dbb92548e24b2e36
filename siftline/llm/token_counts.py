"""Exact token counts by prefix dynamic programming (operator 9).

A byte-pair encoder works piece by piece, where pieces come from a fixed splitting pattern. Within
a piece, for every prefix, exactly one vocabulary entry can be its last token: the one that leaves
a prefix whose own last token may stand before it (joining the two was never due earlier than the
merges that made them). So ``count[i] = count[i - len(last)] + 1`` gives the exact count at every
prefix in one pass, and truncation or budget questions need no encoding afterwards. Pieces recur,
so each worker keeps the answers of those it met (bounded; emptied when full).

Defined cases: null and empty texts have 0 bytes and 0 tokens; strings of the vocabulary's added
tokens inside a text count as one token each, as the library does by default; repeated rows and
null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import json
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from siftline.llm.common import small_batches, span_hashes, text_buffer, text_chunks

#: The splitting pattern of byte-level BPE. Fixed value.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+".replace(r"\s", r"\p{White_Space}").replace(
    r"\S", r"\P{White_Space}"
)
CACHE_ENTRIES = 700_000
OTHER, SPACE, LETTER, NUMBER = range(4)


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable letter: printable Latin-1 bytes as
    themselves, the rest as the code points from 256 up, in order."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def is_space(text: str) -> bool:
    return regex.fullmatch(r"\p{White_Space}+", text) is not None


@lru_cache(maxsize=1)
def letter_kinds() -> np.ndarray:
    """OTHER, SPACE, LETTER or NUMBER of every code point."""
    table = np.zeros(0x110000, np.uint8)
    points = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, name in ((SPACE, "White_Space"), (LETTER, "L"), (NUMBER, "N")):
        table[[ord(c) for c in regex.findall(rf"\p{{{name}}}", points)]] = kind
    return table


def split_pieces(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and rows of the pieces of ``PIECES``, for many texts at once.

    A piece is a run of one kind. Of a run of white space before anything else, the last character
    stands apart, and joins what follows if it is a plain space. A lone apostrophe before certain
    letters takes those with it."""
    none = np.zeros(0, np.int64)
    if not len(buf):
        return none, none, none
    points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    n = len(points)
    kind = letter_kinds()[points]
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[n] = True
    edge[np.searchsorted(at, offsets[:-1])] = True
    cut = edge.copy()
    cut[1:n] |= kind[1:] != kind[:-1]
    blank = kind == SPACE
    last_blank = np.zeros(n, bool)  # white space with other text right after it
    last_blank[: n - 1] = blank[:-1] & ~blank[1:] & ~edge[1:n]
    cut[:n] |= last_blank
    joins = np.flatnonzero(last_blank & (points == 32))
    cut[joins + 1] = False
    quote = np.flatnonzero((points == 39) & cut[:n])
    quote = quote[quote + 1 < n]
    quote = quote[cut[quote + 1] & ~edge[quote + 1]]
    if len(quote):
        one = points[quote + 1]
        two = np.where((quote + 2 < n) & ~edge[np.minimum(quote + 2, n)], points[np.minimum(quote + 2, n - 1)], 0)
        is_in = lambda x, s: np.isin(x, [ord(c) for c in s])
        short = is_in(one, "stmd")
        long = (is_in(one, "rv") & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        cut[quote[short | long] + 1] = False
        cut[quote[short] + 2] = True
        cut[quote[long] + 3] = True
    first = np.flatnonzero(cut)
    bounds = np.append(at, len(buf))[first]
    return bounds[:-1], bounds[1:], np.searchsorted(offsets, bounds[:-1], "right") - 1


class PrefixCounter:
    """Token counts of one vocabulary file (``.json`` with byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        # Tokens are numbered by the merge that makes them; single bytes come first.
        self.number: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for left, right in merges:
            a, b = self.number[raw(left)], self.number[raw(right)]
            whole = raw(left) + raw(right)
            if whole not in self.number:
                self.number[whole] = len(self.halves)
                self.halves.append((a, b))
            self.joined.setdefault((a, b), self.number[whole])
        #: Finds, at every place of a piece (bytes as Latin-1 letters), the tokens ending there, longest first.
        self.ending = ahocorasick.Automaton()
        for token, n in self.number.items():
            self.ending.add_word(token.decode("latin-1"), (n, len(token)))
        self.ending.make_automaton()
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.added_texts = added
        self.pieces = regex.compile(PIECES)
        self.known: dict[int, int] = {}
        self.follows: dict[int, bool] = {}

    def may_follow(self, left: int, right: int) -> bool:
        """Whether ``right`` can stand after ``left``. Going back through the merges in the reverse
        order of their making, no pair that met at the seam was due to be joined earlier."""
        key = left << 20 | right
        answer, bar = True, len(self.halves) + 1
        while True:
            made = self.joined.get((left, right))
            if made is not None and made < bar:
                answer = False
                break
            byte_left, byte_right = left < 256, right < 256
            if byte_left and byte_right:
                break
            if byte_right or (not byte_left and left > right):
                bar, left = left, self.halves[left][1]
            else:
                # at equal times the pair further left is joined first
                bar, right = right + 1, self.halves[right][0]
        if len(self.follows) > 2_000_000:
            self.follows.clear()
        self.follows[key] = answer
        return answer

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Tokens of ``piece[:i]`` for each i from 0 to its length."""
        counts, last = [0] * (len(piece) + 1), [-1] * (len(piece) + 1)
        follows, may_follow, done = self.follows, self.may_follow, -1
        for end, (token, n) in self.ending.iter(piece.decode("latin-1")):
            if end == done:
                continue
            start = end + 1 - n
            if start:
                key = last[start] << 20 | token
                fits = follows.get(key)
                if not (may_follow(last[start], token) if fits is None else fits):
                    continue
            done = end
            last[end + 1], counts[end + 1] = token, counts[start] + 1
        return counts

    def piece_count(self, piece: str) -> int:
        return self.prefix_counts(piece.encode("utf-8", "surrogatepass"))[-1]

    def segments(self, text: str):
        """(start, end, is_added) of the stretches between added tokens, and of those tokens."""
        at = 0
        if self.added is not None and any(a in text for a in self.added_texts):
            for m in self.added.finditer(text):
                if m.start() > at:
                    yield at, m.start(), False
                yield m.start(), m.end(), True
                at = m.end()
        if at < len(text):
            yield at, len(text), False

    def count(self, text: str) -> int:
        total = 0
        for start, end, added in self.segments(text):
            total += 1 if added else sum(map(self.piece_count, self.pieces.findall(text[start:end])))
        return total

    def count_column(self, column: pa.Array) -> np.ndarray:
        """Tokens of every text of an Arrow column; splitting and look-up run over whole buffers."""
        out, row = np.zeros(len(column), np.int64), 0
        special = [a.encode() for a in self.added_texts]
        for first, end, buf, offsets in text_chunks(column):
            data = buf.tobytes()
            if any(a in data for a in special):
                for i in range(first, end):
                    row = i - first
                    out[i] = self.count(data[offsets[row] : offsets[row + 1]].decode())
                continue
            starts, ends, rows = split_pieces(buf, offsets)
            if not len(starts):
                continue
            keys, at, inverse = np.unique(span_hashes(buf, starts, ends, fold=False), return_index=True, return_inverse=True)
            known, counts = self.known, np.empty(len(keys), np.int64)
            for j, key in enumerate(keys.tolist()):
                n = known.get(key)
                if n is None:
                    n = self.prefix_counts(data[starts[at[j]] : ends[at[j]]])[-1]
                    if len(known) >= CACHE_ENTRIES:
                        known.clear()
                    known[key] = n
                counts[j] = n
            out[first:end] = np.bincount(rows, counts[inverse], end - first).astype(np.int64)
        return out

    def table(self, text: str) -> np.ndarray:
        """``t[i]``: tokens of ``text[:i]`` encoded by itself, for every character prefix.

        A prefix that ends inside a piece can split differently from the whole text only at white
        space or an apostrophe, so those tails are split again; other pieces use their own prefix
        counts. A prefix that ends inside an added token's string is ordinary text."""
        out = np.zeros(len(text) + 1, np.int64)
        base = 0
        for start, end, added in self.segments(text):
            if added:
                for i in range(start + 1, end):
                    out[i] = self.count(text[:i])
                base += 1
                out[end] = base
                continue
            tail = start  # where a re-split has to begin
            done = base  # tokens before ``tail``
            for m in self.pieces.finditer(text, start, end):
                piece = m.group()
                blank = is_space(piece)
                if piece[0] == "'" or blank or is_space(text[tail : m.start()]):
                    for i in range(m.start() + 1, m.end() + 1):
                        out[i] = done + sum(map(self.piece_count, self.pieces.findall(text[tail:i])))
                else:
                    counts = self.prefix_counts(piece.encode("utf-8", "surrogatepass"))
                    at = 0
                    for i, c in enumerate(piece):
                        at += len(c.encode("utf-8", "surrogatepass"))
                        out[m.start() + i + 1] = base + counts[at]
                base += self.piece_count(piece)
                if not blank:
                    tail, done = m.end(), base
            out[end] = base
        return out


def longest_within(table: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix that takes at most ``budget`` tokens."""
    return int(np.flatnonzero(table <= budget)[-1])


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``. A narrow stage: no shuffle."""

    def run(batches):
        c = counter(path)
        for batch in batches:
            tokens = c.count_column(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(text_buffer(batch.column(1))[1])), pa.array(tokens), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def prefix_tables(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ``counts``: tokens at every character prefix, from 0 to the whole text."""

    def run(batches):
        c = counter(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([c.table(x or "") for x in batch.column(1).to_pylist()], pa.list_(pa.int64()))],
                ["doc_id", "counts"],
            )

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, counts array<long>")

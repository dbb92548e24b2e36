"""N-gram Jaccard join by vertical partitioning (operator 1).

Texts are sets of distinct 5-word shingles, as 64-bit hashes; the global order of n-grams is cut
into fragments, overlaps are counted fragment by fragment and summed for each pair. Everything
before that only keeps pairs away that cannot reach the threshold:

1. Equal sets are one class; a class is compared once, whatever its number of copies.
2. A set's partner shares all but a fifth of it (for 0.8). So fragment by fragment, n-grams that no
   other class has are counted; a class that has lost more than its fifth is out. The first pass
   looks at the head of the order over all classes, the second at the rest over those left. Both
   count keys, 24 bits of an n-gram within its fragment: a key that no other class has holds an
   n-gram that no other class has, so what keys tell never takes a class out that could have links.
3. Of the classes left, the n-grams of the lower half of all hashes are ordered by how many classes have
   them, before those of the upper half. Two sets that can reach the threshold share one of their
   first in that order (prefix filter); few sets need to look beyond the lower half.
4. Within the bucket of an n-gram all members are compared to one of them, the pivot. Links found
   join components. Members of a bucket that are still in different components are then compared
   pair by pair, in blocks of bounded size. Parity sketches bound the difference of a pair from below;
   pairs they can't rule out are counted exactly. Pairs within one component need no count:
   they can't change it. So copies and near copies cost a star, not all pairs, and no link that
   joins two components is lost.
5. All links lie within components, so for the number of links all pairs of a component's classes
   are counted exactly, each pair once, in blocks of bounded size. A block gives sums by class and no
   rows of pairs; its work grows with the square of a component. ``keep_one`` goes without.

Sets travel as bytes; a fragment is read in slices, so what a task holds follows the distinct
n-grams of its fragment and not how often they occur. A class is named by 128 bits of its members'
hashes until the classes left are numbered. Tables in the scratch folder go after their last reader; narrow
ones (of classes, pairs, components) are broadcast up to ``common.BROADCAST_KEYS`` rows, and shuffled beyond.

Defined cases: null and empty texts, and texts without words, have n_shingles 0 and link with
nothing; fewer than five words are one shingle; repeated rows are members of one class; a null id
gets its row's size, and the component of its class (null if no member has an id).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import PLACE, IdFilter, bounded, bytes_rows, discard, gram_hashes, materialise, mix, row_count, small_batches, span_hashes, spans_of, text_chunks, without
from siftline.llm.components import components

WORDS = 5
PERCENT = 80
#: Share of the order looked at in the first pass, of 256.
HEAD = 77
#: N-grams of one fragment (about), rows that a slice holds, and fragments of the exact count.
FRAGMENT_NGRAMS = 500_000
SLICE = 1_000_000
PARTS = 8
SKETCH_BITS = 1024
BLOCK = 1500
#: Classes and n-grams (about) on a side of a block that counts links, n-grams of small components counted in
#: one group, n-grams of a slice of its matrix, and up to how many holders an n-gram's pairs are listed instead.
LINK_BLOCK, BLOCK_GRAMS, LINK_GRAMS, LINK_SLICE, LISTED = 1000, 4_000_000, 1_000_000, 4096, 16
#: Buckets of at most so many members are compared without sketches, in a join's condition.
SMALL = 48
#: Bytes of an n-gram within its fragment and of a class, where they are packed.
KEY_BYTES, CLASS_BYTES = 3, 6
CLASS_MASK = (1 << 8 * CLASS_BYTES) - 1

_codes = np.arange(256)
_SEPARATES = np.isin(_codes, [32, 9, 10, 11, 12, 13])
_U = np.uint64


def shingles(buf: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(rows, hashes) of the distinct shingles of a run of texts, by row and then hash."""
    starts, ends, rows = spans_of(~_SEPARATES[buf], offsets)
    words = span_hashes(buf, starts, ends)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = gram_hashes(words, k)
    inside = rows[: len(grams)] == rows[len(rows) - len(grams) :]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    count = np.diff(np.append(first, len(rows)))
    few_rows, few = [], []
    for s, n in zip(first[count < k], count[count < k], strict=True):
        few_rows.append(rows[s])
        few.append((int((words[s : s + n] * PLACE[16 : 16 + n]).sum(dtype=np.uint64)) + int(PLACE[32 + n])) % 2**64)
    r = np.concatenate([rows[: len(grams)][inside], np.array(few_rows, np.int64)])
    h = np.concatenate([grams[inside], mix(np.array(few, np.uint64))])
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])])
    return r[new], h[new]


def _bounds(rows: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(rows, np.arange(n + 1))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _class_ids(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit names of whole sets (sums over mixed members: the order of members has no say)."""
    return mix(_sums(mix(h ^ PLACE[40]), bounds) + mix(_sums(mix(h + PLACE[41]), bounds)) * PLACE[42])


def _class_checks(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64 further bits of the names."""
    return mix(_sums(mix(h ^ PLACE[43]), bounds) + mix(_sums(mix(h + PLACE[44]), bounds)) * PLACE[45])


def _narrow(x: np.ndarray, n_bytes: int) -> np.ndarray:
    """The low bytes of 64-bit values, a row of bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n_bytes])


def _wide(data: bytes, n_bytes: int) -> np.ndarray:
    out = np.zeros((len(data) // n_bytes, 8), np.uint8)
    out[:, :n_bytes] = np.frombuffer(data, np.uint8).reshape(-1, n_bytes)
    return out.view("<u8").ravel()


def _keys(grams: np.ndarray, low: int, high: int, fragments: int) -> tuple[np.ndarray, np.ndarray]:
    """Fragment and key of n-grams of the order's part from ``low`` to ``high`` (of 256)."""
    step = _U(-(-((high - low) << 56) // fragments))
    at = grams - _U(low << 56)
    key = (at % step * _U(0x9E3779B97F4A7C15)) >> _U(64 - 8 * KEY_BYTES)
    return (at // step).astype(np.int32), key


def _n_keys(rows: np.ndarray, fragment: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """How many distinct keys each of ``n`` rows has."""
    # a run of texts has fewer than 2**18 rows, and there are at most 2**20 fragments
    whole = np.sort(rows.astype(np.uint64) << _U(44) | fragment.astype(np.uint64) << _U(24) | key)
    new = np.ones(len(whole), bool)
    new[1:] = whole[1:] != whole[:-1]
    return np.bincount((whole[new] >> _U(44)).astype(np.int64), minlength=n)


def _long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


class _Packer:
    """Collects (fragment, key, class) and gives rows of bytes by fragment."""

    def __init__(self, limit: int = 300_000):
        self.limit, self.size = limit, 0
        self.held: list[tuple[np.ndarray, ...]] = []

    def add(self, fragment: np.ndarray, key: np.ndarray, classes: np.ndarray) -> bool:
        self.held.append((fragment, key, classes))
        self.size += len(key)
        return self.size >= self.limit

    def flush(self):
        if not self.size:
            return None
        f, k, c = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        order = np.argsort(f, kind="stable")
        f = f[order]
        edge = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
        ends = np.append(edge[1:], len(f))
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(edge, ends, strict=True)], pa.binary())
        return f[edge], cut(_narrow(k[order], KEY_BYTES)), cut(_narrow(c[order], CLASS_BYTES))


_PACKED = "fragment int, grams binary, classes binary, ids binary, sizes binary"


def _scan(docs: DataFrame, fragments: int) -> DataFrame:
    """One pass over the texts: n-grams of the head by fragment, and (negative fragments) each
    document's id, class, size and keys in the head."""

    def run(batches):
        packer = _Packer()
        none = pa.nulls(1, pa.binary())
        end = _U(HEAD << 56)

        def packed():
            out = packer.flush()
            if out is not None:
                f, g, c = out
                empty = pa.nulls(len(f), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(f), g, c, empty, empty], ["fragment", "grams", "classes", "ids", "sizes"])

        for b in batches:
            ids = b.column(0)
            for i, j, buf, offsets in text_chunks(b.column(1)):
                rows, h = shingles(buf, offsets)
                bounds = _bounds(rows, j - i)
                classes, n = _class_ids(h, bounds), np.diff(bounds)
                head = h < end
                fragment, key = _keys(h[head], 0, HEAD, fragments)
                in_head = _n_keys(rows[head], fragment, key, j - i)
                own = ids[i:j].fill_null(np.iinfo(np.int64).max).to_numpy()
                own = np.column_stack([own, _class_checks(h, bounds).view(np.int64)])
                sizes = np.column_stack([n, in_head]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([-1 - int(classes[0] % _U(fragments))], pa.int32()), none, pa.array([classes.tobytes()], pa.binary()), pa.array([own.tobytes()], pa.binary()), pa.array([sizes.tobytes()], pa.binary())],
                    ["fragment", "grams", "classes", "ids", "sizes"],
                )
                # copies next to each other add nothing
                _, once = np.unique(classes, return_index=True)
                fresh = np.zeros(j - i, bool)
                fresh[once] = True
                of = rows[head]
                take = fresh[of]
                if packer.add(fragment[take], key[take], classes[of[take]]):
                    yield from packed()
        yield from packed()

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, _PACKED)


class _Shared:
    """Which n-grams of a fragment more than one class has, met slice by slice. Kept: each distinct
    n-gram with its first class and whether a second has come."""

    def __init__(self):
        self.key, self.first, self.many = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)

    def meet(self, key: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Adds a slice; gives the classes, one entry each, of (n-gram, class) now known as shared.
        A class may be given twice for one n-gram, never too seldom."""
        m = len(self.key)
        k, c = np.concatenate([self.key, key]), np.concatenate([self.first, cls])
        old = np.concatenate([np.ones(m, bool), np.zeros(len(key), bool)])
        order = np.lexsort((~old, c, k))
        k, c, old = k[order], c[order], old[order]
        new_key = np.concatenate([[True], k[1:] != k[:-1]])
        new_pair = new_key | np.concatenate([[True], c[1:] != c[:-1]])
        k, c, old, new_key = k[new_pair], c[new_pair], old[new_pair], new_key[new_pair]
        group = np.cumsum(new_key) - 1
        size = np.bincount(group)
        was = np.zeros(len(size), bool)
        was[np.searchsorted(k[new_key], self.key)] = self.many
        many = was | (size > 1)
        # an n-gram's first class is told when the second comes, later ones as they come
        tell = many[group] & (~old | ~was[group])
        keep = np.zeros(len(size), np.uint64)
        keep[group[::-1]] = c[::-1]
        keep[group[old]] = c[old]
        self.key, self.first, self.many = k[new_key], keep, many
        return c[tell]


_PARTIAL = "bucket int, classes binary, counts binary, ids binary, sizes binary"
#: Documents have no ``shared``; counts have nothing but that, and of ``cls`` the low CLASS_BYTES.
_COUNTS = "cls long, sig long, id long, n int, head int, shared long"


def _parts(df: DataFrame, fragments: int) -> int:
    return max(1, min(2 * fragments, max(fragments // 4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))


def _count_shared(packed: DataFrame, fragments: int) -> DataFrame:
    """Per class, how many keys another class has (``shared``); with each document's row.

    Fragments give partial counts, packed by bucket of class; a second shuffle sums them up. Rows
    of documents come out as they are, rows of counts have no id."""
    parts = _parts(packed, fragments)
    buckets = _U(parts)
    names = ["bucket", "classes", "counts", "ids", "sizes"]

    def meet(batches):
        shared: dict[int, _Shared] = {}
        held: dict[int, list] = {}
        told: list[np.ndarray] = []

        def counts(force: bool):
            if told and (force or sum(map(len, told)) > SLICE):
                c, n = np.unique(np.concatenate(told), return_counts=True)
                told.clear()
                if len(c):
                    bucket, (classes, count) = bytes_rows((c % buckets).astype(np.int64), c, n.astype(np.int32))
                    gap = pa.nulls(len(bucket), pa.binary())
                    yield pa.RecordBatch.from_arrays([bucket, classes, count, gap, gap], names)

        def settle(f: int):
            grams, classes = zip(*held.pop(f), strict=True)
            told.append(shared.setdefault(f, _Shared()).meet(np.concatenate(grams), np.concatenate(classes)))

        for b in batches:
            f, g, c, ids, sizes = (b.column(x) for x in range(5))
            for x, fragment in enumerate(f.to_numpy()):
                if fragment < 0:
                    cls = np.frombuffer(c[x].as_py(), np.uint64)
                    own, two = (np.frombuffer(y[x].as_py(), np.int64).reshape(-1, 2) for y in (ids, sizes))
                    bucket, (classes, mine, size) = bytes_rows((cls % buckets).astype(np.int64), cls, own, np.ascontiguousarray(two.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([bucket, classes, pa.nulls(len(bucket), pa.binary()), mine, size], names)
                    continue
                held.setdefault(fragment, []).append((_wide(g[x].as_py(), KEY_BYTES), _wide(c[x].as_py(), CLASS_BYTES)))
                if sum(len(y[1]) for y in held[fragment]) > SLICE:
                    settle(fragment)
                    yield from counts(False)
        for f in list(held):
            settle(f)
            shared.pop(f)
            yield from counts(False)
        yield from counts(True)

    def total(batches):
        cls, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            both = np.concatenate([cls, *(c for c, _ in held)])
            c, at = np.unique(both, return_inverse=True)
            return c, np.bincount(at, np.concatenate([n, *(k for _, k in held)]), len(c)).astype(np.int64)

        for b in batches:
            _, classes, counts, ids, sizes = (b.column(x) for x in range(5))
            for x in range(len(b)):
                c = np.frombuffer(classes[x].as_py(), np.uint64)
                if ids[x].is_valid:
                    two = np.frombuffer(sizes[x].as_py(), np.int32).reshape(-1, 2)
                    own = np.frombuffer(ids[x].as_py(), np.int64).reshape(-1, 2)
                    columns = [pa.array(_long(c)), pa.array(np.ascontiguousarray(own[:, 1])), pa.array(np.ascontiguousarray(own[:, 0])), pa.array(np.ascontiguousarray(two[:, 0])), pa.array(np.ascontiguousarray(two[:, 1])), pa.nulls(len(c), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["cls", "sig", "id", "n", "head", "shared"])
                else:
                    held.append((c, np.frombuffer(counts[x].as_py(), np.int32)))
                    if sum(len(k) for k, _ in held) > SLICE:
                        cls, n = merged()
                        held.clear()
        cls, n = merged()
        gap = lambda t: pa.nulls(len(cls), t)
        yield pa.RecordBatch.from_arrays([pa.array(_long(cls)), gap(pa.int64()), gap(pa.int64()), gap(pa.int32()), gap(pa.int32()), pa.array(n)], ["cls", "sig", "id", "n", "head", "shared"])

    return packed.repartition(parts, "fragment").mapInArrow(meet, _PARTIAL).repartition(parts, "bucket").mapInArrow(total, _COUNTS)


def _spare(percent: int) -> Column:
    """How many n-grams of a set of n its partner may lack."""
    return F.floor(F.col("n") * (100 - percent) / 100)


_SETS = "cls long, sig long, n int, late int, grams array<long>, sketch binary"


def _sets(docs: DataFrame, left: DataFrame, n_left: int, fragments: int) -> DataFrame:
    """Of the classes ``left`` (cls, sig, rep), from documents whose id is their ``rep``: cls, sig, n, how many keys
    beyond the head the set has, its hashes and its parity sketch: for each of SKETCH_BITS, whether an odd number of members falls
    there. Two sketches differ in no more places than the sets do. Repeated ids give repeated rows.

    Filter and sets are one Python step: two in one task would be two workers for each core."""
    shared = docs.sparkSession.sparkContext.broadcast(IdFilter.of(left.where(F.col("rep") < 2**63 - 1).select("rep"), n_left))

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            b = b.filter(IdFilter.may_have(shared.value, b.column(0)))
            for i, j, buf, offsets in text_chunks(b.column(1)):
                rows, h = shingles(buf, offsets)
                n_rows = j - i
                bounds = _bounds(rows, n_rows)
                tail = h >= _U(HEAD << 56)
                late = _n_keys(rows[tail], *_keys(h[tail], HEAD, 256, fragments), n_rows)
                odd = np.bincount(rows * SKETCH_BITS + (h % _U(SKETCH_BITS)).astype(np.int64), minlength=n_rows * SKETCH_BITS) & 1
                bits = np.packbits(odd.astype(np.uint8).reshape(n_rows, SKETCH_BITS), axis=1)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(_long(h)))
                names = [pa.array(_long(f(h, bounds))) for f in (_class_ids, _class_checks)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[i:j], *names, pa.array(np.diff(bounds).astype(np.int32)), pa.array(late.astype(np.int32)), lists, pa.array([x.tobytes() for x in bits], pa.binary())],
                    ["doc_id", "cls", "sig", "n", "late", "grams", "sketch"],
                )

    likely = small_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id long, {_SETS}")
    asked = bounded(left.select(F.when(F.col("rep") < 2**63 - 1, F.col("rep")).alias("_id")))
    return likely.join(asked, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").drop("doc_id")


def _pack_sets(sets: DataFrame, low: int, fragments: int) -> DataFrame:
    def run(batches):
        packer = _Packer()

        def packed():
            out = packer.flush()
            if out is not None:
                f, g, c = out
                empty = pa.nulls(len(f), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(f), g, c, empty, empty], ["fragment", "grams", "classes", "ids", "sizes"])

        for b in batches:
            lists = b.column(1)
            grams = lists.flatten().to_numpy().view(np.uint64)
            cls = np.repeat(b.column(0).to_numpy().view(np.uint64), lists.value_lengths().to_numpy())
            late = grams >= _U(low << 56)
            if packer.add(*_keys(grams[late], low, 256, fragments), cls[late]):
                yield from packed()
        yield from packed()

    return small_batches(sets.select("cls", "grams")).mapInArrow(run, _PACKED)


def _fragments(n_grams: float) -> int:
    return int(max(8, min(1_000_000, n_grams // FRAGMENT_NGRAMS)))


def _reach(percent: int) -> Column:
    """Whether two sets can reach the threshold, by sizes and by members that no other class has."""
    top = F.least(F.col("n") - F.col("alone"), F.col("pn") - F.col("palone"))
    return top * (100 + percent) >= percent * (F.col("n") + F.col("pn"))


def _verify(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """x, y of the pairs (a written table) that reach the threshold: overlaps of each fragment, summed."""
    asked = materialise(pairs.select(F.col("y").alias("cls")).distinct())
    left = bounded(pairs).join(parts.withColumnRenamed("cls", "x"), "x").withColumnRenamed("grams", "a").withColumnRenamed("n", "nx")
    right = parts.join(bounded(asked), "cls", "left_semi").withColumnRenamed("cls", "y").withColumnRenamed("grams", "b").withColumnRenamed("n", "ny")
    partial = left.join(right, ["y", "part"]).select("x", "y", "nx", "ny", F.size(F.array_intersect("a", "b")).cast("long").alias("both"))
    total = partial.groupBy("x", "y").agg(F.sum("both").alias("both"), F.max("nx").alias("nx"), F.max("ny").alias("ny"))
    out = materialise(total.where(F.col("both") * 100 >= percent * (F.col("nx") + F.col("ny") - F.col("both"))).select("x", "y"))
    discard(asked)
    return out


def _alike(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Of pairs x, y those that their sketches don't rule out, as a written table."""
    side = lambda c: info.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))

    def run(batches):
        for b in batches:
            if len(b):
                x, y = (np.frombuffer(b"".join(b.column(f"s{c}").to_pylist()), np.uint16).reshape(len(b), -1) for c in "xy")
                both = b.column("nx").to_numpy().astype(np.int64) + b.column("ny").to_numpy()
                # overlap = (sizes - difference) / 2
                can = (both - _POPULAR[x ^ y].sum(1, dtype=np.int64)) * (100 + percent) >= 2 * percent * both
                yield b.select(["x", "y"]).filter(pa.array(can))

    first = materialise(pairs)
    out = materialise(bounded(first).join(side("x"), "x").join(side("y"), "y").mapInArrow(run, "x long, y long"))
    discard(first)
    return out


_POPULAR = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def _longs(block: pa.Table, name: str) -> np.ndarray:
    return block.column(name).to_numpy().astype(np.int64)


def _block_pairs(block: pa.Table, percent: int) -> pa.Table:
    """Pairs across the two sides of a block, of different roots, that nothing rules out."""
    cls, n, alone, root, side = (_longs(block, c) for c in ("cls", "n", "alone", "root", "side"))
    sketch = np.frombuffer(b"".join(block.column("sketch").to_pylist()), np.uint16).reshape(len(cls), -1)
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    own = not len(b)
    b = a if own else b
    x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at, i in enumerate(a):
        both = n[i] + n[b]
        can = (root[i] != root[b]) & (np.minimum(n[i] - alone[i], n[b] - alone[b]) * (100 + percent) >= percent * both)
        if own:
            can[: at + 1] = False
        js = np.flatnonzero(can)
        differ = _POPULAR[sketch[i] ^ sketch[b[js]]].sum(1, dtype=np.int64)
        # overlap = (sizes - difference) / 2
        js = js[(both[js] - differ) * (100 + percent) >= 2 * percent * both[js]]
        x.append(np.full(len(js), cls[i]))
        y.append(cls[b[js]])
    return pa.table({"x": np.concatenate(x), "y": np.concatenate(y)})


def _overlaps(lists: list[np.ndarray]) -> np.ndarray:
    """How many members each two of the sets share, as a matrix."""
    m = len(lists)
    out = np.zeros((m, m), np.float32)
    grams, rows = np.concatenate(lists), np.repeat(np.arange(m), [len(x) for x in lists])
    order = np.argsort(grams, kind="stable")
    grams, rows = grams[order], rows[order]
    edge = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    held = np.diff(np.append(edge, len(grams)))
    few = np.repeat(held <= LISTED, held)
    g, r = grams[few], rows[few]
    for d in range(1, LISTED):
        same = np.flatnonzero(g[d:] == g[:-d])
        if not len(same):
            break
        np.add.at(out, (r[same], r[same + d]), 1)
    out += out.T
    places, r = np.repeat(np.cumsum(held > LISTED) - 1, held)[~few], rows[~few]
    cuts = np.searchsorted(places, np.arange(0, (held > LISTED).sum() + LINK_SLICE, LINK_SLICE))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if a < b:
            has = np.zeros((m, places[b - 1] - k * LINK_SLICE + 1), np.float32)
            has[r[a:b], places[a:b] - k * LINK_SLICE] = 1
            out += has @ has.T
    return out


def _block_links(block: pa.Table, percent: int) -> pa.Table:
    """Per class of a block, how many documents of its other classes (of the other side, if the block
    has two) are linked to it; components apart."""
    cls, n, side, weight, root = (_longs(block, c) for c in ("cls", "n", "side", "weight", "root"))
    lists = block.column("grams").combine_chunks()
    flat, ends = lists.flatten().to_numpy(), np.cumsum(n)
    two = len(cls) > 0 and block.column("i")[0] != block.column("j")[0]
    links = np.zeros(len(cls), np.int64)
    order = np.argsort(root, kind="stable")
    for one in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
        both = _overlaps([flat[ends[k] - n[k] : ends[k]] for k in one]).astype(np.int64)
        linked = both * (100 + percent) >= percent * (n[one][:, None] + n[one][None, :])
        if two:
            linked &= side[one][:, None] != side[one][None, :]
        np.fill_diagonal(linked, False)
        links[one] = linked @ weight[one]
    return pa.table({"cls": cls, "links": links})


def link_counts(linked: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """cls, links: for the classes of all components (cls, root, weight: its documents), the documents
    of other classes that reach the threshold with it."""
    facts = materialise(bounded(linked.select("cls", "root", "weight")).join(sets.select("cls", "n", "grams"), "cls"))
    kinds = facts.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("volume"))
    blocks = F.greatest(F.ceil(F.col("m") / LINK_BLOCK), F.ceil(F.col("volume") / BLOCK_GRAMS)).cast("int")
    kinds = materialise(kinds.withColumn("blocks", blocks))
    groups = 1 + (kinds.where("blocks = 1").agg(F.sum("volume")).first()[0] or 0) // LINK_GRAMS
    # small components share groups; a group of a large one is one block of it
    group = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(groups))).otherwise(F.col("root"))
    seats = facts.join(bounded(kinds.select("root", "blocks")), "root").withColumn("grp", group).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    seats = seats.withColumn("b", F.explode(others)).select("blocks", "grp", "root", "cls", "n", "grams", "weight", "b.i", "b.j", (F.col("own") != F.col("b.i")).cast("int").alias("side"))
    partial = seats.groupBy("blocks", "grp", "i", "j").applyInArrow(lambda block: _block_links(block, percent), "cls long, links long")
    out = materialise(partial.groupBy("cls").agg(F.sum("links").alias("links")))
    discard(facts, kinds)
    return out


def _low() -> Column:
    return F.col("cls").bitwiseAND(CLASS_MASK)


def _counts(counted: DataFrame) -> DataFrame:
    """low (the low bytes of a class's name) and shared."""
    return counted.where("shared is not null").groupBy(F.col("cls").alias("low")).agg(F.sum("shared").alias("shared"))


def _may_link(docs: DataFrame, members: DataFrame, counted: DataFrame, percent: int) -> tuple[DataFrame | None, DataFrame]:
    """(sets of the classes that both passes leave, each once: cls, n, grams, sketch; their names: cls, sig and
    ``key``, by which they are called ``cls`` in the sets). No sets if there is no such class."""
    whole = members.where("n > 0").groupBy("cls", "sig").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.max("head").alias("head"))
    first = whole.join(_counts(counted), _low() == F.col("low"), "left").where(F.coalesce("shared", F.lit(0)) >= F.col("head") - _spare(percent))
    left = materialise(first.select("cls", "sig", "rep", "n", "head", F.coalesce("shared", F.lit(0)).alias("shared"), F.monotonically_increasing_id().alias("key")))
    n_left, n_grams = left.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_left:
        return None, left
    fragments = _fragments(n_grams)
    # the number of a row tells rows of one class apart
    every = materialise(_sets(docs, left, n_left, fragments).withColumn("row", F.monotonically_increasing_id()))
    late = _counts(_count_shared(_pack_sets(every, HEAD, fragments), fragments)).withColumnRenamed("shared", "more")
    rows = every.groupBy("cls", "sig").agg(F.min("row").alias("row"), F.max("late").alias("late"))
    stay = left.join(rows, ["cls", "sig"]).join(late, _low() == F.col("low"), "left").where(F.col("shared") + F.coalesce("more", F.lit(0)) >= F.col("head") + F.col("late") - _spare(percent))
    stay = materialise(stay.select("row", "key", "rep"))
    sets = materialise(every.drop("cls", "sig", "late").join(bounded(stay), "row").drop("row").withColumnRenamed("key", "cls"))
    discard(every, stay)
    return sets, left


def _order(sets: DataFrame, percent: int) -> DataFrame:
    """cls, rep, n, sketch, alone (members that surely no other class has) and prefix of the sets that
    may have links: the members that the prefix filter needs, in the global order."""
    lower = F.filter("grams", lambda g: g >= 0)
    grams = sets.select("cls", F.explode(lower).alias("gram"))
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = grams.join(often, "gram").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("known"))
    most = (_spare(percent) + 1).cast("int")
    upper = F.slice(F.filter("grams", lambda g: g < 0), F.lit(1), F.greatest(most - F.col("low"), F.lit(0)))
    rows = sets.withColumn("low", F.size(lower)).select("cls", "rep", "n", "sketch", "low", upper.alias("upper")).join(shared, "cls", "left")
    known = F.coalesce(F.col("known")["gram"], F.array().cast("array<long>"))
    rows = rows.withColumn("alone", F.col("low") - F.size(known)).withColumn("take", most - F.col("alone").cast("int")).where("take > 0")
    return rows.select("cls", "rep", "n", "sketch", "alone", F.slice(F.concat(known, "upper"), F.lit(1), F.col("take")).alias("prefix"))


def _stars(info: DataFrame, percent: int) -> DataFrame:
    """x, y: each member of an n-gram's bucket with the bucket's pivot, where both can reach the threshold."""
    bucket = info.select(F.explode("prefix").alias("gram"), "cls", "rep", "n", "alone")
    pivot = bucket.groupBy("gram").agg(F.min(F.struct("rep", "cls", F.col("n").alias("pn"), F.col("alone").alias("palone"))).alias("p"), F.count(F.lit(1)).alias("m")).where("m > 1")
    stars = bucket.join(pivot.select("gram", "p.cls", "p.pn", "p.palone").withColumnRenamed("cls", "y"), "gram")
    return stars.where((F.col("cls") != F.col("y")) & _reach(percent)).select(F.col("cls").alias("x"), "y").distinct()


def _apart(info: DataFrame, roots: DataFrame | None, percent: int) -> tuple[DataFrame, DataFrame]:
    """(x, y: pairs of a bucket's members in different components that nothing rules out; the table they
    are made of)."""
    lean = info.select("cls", "n", "alone", "sketch", "prefix")
    lean = lean.join(bounded(roots.withColumnRenamed("node", "cls")), "cls", "left") if roots is not None else lean.withColumn("root", F.lit(None).cast("long"))
    lean = materialise(lean.withColumn("root", F.coalesce("root", "cls")))
    places = lean.select(F.explode("prefix").alias("gram"), "cls", "root")
    apart = places.groupBy("gram").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.count(F.lit(1)).alias("m")).where("r != s")
    apart = apart.select("gram", "m", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    # small buckets: pairs met in the join's own condition; others go block by block
    facts = lean.select("cls", "n", "alone", "root", "sketch")
    seats = places.select("gram", "cls").join(apart, "gram")
    small = seats.where(F.col("m") <= SMALL).select("gram", "cls").join(facts.drop("sketch"), "cls")
    other = small.select("gram", F.col("cls").alias("y"), F.col("n").alias("pn"), F.col("alone").alias("palone"), F.col("root").alias("proot"))
    near = small.join(other, "gram").where((F.col("cls") > F.col("y")) & (F.col("root") != F.col("proot")) & _reach(percent))
    few = near.select(F.col("cls").alias("x"), "y").distinct()
    seats = seats.where(F.col("m") > SMALL).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    seats = seats.select("gram", "cls", "own", F.explode(others).alias("b")).select("gram", "cls", "b.i", "b.j", F.when(F.col("own") == F.col("b.i"), 0).otherwise(1).alias("side"))
    more = seats.join(facts, "cls").groupBy("gram", "i", "j").applyInArrow(lambda block: _block_pairs(block, percent), "x long, y long").unionByName(few)
    return more.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), lean


def classes(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame | None]:
    """(documents: id, n and their class by cls and sig; numbers of the classes that may have links: cls, sig, key;
    links: x, y between keys; sets of the numbered classes, None and None if there are none). The links found
    connect exactly what all links would connect; pairs within a component that others already join are left out."""
    bulk = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = _fragments(bulk / 6 * HEAD / 256)
    counted = materialise(_count_shared(_scan(docs, fragments), fragments))
    members = counted.where("shared is null").select("cls", "sig", "id", "n", "head")
    sets, left = _may_link(docs, members, counted, percent)
    members, numbers = members.drop("head"), left.select("cls", "sig", "key")
    if sets is None:
        return members, numbers, None, None
    info = materialise(_order(sets, percent))
    part = lambda k: F.filter("grams", lambda g: F.shiftrightunsigned(g, 64 - (PARTS - 1).bit_length()) == k)
    parts = sets.select("cls", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), part(k).alias("grams")) for k in range(PARTS)])).alias("f")).select("cls", "n", "f.*")
    parts = materialise(parts.where(F.size("grams") > 0))
    stars = _alike(_stars(info, percent), info, percent)
    links = _verify(stars, parts, percent)
    # buckets that still hold several components
    roots = materialise(components(links.select(F.col("x").alias("u"), F.col("y").alias("v")))) if row_count(links) else None
    more, lean = _apart(info, roots, percent)
    known = links.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    more = _alike(more.join(known, ["x", "y"], "left_anti"), info, percent)
    rest = _verify(more, parts, percent)
    discard(info, lean, parts, stars, more)
    return members, numbers, links.unionByName(rest), sets


def join(docs: DataFrame, percent: int = PERCENT, count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, distinct_texts and, if ``count_links``, n_links (how many other
    rows reach the threshold with it, copies among them) for every row of ``docs``."""
    members, numbers, links, sets = classes(docs, percent)
    none, name = F.lit(2**63 - 1), ["cls", "sig"]
    # class, then component: the least id is counted class by class before components are joined
    names = materialise(members.where("n > 0").groupBy(*name).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("weight")))
    names = names.withColumns({"kinds": F.lit(1).cast("long"), "n_links": F.col("weight") - 1})
    if links is not None and row_count(links):
        roots = materialise(components(links.select(F.col("x").alias("u"), F.col("y").alias("v"))))
        each = materialise(numbers.join(names, name).join(roots.withColumnRenamed("node", "key"), "key").select("key", "root", *name, "first", "weight"))
        whole = each.groupBy("root").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("size"))
        linked = each.join(whole, "root")
        if count_links:
            counts = link_counts(each.select(F.col("key").alias("cls"), "root", "weight"), sets, percent)
            linked = linked.join(counts.withColumnRenamed("cls", "key"), "key", "left")
        linked = materialise(linked.select(*name, "least", "size", *(["links"] if count_links else [])))
        discard(each, roots)
        more = F.coalesce("links", F.lit(0)) if count_links else F.lit(0)
        names = names.join(bounded(linked), name, "left").select(*name, F.coalesce("least", "first").alias("first"), F.coalesce("size", "kinds").alias("kinds"), (F.col("n_links") + more).alias("n_links"))
    if sets is not None:
        discard(sets)
    out = members.join(names.select(*name, "first", "kinds", "n_links"), name, "left")
    own = F.when(F.col("id") != none, F.col("id"))
    first = F.when(F.col("n") > 0, F.when(F.col("first") != none, F.col("first"))).otherwise(own)
    counted = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if count_links else []
    return out.select(own.alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), first.alias("component_id"), F.coalesce("kinds", F.lit(1)).alias("distinct_texts"), *counted)


_SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_SMALL}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
    c AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS cls FROM s GROUP BY 1),
    k AS (SELECT cls, min(doc_id) AS rep, count(*) AS weight, any_value(n) AS n FROM c GROUP BY 1),
    r AS (SELECT rep, g FROM k JOIN s ON s.doc_id = k.rep),
    o AS (SELECT a.rep AS x, b.rep AS y, count(*) AS common FROM r a JOIN r b ON a.g = b.g AND a.rep <> b.rep GROUP BY 1, 2),
    l AS (SELECT x, y, q.weight FROM o JOIN k p ON p.rep = x JOIN k q ON q.rep = y WHERE 100 * common >= {PERCENT} * (p.n + q.n - common)),
    t AS (SELECT rep AS x, rep AS y FROM k UNION SELECT t.x, l.y FROM t JOIN l ON t.y = l.x),
    m AS (SELECT x, min(y) AS component_id, count(*) AS distinct_texts FROM t GROUP BY 1),
    e AS (SELECT x, sum(weight) AS others FROM l GROUP BY 1)
    SELECT w.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id, coalesce(m.distinct_texts, 1) AS distinct_texts,
           CAST(coalesce(k.weight - 1, 0) + coalesce(e.others, 0) AS BIGINT) AS n_links
    FROM w LEFT JOIN c USING (doc_id) LEFT JOIN k ON k.cls = c.cls LEFT JOIN m ON m.x = k.rep LEFT JOIN e ON e.x = k.rep"""


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, whose id is the least of their component. Rows that share
    that id stay, all of them; rows without id stay."""
    gone = join(docs, percent, count_links=False).where("component_id is not null and doc_id != component_id").select("doc_id")
    return without(docs, F.col("doc_id"), gone)

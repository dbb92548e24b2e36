"""What the operators share: scratch tables, Arrow text access, vectorised word hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_U = np.uint64


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Where that is unset, a local one if driver and
    executors are one process (tests); executors of a cluster wouldn't find each other's files there."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="siftline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_written: dict[str, SparkSession] = {}


def materialise(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage ends there, so a lost
    executor costs a re-read rather than a recomputation. Removed by ``discard``, or when the driver exits."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/siftline-{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialise`` gave. All that was made of them must be written by now."""
    for table in tables:
        _remove(table.scratch)


def _remove(path: str) -> None:
    spark = _written.pop(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_all() -> None:
    for path in list(_written):
        try:
            _remove(path)
        except Exception:  # the session may already be gone
            continue


#: Rows of an Arrow batch, where texts go to Python: Spark's 10,000 hold tens of MB of texts on both sides.
TEXT_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session's Arrow batches were bounded to TEXT_ROWS rows, unless smaller already."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= TEXT_ROWS:
        conf.set(key, str(TEXT_ROWS))
    return df


#: So many narrow rows are broadcast (some tens of MB in a hash table); more are shuffled.
BROADCAST_KEYS = 500_000


def bounded(table: DataFrame) -> DataFrame:
    """A written table of narrow rows, to be broadcast if it has no more than BROADCAST_KEYS of them."""
    return F.broadcast(table) if row_count(table) <= BROADCAST_KEYS else table


def without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose ``key`` isn't among the values of ``gone`` (one column).
    While those are few, every row stays where it is."""
    name = "gone"
    while name in docs.columns:
        name += "_"
    gone = bounded(materialise(gone.toDF(name).distinct()))
    return docs.join(gone, key.eqNullSafe(F.col(name)), "left_anti")


def row_count(df: DataFrame) -> int:
    return df.select(F.count(F.lit(1))).first()[0]


def hash_sample(df: DataFrame, size: int, *keys: str) -> DataFrame:
    """About ``size`` rows, at most 1.25 times as many: those whose keys hash below a threshold. The
    filter runs where the rows are; nothing but the sample moves, however large the table is."""
    n = row_count(df)
    if n > size:
        df = df.where(F.xxhash64(*keys) < F.lit(int(2**64 * size / n) - 2**63))
    return df.limit(size + size // 4)


# --- text batches -----------------------------------------------------------------------------


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column, without copying. Nulls have length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_chunks(column: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``limit`` bytes; a
    longer text is a run of its own, so memory follows the longest single text."""
    buf, offsets = text_buffer(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


# --- hashing ----------------------------------------------------------------------------------

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random odd 64-bit value per byte; capital and small ASCII letters share theirs.
BYTE_CODE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
FOLDED_CODE = BYTE_CODE.copy()
FOLDED_CODE[65:91] = FOLDED_CODE[97:123]
BASE = 0x9E3779B97F4A7C13
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, 1 << 19)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def spans_of(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of true bytes; no run crosses a row's end."""
    if not len(mask):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    before, after = np.zeros(len(mask), bool), np.zeros(len(mask), bool)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    first, last = offsets[:-1], offsets[1:] - 1
    full = last >= first
    before[first[full]] = False
    after[last[full]] = False
    starts = np.flatnonzero(mask & ~before)
    return starts, np.flatnonzero(mask & ~after) + 1, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True, other: bool = False) -> np.ndarray:
    """A 64-bit hash of each span's bytes (ASCII case ignored if ``fold``), from running sums; ``other``
    gives one of other values for the bytes."""
    up, down = power_tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    codes = FOLDED_CODE if fold else BYTE_CODE
    np.cumsum((mix(codes) | _U(1) if other else codes)[buf] * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: Odd multipliers, one per place in a gram.
PLACE = _rng.integers(0, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive values."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n] * PLACE[0]
    for i in range(1, k):
        total = total + words[i : n + i] * PLACE[i]
    return mix(total)


# --- ids that may be in a set ------------------------------------------------------------------

#: A Bloom filter has 16 bits for each id, and at most so many bytes.
FILTER_BYTES = 32 << 20


def bytes_rows(bucket: np.ndarray, *columns: np.ndarray):
    """Sorted by bucket, cut into one value of bytes per bucket and column."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = np.append(edge[1:], len(bucket))
    return pa.array(bucket[edge].astype(np.int32)), [pa.array([c[order][a:b].tobytes() for a, b in zip(edge, ends, strict=True)], pa.binary()) for c in columns]


class IdFilter:
    """A Bloom filter of two bytes an id and FILTER_BYTES at most: the bound of what is sent to
    executors. It only keeps texts from a shuffle; an exact join follows. Null ids are always let through."""

    CHUNK = 1 << 16
    HASHES = 4

    @classmethod
    def places(cls, ids: np.ndarray, n_bytes: int) -> np.ndarray:
        h = mix(ids.astype(np.int64).view(np.uint64) + PLACE[50])
        step = mix(h + PLACE[51]) | _U(1)
        return np.concatenate([(h + _U(k) * step) % _U(8 * n_bytes) for k in range(cls.HASHES)]).astype(np.int64)

    @classmethod
    def of(cls, ids: DataFrame, n: int) -> np.ndarray:
        """From a column of about ``n`` longs. Tasks send places by chunk; chunks are joined by tasks too."""

        n_bytes = min(FILTER_BYTES, max(1 << 16, 1 << (2 * n).bit_length()))

        def scatter(batches):
            for b in batches:
                at = cls.places(b.column(0).to_numpy(), n_bytes) if len(b) else np.zeros(0, np.int64)
                if len(at):
                    chunk, (bits,) = bytes_rows(at // (8 * cls.CHUNK), (at % (8 * cls.CHUNK)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([chunk, bits], ["chunk", "bits"])

        def gather(batches):
            held: dict[int, np.ndarray] = {}
            for b in batches:
                for c, bits in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    held.setdefault(c, np.zeros(8 * cls.CHUNK, bool))[np.frombuffer(bits.as_py(), np.int32)] = True
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], ["chunk", "bits"])

        out = np.zeros(n_bytes, np.uint8)
        parts = max(1, n_bytes // cls.CHUNK // 16)
        for c, bits in ids.mapInArrow(scatter, "chunk int, bits binary").repartition(parts, "chunk").mapInArrow(gather, "chunk int, bits binary").collect():
            out[c * cls.CHUNK : (c + 1) * cls.CHUNK] = np.frombuffer(bits, np.uint8)
        return out

    @classmethod
    def may_have(cls, table: np.ndarray, ids: pa.Array) -> pa.Array:
        at = cls.places(ids.fill_null(0).to_numpy(), len(table)).reshape(cls.HASHES, -1)
        found = ((table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(0)
        return pa.array(found | ids.is_null().to_numpy(zero_copy_only=False))

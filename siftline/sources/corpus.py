"""Readers: whatever holds text becomes documents (doc_id, path, body)."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import paths

#: Ignore files from the weakest to the strongest (a repository's own excludes are the weakest of all), and
#: the most rules that a tree may hold: they become one expression on the driver.
EXCLUDES = ".git/info/exclude"
IGNORE_FILES, MOST_RULES = (EXCLUDES, ".gitignore", ".ignore", ".rgignore"), 10_000
DOC = "doc_id long, path string, body string"
LZ4 = b"\x04\x22\x4d\x18"
ZSTD, DICTIONARY_MAGIC = b"\x28\xb5\x2f\xfd", 0x184D2A5D
SPARK_CHARSETS = {"utf-8", "us-ascii", "iso-8859-1", "utf-16", "utf-16le", "utf-16be", "utf-32"}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", path.alias("path"), F.col("text").alias("body"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("url").alias("path"), F.col("html").alias("body"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", F.lit("conv"), F.col("conv_id").cast("string"), F.concat(F.col("turn").cast("string"), F.lit("."), F.col("role")))
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), path.alias("path"), F.col("text").alias("body"))


def from_texts(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """Named texts in memory; a single unnamed one stands for standard input."""
    return spark.createDataFrame([(i, p, b) for i, (p, b) in enumerate(sorted(texts.items()))], DOC)


def files(spark: SparkSession, *roots: str, encoding: str = "utf-8", max_size: int | None = None, decompress: bool = False, binary: str = "skip", pre: Callable[[bytes], bytes] | None = None, pre_globs: tuple[str, ...] = ()) -> DataFrame:
    """The files under ``roots`` (default: the working folder). ``encoding`` auto looks at byte-order
    marks. ``binary``: skip files with a NUL, or take them as text. ``pre`` changes the bytes of the
    files that ``pre_globs`` name (all, if none), which are then not unpacked. A missing root raises."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots) or ["."])
    if max_size is not None:
        raw = raw.where(F.col("length") <= max_size)
    raw = raw.select("path", "content", "modificationTime")
    if decompress or pre:
        chosen = paths.in_globs(F.col("path"), list(pre_globs)) if pre_globs else F.lit(True)
        named = transformed(raw.where(chosen), pre) if pre else raw.where(F.lit(False))
        rest = raw.where(~chosen) if pre else raw
        if decompress:  # Brotli has no mark at its beginning: its name tells
            is_brotli = F.endswith("path", F.lit(".br"))
            rest = transformed(rest.where(~is_brotli), unpacked).unionByName(transformed(rest.where(is_brotli), _by_arrow("brotli")))
        raw = rest.unionByName(named)
    rows = raw.select("path", decoded("content", encoding).alias("body"), F.col("modificationTime").alias("modified"))
    if binary == "skip":
        rows = rows.where(F.instr("body", "\0") == 0)
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", "body", "modified")


def ignore_tree(docs: DataFrame, vcs: bool = True, dot: bool = True, exclude: bool = True, everywhere: tuple[str, ...] = ()) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """Folders and their rules from the ignore files among the documents, for a request's
    ``ignore_tree``: .gitignore if ``vcs``, .ignore and .rgignore if ``dot``, repositories' excludes if ``exclude``
    (and ``vcs``). Rules that hold ``everywhere`` are weaker than any file's. Raises beyond ``MOST_RULES`` rules."""
    own = F.regexp_extract("path", r"^(?:(.*)/)?\.git/info/exclude$", 1)
    is_own = F.rlike("path", F.lit(r"(?:^|/)\.git/info/exclude$"))
    name = F.when(is_own, EXCLUDES).otherwise(paths.basename(F.col("path")))
    folder = F.when(is_own, own).otherwise(paths.dirname(F.col("path")))
    wanted = [n for n in IGNORE_FILES if (vcs and exclude if n == EXCLUDES else vcs if n == ".gitignore" else dot)]
    rules = docs.where(name.isin(*wanted)).select(folder.alias("folder"), name.alias("name"), F.posexplode(F.split("body", r"\r?\n")).alias("at", "rule"))
    found = rules.where("trim(rule) <> '' AND NOT startswith(rule, '#')").limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} ignore rules")
    tree: dict[str, list[str]] = {"": list(everywhere)} if everywhere else {}
    for r in sorted(found, key=lambda r: (r.folder, IGNORE_FILES.index(r.name), r["at"])):
        tree.setdefault(r.folder, []).append(r.rule)
    return tuple((k, tuple(v)) for k, v in tree.items())


def decoded(column: str, encoding: str = "utf-8"):
    """A binary column as text. Charsets that Spark lacks go through an Arrow function."""
    name = encoding.lower()
    content = F.col(column)
    if name == "auto":
        mark = F.hex(F.substring(content, 1, 3))
        sliced = lambda n: F.expr(f"substring({column}, {n + 1})")
        return (
            F.when(mark.startswith("EFBBBF"), F.decode(sliced(3), "UTF-8"))
            .when(mark.startswith("FFFE"), F.decode(sliced(2), "UTF-16LE"))
            .when(mark.startswith("FEFF"), F.decode(sliced(2), "UTF-16BE"))
            .otherwise(F.try_validate_utf8(content.cast("string")))
        )
    if name == "utf-8":
        return F.make_valid_utf8(content.cast("string"))
    if name in SPARK_CHARSETS:
        return F.decode(content, encoding)
    "".encode(encoding)  # an unknown label raises here

    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else bytes(b).decode(encoding, "replace"))

    return decode(content)


def unpacked(data: bytes) -> bytes:
    for magic, unpack in ((b"\x1f\x8b", gzip.decompress), (b"BZh", bz2.decompress), (b"\xfd7zXZ\0", lzma.decompress), (b"]\0\0", lzma.decompress), (b"\x78", zlib.decompress)):
        if data.startswith(magic):
            try:
                return unpack(data)
            except (OSError, zlib.error, lzma.LZMAError):
                return data
    if data.startswith(LZ4):
        return _by_arrow("lz4")(data)
    if data.startswith(ZSTD) or _skippable(data):
        import zstandard

        # skippable frames may lead; one of DICTIONARY_MAGIC holds the dictionary of all frames
        at, dictionary = 0, None
        while _skippable(data[at : at + 8]):
            magic, size = struct.unpack_from("<II", data, at)
            if magic == DICTIONARY_MAGIC:
                dictionary = data[at + 8 : at + 8 + size]
            at += 8 + size
        if not data.startswith(ZSTD, at):
            return data
        if dictionary is not None and dictionary.startswith(ZSTD):
            dictionary = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(dictionary), read_across_frames=True).read()
        extra = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        return zstandard.ZstdDecompressor(**extra).stream_reader(io.BytesIO(data[at:]), read_across_frames=True).read()
    return data


def _by_arrow(codec: str) -> Callable[[bytes], bytes]:
    """Unpacks what Arrow has a codec for; what isn't such data is passed on."""

    def unpack(data: bytes) -> bytes:
        import pyarrow as pa

        try:
            return pa.CompressedInputStream(pa.BufferReader(data), codec).read()
        except OSError:
            return data

    return unpack


def _skippable(data: bytes) -> bool:
    return len(data) >= 8 and 0x50 <= data[0] <= 0x5F and data[1:4] == b"\x2a\x4d\x18"


def transformed(raw: DataFrame, change: Callable[[bytes], bytes]) -> DataFrame:
    """A preprocessor over the ``content`` column, as a Python function of bytes; its errors raise."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(content=[None if c is None else change(bytes(c)) for c in pdf.content])

    return raw.mapInPandas(run, raw.schema)

"""Dictionary-compressed web archives (operator 3).

A Zstandard dictionary is built from a bounded sample of the records to be archived and embedded in
a skippable frame at the head of every archive; each record is compressed as a frame of its own, so
a reader needs nothing but the archive and can start at any record. Of equal payloads one record is
a response and the others are revisits that refer to it.

Archives are rows (name, records, data) of a written table, a few megabytes each, since executors
share nothing but what Spark's writers reach; ``export`` puts them out as files.

Defined cases: null payloads are empty; null urls have no target header; of equal payloads of at
least ``least`` bytes the largest id is the response, so repeated rows that tie for it are
all responses, and payloads whose ids are all null are too; with fewer than eight records to learn
from, archives carry no dictionary; an empty table gives no archives.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import bounded, hash_sample, materialise

LEAST = 1000
ARCHIVE_BYTES = 4 << 20
DICTIONARY_BYTES = 96 << 10
#: Records learnt from, and the longest payload among them.
SAMPLE, SAMPLE_PAYLOAD = 600, 64 << 10
LEVEL = 6
#: Fixed values of the formats: the dictionary's frame, Zstandard's frame.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
DATE = "1970-01-01T00:00:00Z"


def record(page_id, url, payload: bytes, digest: str, refers_to=None, size: int | None = None) -> bytes:
    """One WARC record. A revisit keeps digest and length of the payload that it leaves out."""
    revisit = refers_to is not None
    size = len(payload) if size is None else size
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    if not revisit:
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {' '.join(url.split())}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers, payload length and payload (empty in a revisit) of one record."""
    end = data.index(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in data[:end].decode().split("\r\n")[1:])
    block = data[end + 4 : end + 4 + int(headers["Content-Length"])]
    cut = block.index(b"\r\n\r\n")
    length = next(int(x.split(b": ")[1]) for x in block[:cut].split(b"\r\n") if x.startswith(b"Content-Length: "))
    return headers, length, block[cut + 4 :]


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends: its header says how long it is itself,
    each block says its own length."""
    flags = data[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    content = (single, 2, 4, 8)[flags >> 6]
    at += 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + content
    while True:
        block = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return at + 4 * checksum


def split_archive(data: bytes):
    """(dictionary, record bytes) for every record of an archive."""
    at, unpack = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        (magic,) = struct.unpack_from("<I", data, at)
        if magic & 0xFFFFFFF0 == DICTIONARY_MAGIC & 0xFFFFFFF0:
            (size,) = struct.unpack_from("<I", data, at + 4)
            if magic == DICTIONARY_MAGIC:
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[at + 8 : at + 8 + size]))
            at += 8 + size
        elif magic == FRAME_MAGIC:
            end = frame_end(data, at)
            yield unpack.decompress(data[at:end])
            at = end
        else:
            raise ValueError(f"no frame at byte {at}")


def train(pages: DataFrame) -> bytes:
    """A dictionary of DICTIONARY_BYTES from about SAMPLE records, chosen by the hashes of their ids."""
    payload = F.coalesce("html", F.lit(""))
    rows = hash_sample(pages.where(F.octet_length(payload).between(1, SAMPLE_PAYLOAD)), SAMPLE, "page_id", "url").select("page_id", "url", payload).collect()
    samples = [record(p, u, (h := x.encode()), hashlib.sha1(h).hexdigest()) for p, u, x in sorted(rows, key=str)]
    if len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:  # too little that recurs
        return b""


def plan(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null in responses). Only digests that occur twice
    are joined back. While those are at most ``common.BROADCAST_KEYS``, payloads stay where they are; beyond that they are
    shuffled by digest, and a digest shared by any part of the rows is a skewed join, which Spark splits."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    chosen = (
        pages.select("page_id", payload.alias("payload"))
        .where(F.octet_length("payload") >= least)
        .groupBy(F.sha1("payload").alias("digest"))
        .agg(F.max("page_id").alias("chosen"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and chosen is not null")
        .drop("n")
    )
    chosen = bounded(materialise(chosen))
    other = F.col("chosen").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("chosen"))
    return rows.join(chosen, "digest", "left").select("page_id", "url", "payload", "digest", F.when(other, F.col("chosen")).alias("refers_to"))


def write(planned: DataFrame, dictionary: bytes, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """name, records, data: the archives, as a lazy table."""

    def run(batches):
        extra = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **extra)
        head = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary if dictionary else b""
        parts, size, number, task = [head], len(head), 0, TaskContext.get().partitionId()

        def archive():
            return pa.RecordBatch.from_arrays(
                [pa.array([f"part-{task:06d}-{number:05d}.warc.zst"]), pa.array([len(parts) - 1]), pa.array([b"".join(parts)], pa.binary())], ["name", "records", "data"]
            )

        for b in batches:
            pages, urls, payloads, digests, refers = (b.column(i) for i in range(5))
            for i in range(len(b)):
                body, to = payloads[i].as_py(), refers[i].as_py()
                parts.append(packer.compress(record(pages[i].as_py(), urls[i].as_py(), b"" if to is not None else body, digests[i].as_py(), to, len(body))))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield archive()
                    parts, size, number = [head], len(head), number + 1
        if len(parts) > 1:
            yield archive()

    return planned.mapInArrow(run, "name string, records long, data binary")


def read(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; of responses
    digest and length are those of the payload that was read."""
    number = lambda s: int(x) if (x := s[len("<urn:page:") : -1]) else None

    def run(batches):
        for b in batches:
            for data in b.column(0):
                rows = []
                for raw in split_archive(data.as_py()):
                    headers, length, payload = parse(raw)
                    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response":
                        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != length:
                            raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
                    to = headers.get("WARC-Refers-To")
                    rows.append((number(headers["WARC-Record-ID"]), length, digest, kind, number(to) if to else None))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.select("data").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write every page, then read the archives back."""
    return read(materialise(write(plan(pages, least), train(pages))))


def export(archives: DataFrame, folder: str) -> None:
    """The archives as files of a folder that every executor reaches by ``pyarrow.fs``."""

    def run(rows):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for r in rows:
            with store.open_output_stream(f"{base}/{r.name}") as f:
                f.write(bytes(r.data))

    archives.foreachPartition(run)

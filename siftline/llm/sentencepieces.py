"""SentencePiece encoding with byte offsets, and decoding (operator 4).

The text is normalised by longest prefix through the model's compiled character map (a double-array
trie over byte strings), and every normalised byte keeps the source byte it came from. Pieces tile
the normalised text, so their byte lengths, summed up, project each piece onto a source span.

Defined cases: a null text is an empty one: no ids, decoded to the empty string. Repeated rows and
null ids are kept; other columns are ignored; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftline.llm.common import small_batches

MARK = "▁".encode()  # what stands for a space in pieces
BATCH_CHARS = 1 << 20


def wire_fields(data: bytes):
    """(field, value) of a protocol-buffer message: ints for varints, bytes for all else."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """The compiled map: uint32 trie size, the trie's units, then zero-ended replacement strings."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.texts = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.texts = blob[4 + size :]

    def longest(self, data: bytes, start: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix of ``data[start:]``, and what replaces it."""
        units, found = self.units, None
        if not units:
            return None
        offset = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node = offset(units[0])
        for i in range(start, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:  # a key ends here; its value is in the leaf
                value = units[node] & 0x7FFFFFFF
                found = i + 1 - start, self.texts[value : self.texts.index(b"\0", value)]
        return found


class Normaliser:
    """Source bytes to normalised bytes, with ``origin``: for every normalised byte, and for the
    end, the source byte it starts from."""

    def __init__(self, spec: bytes):
        fields = dict(wire_fields(spec))
        self.map = CharacterMap(fields.get(2, b""))
        self.dummy_prefix, self.squeeze, self.escape = (bool(fields.get(k, 1)) for k in (3, 4, 5))

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        return self._plain(data) if not (self.map.units or self.squeeze) else self._mapped(data)

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """No map, spaces kept: only the prefix and the escaped spaces differ. Whole-array work."""
        mark = MARK if self.escape else b" "
        lead = len(mark) if data and self.dummy_prefix else 0
        width = np.ones(len(data), np.int64)
        if self.escape:
            width[np.frombuffer(data, np.uint8) == 32] = len(MARK)
        origin = np.concatenate([np.zeros(lead, np.int64), np.repeat(np.arange(len(data)), width), [len(data)]])
        return (mark if lead else b"") + (data.replace(b" ", MARK) if self.escape else data), origin

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        parts: list[tuple[bytes, int]] = []  # replacement and where its source starts
        at = 0
        while at < len(data):
            hit = self.map.longest(data, at)
            if hit is None:
                lead = data[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = size, data[at : at + size]
            parts.append((hit[1], at))
            at += hit[0]
        end = len(data)
        if self.squeeze:
            lead = 0
            while lead < len(parts) and parts[lead][0] == b" ":
                lead += 1
            del parts[:lead]
        mark = MARK if self.escape else b" "
        out, origin, blank = bytearray(), [], self.squeeze
        if parts and self.dummy_prefix:
            out += mark
            origin += [parts[0][1] if self.squeeze else 0] * len(mark)
        for text, source in parts:
            for byte in text.lstrip(b" ") if blank and self.squeeze else text:
                piece = mark if byte == 32 else bytes([byte])
                out += piece
                origin += [source] * len(piece)
            if text:
                blank = text.endswith(b" ") and self.squeeze
        if self.squeeze:
            while out.endswith(mark):
                del out[-len(mark) :]
                end = min(end, origin[-1])
                del origin[-len(mark) :]
        return bytes(out), np.array([*origin, end], np.int64)


class Codec:
    """One model: ids, spans of source bytes, and texts again."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            model = f.read()
        self.normalise = Normaliser(next((v for k, v in wire_fields(model) if k == 3), b""))
        size = self.library.get_piece_size()
        self.width = np.array([1 if self.library.is_byte(i) else len(self.library.id_to_piece(i).encode()) for i in range(size)])
        self.digits = [str(i) for i in range(size)]
        self.unknown = self.library.unk_id()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1) if texts else []

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids) if ids else []

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end source bytes of every piece. Pieces of one character's bytes share its
        start, and the last of them reaches its end."""
        normal, origin = self.normalise(text.encode())
        width = self.width[ids] if ids else np.zeros(0, np.int64)
        if self.unknown in ids:  # an unknown stretch is as long as the text it stands for
            width = np.array([len(p.encode()) for p in self.library.encode(text, out_type=str)])
        edges = np.concatenate([[0], np.cumsum(width)])
        if edges[-1] != len(normal):  # not as this normaliser sees it: the library's own spans
            return self.library_spans(text)
        return origin[edges[:-1]], origin[edges[1:]]


    def library_spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The spans that the library gives, in bytes."""
        pieces = self.library.encode(text, return_type="proto").pieces
        return np.array([p.begin for p in pieces], np.int64), np.array([p.end for p in pieces], np.int64)


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def _runs(texts: list[str]):
    """Index ranges of about BATCH_CHARS characters, so that ids of one range are held at a time."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= BATCH_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, begins, ends for every row: pieces with their source byte spans."""
    ints = pa.list_(pa.int32())

    def run(batches):
        c = codec(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for i, j in _runs(texts):
                ids = c.encode(texts[i:j])
                spans = [c.spans(*x) for x in zip(texts[i:j], ids, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array(map(len, ids), pa.int64()), pa.array(ids, ints), *(pa.array([s[k].astype(np.int32) for s in spans], ints) for k in (0, 1))],
                    ["doc_id", "n_tokens", "ids", "begins", "ends"],
                )

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, begins array<int>, ends array<int>")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """What ``encode`` finds, as counts and SHA-256 digests of ids and of the text decoded from
    them, with the source bytes that the spans cover. Ids stay within the worker."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches):
        c = codec(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for i, j in _runs(texts):
                ids = c.encode(texts[i:j])
                covered = []
                for text, own in zip(texts[i:j], ids, strict=True):
                    begins, ends = c.spans(text, own)
                    covered.append(int(ends.max(initial=0) - begins.min(initial=0)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[i:j],
                        pa.array(map(len, ids), pa.int64()),
                        pa.array([sha(",".join([c.digits[x] for x in own])) for own in ids]),
                        pa.array([sha(x) for x in c.decode(ids)]),
                        pa.array(covered, pa.int64()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"],
                )

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long")

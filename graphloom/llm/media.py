"""Media columns: payloads stored in a container, and types found by signature.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over the bytes. A validator of the format
then confirms the structure from there and measures the length; what passes is a medium. One at offset 0 gives the
type, which corrects the declared one; the others are embedded media and can be carved out.

Stored payloads are 8-bit mono WAV samples. Null texts count as empty; an empty payload is 64 zero bytes. Bytes without
a known signature keep their declared type, with an empty list of media. Lengths are unlimited but for a row's 2 GB, and a
worker holds one batch of payloads (a single one if it is large) at a time; ends of archives and page chains are found once for all signatures. Repeated rows are
stored one by one, an empty table gives no rows. `store` reads key and text alone; `identify` keeps all other columns and
replaces those of the names that it adds.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, table, texts

#: Magic bytes of each format (fixed values).
MAGIC = {
    "audio/wav": b"RIFF",
    "image/webp": b"RIFF",
    "image/png": b"\x89PNG\r\n\x1a\n",
    "image/gif": b"GIF8",
    "image/jpeg": b"\xff\xd8\xff",
    "image/bmp": b"BM",
    "application/gzip": b"\x1f\x8b\x08",
    "application/zip": b"PK\x03\x04",
    "application/ogg": b"OggS",
    "application/pdf": b"%PDF-",
}
BLOCK, RATE = 64, 8000


def _riff(kind: bytes):
    def length(b: bytes, at: int) -> int:
        if b[at + 8 : at + 12] != kind or len(b) < at + 12:
            return 0
        end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
        pos = at + 12
        while pos + 8 <= end <= len(b):
            pos += 8 + (n := struct.unpack_from("<I", b, pos + 4)[0]) + n % 2
        return end - at if end <= len(b) and pos >= end > at + 12 and pos <= end + 1 else 0

    return length


def _png(b: bytes, at: int) -> int:
    pos = at + 8
    while pos + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, pos)
        if pos + 12 + n > len(b) or zlib.crc32(b[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", b, pos + 8 + n)[0]:
            return 0
        pos += 12 + n
        if kind == b"IEND":
            return pos - at
    return 0


def _gif(b: bytes, at: int) -> int:
    if b[at + 4 : at + 6] not in (b"7a", b"9a") or len(b) < at + 13:
        return 0
    flags, pos = b[at + 10], at + 13
    pos += 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    while pos < len(b):
        if b[pos] == 0x3B:
            return pos + 1 - at
        if b[pos] == 0x2C and pos + 10 < len(b):
            local = b[pos + 9]
            pos += 10 + (3 << ((local & 7) + 1) if local & 0x80 else 0) + 1
        elif b[pos] == 0x21:
            pos += 2
        else:
            return 0
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        pos += 1
    return 0


def _jpeg(b: bytes, at: int) -> int:
    pos = at + 2
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        kind = b[pos + 1]
        if kind == 0xD9:
            return pos + 2 - at
        n = struct.unpack_from(">H", b, pos + 2)[0]
        if n < 2:
            return 0
        pos += 2 + n
        if kind == 0xDA:  # entropy-coded data up to the next true marker
            while True:
                pos = b.find(b"\xff", pos)
                if pos < 0 or pos + 1 >= len(b):
                    return 0
                if b[pos + 1] == 0 or 0xD0 <= b[pos + 1] <= 0xD7:
                    pos += 2
                else:
                    break
    return pos + 2 - at if b[pos : pos + 2] == b"\xff\xd9" else 0


def _bmp(b: bytes, at: int) -> int:
    if len(b) < at + 26:
        return 0
    n, spare, start, header = struct.unpack_from("<IIII", b, at + 2)
    return n if not spare and header in (12, 40, 52, 56, 108, 124) and 14 + header <= start < n <= len(b) - at else 0


def _gzip(b: bytes, at: int) -> int:
    d = zlib.decompressobj(31)
    try:
        for pos in range(at, len(b), 1 << 16):
            rest = b[pos : pos + (1 << 16)]
            while rest:
                d.decompress(rest, 1 << 20)  # the output is not kept
                rest = d.unconsumed_tail
            if d.eof:
                return min(pos + (1 << 16), len(b)) - len(d.unused_data) - at
    except zlib.error:
        return 0
    return 0


class _Ends:
    """Where archives and page chains that start at a place of the data end, worked out in one pass for all places."""

    def __init__(self, b: bytes) -> None:
        self.data = b
        self.zips: dict[int, int] | None = None
        self.oggs: dict[int, int] = {}

    def zip(self, at: int) -> int:
        """The length of the archive whose directory, as its end record tells, starts counting at `at`; of several the shortest."""
        if self.zips is None:
            b, self.zips = self.data, {}
            end = b.find(b"PK\x05\x06")
            while 0 <= end and end + 22 <= len(b):
                size, start = struct.unpack_from("<II", b, end + 12)
                first = end - size - start
                if first >= 0 and (not size or b[first + start : first + start + 4] == b"PK\x01\x02"):
                    self.zips.setdefault(first, end + 22 + struct.unpack_from("<H", b, end + 20)[0] - first)
                end = b.find(b"PK\x05\x06", end + 4)
        return self.zips.get(at, 0)

    def ogg(self, at: int) -> int:
        """The length of the chain of pages from `at` to the last one; pages that lie in a chain are followed once."""
        b, pos, chain, end = self.data, at, [], 0
        while b[pos : pos + 5] == b"OggS\0" and pos + 27 <= len(b):
            if pos in self.oggs:
                end = self.oggs[pos]
                break
            chain.append(pos)
            table_ = b[pos + 27 : pos + 27 + b[pos + 26]]
            last = b[pos + 5] & 4
            pos += 27 + len(table_) + sum(table_)
            if last:
                end = pos if pos <= len(b) else 0
                break
        self.oggs.update(dict.fromkeys(chain, end))
        end = self.oggs.get(at, 0)
        return end - at if end else 0


def _pdf(b: bytes, at: int) -> int:
    if not b[at + 5 : at + 6].isdigit():
        return 0
    following = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, following if following >= 0 else len(b))
    return end + 5 - at if end > 0 else 0


VALIDATORS = {
    "audio/wav": _riff(b"WAVE"),
    "image/webp": _riff(b"WEBP"),
    "image/png": _png,
    "image/gif": _gif,
    "image/jpeg": _jpeg,
    "image/bmp": _bmp,
    "application/gzip": _gzip,
    "application/pdf": _pdf,
}


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found: dict[bytes, list[str]] = {}
    for kind, magic in MAGIC.items():
        found.setdefault(magic, []).append(kind)
    a = ahocorasick.Automaton()
    for magic, kinds in found.items():
        a.add_word(magic.decode("latin-1"), (len(magic), kinds))
    a.make_automaton()
    return a


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the confirmed media, in order; one inside another of the same pass is listed too."""
    out, ends = [], _Ends(data)
    validators = VALIDATORS | {"application/zip": lambda _, at: ends.zip(at), "application/ogg": lambda _, at: ends.ogg(at)}
    for end, (n, kinds) in automaton().iter(data.decode("latin-1")):
        at = end + 1 - n
        for kind in kinds:
            if length := validators[kind](data, at):
                out.append((kind, at, length))
    return out


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file whose 8-bit samples are the payload."""
    pad = b"\0" * (len(payload) % 2)
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload))
    return b"RIFF" + struct.pack("<I", len(head) + len(payload) + len(pad)) + head + payload + pad


def wav_samples(data: bytes, at: int = 0, length: int | None = None) -> bytes:
    """The samples of a WAV medium."""
    pos, end = at + 12, at + (len(data) - at if length is None else length)
    while pos + 8 <= end:
        kind, n = data[pos : pos + 4], struct.unpack_from("<I", data, pos + 4)[0]
        if kind == b"data":
            return data[pos + 8 : pos + 8 + n]
        pos += 8 + n + n % 2
    return b""


def payload_of(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % BLOCK or (0 if raw else BLOCK))


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, declared (type) and media (the stored file)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            raw = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(["application/octet-stream"] * len(raw), pa.string()), pa.array([wav(payload_of(r)) for r in raw], pa.binary())], names=[key, "n_bytes", "declared", "media"])

    return arrow_map(texts(docs, key, text=text), run, f"`{key}` {kind}, n_bytes long, declared string, media binary")


def identify(rows: DataFrame, media: str = "media", declared: str = "declared", carve: bool = False) -> DataFrame:
    """rows with media_type (the declared type as corrected) and embedded: type, offset, length and, if carved, bytes. A null medium has no type and nothing embedded."""
    rows = rows.drop("media_type", "embedded")
    names = rows.columns
    m, d = names.index(media), names.index(declared)
    item = pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("bytes", pa.binary())])

    def run(batches):
        for batch in batches:
            kinds, inner = [], []
            for data, told in zip(batch.column(m).to_pylist(), batch.column(d).to_pylist(), strict=True):
                found = sniff(data) if data is not None else []
                whole = next((x for x in found if x[1] == 0), None)
                kinds.append(None if data is None else whole[0] if whole else told)
                inner.append([{"type": k, "offset": a, "length": n, "bytes": data[a : a + n] if carve else None} for k, a, n in found if a])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds, pa.string()), pa.array(inner, pa.list_(item))], names=[*names, "media_type", "embedded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return arrow_map(rows, run, f"{schema}, media_type string, embedded array<struct<type:string,offset:bigint,length:bigint,bytes:binary>>")


def describe(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """What is read back from stored media: digests of the samples and of the file, and a feature string."""
    kind = found.schema[key].dataType.simpleString()
    columns = [key, "n_bytes", "media", "media_type", "embedded"]

    def run(batches):
        for batch in batches:
            rows = []
            for n, data, media_type, inner in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                payload = wav_samples(data) if media_type == "audio/wav" else data
                mean = sum(payload) / len(payload)
                feature = f"{media_type};rate={RATE};samples={len(payload)};mean={mean:.4f};embedded={','.join(x['type'] for x in inner) or 'none'}"
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=[key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return arrow_map(found.select(*columns), run, f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(identify(store(table(spark, sf_dir, "documents"))))

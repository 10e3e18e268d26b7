"""Operator 4: media columns, sniffed by signature.

An Aho-Corasick automaton finds every magic number in one pass over the bytes. A validator for the format
then walks its structure and says how long the object is; only objects that it confirms count. The first
confirmed object at offset 0 gives the true type (the declared one is corrected); confirmed objects
inside are carved. Text payloads are stored losslessly as 8-bit mono samples of a WAV file.

Null bytes give a null type and nothing carved; empty ones have type ``application/octet-stream``. Null texts
are stored as empty ones. Repeated rows each get their result, an empty table gives no rows, and columns of the
input with the name of a new one are replaced. Ends of formats without a length are located once for all
their magic numbers, so the work stays in proportion to the bytes.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The formats' magic bytes.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"\xff\xd8\xff": "image/jpeg",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"BM": "image/bmp",
    b"RIFF": "riff",
    b"%PDF-": "application/pdf",
    b"PK\x03\x04": "application/zip",
}
UNKNOWN = "application/octet-stream"
RATE = 8000


class Marks:
    """Where the byte strings are that end objects, each located once for all bytes, in order."""

    def __init__(self, b: bytes):
        self.b, self.found, self.archives = b, {}, None

    def of(self, mark: bytes) -> list[int]:
        if mark not in self.found:
            self.found[mark] = [m.start() for m in re.finditer(re.escape(mark), self.b)]
        return self.found[mark]

    def first(self, mark: bytes, at: int) -> int:
        """The first place of mark from at on, or -1."""
        where = self.of(mark)
        i = bisect_left(where, at)
        return where[i] if i < len(where) else -1

    def archive(self, at: int) -> int:
        """The end of the zip archive that begins at ``at``, or 0: its end record says where it begins."""
        if self.archives is None:
            self.archives = {}
            for end in self.of(b"PK\x05\x06"):
                if end + 22 <= len(self.b):
                    size, start, note = struct.unpack_from("<IIH", self.b, end + 12)
                    if end + 22 + note <= len(self.b):
                        self.archives[end - size - start] = end + 22 + note
        return self.archives.get(at, 0)


def _png(b: bytes, at: int, marks: Marks) -> int:
    p = at + 8
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return 0
        p += 12 + n
        if kind == b"IEND":
            return p - at
    return 0


def _jpeg(b: bytes, at: int, marks: Marks) -> int:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        if b[p + 1] == 0xDA:
            end = marks.first(b"\xff\xd9", p)
            return end + 2 - at if end > 0 else 0
        p += 2 + struct.unpack_from(">H", b, p + 2)[0]
    return 0


def _gif(b: bytes, at: int, marks: Marks) -> int:
    if at + 13 > len(b):
        return 0
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    while p < len(b):
        kind = b[p]
        if kind == 0x3B:
            return p + 1 - at
        if kind == 0x21:
            p += 2
        elif kind == 0x2C and p + 10 <= len(b):
            flags = b[p + 9]
            p += 11 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
        else:
            return 0
        while p < len(b) and b[p]:
            p += 1 + b[p]
        p += 1
    return 0


def _bmp(b: bytes, at: int, marks: Marks) -> int:
    if at + 30 > len(b):
        return 0
    size, _, start, header = struct.unpack_from("<IIII", b, at + 2)
    ok = header in (12, 40, 52, 56, 108, 124) and 14 + header <= start <= size <= len(b) - at
    return size if ok else 0


def _riff(b: bytes, at: int, marks: Marks) -> int:
    if at + 12 > len(b):
        return 0
    n = struct.unpack_from("<I", b, at + 4)[0] + 8
    if b[at + 8 : at + 12] not in (b"WAVE", b"WEBP", b"AVI ") or n < 12 or at + n > len(b):
        return 0
    p = at + 12
    while p + 8 <= at + n:
        size = struct.unpack_from("<I", b, p + 4)[0]
        p += 8 + size + (size & 1)
    return n if p in (at + n, at + n + 1) else 0


def _pdf(b: bytes, at: int, marks: Marks) -> int:
    """Up to the last end mark before the next header: an updated document has several."""
    start = marks.first(b"startxref", at)
    stop = marks.first(b"%PDF-", at + 1)
    ends = marks.of(b"%%EOF")
    i = bisect_left(ends, stop if stop > 0 else len(b)) - 1
    return ends[i] + 5 - at if i >= 0 and at < start < ends[i] else 0


def _zip(b: bytes, at: int, marks: Marks) -> int:
    end = marks.archive(at)
    return end - at if end else 0


VALIDATORS = {"image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "riff": _riff, "application/pdf": _pdf, "application/zip": _zip}
RIFF_TYPES = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}


def automaton():
    """The Aho-Corasick automaton over all magic numbers."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        a.add_word(magic.decode("latin-1"), (len(magic), kind))
    a.make_automaton()
    return a


def objects(b: bytes, a) -> list[tuple[int, int, str]]:
    """(offset, length, type) of every confirmed object, outer before inner, by offset."""
    out, marks = [], Marks(b)
    for end, (n, kind) in a.iter(b.decode("latin-1")):
        at = end - n + 1
        size = VALIDATORS[kind](b, at, marks)
        if size:
            out.append((at, size, RIFF_TYPES[b[at + 8 : at + 12]] if kind == "riff" else kind))
    return sorted(out, key=lambda x: (x[0], -x[1]))


def wav(payload: bytes) -> bytes:
    """A mono WAV file whose 8-bit samples are the payload (of even length)."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def wav_samples(b: bytes) -> bytes:
    """The bytes of a WAV file's data chunk."""
    p = 12
    while p + 8 <= len(b):
        kind, n = struct.unpack_from("<4sI", b, p)
        if kind == b"data":
            return b[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def _map(df: DataFrame, drop: str, added: str, f) -> DataFrame:
    """df without the column ``drop`` and with the columns that f makes of its values (dicts), row by row."""
    new = df.sparkSession.createDataFrame([], added).schema
    keep = [c for c in df.columns if c != drop and c not in new.names]
    schema = df.select(*keep).schema
    for field in new:
        schema = schema.add(field)
    from pyspark.sql.pandas.types import to_arrow_schema

    types = to_arrow_schema(new)

    def run(batches):
        state = f()
        for b in batches:
            column = b.column(b.schema.get_field_index(drop))
            for lo in range(0, b.num_rows, 500):
                made = [state(x.as_py()) for x in column.slice(lo, 500)]
                cols = [b.column(b.schema.get_field_index(c)).slice(lo, 500) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array([m[t.name] for m in made], t.type) for t in types)], [*keep, *types.names])

    return df.select(*keep, drop).mapInArrow(run, schema)


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with its text as ``media``: UTF-8, zero bytes up to a positive multiple of 64, as WAV samples. Null is empty.

    ``declared`` says what the column was declared as: text.
    """

    def make():
        def one(t):
            raw = (t or "").encode()
            return {"media": wav(raw + bytes(-len(raw) % 64 or (0 if raw else 64))), "n_bytes": len(raw), "declared": "text/plain"}

        return one

    return _map(docs, text, "media binary, n_bytes long, declared string", make)


CARVED = "array<struct<offset:bigint,length:bigint,type:string>>"


def sniffed(b: bytes, a) -> tuple[str, list[dict]]:
    """(true type, confirmed objects inside)."""
    found = objects(b, a)
    whole = next((x for x in found if x[0] == 0), None)
    return whole[2] if whole else UNKNOWN, [{"offset": o, "length": n, "type": t} for o, n, t in found if (o, n, t) != whole]


def sniff(media: DataFrame, column: str = "media", declared: str = "declared") -> DataFrame:
    """media (kept) with ``kind`` (true type), ``corrected`` (the declared one was wrong) and ``carved``: (offset, length, type) of the objects inside."""

    def make():
        a = automaton()

        def one(b):
            kind, carved = (None, None) if b is None else sniffed(b, a)
            return {"kind": kind, "carved": carved}

        return one

    twin = media.withColumn("_bytes", F.col(column))
    out = _map(twin, "_bytes", f"kind string, carved {CARVED}", make)
    return out.withColumn("corrected", ~F.col("kind").eqNullSafe(F.col(declared)))


def features(media: DataFrame) -> DataFrame:
    """The columns of query op4 from stored media: everything is computed on the bytes read back."""

    def make():
        a = automaton()

        def one(b):
            kind, carved = sniffed(b, a)
            if kind != "audio/wav":
                raise ValueError("the stored bytes aren't a whole WAV file")
            p = wav_samples(b)
            inner = ";".join(f"{x['type']}@{x['offset'] - 44}+{x['length']}" for x in carved)
            return {
                "payload_bytes": len(p), "payload_sha256": hashlib.sha256(p).hexdigest(), "tail_crc32": zlib.crc32(p[-64:]),
                "media_bytes": len(b), "media_sha256": hashlib.sha256(b).hexdigest(), "kind": kind,
                "feature": f"audio/wav rate={RATE} samples={len(p)} min={min(p)} max={max(p)} mean={sum(p) / len(p):.6f} carved={inner}",
            }

        return one

    new = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, kind string"
    out = _map(media.select("doc_id", "n_bytes", "declared", "media"), "media", new, make)
    return out.withColumn("corrected", ~F.col("kind").eqNullSafe(F.col("declared")))

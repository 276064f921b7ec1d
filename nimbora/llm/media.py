"""Media columns: signature sniffing, validation, carving, and lossless 8-bit samples.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass; a hit counts
only if the format's validator confirms its structure and gives its length. Validators of one
text share a memo: a walk that comes to a place where another has been ends as that one did, so
bytes full of magic are not walked anew from every hit.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbora.llm.store import arrow_batches, take

# Magic bytes, the offset at which they stand in a file, and media types.
MAGIC = [
    ("png", b"\x89PNG\r\n\x1a\n", 0), ("gif", b"GIF87a", 0), ("gif", b"GIF89a", 0), ("jpeg", b"\xff\xd8\xff", 0), ("bmp", b"BM", 0),
    ("wav", b"WAVE", 8), ("webp", b"WEBP", 8), ("avi", b"AVI ", 8), ("pdf", b"%PDF-", 0), ("zip", b"PK\x03\x04", 0),
    ("gzip", b"\x1f\x8b\x08", 0), ("ogg", b"OggS", 0), ("flac", b"fLaC", 0), ("mp4", b"ftyp", 4), ("tiff", b"II*\x00", 0), ("tiff", b"MM\x00*", 0),
]
TYPES = {
    "png": "image/png", "gif": "image/gif", "jpeg": "image/jpeg", "bmp": "image/bmp", "wav": "audio/wav", "webp": "image/webp", "avi": "video/x-msvideo", "pdf": "application/pdf",
    "zip": "application/zip", "gzip": "application/gzip", "ogg": "audio/ogg", "flac": "audio/flac", "mp4": "video/mp4", "tiff": "image/tiff",
}


class Memo(dict):
    """What walks over some bytes have found: (kind of walk, position) -> how it ended from there."""

    def walk(self, kind: str, at: int, step):
        """``step(position)`` gives (next position, None) or (None, the end's value)."""
        trail = []
        while (kind, at) not in self:
            trail.append(at)
            ahead, value = step(at)
            if ahead is None:
                self[kind, at] = value
                break
            at = ahead
        value = self[kind, at]
        for x in trail:
            self[kind, x] = value
        return value

    def next_zero(self, b: bytes, at: int) -> int:
        """The next zero byte, or -1: looked for once between two of them."""
        low, high = self.get("zero", (0, -2))
        if not (low <= at and (high == -1 or at <= high)):
            high = b.find(0, at)
            self["zero"] = (at, high)
        return high


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of the CRC, bits reversed as zlib has them."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ 0xEDB88320 if b & 1 else b >> 1
    return out


def _crc(b: bytes, start: int, end: int, memo: Memo, step: int = 1 << 16) -> int:
    """CRC-32 of a part. Long ones are worked out from the CRCs of all bytes up to their ends."""
    if end - start <= step:
        return zlib.crc32(b[start:end])
    if "crc" not in memo:
        sums = [0]
        for i in range(0, len(b), step):
            sums.append(zlib.crc32(b[i : i + step], sums[-1]))
        memo["crc"] = sums
    upto = lambda i: zlib.crc32(b[i - i % step : i], memo["crc"][i // step])
    power, n, shift = 1 << 23, end - start, 1 << 31  # x**8, and 1
    while n:
        if n & 1:
            shift = _times(shift, power)
        power, n = _times(power, power), n >> 1
    return upto(end) ^ _times(shift, upto(start))


def _png(b: bytes, at: int, memo: Memo) -> int:
    def step(pos: int):
        if pos + 12 > len(b):
            return None, 0
        size, kind = struct.unpack(">I4s", b[pos : pos + 8])
        end = pos + 12 + size
        if end > len(b) or _crc(b, pos + 4, end - 4, memo) != int.from_bytes(b[end - 4 : end], "big"):
            return None, 0
        return (None, end) if kind == b"IEND" else (end, None)

    if b[at + 8 : at + 16] != b"\0\0\0\x0dIHDR":
        return 0
    end = memo.walk("png", at + 8, step)
    return end - at if end else 0


def _gif(b: bytes, at: int, memo: Memo) -> int:
    """With an image at least: a header and a trailer alone are none."""
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 128 else 0

    def sub(p: int):
        return (None, p + 1) if p >= len(b) or not b[p] else (p + b[p] + 1, None)

    def step(pos: int):
        if pos >= len(b) or b[pos] not in (0x3B, 0x21, 0x2C):
            return None, 0
        if b[pos] == 0x3B:
            return None, pos + 1
        if b[pos] == 0x2C and pos + 11 > len(b):
            return None, 0
        return memo.walk("gif part", pos + 2 if b[pos] == 0x21 else pos + 11 + table(b[pos + 9]), sub), None

    def image(pos: int):
        """Whether an image comes on the way."""
        if pos >= len(b) or b[pos] not in (0x21, 0x2C):
            return None, False
        return (None, True) if b[pos] == 0x2C else step(pos)

    if at + 13 > len(b):
        return 0
    first = at + 13 + table(b[at + 10])
    end = memo.walk("gif", first, step)
    return end - at if end and memo.walk("gif image", first, image) else 0


#: A marker within entropy-coded data that ends it: no stuffed byte and no restart.
_MARKER = re.compile(rb"\xff(?![\x00\xd0-\xd7])(?=.)", re.S)


def _jpeg(b: bytes, at: int, memo: Memo) -> int:
    def step(pos: int):
        if pos + 2 > len(b) or b[pos] != 0xFF:
            return None, 0
        kind = b[pos + 1]
        if kind == 0xD9:
            return None, pos + 2
        size = int.from_bytes(b[pos + 2 : pos + 4], "big")
        if pos + 4 > len(b) or size < 2:
            return None, 0
        pos += 2 + size
        if kind == 0xDA:  # entropy-coded data lasts to the next marker that isn't a restart
            if "markers" not in memo:
                memo["markers"] = [m.start() for m in _MARKER.finditer(b)]
            i = bisect_left(memo["markers"], pos)
            return (memo["markers"][i], None) if i < len(memo["markers"]) else (None, 0)
        return pos, None

    end = memo.walk("jpeg", at + 2, step)
    return end - at if end else 0


def _bmp(b: bytes, at: int, memo: Memo) -> int:
    if at + 30 > len(b):
        return 0
    size, _, offset, header = struct.unpack("<IIII", b[at + 2 : at + 18])
    planes = struct.unpack("<H", b[at + 26 : at + 28])[0]
    return size if header in (40, 52, 56, 108, 124) and planes == 1 and 14 + header <= offset <= size <= len(b) - at else 0


def _riff(b: bytes, at: int, memo: Memo) -> int:
    if b[at : at + 4] != b"RIFF" or at + 12 > len(b):
        return 0
    size = 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    pos, end, chunks = at + 12, at + size, set()
    if end > len(b):
        return 0
    while pos + 8 <= end:
        kind, n = struct.unpack("<4sI", b[pos : pos + 8])
        chunks.add(kind)
        pos += 8 + n + (n & 1)
    form = b[at + 8 : at + 12]
    sound = {b"fmt ", b"data"} <= chunks if form == b"WAVE" else b"LIST" in chunks if form == b"AVI " else bool({b"VP8 ", b"VP8L", b"VP8X"} & chunks)
    return size if pos == end and sound else 0


def _pdf(b: bytes, at: int, memo: Memo) -> int:
    if b[at + 5 : at + 6] not in (b"1", b"2") or b[at + 6 : at + 7] != b".":
        return 0
    follow = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, follow if follow > 0 else len(b))
    return end + 5 - at if end > 0 and b.find(b"startxref", at, end) > 0 else 0


def _zips(b: bytes) -> dict[int, int]:
    """First byte -> length of every archive, from the records at their ends."""
    found: dict[int, int] = {}
    end = b.find(b"PK\x05\x06")
    while 0 <= end <= len(b) - 22:
        size, start, note = struct.unpack("<IIH", b[end + 12 : end + 22])
        at = end - size - start
        if at >= 0 and b[at : at + 4] == b"PK\x03\x04" and b[at + start : at + start + 4] == b"PK\x01\x02" and end + 22 + note <= len(b):
            found.setdefault(at, end + 22 + note - at)
        end = b.find(b"PK\x05\x06", end + 4)
    return found


def _gzip(b: bytes, at: int, memo: Memo) -> int:
    flags, pos = b[at + 3 : at + 4], at + 10
    if pos > len(b) or flags[0] & 0xE0:
        return 0
    if flags[0] & 4:
        pos += 2 + int.from_bytes(b[pos : pos + 2], "little")
    for _ in range((flags[0] >> 3 & 1) + (flags[0] >> 4 & 1)):  # a name and a note, each up to a zero
        if pos >= len(b) or (end := memo.next_zero(b, pos)) < 0:
            return 0
        pos = end + 1
    job, pos = zlib.decompressobj(31), at
    try:
        while not job.eof and pos < len(b):
            rest = b[pos : pos + (1 << 16)]
            pos += len(rest)
            while rest and not job.eof:
                job.decompress(rest, 1 << 20)
                rest = job.unconsumed_tail
    except zlib.error:
        return 0
    return pos - at - len(job.unused_data) if job.eof else 0


_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def _ogg_crc(page: bytes) -> int:
    """The checksum of an Ogg page, whose own field counts as zeros: zlib's polynomial, but the high bit
    first and without inversions, so of reversed bytes, and its bits reversed."""
    turned = (page[:22] + bytes(4) + page[26:]).translate(_REVERSED)
    return int(f"{zlib.crc32(turned, 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


def _ogg(b: bytes, at: int, memo: Memo) -> int:
    """Pages up to the stream's last one; a stream begins with its page 0."""

    def step(pos: int):
        if pos + 27 > len(b) or b[pos : pos + 5] != b"OggS\x00":
            return None, 0
        n = b[pos + 26]
        end = pos + 27 + n + sum(b[pos + 27 : pos + 27 + n])
        if end > len(b) or _ogg_crc(b[pos:end]) != int.from_bytes(b[pos + 22 : pos + 26], "little"):
            return None, 0
        return (None, end) if b[pos + 5] & 4 else (end, None)

    if b[at + 5 : at + 6] not in (b"\x02", b"\x06") or b[at + 18 : at + 22] != bytes(4):
        return 0
    end = memo.walk("ogg", at, step)
    return end - at if end else 0


def _bitwise(poly: int, bits: int) -> list[int]:
    out = []
    for i in range(256):
        r = i << (bits - 8)
        for _ in range(8):
            r = r << 1 ^ poly if r >> (bits - 1) & 1 else r << 1
        out.append(r & (1 << bits) - 1)
    return out


_CRC8, _CRC16 = _bitwise(0x07, 8), _bitwise(0x8005, 16)


def _flac_header(b: bytes, pos: int) -> tuple[int, int] | None:
    """(length, samples) of a frame's header, whose checksum holds."""
    if pos + 6 > len(b) or b[pos] != 0xFF or b[pos + 1] & 0xFE != 0xF8:
        return None
    size, rate = b[pos + 2] >> 4, b[pos + 2] & 15
    lead, at = b[pos + 4], pos + 5
    at += 0 if lead < 0x80 else 1 if lead >> 5 == 6 else 2 if lead >> 4 == 14 else 3 if lead >> 3 == 30 else 4 if lead >> 2 == 62 else 5 if lead >> 1 == 126 else 6
    if not size or rate == 15 or b[pos + 3] & 1:
        return None
    samples = 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)
    if size in (6, 7):
        samples = int.from_bytes(b[at : at + size - 5], "big") + 1
        at += size - 5
    at += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    crc = 0
    for x in b[pos:at]:
        crc = _CRC8[crc ^ x]
    return (at + 1 - pos, samples) if at < len(b) and crc == b[at] else None


def _flac(b: bytes, at: int, memo: Memo) -> int:
    """Metadata, then frames. A frame has no length: it ends where its checksum comes out and either all
    samples that the metadata name have been, or another frame begins, or nothing comes any more."""
    pos, last, first = at + 4, False, True
    while not last:
        if pos + 4 > len(b) or (first and (b[pos] & 127 or int.from_bytes(b[pos + 1 : pos + 4], "big") != 34)):
            return 0
        last, first = bool(b[pos] & 128), False
        pos += 4 + int.from_bytes(b[pos + 1 : pos + 4], "big")
    left = int.from_bytes(b[at + 21 : at + 26], "big") & (1 << 36) - 1
    known, end, wide = left > 0, 0, (b[at + 20] & 1) << 4 | b[at + 21] >> 4
    while (head := _flac_header(b, pos)) and (left > 0 or not known):
        after, crc, stop = left - head[1], 0, 0
        # No frame is larger than its samples as they are, with a few bytes more a channel.
        for i in range(pos, min(len(b), pos + 32 + (1 + min(b[pos + 3] >> 4, 7)) * (64 + head[1] * (wide + 2) // 8))):
            crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ b[i]]
            if not crc and i > pos + head[0] and (known and after <= 0 or i + 1 == len(b) or _flac_header(b, i + 1) or not known and b[i + 1] != 0xFF):
                stop = i + 1
                break
        if not stop:
            break
        pos = end = stop
        left = after
    return end - at if end and (not known or left <= 0) else 0


def _mp4(b: bytes, at: int, memo: Memo) -> int:
    def step(pos: int):
        if pos + 8 > len(b):
            return None, pos
        size, kind = struct.unpack(">I4s", b[pos : pos + 8])
        known = kind in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"moof", b"mfra", b"uuid", b"wide")
        return (pos + size, None) if known and size >= 8 and pos + size <= len(b) else (None, pos)

    end = memo.walk("mp4", at, step) if at >= 0 and b[at + 4 : at + 8] == b"ftyp" else at
    first = int.from_bytes(b[at : at + 4], "big") if end > at else 0
    return end - at if end > at + first else 0


def _tiff(b: bytes, at: int, memo: Memo) -> int:
    """Directory entries are walked; the file lasts to the furthest byte they name."""
    order, pos, far = "<" if b[at : at + 2] == b"II" else ">", 0, 0
    if at + 8 > len(b):
        return 0
    pos, seen, widths = struct.unpack(order + "I", b[at + 4 : at + 8])[0], set(), [0, 1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8]

    def entries(spot: int) -> tuple[int, int, int] | None:
        """(bytes of a directory, furthest byte its entries name, next directory), or nothing if it isn't one."""
        n = struct.unpack(order + "H", b[spot : spot + 2])[0] if spot + 2 <= len(b) else 0
        end, most = spot + 2 + 12 * n, 0
        if not n or end + 4 > len(b):
            return None
        for e in range(spot + 2, end, 12):
            _, kind, count, value = struct.unpack(order + "HHII", b[e : e + 12])
            if not 0 < kind < 13:
                return None
            if widths[kind] * count > 4:
                most = max(most, value + widths[kind] * count)
        return end + 4 - spot, most, struct.unpack(order + "I", b[end : end + 4])[0]

    while pos and pos not in seen:
        seen.add(pos)
        if pos < 8:
            return 0
        if ("tiff" + order, at + pos) not in memo:
            memo["tiff" + order, at + pos] = entries(at + pos)
        if (found := memo["tiff" + order, at + pos]) is None:
            return 0
        size, most, ahead = found
        far, pos = max(far, most, pos + size), ahead
    return far if seen and at + far <= len(b) else 0


VALID = {"png": _png, "gif": _gif, "jpeg": _jpeg, "bmp": _bmp, "wav": _riff, "webp": _riff, "avi": _riff, "pdf": _pdf, "gzip": _gzip, "ogg": _ogg, "flac": _flac, "mp4": _mp4, "tiff": _tiff}


_automaton = None


def _machine():
    """Made in each worker: magic bytes as Latin-1 text, which has one character per byte."""
    global _automaton
    if _automaton is None:
        _automaton = ahocorasick.Automaton()
        for kind, magic, offset in MAGIC:
            _automaton.add_word(magic.decode("latin-1"), (kind, offset, len(magic)))
        _automaton.make_automaton()
    return _automaton


def sniff_all(data: bytes) -> list[tuple[str, int, int, int]]:
    """(format, start, length, start of the medium it lies in, or -1) of every confirmed medium, by
    start. One of its own format that ends where the medium around it ends is that one's last part."""
    found, open_, zips, memo = [], [], None, Memo()
    hits = sorted({(end + 1 - size - offset, kind) for end, (kind, offset, size) in _machine().iter(data.decode("latin-1"))})
    for start, kind in hits:
        if start < 0:
            continue
        while open_ and open_[-1][1] + open_[-1][2] <= start:
            open_.pop()
        if kind == "zip":
            zips = _zips(data) if zips is None else zips
            size = zips.get(start, 0)
        else:
            size = VALID[kind](data, start, memo)
        if not size or (open_ and (start + size > open_[-1][1] + open_[-1][2] or start == open_[-1][1] or (kind == open_[-1][0] and start + size == open_[-1][1] + open_[-1][2]))):
            continue
        found.append((kind, start, size, open_[-1][1] if open_ else -1))
        open_.append(found[-1])
    return found


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(format, start, length) of the confirmed media that lie in no other."""
    return [f[:3] for f in sniff_all(data) if f[3] < 0]


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """One channel of unsigned 8-bit samples; an odd count gets the format's padding byte."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    data = struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(data), b"WAVE") + fmt + data


def wav_samples(media: bytes) -> bytes:
    """The data chunk of a stored WAV."""
    pos = 12
    while pos + 8 <= len(media):
        kind, n = struct.unpack("<4sI", media[pos : pos + 8])
        if kind == b"data":
            return media[pos + 8 : pos + 8 + n]
        pos += 8 + n + (n & 1)
    raise ValueError("no data chunk")


MEDIUM = "struct<type: string, start: long, length: long, parent: long>"


def correct_types(frame: DataFrame, media: str = "media", declared: str = "declared_type", key: str = "doc_id") -> DataFrame:
    """One row per row: key, detected type (null: no known format at the start), corrected type
    (detected, or else declared), and the embedded media (array of type, start, length, and the
    start of the medium it lies in, null for none).

    Null bytes count as empty and give the declared type; a null declaration stays null where
    nothing is detected. Repeated rows give equal rows; other columns don't matter, whatever
    their names. Very long bytes are read whole. Of formats that tie for a start, the first by
    name counts. An empty table gives an empty result.
    """
    arrow_batches(frame.sparkSession, rows=100)

    def rows(batches):
        for batch in batches:
            kinds, fixed, inner = [], [], []
            for data, said in zip(batch.column(1), batch.column(2), strict=True):
                found = sniff_all(data.as_py() or b"")
                kind = TYPES[found[0][0]] if found and found[0][1] == 0 else None
                kinds.append(kind)
                fixed.append(kind or said.as_py())
                inner.append([{"type": TYPES[k], "start": s, "length": n, "parent": p if p >= 0 else None} for k, s, n, p in found if s])
            item = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("parent", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string()), pa.array(fixed, pa.string()), pa.array(inner, item)], names=["key", "detected", "corrected", "embedded"])

    plain = take(frame, key, media, declared).toDF("key", "media", "declared")
    kind = plain.schema["key"].dataType.simpleString()
    return plain.withColumn("declared", F.col("declared").cast("string")).mapInArrow(rows, f"key {kind}, detected string, corrected string, embedded array<{MEDIUM}>")


def carve(frame: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """A row per embedded medium, also one within another: key, type, start, bytes. Null and empty bytes give none; the rest
    as in ``correct_types``."""
    spark = frame.sparkSession
    arrow_batches(spark, rows=100)

    def rows(batches):
        for batch in batches:
            out = [(k, TYPES[f], s, b[s : s + n]) for k, m in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for b in [m.as_py() or b""] for f, s, n, _ in sniff_all(b) if s]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], batch.schema.field(0).type), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.binary())], names=["key", "type", "start", "bytes"])

    plain = take(frame, key, media).toDF("key", "media")
    kind = plain.schema["key"].dataType.simpleString()
    return plain.mapInArrow(rows, f"key {kind}, type string, start long, bytes binary")


def text_media(docs: DataFrame, unit: int = 192) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a WAV of 8-bit samples, padded with spaces to a
    positive multiple of ``unit`` bytes. A null text is empty; a null doc_id stays null; repeated
    rows give equal rows; very long texts are stored whole; other columns don't matter, whatever
    their names; an empty table gives an empty result."""
    arrow_batches(docs.sparkSession)

    def rows(batches):
        for batch in batches:
            raw = [(t.as_py() or "").encode() for t in batch.column(1)]
            media = [to_wav(b + b" " * (max(unit, -(-len(b) // unit) * unit) - len(b))) for b in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) for b in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return take(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, n_bytes long, media binary")


def media_digest(media: DataFrame) -> DataFrame:
    """Reads the stored bytes of ``text_media`` back: sniffed type, payload digests, sample
    features, the payload's own type (declared text/plain, corrected where a format is confirmed
    at its start) and the media carved from it (type:start:length:crc32). A row per row; equal texts give
    equal values; an empty table gives an empty result."""
    arrow_batches(media.sparkSession)

    def rows(batches):
        for batch in batches:
            out = []
            for m in batch.column(2):
                b = m.as_py()
                found = sniff(b)
                payload = wav_samples(b)
                x = np.frombuffer(payload, np.uint8).astype(np.int64)
                inside = sniff_all(payload)
                turns = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
                feature = f"{TYPES[found[0][0]]};samples={len(x)};min={x.min()};max={x.max()};sum={x.sum()};power={int((x * x).sum())};crossings={turns};embedded={len(inside)}"
                kind = TYPES[inside[0][0]] if inside and inside[0][1] == 0 else None
                carved = ",".join(f"{TYPES[k]}:{s}:{n}:{zlib.crc32(payload[s : s + n])}" for k, s, n, _ in inside if s)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(b), hashlib.sha256(b).hexdigest(), feature, kind or "text/plain", carved))
            cols = list(zip(*out, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "payload_type", "carved"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "n_bytes", *names])

    return media.mapInArrow(rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, payload_type string, carved string")

"""Secret scans through nested encodings: a worklist of decoded layers per document.

A layer is a text and a map of its characters to spans of the layer it came from, kept as
runs of characters. URL and Unicode escapes keep the map piece by piece; what comes out of
base64 (inflated where it is compressed) maps to the whole encoded run. Each new layer is
scanned and decoded in turn until nothing new appears; a layer already seen at the same
place is not taken again, so cycles end, and equal secrets at two places are both found.
The worklist is depth first, and inflated data are read window by window, so no more is
held than a window of each layer on the way down.

Depth costs nothing by itself: an escaped escape sign is decoded together with what follows it, in
one step however often it is escaped, and a layer of escapes has only the stretches around what
was decoded, up to characters that stand in no secret and no encoding. A run of base64 letters may
begin with others (a path, a name, a key), so it is decoded at all four alignments, and compressed
data are also looked for inside of what comes out.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbora.llm import words as W
from nimbora.llm.store import arrow_batches, numbered, take

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A greedy run of 24 or more starts where the run of any length would.
HEX = re.compile(r"[0-9a-f]{24,}")

# An escape, its sign escaped any number of times.
URL_ONE = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
URL_PART = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
_UNICODE = r"\\(?:u005[Cc]|x5[Cc])*(?:u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|u\{[0-9A-Fa-f]{1,8}\}|U[0-9A-Fa-f]{8})|%(?:u0025)*u[0-9A-Fa-f]{4}"
UNICODE_ONE = re.compile(_UNICODE)
UNICODE_PART = re.compile(f"(?:{_UNICODE})+")
UNICODE_CODE = re.compile(r"[uUx]\{?([0-9A-Fa-f]+)\}?$")
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# The same over several lines. It starts where a run does, so each run is read once.
BASE64_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[A-Za-z0-9+/_-]++)+={0,2}")
#: What stands in no secret and no encoding: windows of inflated data and stretches of a layer end there.
OUTSIDE = re.compile(rb"[^A-Za-z0-9+/_.=\-%\\\"' :\r\n{}]|\n\r?\n")
OUTSIDE_TEXT = re.compile(OUTSIDE.pattern.decode())
#: Compressed data that can't be taken for others, wherever they begin, and where zlib's two bytes are believed.
PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00")
SEPARATOR = re.compile(r"[/_+-]")


@dataclass(frozen=True)
class Scan:
    """``window``: bytes of inflated data that are looked at together. A window grows up to
    ``longest`` bytes until it ends outside of any secret or encoded run; beyond, windows
    overlap by ``window`` and by the run that has begun, so that only a single run or
    assignment of more than ``longest`` bytes could be missed."""

    window: int = 1 << 22
    longest: int = 1 << 26


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets of a text."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


class Layer:
    """A text; ``pieces`` (first character, start, end, one to one) say where in ``parent`` each
    run of its characters came from. The document itself has no parent."""

    def __init__(self, text: str, parent: Layer | None = None, pieces: list[tuple[int, int, int, bool]] = ()):
        self.text, self.parent, self.pieces = text, parent, pieces
        self.firsts = [p[0] for p in pieces]

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The span of the document that characters start to end (exclusive) came from."""
        layer = self
        while layer.parent is not None:
            first, from_, _, even = layer.pieces[bisect_right(layer.firsts, start) - 1]
            low = from_ + start - first if even else from_
            first, from_, to, even = layer.pieces[bisect_right(layer.firsts, end - 1) - 1]
            start, end, layer = low, from_ + end - first if even else to, layer.parent
        return start, end


def _inflaters(raw: bytes):
    """Makers of a decompressor for what ``raw`` begins like, one for each member to come."""
    if raw[:2] == b"\x1f\x8b":
        return lambda: zlib.decompressobj(31)
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor
    if len(raw) > 2 and raw[0] & 15 == 8 and (raw[0] << 8 | raw[1]) % 31 == 0:
        return zlib.decompressobj
    return None


def _parts(raw: bytes, step: int, left: list[int] | None = None) -> Iterator[bytes]:
    """What all members of compressed ``raw`` hold, up to ``step`` bytes at a time. Damaged data
    end where they can't be read any further. ``left`` is told how many bytes come after a member."""
    while (make := _inflaters(raw)) is not None:
        engine, is_zlib = make(), False
        is_zlib = hasattr(engine, "unconsumed_tail")
        rest, raw = raw, b""
        try:
            while not engine.eof:
                part = engine.decompress(rest, step)
                rest = engine.unconsumed_tail if is_zlib else b""
                if part:
                    yield part
                elif not rest and (is_zlib or engine.needs_input):
                    break
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
            return
        raw = engine.unused_data.lstrip(b"\0")  # xz pads its members
        if left is not None and engine.eof:
            left[:] = [len(raw)]


def _windows(parts: Iterator[bytes], scan: Scan) -> Iterator[bytes]:
    """The same bytes in windows that end outside of secrets and encoded runs."""
    have = bytearray()
    for part in parts:
        have += part
        if len(have) < scan.window:
            continue
        low = max(0, len(have) - scan.window)
        cut = max((m.end() for m in OUTSIDE.finditer(have, low)), default=0)
        if cut:
            yield bytes(have[:cut])
            del have[:cut]
        elif len(have) >= scan.longest:
            yield bytes(have)
            gap = max(have.rfind(b" "), have.rfind(b"\n"))  # an encoded run that began is read again
            del have[: min(len(have) - scan.window, gap) if gap > 0 else -scan.window]
    if have:
        yield bytes(have)


def _unquote(part: str) -> list[tuple[int, str | None]]:
    """(length in ``part``, decoded character) of URL escapes; None for what is no UTF-8 or a control."""
    ones = [(m.end() - m.start(), int(m[1], 16)) for m in URL_ONE.finditer(part)]
    out, at = [], 0
    for c in bytes(v for _, v in ones).decode("utf-8", "surrogateescape"):
        n = len(c.encode("utf-8", "surrogateescape"))
        out.append((sum(w for w, _ in ones[at : at + n]), c if c.isprintable() or c in "\t\n\r" else None))
        at += n
    return out


def _unescape(part: str) -> list[tuple[int, str | None]]:
    """The same of Unicode escapes; None for lone surrogates and what is no code point."""
    ones = [(len(x), int(UNICODE_CODE.search(x)[1], 16)) for x in UNICODE_ONE.findall(part)]
    out, i = [], 0
    while i < len(ones):
        width, code = ones[i]
        i += 1
        if 0xD800 <= code < 0xDC00 and i < len(ones) and 0xDC00 <= ones[i][1] < 0xE000:
            width, code = width + ones[i][0], 0x10000 + (code - 0xD800 << 10) + ones[i][1] - 0xDC00
            i += 1
        out.append((width, None if code > 0x10FFFF or 0xD800 <= code < 0xE000 else chr(code)))
    return out


def _unescaped(layer: Layer, part: re.Pattern, decode) -> Iterator[Layer]:
    """Layers of the stretches in which escapes of one kind can be decoded, with all of these decoded;
    other escapes stay as they stand."""
    text, new = layer.text, []
    for m in part.finditer(text):
        here = m.start()
        for width, char in decode(m[0]):
            if char is not None:
                new.append((here, here + width, char))
            here += width
    if not new:
        return
    cuts = [m.span() for m in OUTSIDE_TEXT.finditer(text)]
    ends, i = [c[1] for c in cuts], 0
    while i < len(new):
        k = bisect_right(ends, new[i][0])
        at = ends[k - 1] if k else 0
        stop = cuts[k][0] if k < len(cuts) else len(text)
        chars, pieces, size = [], [], 0
        while i < len(new) and new[i][0] < max(stop, at + 1):
            start, end, char = new[i]
            if start > at:
                pieces.append((size, at, start, True))
                chars.append(text[at:start])
                size += start - at
            pieces.append((size, start, end, False))
            chars.append(char)
            size, at, i = size + len(char), end, i + 1
            stop = max(stop, end)
        if stop > at:
            pieces.append((size, at, stop, True))
            chars.append(text[at:stop])
        yield Layer("".join(chars), layer, pieces)


def _flat(layer: Layer, raw: bytes, start: int, end: int, scan: Scan, begins: list[int] = ()) -> Iterator[Layer]:
    """Layers of the bytes of one encoded run. All patterns are ASCII and the whole run is their
    place, so the bytes' encoding doesn't matter; two-byte encodings are read without their zeros.
    ``begins``: bytes of ``raw`` before which a separator stood in the run."""
    read = False
    for part in _windows(_parts(raw, scan.window), scan):
        read = True
        yield from _bytes(layer, part, start, end)
    if read:
        return
    yield from _bytes(layer, raw, start, end)  # not compressed, or only what looks like it
    weak = [b for b in begins if 0 < b < len(raw) - 2 and raw[b] & 15 == 8 and (raw[b] << 8 | raw[b + 1]) % 31 == 0]
    past = 0
    for at in sorted({m.start() for m in PACKED.finditer(raw, 1)} | set(weak)):
        if at >= past:
            left: list[int] = []
            for part in _windows(_parts(raw[at:], scan.window, left), scan):
                yield from _bytes(layer, part, start, end)
            past = len(raw) - left[0] if left else past  # what was read to its end isn't looked into again


def _bytes(layer: Layer, part: bytes, start: int, end: int) -> Iterator[Layer]:
    if b"\0" in part:
        yield Layer(part.replace(b"\0", b"").decode("latin-1"), layer, [(0, start, end, False)])
    yield Layer(part.decode("latin-1"), layer, [(0, start, end, False)])


def layers(layer: Layer, scan: Scan) -> Iterator[Layer]:
    """The layers that one decoding of ``layer`` gives."""
    text = layer.text
    if "%" in text:
        yield from _unescaped(layer, URL_PART, _unquote)
    if "\\" in text or "%u" in text:
        yield from _unescaped(layer, UNICODE_PART, _unescape)
    for pattern in (BASE64_RUN, BASE64_LINES):
        for m in pattern.finditer(text):
            run = m[0].rstrip("=")
            if pattern is BASE64_LINES:
                run = run.replace("\r", "").replace("\n", "")
            splits = [s.end() for s in SEPARATOR.finditer(run)]
            letters = run.replace("-", "+").replace("_", "/")
            for first in range(4):
                body = letters[first:]
                if len(body) % 4 == 1:
                    body = body[:-1]
                if first and len(body) < 16:
                    break
                begins = [(s - first) // 4 * 3 for s in splits if (s - first) % 4 == 0]
                yield from _flat(layer, base64.b64decode(body + "=" * (-len(body) % 4)), m.start(), m.end(), scan, begins)


def scan_text(text: str, scan: Scan = Scan()) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(secrets of the text itself, secrets of all layers mapped to the text), both sorted."""
    base = sorted(find(text))
    found, seen, work = set(base), set(), [layers(Layer(text), scan)]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if not layer.text:
            continue
        place = layer.span(0, len(layer.text))
        key = (hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), place)
        if key in seen:
            continue
        seen.add(key)
        for s, k, e in find(layer.text):
            s, e = layer.span(s, e)
            found.add((s, k, e))
        work.append(layers(layer, scan))
    return base, sorted(found)


def suspects(column: pa.Array) -> np.ndarray:
    """Rows that can have a secret or an encoded run at all: found from the bytes of the
    whole batch, so that plain prose costs no regular expression."""
    run = np.zeros(256, bool)
    run[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True
    one = np.zeros(256, bool)
    one[[ord(c) for c in "=:%\\"]] = True
    out = np.zeros(len(column), bool)
    for lo, hi, data, bounds in W.slices(column):
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(run[data], out=total[1:])
        hit = np.flatnonzero(total[16:] - total[:-16] == 16) if len(data) >= 16 else np.zeros(0, int)
        hit = np.concatenate([hit, np.flatnonzero(one[data])])
        out[lo + np.unique(np.searchsorted(bounds, hit, "right") - 1)] = True
    return out


def name(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def find_secrets(docs: DataFrame, scan: Scan = Scan()) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and spans, both array<struct<kind, start, end>>
    in code points, end exclusive, by start, kind, end. ``base`` is what the text itself shows.

    Reads ``doc_id`` and ``text``; other columns don't matter, whatever their names. A null or
    empty text has no spans; a null doc_id stays null; repeated rows give equal rows; no rows
    give none. Very long texts are scanned whole, in time about linear in them. Spans of one
    start are ordered by kind and end; equal spans are one.
    """
    arrow_batches(docs.sparkSession)

    def rows(batches):
        for batch in batches:
            able = suspects(batch.column(1))
            base, spans = [], []
            for text, check in zip(batch.column(1), able, strict=True):
                a, b = scan_text(text.as_py() or "", scan) if check else ([], [])
                base.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in a])
                spans.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in b])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(SPAN)), pa.array(spans, pa.list_(SPAN))], names=["doc_id", "base", "spans"])

    kind = "array<struct<kind: string, start: long, end: long>>"
    return take(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, f"doc_id long, base {kind}, spans {kind}")


def digest(found: DataFrame) -> DataFrame:
    """The counts and digests of ``find_secrets``."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, scan: Scan = Scan(), mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by ``mark``; all rows and columns
    stay, whatever the columns' names. Null texts stay null and empty ones empty; repeated rows
    give equal rows; an empty table an empty one; very long texts are redacted whole."""
    spark = docs.sparkSession
    arrow_batches(spark)
    at = docs.columns.index("text")
    _, plain = numbered(docs)

    def clean(text: str) -> str:
        parts, last = [], 0
        for s, _, e in scan_text(text, scan)[1]:
            if s >= last:
                parts += [text[last:s], mark]
            last = max(last, e)
        return "".join([*parts, text[last:]])

    def rows(batches):
        for batch in batches:
            able = suspects(batch.column(at))
            texts = pa.array([None if (x := t.as_py()) is None else clean(x) if check else x for t, check in zip(batch.column(at), able, strict=True)], pa.string())
            yield batch.set_column(at, batch.schema.field(at).with_type(pa.string()), texts)

    out = plain.mapInArrow(rows, plain.schema)
    return out.toDF(*docs.columns)

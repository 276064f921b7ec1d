"""Document fingerprints by winnowing.

A text's k-grams of code points get polynomial hashes modulo 2**64, built by doubling (a gram of 2m
is two of m), so a text costs log2(k) passes over its code points. Of every ``window`` consecutive
grams the least hash is taken, of equals the rightmost, and each one taken is kept once, with its
position. So two texts that share ``gram + window - 1`` consecutive code points share a
fingerprint of that place, wherever it lies in them, and what is shorter than ``gram`` can't match
by chance.

Defined cases: a null text is an empty one; an empty text has no fingerprints; a text shorter than a
gram is one gram; one with fewer grams than a window has the least of these. Texts of any length
are taken whole, block by block. Likeness is the share of different hashes that both have among all
(two texts without hashes: 1).

``with_next`` pairs each row with the next in descending order of id (null ids last, equal ids by
their texts' hashes, after the last row the first) without sorting texts as a whole: ids and hashes
alone are put into ranges, whose first rows are the only thing that goes to the driver (one per
range); then each text goes once to its range, a range's first row to the range before it too. Rows that
repeat id and text are counted where they are read and meet as counts: each but the last is
followed by its equal. Columns beside id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbora.llm.store import take
from nimbora.sources.scratch import ship

#: An odd multiplier (the golden ratio's), and the bits of a hash that are dropped for a positive long.
BASE, DROPPED = 0x9E3779B97F4A7C15, 4


@dataclass(frozen=True)
class Winnow:
    gram: int = 16
    window: int = 49
    block: int = 1 << 20  # code points looked at together

    @property
    def guarantee(self) -> int:
        """Code points in common that are never missed."""
        return self.gram + self.window - 1


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Sum of code * BASE**(k - 1 - i) modulo 2**64 over each k-gram, without the lowest bits."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    power, width, unit = BASE, 1, codes.astype(np.uint64)
    out, done = None, 0  # hashes of grams of ``done`` code points, of those bits of k seen so far
    while True:
        if k & width:
            if out is None:
                out, done = unit, width
            else:  # ``unit`` in front of what there is
                size = len(codes) - width - done + 1
                out = unit[:size] * np.uint64(pow(BASE, done, 1 << 64)) + out[width : width + size]
                done += width
        width *= 2
        if width > k:
            break
        size = len(unit) - width // 2
        unit = unit[:size] * np.uint64(power) + unit[width // 2 :]
        power = power * power % (1 << 64)
    return (out[:n] >> np.uint64(DROPPED)).astype(np.int64)


def rightmost_least(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash of every window, of equals the rightmost, each once, ascending."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    window = min(window, n)
    better = lambda left, right: np.where(hashes[right] <= hashes[left], right, left)
    at, width = np.arange(n), 1
    while 2 * width <= window:
        at = better(at[:-width], at[width:])
        width *= 2
    rest = window - width
    if rest:
        at = better(at[:-rest], at[rest:])
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


def winnow(text: str, c: Winnow = Winnow()) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of a whole text's fingerprints."""
    codes = codes_of(text)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = min(c.gram, len(codes))
    spots, values = [], []
    # Blocks overlap by all but one gram of a window, so that each window lies in one of them whole.
    step = max(1, c.block)
    reach = step + c.window - 1 + k - 1
    for lo in range(0, max(1, len(codes) - k + 1 - c.window + 1), step):
        hashes = gram_hashes(codes[lo : lo + reach], k)
        at = rightmost_least(hashes, c.window)
        spots.append(at + lo)
        values.append(hashes[at])
    spots, first = np.unique(np.concatenate(spots), return_index=True)
    return spots, np.concatenate(values)[first]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of different hashes in both among those in either; 1 if neither has any."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def fingerprints(docs: DataFrame, c: Winnow = Winnow()) -> DataFrame:
    """(doc_id, prints: array of (position, hash)) of each row; a narrow pass."""
    ship(docs.sparkSession)
    rows = take(docs, "doc_id", "text")

    def prints(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [winnow(t or "", c) for t in part.column("text").to_pylist()]
                bounds = np.cumsum([0] + [len(p) for p, _ in found]).astype(np.int32)
                flat = [np.concatenate([f[i] for f in found]) for i in (0, 1)]
                cells = pa.StructArray.from_arrays([pa.array(x) for x in flat], ["position", "hash"])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds), cells)], names=["doc_id", "prints"])

    return rows.mapInArrow(prints, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, prints array<struct<position: long, hash: long>>")


def _key(doc_id: int | None, h: int) -> tuple:
    """Sorts descending ids first, null ids last, then hashes."""
    return (doc_id is None, -(doc_id or 0), h)


def with_next(docs: DataFrame, each: Callable[[Iterator[tuple[int | None, str, str, int]]], Iterator[pa.RecordBatch]], schema: str, mb: int = 128) -> DataFrame:
    """What ``each`` makes of (id, text, next text, times) of all rows; ``schema`` is its rows'.

    ``mb``: MB of text that a range holds about, where the session's shuffle partitions are fewer.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = take(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (mb << 20)))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h").asc()]
    cut = rows.select("doc_id", "h").repartitionByRange(ranges, *order).groupBy(F.spark_partition_id().alias("p"))
    # Of the ids of a range the first: the greatest, or null where there are no others.
    firsts = cut.agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id").cast("decimal(20,0)")).alias("back"), F.col("h"))).alias("first")).collect()
    starts = sorted({_key(None if r["first"]["none"] else -int(r["first"]["back"]), r["first"]["h"]) for r in firsts})

    def deal(batches):
        """Each different row once, to its range, and the first of a range to the one before it; then how often the repeated ones came."""
        seen: dict[tuple, int] = {}
        kind = None
        for batch in batches:
            kind = batch.schema
            ids, hashes, texts = batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), batch.column("text")
            at, bucket, heads = [], [], []
            for i, (d, h) in enumerate(zip(ids, hashes, strict=True)):
                key = _key(d, h)
                seen[key] = seen.get(key, 0) + 1
                if seen[key] > 1:
                    continue
                b = bisect_right(starts, key) - 1
                at.append(i)
                bucket.append(b)
                heads.append(False)
                if starts[b] == key:
                    at.append(i)
                    bucket.append((b - 1) % len(starts))
                    heads.append(True)
            if at:
                some = pa.array(at)
                yield out(bucket, heads, batch.column("doc_id").take(some), [hashes[i] for i in at], texts.take(some), [1] * len(at))
        more = [(k, n - 1) for k, n in seen.items() if n > 1]
        for lo in range(0, len(more), 10_000):
            part = more[lo : lo + 10_000]
            n = len(part)
            yield out([bisect_right(starts, k) - 1 for k, _ in part], [False] * n, pa.array([None if k[0] else -k[1] for k, _ in part], kind.field("doc_id").type), [k[2] for k, _ in part], pa.nulls(n, pa.string()), [t for _, t in part])

    def out(bucket, head, ids, hashes, texts, times):
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(head), ids, pa.array(hashes, pa.int64()), texts, pa.array(times, pa.int64())], names=["bucket", "head", "doc_id", "h", "text", "times"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    dealt = rows.mapInArrow(deal, f"bucket int, head boolean, doc_id {kind}, h long, text string, times long")
    # Within a range as ordered, a row's text before its counts; the next range's first row at the end.
    sorted_ = dealt.repartition(ranges, "bucket").sortWithinPartitions("bucket", "head", *order, F.col("text").isNull())

    def pairs(batches) -> Iterator[tuple[int | None, str, str, int]]:
        held = None  # bucket, id, hash, text, times
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("bucket", "head", "doc_id", "h", "times")]
            texts = batch.column("text")
            for i, (bucket, head, d, h, times) in enumerate(zip(*columns, strict=True)):
                if held and not head and held[:3] == [bucket, d, h]:
                    held[4] += times
                    continue
                text = texts[i].as_py()
                if held:
                    if held[4] > 1:
                        yield held[1], held[3], held[3], held[4] - 1
                    yield held[1], held[3], text, 1
                held = None if head else [bucket, d, h, text, times]

    def run(batches):
        yield from each(pairs(batches))

    return sorted_.mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """The last third (down) of the code points replaced by as many of the next text's first."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def told(spots: np.ndarray, values: np.ndarray) -> str:
    """position:hash (hexadecimal), by position, joined by commas."""
    return ",".join(f"{p}:{v:x}" for p, v in zip(spots.tolist(), values.tolist(), strict=True))


def compare_edits(docs: DataFrame, c: Winnow = Winnow()) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    ids = {"bigint": pa.int64(), "int": pa.int32()}.get(kind := docs.schema["doc_id"].dataType.simpleString(), pa.int64())
    types = [ids, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def each(rows):
        held, cells, weight = None, [], 0  # the last text that was the next one, with its fingerprint
        for d, text, following, times in rows:
            own = held[1] if held and held[0] == text else winnow(text, c)
            other = own if following == text else winnow(following, c)
            held = (following, other)
            new = edited(text, following)
            changed = own if new == text else winnow(new, c)
            cells.append((d, len(text), hashlib.sha256(new.encode()).hexdigest(), told(*own), told(*changed), likeness(own[1], changed[1]), likeness(own[1], other[1]), times))
            weight += len(cells[-1][3]) + len(cells[-1][4]) + 200
            if weight > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*cells, strict=True), types, strict=True)], names=[*names, "times"])
                cells, weight = [], 0
        if cells:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*cells, strict=True), types, strict=True)], names=[*names, "times"])

    made = with_next(docs, each, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, times long")
    return made.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times", "_again")

"""Vector code compression: product codes of integer vectors, codebooks by Yinyang Lloyd.

A component x becomes the integer floor(scale * x). Vectors are cut into equal parts; each part
position has a codebook, fitted by Lloyd's rounds and exact in integers, so that no result hangs
on the order of sums. What Yinyang saves are distances: the entries of a codebook are dealt into
few groups, a vector keeps for each group one lower bound of its distance to the group's entries
other than its own, and the bounds sink by how far the entries have moved. Only groups whose bound
isn't safely above the distance to the own entry are looked at, and there integer distances decide,
ties included (the lower index wins).

A round is a narrow pass over a stored table that writes the next one (codes and bounds beside
the vectors), so a lost executor costs a part of one pass. To the driver go sums by part, entry
and component: parts * entries * width rows.

Defined cases: a vector that is null, empty, of a length that the parts don't divide, or with a
null or non-finite component (also one whose multiple by ``scale`` isn't finite) is dropped, and so
is one of another length than the first's, where lengths differ. The first ones are those of the
least ids, null ids last, ties by the vector itself; fewer vectors than entries give smaller
codebooks. Repeated rows stay, each with its code; null labels are one label. Integers of any size
are exact; an error that no long holds is null. An empty table gives no rows and the hash of an
empty text. Columns beside the three named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbora.llm.store import Scratch, numbered
from nimbora.sources.scratch import ship


@dataclass(frozen=True)
class Codes:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096
    groups: int = 4
    few_labels: int = 10_000  # sums of up to so many labels are broadcast
    salts: int = 64  # of each label where there are more


def integers(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of equally long vectors, as a matrix of whole doubles."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(scale * flat).reshape(len(column), -1) + 0.0  # no negative zero


def exact(values: np.ndarray, width: int, most: float) -> np.ndarray:
    """Whole doubles as 64-bit integers where squared distances of vectors of this width within
    ``most`` stay below 2**62, else as Python's integers."""
    if width * (2 * most) ** 2 < 2.0**62:
        return values.astype(np.int64)
    return np.array([int(v) for v in values.ravel().tolist()], object).reshape(values.shape)


def grouped(entries: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """A group number for each codebook entry: a small k-means from entries that lie far apart."""
    x = entries.astype(float)
    centers = x[:1]
    while len(centers) < min(groups, len(x)):
        away = ((x[:, None] - centers[None]) ** 2).sum(2).min(1)
        centers = np.concatenate([centers, x[[int(away.argmax())]]])
    at = np.zeros(len(x), int)
    for _ in range(rounds):
        at = ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)
        centers = np.array([x[at == g].mean(0) if (at == g).any() else c for g, c in enumerate(centers)])
    return at


@dataclass
class Book:
    """One codebook as integers, its entries' groups, and how far each group's furthest entry has moved."""

    entries: np.ndarray
    group: np.ndarray
    drift: np.ndarray

    def moved(self, entries: np.ndarray) -> Book:
        far = np.sqrt(((entries - self.entries) ** 2).sum(1).astype(float)) * (1 + 1e-9)
        return Book(entries, self.group, np.array([far[self.group == g].max(initial=0) for g in range(len(self.drift))]))


def _down(low: np.ndarray) -> np.ndarray:
    """Single precision, never above ``low``."""
    held = np.minimum(low, np.finfo(np.float32).max).astype(np.float32)
    return np.where(held > low, np.nextafter(held, np.float32(-np.inf)), held)


def assign(x: np.ndarray, book: Book, code: np.ndarray | None, low: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(codes, lower bounds by group, exact squared distances, entries looked at) of the rows of ``x``.

    ``code`` and ``low`` are what the round before returned for the entries before they moved;
    without them every group is looked at.
    """
    n, groups = len(x), len(book.drift)
    looked = 0
    if code is None:
        best, at, bound = None, np.zeros(n, np.int64), np.full((n, groups), -1.0)
    else:
        best, at = ((x - book.entries[code]) ** 2).sum(1), code.astype(np.int64)
        bound, looked = low.astype(float) - book.drift, n
    old, old_best = at.copy(), best
    nearest, first, second = (np.full((n, groups), -1, np.int64), np.zeros((n, groups)), np.full((n, groups), np.inf))
    for g in range(groups):
        members = np.flatnonzero(book.group == g)
        if not len(members):
            bound[:, g] = np.inf
            continue
        if best is None:
            rows = np.arange(n)
        else:
            rows = np.flatnonzero(~(bound[:, g] * (1 - 1e-9) > np.sqrt(best.astype(float)) * (1 + 1e-9)))
        if not len(rows):
            continue
        d = ((x[rows, None, :] - book.entries[None, members]) ** 2).sum(2)
        looked += d.size
        i = d.argmin(1)  # of equals the first, so the least index
        least = d[np.arange(len(rows)), i]
        roots = np.sqrt(d.astype(float))
        nearest[rows, g], first[rows, g] = members[i], roots[np.arange(len(rows)), i]
        roots[np.arange(len(rows)), i] = np.inf
        second[rows, g] = roots.min(1)
        if best is None:
            best, at = least.copy(), members[i].astype(np.int64)
        else:
            nearer = (least < best[rows]) | ((least == best[rows]) & (members[i] < at[rows]))
            best[rows[nearer]], at[rows[nearer]] = least[nearer], members[i][nearer]
    if best is None:
        best = np.zeros(n, np.int64)
    scanned = nearest >= 0
    own = scanned & (nearest == at[:, None])
    bound = np.where(own, second, np.where(scanned, first, bound))
    if old_best is not None:  # who left an entry must stay below it, where its group wasn't looked at
        left = np.flatnonzero(at != old)
        g = book.group[old[left]]
        apart = np.sqrt(((x[left] - book.entries[old[left]]) ** 2).sum(1).astype(float))
        bound[left, g] = np.where(scanned[left, g], bound[left, g], np.minimum(bound[left, g], apart))
    return at, _down(bound * (1 - 1e-9)), best, looked


def _parts(batch: pa.RecordBatch, parts: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(part, that part of the vectors, its width)."""
    column = batch.column("x")
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    width = x.shape[1] // parts
    for p in range(parts):
        yield p, x[:, p * width : (p + 1) * width], width


def _bytes(column: pa.Array, kind: type, shape: tuple) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(shape)


def advance(state: DataFrame, books: list[Book], most: float, started: bool, last: bool) -> DataFrame:
    """The next state: rows with code, bounds, and, in the last one, error and the entries looked at."""
    parts, groups = len(books), len(books[0].drift)

    def rows(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            codes, low = (_bytes(batch.column("code"), np.uint16, (n, parts)), _bytes(batch.column("low"), np.float32, (n, parts, groups))) if started else (None, None)
            new, bounds, error, looked = np.zeros((n, parts), np.uint16), np.zeros((n, parts, groups), np.float32), [0] * n, int(pc.sum(batch.column("looked")).as_py()) if started else 0
            for p, x, width in _parts(batch, parts):
                own = exact(x, width, most)
                at, down, best, seen = assign(own, books[p], codes[:, p] if started else None, low[:, p] if started else None)
                new[:, p], bounds[:, p], looked = at, down, looked + seen
                error = [e + int(b) for e, b in zip(error, best.tolist(), strict=True)] if last else error
            out = {"vec_id": batch.column("vec_id"), "label": batch.column("label"), "x": batch.column("x"), "code": pa.array([r.tobytes() for r in new], pa.binary()), "low": pa.array([r.tobytes() for r in bounds], pa.binary())}
            # Work is told once per batch, in its first row.
            out["looked"] = pa.array([looked] + [0] * (n - 1), pa.int64())
            if last:
                out["error"] = pa.array([e if e < 1 << 63 else None for e in error], pa.int64())
            yield pa.RecordBatch.from_pydict(out)

    kinds = {f.name: f.dataType.simpleString() for f in state.schema}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, x array<double>, code binary, low binary, looked long" + (", error long" if last else "")
    return state.mapInArrow(rows, schema)


#: Sums leave a task as high * LIMB + low, both decimals, so that none overflows.
LIMB = 10**30


def totals(state: DataFrame, parts: int, entries: int, most: float) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> (count, exact sums by component); summed in each task first."""

    def rows(batches):
        counts, sums = np.zeros((parts, entries), np.int64), {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            codes = _bytes(batch.column("code"), np.uint16, (n, parts))
            for p, x, width in _parts(batch, parts):
                own = exact(x, width, most)
                for e in np.unique(codes[:, p]).tolist():
                    mine = own[codes[:, p] == e]
                    counts[p, e] += len(mine)
                    now = [int(v) for v in mine.sum(0)]
                    had = sums.get((p, e))
                    sums[p, e] = now if had is None else [a + b for a, b in zip(had, now, strict=True)]
        cells = [(p, e, i, int(counts[p, e]), v) for (p, e), s in sums.items() for i, v in enumerate(s)]
        if cells:
            p, e, i, n, v = zip(*cells, strict=True)
            limb = lambda f: pa.array([Decimal(f(x)) for x in v], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "at": pa.array(i, pa.int32()), "n": pa.array(n, pa.int64()), "high": limb(lambda x: x // LIMB), "low": limb(lambda x: x % LIMB)})

    cells = state.select("x", "code").mapInArrow(rows, "part int, entry int, at int, n long, high decimal(38,0), low decimal(38,0)")
    found: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in cells.groupBy("part", "entry", "at").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]).orderBy("part", "entry", "at").collect():
        found.setdefault((r["part"], r["entry"]), (r["n"], []))[1].append(int(r["high"]) * LIMB + int(r["low"]))
    return found


def kept_vectors(frame: DataFrame, id_: str, vector: str, label: str, c: Codes) -> tuple[DataFrame, list[list[float]]]:
    """(vec_id, label, v as doubles) of usable vectors, and the first ones, by id."""
    names, plain = numbered(frame)
    spot = lambda n: F.col(names[frame.columns.index(n)])
    as_double = F.transform(spot(vector), lambda x: x.cast("double"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * F.lit(float(c.scale))) < F.lit(float("inf"))))
    rows = plain.select(spot(id_).alias("vec_id"), spot(label).alias("label"), as_double.alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % c.parts == 0) & ok)
    first = lambda r: [x["v"] for x in r.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(c.entries).collect()]
    seeds = first(rows)
    if seeds:
        rows = rows.filter(F.size("v") == len(seeds[0]))
        if len({len(s) for s in seeds}) > 1:
            seeds = first(rows)
    return rows, seeds


@dataclass
class Coded:
    """rows: vec_id, label, code (binary, two bytes a part), error, looked. books: parts x entries x
    width integers. looked: distances that were worked out, of ``most``."""

    rows: DataFrame
    books: list[list[list[int]]]
    c: Codes

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for b in self.books for e in b for v in e).encode()).hexdigest()


def encode_vectors(frame: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str = "label", c: Codes = Codes()) -> Coded:
    """Fit the codebooks on all vectors and give every vector its code."""
    spark = frame.sparkSession
    ship(spark)
    rows, seeds = kept_vectors(frame, id_, vector, label, c)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    if not seeds:
        return Coded(spark.createDataFrame([], f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, looked long, error long"), [], c)
    scale = c.scale

    def whole(batches):
        for batch in batches:
            x = integers(batch.column("v"), scale)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1] if len(x) else [0], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), values], names=["vec_id", "label", "x"])

    store = Scratch(spark, "codes")
    state = store.save("round0", rows.mapInArrow(whole, f"vec_id {kinds['vec_id']}, label {kinds['label']}, x array<double>"))
    most = float(state.agg(F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x"))))).first()[0])
    start = np.floor(scale * np.array(seeds, float))
    width = start.shape[1] // c.parts
    books = []
    for p in range(c.parts):
        entries = exact(start[:, p * width : (p + 1) * width], width, most)
        group = grouped(entries, c.groups)
        books.append(Book(entries, group, np.zeros(min(c.groups, len(entries)))))
    for r in range(1, c.rounds + 1):
        state = store.save(f"round{r}", advance(state, books, most, r > 1, False))
        store.drop(f"round{r - 1}")
        found = totals(state, c.parts, len(seeds), most)
        for p, book in enumerate(books):
            entries = book.entries.copy()
            for e in range(len(entries)):
                if (p, e) in found:
                    n, sums = found[p, e]
                    entries[e] = [s // n for s in sums]
            books[p] = book.moved(entries)
    coded = store.save("coded", advance(state, books, most, c.rounds > 0, True).drop("x", "low"))
    store.drop(f"round{c.rounds}")
    return Coded(coded, [[[int(v) for v in e] for e in b.entries] for b in books], c)


def with_label_errors(coded: Coded) -> DataFrame:
    """``rows`` with label_error: the errors of each label together. Sums are made before any
    exchange; where there are many labels, the rows of each are dealt over ``salts`` keys."""
    rows, c = coded.rows, coded.c
    total = F.expr("try_cast(sum(cast(error AS decimal(38,0))) AS long)")
    sums = rows.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "label_")
    same = F.col("label").eqNullSafe(F.col("label_"))
    if sums.limit(c.few_labels + 1).count() <= c.few_labels:
        return rows.join(F.broadcast(sums), same).drop("label_")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(c.salts)))
    spread = sums.withColumn("salt_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c.salts - 1).cast("long"))))
    return salted.join(spread, same & (F.col("salt") == F.col("salt_"))).drop("label_", "salt", "salt_")


def digest(coded: Coded) -> DataFrame:
    """vec_id, code in hexadecimal (two digits a part), error, label_error, codebooks_sha256."""
    digits = F.lower(F.hex("code"))  # little-endian 16-bit codes: the low byte comes first
    code = F.concat(*[F.substring(digits, 4 * p + 1, 2) for p in range(coded.c.parts)])
    return with_label_errors(coded).select("vec_id", code.alias("code"), "error", "label_error", F.lit(coded.sha256()).alias("codebooks_sha256"))

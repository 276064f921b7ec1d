"""All pairs of points and sums over them, without a single-task step.

Points are dealt into blocks; a task reduces the distances of a pair of blocks at once (sums by
label), so that pairs are rows only where all pairs are the result. What bounds can settle is in
``metric`` and ``distance_ranks``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nimbora.sources.scratch import Scratch, ship

#: Points of a block where there are few, blocks that are enough for tasks, most tasks.
BLOCK, MOST, TASKS = 1_000, 24, 1_024


def squared(a: Column, b: Column, dims: int) -> Column:
    """Sum of squared differences, spelled out so that it compiles."""
    out = F.lit(0.0)
    for i in range(dims):
        out = out + (a[i] - b[i]) * (a[i] - b[i])
    return out


def all_pairs(points: DataFrame, id_: str, vector: str, dims: int, ordered: bool = False, blocks: int = 0) -> DataFrame:
    """(a, b, d): Euclidean distances, for a < b, or for all a <> b if ``ordered``.

    All pairs are the result, so its size is what it is; blocks against blocks (as many as the
    number of points asks for) spread them evenly over blocks * blocks join keys.
    """
    blocks = blocks or max(8, -(-points.count() // BLOCK))
    block = F.pmod(F.xxhash64(id_), F.lit(blocks))
    left = points.select(F.col(id_).alias("a"), F.col(vector).alias("va"), (block * blocks).alias("row")).withColumn("key", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("key", F.col("row") + F.col("key")).drop("row")
    right = points.select(F.col(id_).alias("b"), F.col(vector).alias("vb"), block.alias("col")).withColumn("key", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("key", F.col("key") * blocks + F.col("col")).drop("col")
    met = left.join(right, "key").filter(F.col("a") != F.col("b") if ordered else F.col("a") < F.col("b"))
    return met.select("a", "b", F.sqrt(squared(F.col("va"), F.col("vb"), dims)).alias("d"))


def block_rows(dims: int, columns: int) -> int:
    """Most points of a block, so that its vectors and its sums by label take some ten MB each."""
    return max(256, min(32_768, (1 << 21) // max(1, dims), (1 << 22) // max(1, columns)))


def _packed(points: DataFrame, id_: str, vector: str, labels: str, blocks: int) -> DataFrame:
    """(block, ids, x, labels): a row per block; vectors as bytes, in single precision where that loses nothing."""
    kind = points.schema[id_].dataType.simpleString()
    rows = points.select(F.pmod(F.xxhash64(id_), F.lit(blocks)).cast("int").alias("block"), F.col(id_).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(labels).cast("array<int>").alias("labels"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        table = table.take(pc.sort_indices(table.column("id")))
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        short = v.astype(np.float32)
        data = short if (short == v).all() else v
        mark = table.column("labels").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column("id").combine_chunks())
        return pa.table({"block": table.column("block")[:1], "ids": ids, "x": pa.array([data.tobytes()], pa.binary()), "labels": pa.array([mark.tobytes()], pa.binary())})

    return rows.groupBy("block").applyInArrow(pack, f"block int, ids array<{kind}>, x binary, labels binary")


def _near(a: np.ndarray, b: np.ndarray, d: np.ndarray, scale: float) -> np.ndarray:
    """Squared distances ``d`` that came from products: those that cancellation may have spoilt are worked out by differences."""
    r, c = np.nonzero(d < 1e-7 * scale)
    for lo in range(0, len(r), 8_192):
        i, j = r[lo : lo + 8_192], c[lo : lo + 8_192]
        d[i, j] = ((a[i] - b[j]) ** 2).sum(1)
    return d


def _label_sums(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, use: list[list[int] | None], groups: list[int], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the distances of each point of ``a`` to those of ``b`` by label, and of ``b`` to ``a``; a column per group of each
    grouping. Distances come from products, once for all groupings; one left-out dimension is taken away from them."""
    dims, at = a.shape[1], np.concatenate([[0], np.cumsum(groups)])
    middle = a.mean(0)
    a, b = a - middle, b - middle
    norm_a, norm_b = (a * a).sum(1), (b * b).sum(1)
    scale = float(norm_a.max() + norm_b.max())
    marks = []
    for labels in (la, lb):
        one = np.zeros((len(labels), at[-1]))
        for i in range(len(groups)):
            rows = np.flatnonzero(labels[:, i] >= 0)
            one[rows, at[i] + labels[rows, i]] = 1
        marks.append(one)
    runs: list[tuple[list[int] | None, int, int]] = []  # groupings next to each other that use the same dimensions
    for i, some in enumerate(use):
        if runs and runs[-1][0] == some:
            runs[-1] = (some, runs[-1][1], int(at[i + 1]))
        else:
            runs.append((some, int(at[i]), int(at[i + 1])))
    across = np.ascontiguousarray(b.T)
    to_b, to_a = np.zeros((len(a), at[-1])), np.zeros((len(b), at[-1]))
    step = max(16, (1 << 17) // max(1, len(b)))  # about what a core's cache holds
    for lo in range(0, len(a), step):
        x, rows = a[lo : lo + step], slice(lo, lo + step)
        whole = norm_a[rows, None] + norm_b[None] - 2 * (x @ b.T)
        for some, left, right in runs:
            gone = sorted(set(range(dims)) - set(some)) if some is not None else []
            y, z = (x, b) if some is None else (x[:, some], b[:, some]) if len(gone) > 2 else (None, None)
            if len(gone) > 2:
                d = (y * y).sum(1)[:, None] + (z * z).sum(1)[None] - 2 * (y @ z.T)
            else:
                d = whole.copy()
                for j in gone:
                    off = x[:, j, None] - across[j][None]
                    d -= np.multiply(off, off, out=off)
            if d.min(initial=np.inf) < 1e-7 * scale:
                d = _near(*((y, z) if y is not None else (x[:, some], b[:, some])), d, scale)
            np.sqrt(np.maximum(d, 0, out=d), out=d)
            to_b[rows, left:right] = d @ marks[1][:, left:right]
            if not same:
                to_a[:, left:right] += d.T @ marks[0][rows, left:right]
    return to_b, to_a


def silhouettes(points: DataFrame, id_: str, vector: str, dims: int, use: list[list[int] | None], groups: list[int], means: bool = False) -> DataFrame:
    """(id, s): the silhouettes of each point by each entry of ``labels`` (numbers from 0 up to ``groups`` less one; below 0:
    no label), by the dimensions in ``use`` (none: all). 0 for a point alone in its group, without a label or with one group.
    With ``means`` (which, s, n) instead: sums over the points of a task.

    Blocks of points meet in pairs, each unordered one once; what leaves it is a matrix for each of its blocks, points by
    groups, and the matrices of a block meet in one task, so neither pairs nor sums by point are rows.
    """
    spark, total = points.sparkSession, sum(groups)
    ship(spark)
    store = Scratch(spark, "silhouettes")
    n = points.count()
    blocks = max(-(-n // block_rows(dims, total)), min(MOST, -(-n // BLOCK)), 1)
    packed = store.save("blocks", _packed(points, id_, vector, "labels", blocks))
    kind, many = points.schema[id_].dataType.simpleString(), len(use)
    sizes = np.zeros(total)
    at = np.concatenate([[0], np.cumsum(groups)])
    marks = points.select(F.posexplode("labels").alias("which", "label")).filter("label >= 0").groupBy("which", "label").agg(F.count("*").alias("n")).collect()  # a row per grouping and group
    for r in marks:
        sizes[at[r["which"]] + r["label"]] = r["n"]

    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda j: F.struct(F.least(F.col("block"), j).alias("i"), F.greatest(F.col("block"), j).alias("j"))))
    tasks = min(blocks * (blocks + 1) // 2, TASKS)
    met = packed.select(pairs.alias("p"), "block", "x", "labels").select("p.*", "block", "x", "labels").repartition(tasks, "i", "j").sortWithinPartitions("i", "j", "block")

    def wide(row_x, row_l):
        mark = np.frombuffer(row_l.as_py(), np.int32).reshape(-1, many)
        raw = row_x.as_py()
        x = np.frombuffer(raw, np.float32 if len(raw) == 4 * dims * len(mark) else np.float64).reshape(-1, dims)
        return x.astype(float), mark

    def meet(batches):
        first = None
        for batch in batches:
            for r in range(batch.num_rows):
                i, j, block = (batch.column(c)[r].as_py() for c in ("i", "j", "block"))
                one = wide(batch.column("x")[r], batch.column("labels")[r])
                if i < j and (first is None or first[0] != (i, j)):
                    first = ((i, j), *one)
                    continue
                a, la = one if i == j else first[1:]
                out = _label_sums(a, la, *one, use, groups, i == j)
                for name, sums in ((i, out[0]), (j, out[1]))[: 1 if i == j else 2]:
                    yield pa.RecordBatch.from_pydict({"block": pa.array([name], pa.int32()), "sums": pa.array([sums.tobytes()], pa.binary())})
                first = None

    sums = met.mapInArrow(meet, "block int, sums binary").select("block", "sums", F.lit(None).cast(f"array<{kind}>").alias("ids"), F.lit(None).cast("binary").alias("labels"))
    heads = packed.select("block", F.lit(None).cast("binary").alias("sums"), "ids", "labels")
    rows = heads.unionByName(sums).repartition(min(blocks, TASKS), "block").sortWithinPartitions("block", F.col("ids").isNull())

    def told(ids, mark, held):
        out = np.zeros(mark.shape)
        for g in range(many):
            n, s, own = sizes[at[g] : at[g + 1]], held[:, at[g] : at[g + 1]], mark[:, g]
            each = np.arange(len(own))
            safe = np.maximum(own, 0)
            within = s[each, safe] / np.maximum(n[safe] - 1, 1)
            mean = np.where(n > 0, s / np.maximum(n, 1), np.inf)
            mean[each, safe] = np.inf
            beside = mean.min(1, initial=np.inf)
            ok = (own >= 0) & (n[safe] > 1) & np.isfinite(beside)
            most = np.maximum(within, np.where(ok, beside, 0))
            out[:, g] = np.where(ok & (most > 0), (np.where(ok, beside, 0) - within) / np.where(most > 0, most, 1), 0)
        if means:
            return pa.RecordBatch.from_arrays([pa.array(np.arange(many, dtype=np.int32)), pa.array(out.sum(0)), pa.array(np.full(many, len(out), np.int64))], names=["which", "s", "n"])
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * many), pa.array(out.ravel()))], names=["id", "s"])

    def close(batches):
        ids, mark, held = None, None, None
        for batch in batches:
            for r in range(batch.num_rows):
                if batch.column("ids")[r].is_valid:  # a block's points, before its sums
                    if ids is not None:
                        yield told(ids, mark, held)
                    ids = batch.column("ids").slice(r, 1).flatten()
                    mark, held = np.frombuffer(batch.column("labels")[r].as_py(), np.int32).reshape(-1, many), np.zeros((len(ids), total))
                    continue
                held += np.frombuffer(batch.column("sums")[r].as_py()).reshape(-1, total)
        if ids is not None:
            yield told(ids, mark, held)

    return rows.mapInArrow(close, "which int, s double, n long" if means else f"id {kind}, s array<double>")


def silhouette_means(points: DataFrame, id_: str, vector: str, dims: int, use: list[list[int] | None], groups: list[int]) -> list[float]:
    """Mean silhouette of each entry of ``labels``, as in ``silhouettes``."""
    one = silhouettes(points, id_, vector, dims, use, groups, means=True).groupBy("which").agg((F.sum("s") / F.sum("n")).alias("m"))
    found = {r["which"]: r["m"] for r in one.collect()}  # a row per grouping
    return [float(found.get(i, 0.0)) for i in range(len(use))]


def global_rank(rows: DataFrame, by: str, name: str = "below") -> DataFrame:
    """``rows`` with the number of rows whose ``by`` is strictly smaller.

    Range partitions hold equal values together; ranks within plus sizes of the partitions
    before give ranks of all, so no task sorts everything.
    """
    spread = Scratch(rows.sparkSession, "rank").save("spread", rows.repartitionByRange(F.col(by)).withColumn("_part", F.spark_partition_id()))
    sizes = spread.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()  # a row per partition
    before, total = [], 0
    for r in sizes:
        before.append((r["_part"], total))
        total += r["n"]
    offsets = rows.sparkSession.createDataFrame(before, "_part int, _before long")
    inside = F.rank().over(Window.partitionBy("_part").orderBy(by)) - 1
    met = spread.withColumn(name, inside.cast("long")).join(F.broadcast(offsets), "_part")
    return met.withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def similarity(pairs: DataFrame) -> DataFrame:
    """(a, b, d, similarity_pct): the share of pairs at least as far apart."""
    ranked = global_rank(pairs, "d")
    total = ranked.agg(F.count("*").alias("total"))
    met = ranked.crossJoin(F.broadcast(total))  # the right side is one row
    return met.select("a", "b", "d", (100 * (1 - F.col("below") / F.col("total"))).alias("similarity_pct"))

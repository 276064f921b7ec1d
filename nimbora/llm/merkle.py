"""Merkle manifest of a table: a radix-ranked trie of row hashes, by group.

A row is a leaf: the SHA-256 of its fields. The leaves of a group stand in the order of their key;
a node is the hash of ``fanout`` consecutive nodes, and the groups' roots, in the order of the
groups, make the table's root in the same way.

* **Ranks.** Nothing is sorted as a whole. Rows are counted by key >> 8, these counts by 14 more
  bits of the key each, up to the group; a row's rank is what smaller siblings hold on every level
  of this hierarchy, plus its place among the rows of its own 256 keys. Buckets that repeated keys
  make crowded go on by the digits of the leaf hashes, so one hot key (or a null one) spreads.
* **Nodes.** The digits of a rank to the base ``fanout`` are a node's key in the trie. Rows that
  share all but the last digits (up to 256 leaves) meet in one task, which reduces them from the
  longest prefix to a shorter one; their common prefix is the leaf of the next pass.
* **Proofs.** On the way back each pass gives its members the siblings of its levels in front of
  what their node got from above.

Every pass is written to the shared folder; a pass has a 256th of the rows of that before. What
goes to the driver is the root, the number of rows, and the crowded buckets (at most 10,000).

Defined cases: a null key comes first and is never tampered with; a null group is a group and the
first one; rows with one key stand in the order of their leaves; equal rows are leaves each, and
which of two equal rows has which place can't be told. Empty texts are values of no bytes. An
empty table has no rows and no root. Columns that are not fields are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nimbora.llm.store import Scratch, take
from nimbora.operators.ranks import grouped_ranks
from nimbora.sources.scratch import ship

#: Bits of a key below its bucket, and bits of each level of counts above.
LOW, DIGIT = 8, 14
#: Bucket of rows without a key: below that of any long.
NO_KEY = -(1 << 60)


@dataclass(frozen=True)
class Tree:
    fanout: int = 2
    chunk: int = 256  # most leaves that one task reduces at once, as a power of ``fanout`` below it
    crowd: int = 65_536  # rows of a bucket beyond which it is split by leaf hashes; or a 10,000th of all rows
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")
    key: str = "doc_id"
    group: str = "lang"
    #: Tampering: where 7 divides the CRC of the decimal key, this field grows by 1.
    tampered: str = "n_chars"
    every: int = 7

    @property
    def depth(self) -> int:
        d = 1
        while self.fanout ** (d + 1) <= self.chunk:
            d += 1
        return d


def leaf_hash(fields: list[Column]) -> Column:
    """SHA-256 of '-' for each null and 'bytes:value' for each other field, as 32 bytes."""
    one = lambda s: F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[one(f.cast("string")) for f in fields]).cast("binary"), 256))


def leaves(docs: DataFrame, c: Tree) -> DataFrame:
    """(g, id, leaf, altered, copies): a row per different row of ``docs``. ``g`` is the group as a
    text that orders null first; ``altered`` is the leaf after tampering, null where nothing changes."""
    rows = take(docs, *c.fields)
    grown = [(F.col(f).cast("decimal(20,0)") + 1) if f == c.tampered else F.col(f) for f in c.fields]
    hit = (F.crc32(F.col(c.key).cast("string").cast("binary")) % c.every == 0) & F.col(c.tampered).isNotNull()
    g = F.coalesce(F.concat(F.lit("1"), F.col(c.group)), F.lit("0"))
    slim = rows.select(g.alias("g"), F.col(c.key).alias("id"), leaf_hash([F.col(f) for f in c.fields]).alias("leaf"), F.when(hit, leaf_hash(grown)).alias("altered"))
    return slim.groupBy("g", "id", "leaf", "altered").agg(F.count("*").alias("copies"))


def before(counts: DataFrame, group: list[str], key: str, levels: int) -> DataFrame:
    """``counts`` (group, key, n) with ``before``: how many rows of the group have a smaller key. Sums
    of siblings on each level of key >> DIGIT, so no window holds more than 2**DIGIT rows."""
    inside = lambda w: F.coalesce(F.sum("n").over(w.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if levels <= 1:
        return counts.withColumn("before", inside(Window.partitionBy(*group)))
    up = f"_up{levels}"
    own = counts.withColumn(up, F.shiftright(key, DIGIT))
    upper = before(own.groupBy(*group, up).agg(F.sum("n").alias("n")), group, up, levels - 1)
    met = own.withColumn("_in", inside(Window.partitionBy(*group, up))).join(upper.select(*group, up, F.col("before").alias("_before")), [*group, up])
    return met.withColumn("before", F.col("_in") + F.col("_before")).drop(up, "_in", "_before")


def ranked(rows: DataFrame, store: Scratch, c: Tree) -> DataFrame:
    """(g, rank, size, id, leaf, altered): each row's place among its group's, by id and leaf, from 0."""
    b = F.coalesce(F.shiftright("id", LOW).cast("long"), F.lit(NO_KEY))
    rows = store.save("rows", rows.withColumn("b", b))
    counts = store.save("counts", rows.groupBy("g", "b").agg(F.sum("copies").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    crowded = counts.filter(F.col("n") > max(c.crowd, total // 10_000)).select("g", "b").collect()  # at most 10,000
    rows = rows.withColumn("d", F.lit(0).cast("long"))
    if crowded:
        mark = rows.sparkSession.createDataFrame(crowded, "g string, b long").withColumn("_hit", F.lit(True))
        digits = F.shiftleft(F.coalesce(F.col("id").bitwiseAND((1 << LOW) - 1), F.lit(0)).cast("long"), 20) + F.conv(F.substring(F.hex("leaf"), 1, 5), 16, 10).cast("long")
        rows = rows.join(F.broadcast(mark), ["g", "b"], "left").withColumn("d", F.when(F.col("_hit"), digits).otherwise(F.col("d"))).drop("_hit")
    levels = -(-(64 - LOW) // DIGIT)
    buckets = before(counts, ["g"], "b", levels)
    sizes = counts.groupBy("g").agg(F.sum("n").alias("size"))
    buckets = buckets.join(sizes, "g")
    if crowded:  # and what the bucket's smaller digits hold
        cells = before(store.save("cells", rows.groupBy("g", "b", "d").agg(F.sum("copies").alias("n"))), ["g", "b"], "d", 2)
        buckets = cells.select("g", "b", "d", F.col("before").alias("_inner")).join(buckets.select("g", "b", "before", "size"), ["g", "b"])
        buckets = buckets.select("g", "b", "d", (F.col("before") + F.col("_inner")).alias("before"), "size")
    else:
        buckets = buckets.select("g", "b", F.lit(0).cast("long").alias("d"), "before", "size")
    w = Window.partitionBy("g", "b", "d").orderBy(F.col("id").asc_nulls_first(), "leaf").rowsBetween(Window.unboundedPreceding, -1)
    met = rows.withColumn("_in", F.coalesce(F.sum("copies").over(w), F.lit(0))).join(buckets, ["g", "b", "d"])
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    return met.select("g", "size", "id", "leaf", "altered", (F.col("before") + F.col("_in")).alias("first"), at).select("g", (F.col("first") + F.col("copy")).alias("rank"), "size", "id", "leaf", "altered")


def _hash(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def levels_of(nodes: list[str], size: int, fanout: int, depth: int) -> list[list[str]]:
    """The nodes of an aligned run of a level that has ``size`` nodes, and of up to ``depth`` levels
    above, as long as a level of the whole tree has several."""
    out = [nodes]
    while len(out) <= depth and size > 1:
        nodes, size = [_hash(nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)], -(-size // fanout)
        out.append(nodes)
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, dict]]:
    """(g, chunk, size, columns) of each chunk of rows that come sorted by these; chunks are small."""
    key, held = None, []
    join = lambda held: pa.Table.from_batches(held).to_pydict()
    for batch in batches:
        at = list(zip(batch.column("g").to_pylist(), batch.column("chunk").to_pylist(), strict=True))
        lo = 0
        while lo < len(at):
            hi = lo + 1
            while hi < len(at) and at[hi] == at[lo]:
                hi += 1
            if at[lo] != key:
                if held:
                    yield *key, held[0].column("size")[0].as_py(), join(held)
                key, held = at[lo], []
            held.append(batch.slice(lo, hi - lo))
            lo = hi
    if held:
        yield *key, held[0].column("size")[0].as_py(), join(held)


def climb(rows: DataFrame, store: Scratch, name: str, c: Tree) -> tuple[list[DataFrame], DataFrame]:
    """Passes from the leaves up, and (g, root). A pass is a table (g, chunk, size, ids, leaves,
    altered, top, last) of a row per chunk; ``last``: its top is the group's root."""
    fanout, depth, width = c.fanout, c.depth, c.fanout**c.depth
    kind = rows.schema["id"].dataType.simpleString()

    def reduce(batches):
        for g, chunk, size, part in _runs(batches):
            top = levels_of([x.hex() for x in part["leaf"]], size, fanout, depth)[-1][0]
            yield pa.RecordBatch.from_pydict({
                "g": [g], "chunk": [chunk], "size": [size], "ids": pa.array([part["id"]], pa.list_(pa.string() if kind == "string" else pa.int64())), "leaves": [b"".join(part["leaf"])],
                "altered": pa.array([part["altered"]], pa.list_(pa.binary())), "top": [bytes.fromhex(top)], "last": [size <= width],
            })

    passes, roots = [], None
    while True:
        met = rows.withColumn("chunk", F.expr(f"rank div {width}")).repartition("g", "chunk").sortWithinPartitions("g", "chunk", "rank")
        wide = "string" if kind == "string" else "bigint"
        made = store.save(f"{name}{len(passes)}", met.mapInArrow(reduce, f"g string, chunk long, size long, ids array<{wide}>, leaves binary, altered array<binary>, top binary, last boolean"))
        passes.append(made)
        done = made.filter("last").select("g", F.col("top").alias("root"))
        roots = done if roots is None else roots.unionByName(done)
        if not made.filter("not last").limit(1).count():
            return passes, roots
        rows = made.filter("not last").select("g", F.col("chunk").alias("rank"), F.expr(f"(size + {width - 1}) div {width}").alias("size"), F.lit(None).cast(kind).alias("id"), F.col("top").alias("leaf"), F.lit(None).cast("binary").alias("altered"))


def descend(passes: list[DataFrame], above: DataFrame, c: Tree, more: str = "subroot") -> DataFrame:
    """(g, id, leaf, altered, spots, others, ``more``) of each leaf: on each level its place in its run,
    and the run's other nodes, left to right. ``above``: (g, spots, others, ``more``) of each root."""
    fanout, depth, width = c.fanout, c.depth, c.fanout**c.depth

    def members(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                raw = row["leaves"]
                nodes = [raw[i : i + 32].hex() for i in range(0, len(raw), 32)]
                levels = levels_of(nodes, row["size"], fanout, depth)[:-1] if row["size"] > 1 else []
                spots, others = [], []
                for i in range(len(nodes)):
                    at, mine, them = i, [], []
                    for level in levels:
                        lo = at - at % fanout
                        mine.append(at - lo)
                        them.append("".join(level[lo:at] + level[at + 1 : lo + fanout]))
                        at //= fanout
                    spots.append(mine + row["spots"])
                    others.append(them + row["others"])
                n = len(nodes)
                yield pa.RecordBatch.from_pydict({
                    "g": [row["g"]] * n, "chunk": [row["chunk"] * width + i for i in range(n)], "id": pa.array(row["ids"], batch.schema.field("ids").type.value_type), "leaf": nodes,
                    "altered": pa.array([x and x.hex() for x in row["altered"]], pa.string()), "spots": pa.array(spots, pa.list_(pa.int32())), "others": pa.array(others, pa.list_(pa.string())), more: [row[more]] * n,
                })

    paths = None
    for made in reversed(passes):
        start = made.filter("last").select("g", "chunk").join(above, "g")
        paths = start if paths is None else paths.select(start.columns).unionByName(start)
        kind = made.schema["ids"].dataType.elementType.simpleString()
        met = made.drop("top", "last").join(paths, ["g", "chunk"])
        paths = met.mapInArrow(members, f"g string, chunk long, id {kind}, leaf string, altered string, spots array<int>, others array<string>, {more} string")
    return paths.drop("chunk")


@dataclass
class Manifest:
    """rows: (g, id, leaf, altered, spots, others, subroot) of each row; root: null of an empty table."""

    rows: DataFrame
    root: str | None


def manifest(docs: DataFrame, c: Tree = Tree()) -> Manifest:
    spark = docs.sparkSession
    ship(spark)
    store = Scratch(spark, "merkle")
    passes, roots = climb(ranked(leaves(docs, c), store, c), store, "pass", c)
    groups = grouped_ranks(roots.select(F.lit(0).alias("all"), F.col("g").alias("name")), "all", "name")
    tops = groups.join(roots.withColumnRenamed("g", "name"), "name").select(F.lit("").alias("g"), F.col("before").alias("rank"), F.col("total").alias("size"), F.col("name").alias("id"), F.col("root").alias("leaf"), F.lit(None).cast("binary").alias("altered"))
    above, top = climb(tops, store, "groups", c)
    found = top.first()
    start = spark.createDataFrame([("", [], [], "")], "g string, spots array<int>, others array<string>, subroot string")
    each = descend(above, start, c).select(F.col("id").alias("g"), "spots", "others", F.col("leaf").alias("subroot"))
    return Manifest(descend(passes, each, c), found["root"].hex() if found else None)


def folded(leaf: Column, spots: Column, others: Column) -> Column:
    """The root that a leaf and its siblings give."""
    step = lambda h, x: F.sha2(F.concat(F.substr(x["others"], F.lit(1), 64 * x["spots"]), h, F.substr(x["others"], 64 * x["spots"] + 1)).cast("binary"), 256)
    return F.aggregate(F.arrays_zip(spots.alias("spots"), others.alias("others")), leaf, step)


def digest(made: Manifest, c: Tree = Tree()) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (of the tampered leaf where there is one), verified."""
    root = F.lit(made.root).cast("string")
    fold = folded(F.coalesce("altered", "leaf"), F.col("spots"), F.col("others"))
    rows = made.rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", root.alias("root"), F.sha2(F.array_join("others", "").cast("binary"), 256).alias("proof_sha256"), fold.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))

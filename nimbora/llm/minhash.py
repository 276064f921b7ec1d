"""Near-duplicate groups: minhash bands, sketch and exact verification, star contraction.

Plan. One pass over the texts writes, per document, the size and a 128-bit
fingerprint of its shingle set, a 128-bit sketch and its band hashes. Documents of
one fingerprint form a class, of which only the smallest doc_id goes on. Members of
a band's bucket are compared with the bucket's most central member, never pair by pair.
What such stars leave in other components meets the rest of its bucket by what both
differ in from one hub document: two documents that link share a known number of these
items, so one of the rarest of either's is common. No pair that shares a bucket is lost
by it, and every link is confirmed on full sets. No step brings a
bucket, class or component into one task: buckets and classes are joined by
sort-merge joins, which adaptive execution splits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbora.llm import words as W
from nimbora.llm.store import Scratch, arrow_batches, numbered, take


@dataclass(frozen=True)
class Near:
    """``bands`` x ``rows`` minima: a pair at the limit of 80 % misses all bands with
    probability (1 - 0.8**5)**40 = 1.2e-7. Sketches of 128 bits agree there in 115 bits
    on average (standard deviation 3.4); pairs under ``min_agree`` go unverified."""

    shingle: int = 2
    percent: int = 80
    bands: int = 40
    rows: int = 5
    min_agree: int = 96
    seed: int = 7
    #: Ids up to which the filter of documents is broadcast (8 MB of ids).
    broadcast_ids: int = 1_000_000
    #: Bounds of the classes of weight (see ``straggling``), in sizes of the hub times 100 - percent.
    classes: tuple[float, ...] = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0)


SIGNED = "doc_id long, n long, fp_a long, fp_b long, sk_a long, sk_b long, bands array<long>"


def _sets(data: np.ndarray, bounds: np.ndarray, width: int):
    """Sorted distinct shingle hashes of each text, in one array, with the bounds of each."""
    words = W.find_words(data, bounds, lower=True)
    at, hashes = W.windows(words, width)
    text = words.text_of()[at]
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = W.run_hashes(words.hash, words.first[short], words.first[short + 1], 0xA0761D6478BD642F)
        text, hashes = np.concatenate([text, short]), np.concatenate([hashes, whole])
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    text, hashes = text[new], hashes[new]
    return hashes, np.searchsorted(text, np.arange(len(bounds)))


def _sum_runs(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def fingerprints(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    sizes = np.diff(first).astype(np.uint64)
    return tuple(W.mix(_sum_runs(W.mix(hashes ^ np.uint64(salt)), first) + sizes) for salt in (0x51ED270B, 0xB5297A4D3F84D5B5))


def sign(near: Near):
    """Arrow function from (doc_id, text) to SIGNED."""
    rng = np.random.default_rng(near.seed)
    k = near.bands * near.rows
    mul = rng.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32)

    def rows(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, bounds in W.slices(batch.column(1)):
                hashes, first = _sets(data, bounds, near.shingle)
                sizes = np.diff(first)
                some = np.flatnonzero(sizes)
                fp_a, fp_b = fingerprints(hashes, first)
                low = (hashes >> np.uint64(32)).astype(np.uint32)
                least = np.zeros((len(sizes), k), np.uint32)
                if len(some):
                    starts = first[:-1][some]
                    for j in range(k):
                        least[some, j] = np.minimum.reduceat(low * mul[j] + add[j], starts)
                salted = (least.astype(np.uint64) + (np.arange(k, dtype=np.uint64) << np.uint64(32))).reshape(-1)
                mixed = W.mix(salted).reshape(-1, k)
                bits = np.packbits((mixed[:, :128] & np.uint64(1)).astype(np.uint8), axis=1).copy().view(np.uint64)
                bands = W.mix(mixed.reshape(-1, near.bands, near.rows).sum(2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(near.bands, dtype=np.uint64))
                bands = bands[some].reshape(-1)
                offsets = np.zeros(len(sizes) + 1, np.int32)
                np.cumsum((sizes > 0) * near.bands, out=offsets[1:])
                empty = sizes == 0
                opt = lambda x: pa.array(x.view(np.int64), mask=empty)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [ids[lo:hi], W.as_long(sizes), opt(fp_a), opt(fp_b), opt(np.ascontiguousarray(bits[:, 0])), opt(np.ascontiguousarray(bits[:, 1])), pa.ListArray.from_arrays(pa.array(offsets), W.as_long(bands))],
                    names=["doc_id", "n", "fp_a", "fp_b", "sk_a", "sk_b", "bands"],
                )

    return rows


def shingle_sets(near: Near):
    """Arrow function from (doc_id, text) to (fp_a, fp_b, items): the full sets and their fingerprints."""

    def rows(batches):
        for batch in batches:
            for _, _, data, bounds in W.slices(batch.column(1)):
                hashes, first = _sets(data, bounds, near.shingle)
                fp_a, fp_b = fingerprints(hashes, first)
                yield pa.RecordBatch.from_arrays([W.as_long(fp_a), W.as_long(fp_b), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), W.as_long(hashes))], names=["fp_a", "fp_b", "items"])

    return rows


def _stars(store: Scratch, edges: DataFrame, label: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that isn't its component's smallest:
    large-star and small-star in turn, each a minimum per node and a join, until nothing moves."""

    def large(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        return both.join(least, both["a"] == least["u"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    def small(e: DataFrame) -> DataFrame:
        least = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        moved = e.join(least, e["a"] == least["u"]).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()

    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    now = store.save(f"{label}0", edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = state(now)
    if not before[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for i in range(1, rounds):
        after = store.save(f"{label}{i}", small(large(now)))
        store.drop(f"{label}{i - 1}")
        now, found = after, state(after)
        if found == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = found
    raise RuntimeError("components did not settle")


def straggling(store: Scratch, deltas: DataFrame, near: Near) -> DataFrame:
    """Pairs (a, b, ca, cb) of ``deltas`` that link, at least one of them of another component
    than the hub's, found by the items in which both differ from their hub.

    ``deltas``: hub, id, comp, main, n (size), ref (the hub's size), items (the difference),
    weight = (100 + p) * |items| - (100 - p) * n. As J >= p % is (100 + p) * |difference| <=
    (100 - p) * (sum of sizes), two documents link if their differences share at least
    (sum of weights) / (2 * (100 + p)) items. With items in one order, rarest first, the first
    that both share lies in a prefix of either. Prefixes are cut by the least weight of the
    other's class, and a pair goes on only if enough items are left behind the shared one.
    Items that one document of a hub alone has come first and meet nothing; they aren't even joined.
    """
    p, q = near.percent, 100 - near.percent
    edges = F.array(*[F.lit(float(c)) for c in near.classes])
    unit = q * F.col("ref")
    other = F.col("comp") != F.col("main")
    table = deltas.select("hub", "id", "comp", "n", "ref", "weight", "items", other.alias("other"), F.size(F.filter(edges, lambda c: F.col("weight") >= c * unit)).alias("cls"))
    found = table.groupBy("hub").agg(F.collect_set("cls").alias("any_cls"), F.collect_set(F.when(F.col("other"), F.col("cls"))).alias("other_cls")).filter("size(other_cls) > 0")
    table = store.save("table", table.join(found, "hub"))
    each = table.select("hub", "id", F.explode("items").alias("item"))
    often = each.groupBy("hub", "item").agg(F.count("*").alias("times")).filter("times > 1")
    shared = each.join(often, ["hub", "item"]).groupBy("hub", "id").agg(F.sort_array(F.collect_list(F.struct("times", "item"))).alias("shared"))
    # No weight is below -unit, so that is the least of the first class.
    low = F.when(F.col("partner") == 0, -unit).otherwise(F.element_at(edges, F.greatest("partner", F.lit(1))) * unit)
    need = F.greatest(F.lit(1), F.ceil((F.col("weight") + low) / (2 * (100 + p))))
    alone = F.size("items") - F.size("shared")
    posts = table.join(shared, ["hub", "id"]).withColumn("partner", F.explode(F.when(F.col("other"), F.col("any_cls")).otherwise(F.col("other_cls"))))
    posts = posts.withColumn("alone", alone).withColumn("reach", F.size("items") - need + 1 - F.col("alone")).filter("reach > 0")
    posts = posts.select("hub", "id", "comp", "other", "weight", "cls", "partner", F.size("items").alias("size"), "alone", F.posexplode(F.slice("shared", F.lit(1), F.col("reach").cast("int"))).alias("at", "entry"))
    # What stays of the document's items from this one on.
    posts = posts.select("hub", F.col("entry.item").alias("item"), "cls", "partner", "id", "comp", "other", "weight", (F.col("size") - F.col("alone") - F.col("at")).alias("rest"))
    posts = store.save("posts", posts)
    x = posts.filter("other").select("hub", "item", F.col("cls").alias("c1"), F.col("partner").alias("c2"), F.col("id").alias("a"), F.col("comp").alias("ca"), F.col("weight").alias("wa"), F.col("rest").alias("ra"))
    y = posts.select("hub", "item", F.col("partner").alias("c1"), F.col("cls").alias("c2"), F.col("id").alias("b"), F.col("comp").alias("cb"), F.col("weight").alias("wb"), F.col("rest").alias("rb"), "other")
    able = (F.col("ca") != F.col("cb")) & (~F.col("other") | (F.col("a") < F.col("b"))) & (2 * (100 + p) * F.least("ra", "rb") >= F.col("wa") + F.col("wb"))
    pairs = x.join(y, ["hub", "item", "c1", "c2"]).filter(able).select("hub", "a", "b", "ca", "cb").distinct()
    mine, his = (table.select("hub", F.col("id").alias(i), F.col("n").alias(f"n{i}"), F.col("items").alias(f"items_{i}")) for i in "ab")
    met = pairs.join(mine, ["hub", "a"]).join(his, ["hub", "b"])
    apart = F.size("items_a") + F.size("items_b") - 2 * F.size(F.array_intersect("items_a", "items_b"))
    return met.filter((100 + p) * apart <= q * (F.col("na") + F.col("nb"))).select("a", "b", "ca", "cb")


def near_duplicates(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Reads ``doc_id`` (integer) and ``text``; other columns don't matter, whatever their names.
    A null or empty text has an empty set: linked with nothing, its own component, kept. A null
    doc_id is linked with nothing; its component is null and it is kept. Rows that repeat a
    doc_id are one document with several texts: they share their component, and a link of any
    of the texts counts. Ties do not arise: a component is named by its smallest doc_id. Very
    long texts are taken whole. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    store = Scratch(spark, "minhash")
    plain = take(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = store.save("signed", plain.mapInArrow(sign(near), SIGNED))
    full = signed.filter("n > 0 and doc_id is not null")
    # A class holds all rows of one set and is known by its smallest doc_id. Where one doc_id
    # has several texts, its further classes get numbers beyond all ids, written with the table.
    found = full.groupBy("fp_a", "fp_b").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sk_a").alias("sk_a"), F.first("sk_b").alias("sk_b"), F.first("bands").alias("bands"))
    classes = store.save("found", found.withColumn("low", F.col("rep")))
    both = classes.groupBy("low").agg(F.count("*").alias("k"), F.min(F.struct("fp_a", "fp_b")).alias("one")).filter("k > 1").select("low", "one")
    if both.limit(1).count():
        further = F.col("one").isNotNull() & (F.struct("fp_a", "fp_b") != F.col("one"))
        classes = classes.join(both, "low", "left").withColumn("rep", F.when(further, F.lit(1 << 62) + F.monotonically_increasing_id()).otherwise(F.col("low"))).drop("one")
        classes = store.save("classes", classes)
    rep = classes.select("rep", "n", "sk_a", "sk_b")

    # Buckets of two or more. Its center is the member that meets most others in all its buckets.
    rows = classes.select(F.explode("bands").alias("key"), "rep")
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = store.save("members", rows.join(sizes, "key"))
    central = store.save("central", members.groupBy("rep").agg(F.sum("size").alias("central")))
    most = lambda x: F.max_by(x, F.struct(F.col("central"), -F.col(x)))
    centers = members.join(central, "rep").groupBy("key").agg(most("rep").alias("center"))
    pairs = members.join(centers, "key").filter("rep <> center")

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of about equal size whose sketches agree enough."""
        a, b = (rep.select(*[F.col(c).alias(f"{c}_{s}") for c in rep.columns]) for s in "ab")
        met = pairs.join(a, F.col("a") == F.col("rep_a")).join(b, F.col("b") == F.col("rep_b"))
        agree = 128 - F.bit_count(F.col("sk_a_a").bitwiseXOR(F.col("sk_a_b"))) - F.bit_count(F.col("sk_b_a").bitwiseXOR(F.col("sk_b_b")))
        return met.filter((100 * F.least("n_a", "n_b") >= near.percent * F.greatest("n_a", "n_b")) & (agree >= near.min_agree)).select("a", "b")

    def sets_of(pairs: DataFrame, name: str) -> DataFrame:
        """(rep, items) of the classes in ``pairs``, from one document of each."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("r")).distinct().join(classes.select("rep", "low", "fp_a", "fp_b"), F.col("r") == F.col("rep")).drop("r")
        wanted = store.save(f"{name}_ids", wanted)
        ids = wanted.select(F.col("low").alias("wanted_id")).distinct()
        if wanted.count() <= near.broadcast_ids:
            ids = F.broadcast(ids)
        met = plain.join(ids, plain["doc_id"] == ids["wanted_id"], "left_semi").mapInArrow(shingle_sets(near), "fp_a long, fp_b long, items array<long>")
        # Rows that repeat a doc_id may hold several sets, or one several times.
        return store.save(name, met.join(wanted.select("rep", "fp_a", "fp_b"), ["fp_a", "fp_b"]).groupBy("rep").agg(F.first("items").alias("items")))

    def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        a, b = (sets.select(F.col("rep").alias(s + "_id"), F.col("items").alias(s + "_items")) for s in "ab")
        met = pairs.join(a, F.col("a") == F.col("a_id")).join(b, F.col("b") == F.col("b_id"))
        both = F.size(F.array_intersect("a_items", "b_items"))
        return met.filter(100 * both >= near.percent * (F.size("a_items") + F.size("b_items") - both)).select(*pairs.columns)

    # Stars: each member with the centers of its buckets, its least one first.
    star = pairs.groupBy(F.col("rep").alias("a"), F.col("center").alias("b")).agg(F.count("*").alias("bands_shared")).select("a", "b")
    star = store.save("star", likely(star))
    sets = sets_of(star, "sets")
    one = star.groupBy("a").agg(F.min("b").alias("b"))
    linked = store.save("linked_one", confirmed(one, sets))
    # A pair whose ends the first links already join needs no check.
    at = linked.select(F.col("a").alias("x"), F.col("b").alias("to"))
    rest = star.join(one.withColumnRenamed("b", "b1"), "a").filter("b <> b1").select("a", "b")
    rest = rest.join(at, rest["a"] == at["x"], "left").select("a", "b", F.coalesce("to", "a").alias("ra"))
    rest = rest.join(at, rest["b"] == at["x"], "left").filter(F.col("ra") != F.coalesce("to", "b")).select("a", "b")
    # The classes of one doc_id belong together.
    texts = full.groupBy("doc_id").agg(F.min(F.struct("fp_a", "fp_b")).alias("p"), F.max(F.struct("fp_a", "fp_b")).alias("q")).filter("p <> q").select("doc_id")
    edges = linked.union(confirmed(rest, sets))
    if texts.limit(1).count():
        named = full.select("doc_id", "fp_a", "fp_b").join(texts, "doc_id").join(classes.select("fp_a", "fp_b", "rep"), ["fp_a", "fp_b"])
        firsts = named.groupBy("doc_id").agg(F.min("rep").alias("b"))
        edges = edges.union(named.join(firsts, "doc_id").filter("rep <> b").select(F.col("rep").alias("a"), "b").distinct())
    edges = store.save("edges", edges)
    store.drop("linked_one", "sets", "sets_ids")
    roots = store.save("roots", _stars(store, edges, "cc"))

    # What a bucket holds outside of its main component meets the rest: only in buckets of
    # two components or more, and by way of one reference document per bucket, the hub of
    # the main component (its most central member).
    home = store.save("home", roots.select(F.col("node").alias("x"), "root"))
    tagged = members.join(home, members["rep"] == home["x"], "left").select("key", "rep", F.coalesce("root", "rep").alias("comp"))
    groups = tagged.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mains = groups.groupBy("key").agg(F.max_by("comp", F.struct(F.col("n"), -F.col("comp"))).alias("main"), F.count("*").alias("comps")).filter("comps > 1")
    hubs = central.join(home, central["rep"] == home["x"], "left").groupBy(F.coalesce("root", "rep").alias("c")).agg(most("rep").alias("hub"))
    mains = mains.join(hubs, mains["main"] == hubs["c"]).select(F.col("key").alias("k"), "main", "hub")
    to_hub = tagged.join(mains, F.col("key") == F.col("k")).filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"), "comp", "main").distinct()
    to_hub = store.save("to_hub", to_hub)
    sets = sets_of(to_hub, "hub_sets")
    own, ref = (sets.select(F.col("rep").alias(c + "_id"), F.col("items").alias(c + "_items")) for c in ("own", "ref"))
    met = to_hub.join(own, F.col("a") == F.col("own_id")).join(ref, F.col("b") == F.col("ref_id"))
    delta = F.concat(F.array_except("own_items", "ref_items"), F.array_except("ref_items", "own_items"))
    met = met.select(F.col("b").alias("hub"), F.col("a").alias("id"), "comp", "main", F.size("own_items").alias("n"), F.size("ref_items").alias("ref"), delta.alias("items"))
    met = met.withColumn("weight", (100 + near.percent) * F.size("items") - (100 - near.percent) * F.col("n"))
    met = store.save("deltas", met.withColumn("linked", F.col("weight") <= (100 - near.percent) * F.col("ref")))
    joined = met.filter("linked and comp <> main").select(F.col("comp").alias("ca"), F.col("main").alias("cb"))
    # Whoever links with the hub is of its component by now.
    now = met.withColumn("comp", F.when(F.col("linked"), F.col("main")).otherwise(F.col("comp")))
    joined = joined.union(straggling(store, now, near).select("ca", "cb"))
    joined = store.save("joined", joined.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    final = roots
    if joined.limit(1).count():
        tops = store.save("tops", _stars(store, joined, "top").select(F.col("node").alias("x"), F.col("root").alias("top")))
        lifted = roots.join(tops, roots["root"] == tops["x"], "left").select("node", F.coalesce("top", "root").alias("root"))
        final = store.save("final", lifted.union(tops.select(F.col("x").alias("node"), F.col("top").alias("root"))))
    store.drop("members", "central", "star", "to_hub", "hub_sets", "hub_sets_ids", "deltas", "table", "posts", "home")

    named = classes.select("fp_a", "fp_b", "rep").join(final, F.col("rep") == F.col("node"), "left").select("fp_a", "fp_b", F.coalesce("root", "rep").alias("component_id"))
    named = store.save("named", named)
    some = signed.select("doc_id", "n", "fp_a", "fp_b").filter("n > 0 and doc_id is not null").join(named, ["fp_a", "fp_b"])
    none = signed.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    every = some.select("doc_id", "n", "component_id").union(none)
    return every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, with all columns of ``docs``.

    Of rows that repeat the kept doc_id, the one of the smallest text stays (null last; equal
    texts: any one, they are alike in what the operator reads). Null and empty texts, and rows
    with a null doc_id, stay. Very long texts are compared whole. An empty table gives an empty
    result. Other columns, also those whose names differ in case only, pass through.
    """
    spark = docs.sparkSession
    store = Scratch(spark, "near-kept")
    names, plain = numbered(docs)
    id_ = names[docs.columns.index("doc_id")]
    text = names[docs.columns.index("text")]
    found = store.save("kept", near_duplicates(docs, near).filter("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("times")))
    ids = found.select(F.col("doc_id").alias("kept_doc_id"))
    kept = plain.join(ids, F.col(id_).cast("long") == F.col("kept_doc_id"), "left_semi").union(plain.filter(F.col(id_).isNull()))
    twice = found.filter("times > 1").select(F.col("doc_id").alias("kept_doc_id"))
    if twice.limit(1).count():
        repeats = kept.join(twice, F.col(id_).cast("long") == F.col("kept_doc_id"), "left_semi")
        first = repeats.groupBy(F.col(id_).cast("long").alias("g")).agg(F.min_by(F.struct(*names), F.struct(F.col(text).isNull(), text)).alias("row")).select("row.*")
        kept = kept.join(twice, F.col(id_).cast("long") == F.col("kept_doc_id"), "left_anti").union(first)
    return kept.toDF(*docs.columns)

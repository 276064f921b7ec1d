"""The manifest against a brute-force tree, and its proofs."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from nimbora.llm import merkle
from nimbora.llm.merkle import Tree

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    cells = (row[0], row[3], row[2], row[4] + more if more else row[4], row[1])
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in cells])


def tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def siblings(levels, i, fanout):
    out = []
    for level in levels[:-1]:
        lo = i // fanout * fanout
        out.append((level[lo:i], level[i + 1 : lo + fanout]))
        i //= fanout
    return out


def brute(rows, fanout=2):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]], fanout)
    top, out = tree([trees[g][-1][0] for g in names], fanout), []
    for at, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            path = siblings(trees[g], i, fanout) + siblings(top, at, fanout)
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            fold = leaf(r, 1) if hit else leaf(r)
            for left, right in path:
                fold = h(*left, fold, *right)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], h(*[x for l, r_ in path for x in l + r_]), fold, fold == top[-1][0]))
    return sorted(out, key=repr)


def made(spark, rows, c=Tree()):
    frame = merkle.digest(merkle.manifest(spark.createDataFrame(rows, SCHEMA), c), c)
    assert frame.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted([tuple(r) for r in frame.collect()], key=repr)


def some(n, seed, ids):
    rng = random.Random(seed)
    return [(ids(rng, i), rng.choice(["", "a", "wörter %d" % rng.randrange(9), None]), rng.choice(["en", "de", None, "", "z"]), rng.choice(["x", None]), rng.choice([None, 5, rng.randrange(99)])) for i in range(n)]


@pytest.mark.parametrize("fanout,chunk,crowd", [(2, 256, 65_536), (2, 4, 3), (3, 9, 2), (16, 16, 10)])
def test_equals_brute_force(spark, fanout, chunk, crowd):
    """Gaps, negative and huge ids, null ids, one id with many texts, equal rows; small chunks make
    several passes, and a small limit splits crowded buckets by leaf hashes."""
    far = [-(1 << 63), -1, 0, 255, 256, (1 << 63) - 1, None, 7]
    rows = some(150, fanout, lambda r, i: r.choice(far) if i % 3 == 0 else i * 10**15 % (1 << 62) if i % 3 == 1 else i)
    rows += [(7, "same", "en", "x", 4)] * 25 + [(None, f"t{i}", "en", "x", i) for i in range(30)]
    assert made(spark, rows, Tree(fanout=fanout, chunk=chunk, crowd=crowd)) == brute(rows, fanout)


def test_ranks_are_places(spark):
    rows = some(400, 3, lambda r, i: r.randrange(-(10**9), 10**9))
    c = Tree(crowd=5)
    store = merkle.Scratch(spark, "ranks-test")
    found = merkle.ranked(merkle.leaves(spark.createDataFrame(rows, SCHEMA), c), store, c).collect()
    by = {}
    for r in found:
        by.setdefault(r["g"], []).append((r["rank"], r["size"], r["id"], bytes(r["leaf"])))
    for cells in by.values():
        cells.sort()
        assert [c[0] for c in cells] == list(range(len(cells))) and {c[1] for c in cells} == {len(cells)}
        assert [c[2:] for c in cells] == sorted(c[2:] for c in cells)


def test_single_rows_empty_tables_and_clashing_columns(spark):
    assert made(spark, []) == []
    one = [(3, None, None, None, None)]
    assert made(spark, one) == brute(one)
    lone = [(1, "a", "en", "s", 1), (2, "b", "de", "s", 2), (3, "c", "fr", "s", 3)]
    assert made(spark, lone) == brute(lone)
    rows = some(20, 5, lambda r, i: i)
    frame = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("x").alias("rank"), F.lit(1).alias("Leaf"), F.lit(2).alias("g.b"))
    assert sorted([tuple(r) for r in merkle.digest(merkle.manifest(frame)).collect()], key=repr) == brute(rows)


def test_changes_show(spark):
    """Any other text, order of fields or missing row gives another root; a proof fits its leaf only."""
    rows = [(i, f"text {i}", "en", "s", i) for i in range(40)]
    root = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).root
    assert root == merkle.manifest(spark.createDataFrame(rows[::-1], SCHEMA)).root
    assert root != merkle.manifest(spark.createDataFrame(rows[:-1], SCHEMA)).root
    assert root != merkle.manifest(spark.createDataFrame([*rows[:-1], (39, "text 40", "en", "s", 39)], SCHEMA)).root
    got = made(spark, rows)
    hit = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 7 == 0}
    assert hit and {r[0] for r in got if not r[-1]} == hit


def test_long_text(spark):
    rows = [(1, "ü" * 3_000_000, "en", "s", 3_000_000), (2, "", "en", "s", 0)]
    assert made(spark, rows) == brute(rows)

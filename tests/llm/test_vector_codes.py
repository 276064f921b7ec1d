"""Yinyang Lloyd against plain Lloyd in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nimbora.llm import vector_codes as V
from nimbora.llm.vector_codes import Codes


def brute(rows, c=Codes()):
    ok = [(i, v, label) for i, v, label in rows if v and len(v) % c.parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not ok:
        return []
    ok = [r for r in ok if len(r[1]) == len(ok[0][1])]
    whole = [[math.floor(c.scale * x) for x in v] for _, v, _ in ok]
    w = len(whole[0]) // c.parts
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    codes, errors, book = [[] for _ in ok], [0] * len(ok), []
    for p in range(c.parts):
        xs = [v[p * w : (p + 1) * w] for v in whole]
        entries = [list(x) for x in xs[: c.entries]]
        for r in range(c.rounds + 1):
            at = [min(range(len(entries)), key=lambda e: (away(x, entries[e]), e)) for x in xs]
            if r < c.rounds:
                for e in range(len(entries)):
                    mine = [x for x, a in zip(xs, at, strict=True) if a == e]
                    if mine:
                        entries[e] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]
        for i, a in enumerate(at):
            codes[i].append(a)
            errors[i] += away(xs[i], entries[a])
        book += [x for e in entries for x in e]
    sha = hashlib.sha256(",".join(map(str, book)).encode()).hexdigest()
    total = {}
    for (_, _, label), e in zip(ok, errors, strict=True):
        total[label] = total.get(label, 0) + e
    long = lambda x: x if x < 1 << 63 else None
    return sorted([(i, "".join(f"{x:02x}" for x in code), long(e), long(total[label]), sha) for (i, _, label), code, e in zip(ok, codes, errors, strict=True)], key=repr)


def made(spark, rows, c=Codes(), kind="double"):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    out = V.digest(V.encode_vectors(frame, c=c))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted([tuple(r) for r in out.collect()], key=repr)


def vectors(n, seed, dims=16, spread=0.3):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(7)]
    return [(i * 3 % 1009, [x + rng.gauss(0, spread) for x in rng.choice(centers)], rng.choice([1, 2, None])) for i in range(n)]


@pytest.mark.parametrize("groups,few", [(4, 10_000), (1, 10_000), (16, 1)])
def test_equals_brute_force(spark, groups, few):
    rows = vectors(300, groups)
    assert made(spark, rows, Codes(groups=groups, few_labels=few)) == brute(rows)


def test_ties_repeats_and_unused_entries(spark):
    """Coarse steps: many equal distances, equal entries and entries that no vector takes."""
    rng = random.Random(5)
    rows = [(i // 2, [rng.randrange(-1, 2) / 4096 for _ in range(8)], i % 3) for i in range(200)] + [(1000, [0.0] * 8, None)] * 60
    assert made(spark, rows) == brute(rows)
    same = [(i, [0.5, -0.5] * 8, 1) for i in range(40)]
    assert made(spark, same) == brute(same)


def test_unusable_vectors_and_few_vectors(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(0, None, 1), (0, [], 1), (1, [1.0] * 7, 1), (2, [nan] + [1.0] * 15, 1), (3, [None] + [1.0] * 15, 2), (4, [-inf] + [1.0] * 15, 2), (5, [0.1] * 24, 1)]
    few = [(None, [0.2] * 16, 1), (-3, [-1.5] * 16, None), (9, [0.7] * 16, None)]
    assert made(spark, bad + few) == brute(bad + few)
    assert len(made(spark, bad + few)) == 3
    assert made(spark, bad[:5]) == [] and made(spark, []) == []
    assert made(spark, bad[-1:]) == brute(bad[-1:])


def test_integers_of_any_size(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([1e3, 1e12, 1e30]) * rng.gauss(0, 1) for _ in range(16)], 1) for i in range(60)]
    assert made(spark, rows) == brute(rows)
    small = [(i, [rng.gauss(0, 3e4) for _ in range(16)], 1) for i in range(60)]
    assert made(spark, small) == brute(small)


def test_bounds_hold_and_save_distances(spark):
    """After each move the kept bounds are below the true distances; most groups are not looked at."""
    rng = np.random.default_rng(7)
    centers = rng.normal(0, 3000, (16, 8))
    x = np.floor(centers[rng.integers(0, 16, 4000)] + rng.normal(0, 200, (4000, 8))).astype(np.int64)
    start = x[:16].copy()
    book = V.Book(start, V.grouped(start, 4), np.zeros(4))
    code = low = None
    looked, full = 0, 0
    for _ in range(7):
        code, low, best, seen = V.assign(x, book, code, low)
        d = ((x[:, None] - book.entries[None]) ** 2).sum(2)
        assert (code == d.argmin(1)).all() and (best == d.min(1)).all()
        for g in range(4):
            others = np.where((book.group == g)[None] & (np.arange(16)[None] != code[:, None]), np.sqrt(d), np.inf).min(1)
            assert (low[:, g] <= others).all()
        looked, full = looked + seen, full + d.size
        entries = book.entries.copy()
        for e in np.unique(code):
            entries[e] = x[code == e].sum(0) // (code == e).sum()
        book = book.moved(entries)
    assert looked < 0.6 * full


def test_work_is_told_and_columns_may_clash(spark):
    rows = vectors(500, 8)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    wide = frame.select("*", F.lit(1).alias("x"), F.lit(2).alias("Code"), F.lit(3).alias("a.b"))
    coded = V.encode_vectors(wide)
    looked = coded.rows.agg(F.sum("looked")).first()[0]
    assert 0 < looked < 500 * 16 * 8 * 7
    assert sorted([tuple(r) for r in V.digest(coded).collect()], key=repr) == brute(rows)


def test_single_precision_table(spark):
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in vectors(100, 11, 64)]
    assert made(spark, rows, kind="float") == brute(rows)

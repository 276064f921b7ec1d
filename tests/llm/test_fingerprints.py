"""Winnowing against brute force, its guarantee, and the order of next documents."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nimbora.llm import fingerprints as W
from nimbora.llm.fingerprints import Winnow


def brute(text, c=Winnow()):
    if not text:
        return []
    k = min(c.gram, len(text))
    hashes = [(sum(ord(x) * pow(W.BASE, k - 1 - j, 1 << 64) for j, x in enumerate(text[i : i + k])) % (1 << 64)) >> W.DROPPED for i in range(len(text) - k + 1)]
    width, taken = min(c.window, len(hashes)), set()
    for i in range(len(hashes) - width + 1):
        least = min(hashes[i : i + width])
        taken.add(max(j for j in range(i, i + width) if hashes[j] == least))
    return [(p, hashes[p]) for p in sorted(taken)]


def pairs(text, c=Winnow()):
    return [*zip(*(x.tolist() for x in W.winnow(text, c)), strict=True)]


@pytest.mark.parametrize("gram,window", [(16, 49), (1, 1), (3, 4), (5, 8), (7, 1), (4, 100)])
def test_equals_brute_force(gram, window):
    rng = random.Random(gram)
    for n in (0, 1, 2, gram - 1, gram, gram + 1, gram + window - 2, gram + window - 1, gram + window, 300):
        for letters in ("ab", "abcdefgh ", "aä€😀"):
            text = "".join(rng.choice(letters) for _ in range(n))
            for block in (1 << 20, 1, 7, 64):
                assert pairs(text, Winnow(gram, window, block)) == brute(text, Winnow(gram, window)), (n, letters, block)
    same = "a" * 500  # all grams tie: the rightmost of each window
    assert pairs(same, Winnow(gram, window)) == brute(same, Winnow(gram, window))


def test_shared_passages_share_a_fingerprint():
    rng = random.Random(1)
    c = Winnow()
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    for _ in range(200):
        passage = word(c.guarantee)
        a, b = word(rng.randrange(200)) + passage + word(rng.randrange(200)), word(rng.randrange(200)) + passage + word(rng.randrange(200))
        at = a.index(passage)
        inside = {h for p, h in pairs(a) if at <= p <= at + c.window - 1}
        assert inside & {h for _, h in pairs(b)}


def test_no_window_without_one_and_density():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(50_000))
    c = Winnow()
    spots, _ = W.winnow(text, c)
    assert np.diff(spots).max() <= c.window and spots[0] < c.window
    assert abs(len(spots) / len(text) - 2 / (c.window + 1)) < 0.004


def test_likeness():
    a = W.winnow("x" * 10 + "the quick brown fox jumps over the lazy dog " * 9)[1]
    assert W.likeness(a, a) == 1.0 and W.likeness(a[:0], a[:0]) == 1.0 and W.likeness(a, a[:0]) == 0.0
    assert W.likeness(np.array([1, 1, 2]), np.array([2, 3])) == 1 / 3


def told(text):
    return ",".join(f"{p}:{h:x}" for p, h in brute(text))


def near(a, b):
    a, b = {h for _, h in brute(a)}, {h for _, h in brute(b)}
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(order):
    """``order``: (doc_id, text) as they follow each other."""
    out = []
    for i, (d, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        third = len(text) // 3
        new = text[: len(text) - third] + following[:third]
        out.append((d, len(text), hashlib.sha256(new.encode()).hexdigest(), told(text), told(new), near(text, new), near(text, following)))
    return sorted(out, key=repr)


def got(frame):
    made = W.compare_edits(frame)
    assert made.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return sorted([tuple(r) for r in made.collect()], key=repr)


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "δέλτα", "epsilon", "😀"]) for _ in range(n))


@pytest.mark.parametrize("shuffles", [1, 4, 40])
def test_next_documents(spark, shuffles):
    rng = random.Random(shuffles)
    rows = [(d * 7 - 100, rng.choice(["", None, words(rng, rng.randrange(60))])) for d in range(120)]
    rng.shuffle(rows)
    had = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        found = got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)
    assert found == expected([(d, t or "") for d, t in sorted(rows, key=lambda r: -r[0])])


def test_ties_repeats_and_null_ids(spark):
    """Equal ids stand by their texts' hashes, null ids last; each of equal rows but the last is followed by its equal."""
    rng = random.Random(9)
    rows = [(5, words(rng, 30)) for _ in range(6)] + [(5, "twice " * 20)] * 40 + [(None, words(rng, 12)) for _ in range(5)] + [(None, None)] * 3 + [(1, "one"), (9, "nine " * 40)]
    hashes = {r["t"]: r["h"] for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)) == expected(order)


def test_one_row_empty_table_and_clashing_columns(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []
    assert got(spark.createDataFrame([(3, "abc")], "doc_id long, text string")) == expected([(3, "abc")])
    frame = spark.createDataFrame([(1, "abcdef" * 30), (2, "xyz" * 50)], "doc_id long, text string").select("*", F.lit(1).alias("h"), F.lit(2).alias("Bucket"), F.lit(3).alias("a.b"))
    assert got(frame) == expected([(2, "xyz" * 50), (1, "abcdef" * 30)])


def test_rows_of_prints_and_long_texts(spark):
    text = words(random.Random(4), 400_000)
    frame = spark.createDataFrame([(1, text), (2, None), (2, "short")], "doc_id long, text string")
    found = {(r["doc_id"], len(r["prints"])): [(p["position"], p["hash"]) for p in r["prints"]] for r in W.fingerprints(frame).collect()}
    assert found[2, 0] == [] and found[2, 1] == brute("short")
    assert [v for k, v in found.items() if k[0] == 1][0] == pairs(text, Winnow(block=10**9))

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nimbora.llm.minhash import Near, keep_one, near_duplicates, sign

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, percent=80):
    sets = {}
    for i, text in docs:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset([tuple(words)] if words else [])
    holders, up = defaultdict(list), {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for x in sets[i]:
            holders[x].append(i)
    for i, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j < i:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(sets[i]), top(i)) for i in sets}


def family(rng, base, first, count):
    """Copies of a text with up to a fifth of its words replaced, dropped or added, some of them copies of copies."""
    texts = [base]
    for _ in range(count):
        words = list(rng.choice(texts[: 1 + len(texts) // 3]))
        for _ in range(rng.randrange(0, len(words) // 8)):
            at = rng.randrange(len(words))
            words[at : at + rng.choice([0, 1, 1])] = [f"x{rng.randrange(10**6)}"] if rng.random() < 0.6 else []
        texts.append(words)
    return [(first + i, " ".join(t)) for i, t in enumerate(texts)]


def test_equals_brute_force_on_families_with_stragglers(spark):
    rng = random.Random(5)
    docs = []
    for f in range(4):
        docs += family(rng, [f"w{rng.randrange(60)}f{f}" for _ in range(90)], 1000 * f, 60)
    rng.shuffle(docs)
    docs = [(i, t) for i, t in docs] + [(9001, None), (9002, ""), (9003, "One"), (9004, "oNE  "), (9005, "a b"), (9006, "A\tB")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame).collect()}
    want = brute(docs)
    assert len({c for _, c in want.values()}) > 12
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


@pytest.mark.parametrize("near", [Near(), Near(classes=(1.0,))])
def test_one_large_group_of_near_copies(spark, near):
    """Copies of one text with a tenth to two fifths of the words edited, so that many lie about the limit."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(80)}" for _ in range(70)]
    docs = [(0, " ".join(base))]
    for i in range(1, 260):
        words = list(base)
        for _ in range(rng.randrange(0, 12)):
            at = rng.randrange(len(words))
            words[at : at + rng.choice([0, 1, 1])] = [f"x{rng.randrange(60)}"] if rng.random() < 0.5 else []
        docs.append((i, " ".join(words)))
    # A passage that many texts of their own share.
    docs += [(1000 + i, " ".join(base[:40] + [f"y{rng.randrange(400)}" for _ in range(rng.randrange(5, 40))])) for i in range(80)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(frame, near).collect()}
    want = brute(docs)
    assert len({c for _, c in want.values()}) > 20
    assert got == {i: c for i, (_, c) in want.items()}


def test_rows_of_one_doc_id_with_several_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "pq")
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (4, "other words here")]
    got = {(r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}
    rows = [(5, a), (5, b), (2, a + " z"), (3, b + " z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in near_duplicates(frame).collect()} == {2}
    kept = keep_one(spark.createDataFrame([(1, b), (1, a), (2, a)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.text) for r in kept] == [(1, a)]


def test_names_that_differ_in_case_only_and_a_very_long_text(spark):
    long = " ".join(f"w{i % 70_000}" for i in range(200_000))
    frame = spark.createDataFrame([(1, long), (2, long + " x"), (3, "a b c")], "doc_id long, text string")
    frame = frame.selectExpr("doc_id", "text", "'p' as TEXT", "1 as `Doc_ID`", "2 as `a.b`")
    assert {r.doc_id: r.component_id for r in near_duplicates(frame).collect()} == {1: 1, 2: 1, 3: 3}
    kept = keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r[0] for r in kept.collect()) == [1, 3]


def test_recall_of_bands_and_sketches_at_the_limit():
    """Pairs of a Jaccard of 0.80 to 0.85, of 60 to 600 words: all share a band and pass the sketch."""
    rng = np.random.default_rng(12)
    near, texts = Near(), []
    while len(texts) < 4000:
        n = int(rng.integers(60, 600))
        words = rng.integers(0, 10**6, n).astype(str).tolist()
        other = list(words)
        for at in rng.choice(n, max(1, int(n * rng.uniform(0.04, 0.06))), replace=False):
            other[at] = f"x{rng.integers(0, 10**6)}"
        a, b = (set(zip(t, t[1:])) for t in (words, other))
        if 80 * len(a | b) <= 100 * len(a & b) <= 85 * len(a | b):
            texts += [" ".join(words), " ".join(other)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    rows = pa.Table.from_batches(list(sign(near)([batch]))).to_pylist()
    for x, y in zip(rows[::2], rows[1::2], strict=True):
        assert set(x["bands"]) & set(y["bands"])
        assert 128 - sum(((x[k] ^ y[k]) & (2**64 - 1)).bit_count() for k in ("sk_a", "sk_b")) >= near.min_agree


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(1, "a b c d", 5), (1, "a b c d", 5), (2, "A B C D", 6), (None, "a b c d", 7), (3, "", 8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept long").withColumn("component_id", F.lit("x"))
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_duplicates(frame).collect())
    assert got == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    kept = keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("ids", [0, 10**6])
def test_filter_of_documents_by_join_or_broadcast(spark, ids):
    frame = spark.createDataFrame([(i, f"a b c d e f g h i {'z' * (i % 2)}") for i in range(6)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(frame, Near(broadcast_ids=ids)).collect()}
    assert got == dict.fromkeys(range(6), 0)

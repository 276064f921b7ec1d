import random
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from nimbora.llm import toxicity as T
from nimbora.llm import weak_quality as Q
from nimbora.llm.store import gather


def chain(e, trans, start):
    """Marginals by summing over all labellings."""
    total, on = 0.0, np.zeros(len(e))
    for y in product((0, 1), repeat=len(e)):
        s = start[y[0]] + sum(trans[a, b] for a, b in zip(y, y[1:])) + sum(x for x, k in zip(e, y) if k)
        total += np.exp(s)
        on += np.exp(s) * np.array(y)
    return on / total


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    trans, start = rng.normal(size=(2, 2)), rng.normal(size=2)
    first = np.array([0, 0, 1, 4, 13, 13])
    e = rng.normal(size=13) * 2
    want = np.concatenate([chain(e[a:b], trans, start) for a, b in zip(first, first[1:]) if b > a])
    for size in (2, 3, 64):  # messages across blocks are exact
        rows = T.blocks
        T_blocks = lambda x, f, s=size: rows(x, f, s)
        T.blocks, old = T_blocks, T.blocks
        try:
            assert np.allclose(T.marginals(e, first, trans, start), want)
        finally:
            T.blocks = old


def toxic_corpus(n=500, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(rng.randrange(1, 4)):
                text.insert(rng.randrange(len(text) + 1), rng.choice(["Nastyword,", "vilest", "vile" + rng.choice(words)]))
        docs.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_documents_and_spans(spark):
    docs, labels = toxic_corpus()
    frame = spark.createDataFrame([*docs, (1000, None), (1001, ""), (1002, "é nastyword!"), (1002, "é nastyword!"), (None, "w1 " * 30_000)], "doc_id long, text string").selectExpr("*", "1 as toxic", "2 as labelled", "'q' as TEXT", "3 as `Doc_Id`", "4 as `a.b`")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = T.score_toxicity(frame, known, keep=F.col("doc_id") < 350).collect()
    got = {r.doc_id: r for r in rows}
    wrong = [i for i, y in labels if i >= 350 and (got[i].score >= 0.7) != bool(y)]
    assert len(wrong) <= 3
    # The same result as that of one task over all texts with the model of the same sample.
    texts, toxic = T.sample(T.take(frame, "doc_id", "text"), known, T.Field(), F.col("doc_id") < 350)
    model = T.fit(texts, toxic, T.Field())
    batch = T.pa.RecordBatch.from_arrays([T.pa.array([i for i, _ in docs]), T.pa.array([t for _, t in docs])], names=["doc_id", "text"])
    for r in T.pa.Table.from_batches(list(T._score(model, T.Field())([batch]))).to_pylist():
        assert abs(got[r["doc_id"]].score - r["score"]) < 1e-9
    assert len(rows) == 505 and got[1000].score < 0.5 and got[None].score < 0.5
    assert [(s.start, s.end) for s in got[1002].spans] == [(2, 11)]


def test_toxicity_without_labels_or_rows(spark):
    frame = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in T.score_toxicity(frame, none).collect()] == [0.0]
    assert T.score_toxicity(frame.limit(0), none).collect() == []


def test_samples_are_bounded_in_rows_and_bytes(spark):
    rows = [(i, "x" * (1 + 100 * (i % 7))) for i in range(200)] + [(5, "other text of five")] * 3 + [(300, None), (301, "y" * 10_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = gather(frame, [F.col("doc_id") % 10], 1000, 9000).to_pylist()
    assert sum(len(r["text"] or "") for r in found) <= 9000 and 301 not in {r["doc_id"] for r in found}
    assert sum(r["doc_id"] == 5 for r in gather(frame, [F.col("doc_id")], 1000, 10**9).to_pylist()) == 2 and len(gather(frame, [F.col("doc_id")], 17, 10**9)) == 15  # id 5 has four rows and two texts
    assert found == gather(frame.repartition(7), [F.col("doc_id") % 10], 1000, 9000).to_pylist()


def test_em_finds_the_labellers_accuracies():
    rng = np.random.default_rng(3)
    y = rng.random(20_000) < 0.7
    accuracy = np.array([0.95, 0.8, 0.7, 0.6])
    right = rng.random((len(y), 4)) < accuracy
    v = np.where(right == y[:, None], 1, -1)
    v[rng.random(v.shape) < 0.2] = 0
    patterns, inverse, counts = np.unique(Q.pattern_of(v), return_inverse=True, return_counts=True)
    q, table, prior = Q.em(patterns, counts.astype(float), 4, 200)
    assert abs(prior - 0.7) < 0.05
    voted = table[:, 1, 2] / (table[:, 1, 2] + table[:, 1, 0])
    assert np.abs(voted - accuracy).max() < 0.05
    assert ((q[inverse] > 0.5) == y).mean() > 0.9


def test_quality_of_prose_and_junk(spark):
    rng = random.Random(7)
    stop, words = "the of and to in is that for it as with".split(), [f"term{i}" for i in range(500)]
    prose = lambda: " ".join(rng.choice(stop) if rng.random() < 0.4 else rng.choice(words) for _ in range(120))
    junk = [lambda: "BUY!! NOW!! $$$ " * 30, lambda: "spam " * 80, lambda: "a | b | c\n" * 40, lambda: "x"]
    docs = [(i, prose() if i % 3 else rng.choice(junk)()) for i in range(300)] + [(900, None), (901, ""), (None, prose()), (1, "same"), (1, "same"), (902, prose() * 2000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as score", "1 as pattern", "'q' as TEXT", "3 as `Doc_Id`")
    rows = Q.classify(frame).collect()
    assert len(rows) == len(docs)
    good = {r.doc_id: r.kept for r in rows if r.doc_id is not None and r.doc_id < 300 and r.doc_id != 1}
    assert np.mean([good[i] == bool(i % 3) for i in good]) > 0.95
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in rows)
    assert Q.classify(frame.limit(0)).collect() == []

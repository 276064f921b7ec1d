"""Silhouettes from matrices of pairs of blocks, beside all distances at once; what they exchange and how they grow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nimbora.operators import diagnostics as G
from nimbora.operators import pairs as P


def plain(x, labels):
    """Silhouettes by all distances."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = np.zeros(len(x))
    for i, own in enumerate(labels):
        mine = (labels == own) & (np.arange(len(x)) != i)
        others = [d[i, labels == k].mean() for k in set(labels.tolist()) - {own, -1}]
        if own >= 0 and mine.any() and others:
            a, b = d[i, mine].mean(), min(others)
            out[i] = (b - a) / max(a, b) if max(a, b) > 0 else 0
    return out


@pytest.mark.parametrize("single", [True, False])
def test_all_groupings_and_dimensions(spark, monkeypatch, single):
    monkeypatch.setattr(P, "BLOCK", 40)
    rng = np.random.default_rng(1)
    x = 1000 + rng.normal(size=(300, 6)).round(2)
    x[50:80] = x[50]  # copies
    x = x.astype(np.float32).astype(float) if single else x
    labels = np.stack([rng.integers(0, 4, 300), rng.integers(-1, 3, 300), np.where(np.arange(300) == 7, 1, 0), np.zeros(300, int)], 1)
    use = [None, [0, 1, 3, 4, 5], [2, 4], None]
    frame = spark.createDataFrame([(f"p{i:03d}", v.tolist(), m.tolist()) for i, (v, m) in enumerate(zip(x, labels, strict=True))], "id string, v array<double>, labels array<int>").repartition(3)
    got = {r.id: r.s for r in P.silhouettes(frame, "id", "v", 6, use, [4, 3, 2, 1]).collect()}
    want = np.stack([plain(x[:, u] if u else x, labels[:, g]) for g, u in enumerate(use)], 1)
    assert len(got) == 300 and np.allclose([got[f"p{i:03d}"] for i in range(300)], want, atol=1e-9)
    assert np.allclose(P.silhouette_means(frame, "id", "v", 6, use, [4, 3, 2, 1]), want.mean(0), atol=1e-9)


def test_rows_do_not_grow_with_points_times_blocks(spark):
    """What is exchanged is a row per pair of blocks, not one per point, block and label."""
    frame = spark.range(4_000).select("id", F.transform(F.sequence(F.lit(1), F.lit(3)), lambda j: F.rand(3) * j).alias("v"), (F.col("id") % 5).cast("int").alias("label"))
    s = G.silhouette_samples(frame, "id", "v", "label", 3)
    assert s.count() == 4_000
    text = s._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [a#" not in text and "lb#" not in text


def test_labels_of_any_kind_and_none(spark):
    frame = spark.createDataFrame([(1, [0.0], "a"), (2, [1.0], "a"), (3, [5.0], "b"), (4, [6.0], None)], "id int, v array<double>, label string")
    got = {r.id: (r.label, round(r.silhouette, 6)) for r in G.silhouette_samples(frame, "id", "v", "label", 1).collect()}
    assert got == {1: ("a", 0.8), 2: ("a", 0.75), 3: ("b", 0.0), 4: (None, 0.0)}
    assert G.silhouette_samples(frame.limit(0), "id", "v", "label", 1).count() == 0

"""Starts of k-means: drawn over all points, no worse than k-means++ on them."""

import numpy as np
from pyspark.sql import functions as F

from nimbora.operators import fits as V


def plus_plus(x, k, seed):
    rng = np.random.default_rng(seed)
    c = x[[rng.integers(len(x))]]
    while len(c) < k:
        near = ((x[:, None] - c[None]) ** 2).sum(2).min(1)
        c = np.concatenate([c, x[[rng.choice(len(x), p=near / near.sum())]]])
    return c


def lloyd(x, c):
    for _ in range(100):
        at = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        new = np.stack([x[at == i].mean(0) if (at == i).any() else c[i] for i in range(len(c))])
        if np.abs(new - c).max() < 1e-6:
            break
        c = new
    return ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum()


def test_costs_beside_plus_plus(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 3, (9, 6))[rng.integers(0, 9, 1500)] + rng.normal(0, 0.7, (1500, 6))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(5)
    mine = [cost for _, cost in V.kmeans_fits(frame, "id", "v", [V.Fit(9, s) for s in range(6)])]
    theirs = [lloyd(x, plus_plus(x, 9, s)) for s in range(6)]
    assert min(mine) <= min(theirs) * 1.001 and np.mean(mine) <= np.mean(theirs) * 1.02


def test_starts_do_not_hang_on_partitions(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 3)))]
    fits = [V.Fit(4, 1), V.Fit(5, 2, share=0.5), V.Fit(3, 3, dims=(0, 2)), V.Fit(4, 4, noise=0.1)]
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    one, two = (V.kmeans_fits(f, "id", "v", fits, steps=1) for f in (frame.repartition(1), frame.repartition(7)))
    assert all(np.allclose(a, b) and abs(x - y) < 1e-6 * x for (a, x), (b, y) in zip(one, two, strict=True))


def test_draws_are_in_proportion(spark):
    """Points far from what there is are drawn; those that are among it never."""
    x = np.concatenate([np.zeros((200, 2)), np.full((5, 2), 100.0), np.full((5, 2), -100.0)])
    data = V.hashed(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), "id", "v")
    drawn = V._drawn(data, [V.Fit(2, s) for s in range(20)], [1 << 16] * 20, [np.zeros((1, 2))] * 20, [3] * 20, 1)
    assert all(len(d) == 3 and (np.abs(d) == 100).all() for d in drawn) and 10 < sum((d > 0).all(1).sum() for d in drawn) < 50
    all_ = V._drawn(data, [V.Fit(2, 1)], [1 << 16], [np.zeros((0, 0))], [500], 0)
    assert len(all_[0]) == 210


def test_few_and_equal_points(spark):
    frame = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "id long, v array<double>")
    ((centers, cost),) = V.kmeans_fits(frame, "id", "v", [V.Fit(3)])
    assert centers.shape == (3, 2) and cost < 1e-9
    assert V.kmeans_fits(frame.filter(F.col("id") < 0), "id", "v", [V.Fit(3)])[0][0].shape == (0, 0)
    ((centers, _),) = V.kmeans_fits(frame.limit(1), "id", "v", [V.Fit(2, share=0.01)])
    assert centers.shape == (2, 2)


def test_mixtures_from_known_starts(spark, monkeypatch):
    """A sweep's mixtures start from its k-means; they are not fitted again, and come out the same."""
    from nimbora.operators import cluster as K

    rng = np.random.default_rng(8)
    x = rng.normal(0, 6, (3, 2))[rng.integers(0, 3, 120)] + rng.normal(size=(120, 2))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    fits = [V.Fit(k, 42 + i) for k in (2, 3) for i in range(2)]
    anew, known = V.mixture_fits(frame, "id", "v", fits), V.mixture_fits(frame, "id", "v", fits, starts=V.kmeans_fits(frame, "id", "v", fits))
    assert all(abs(a[0] - b[0]) < 1e-6 * abs(a[0]) for a, b in zip(anew, known, strict=True))
    calls = []
    whole = V.kmeans_fits
    monkeypatch.setattr(K, "kmeans_fits", lambda *a, **b: calls.append(1) or whole(*a, **b))
    monkeypatch.setattr(V, "kmeans_fits", lambda *a, **b: calls.append(2) or whole(*a, **b))
    K.sweep(frame, "id", "v", 2, [2, 3], restarts=2, mixtures=2)
    assert calls == [1]


def test_deviates_are_normal():
    h = np.random.default_rng(0).integers(0, 1 << 63, 20_000).astype(np.uint64)
    one = V.deviates(h, 6, 5)
    assert one.shape == (20_000, 6) and abs(one.mean()) < 0.02 and abs(one.std() - 1) < 0.02 and np.abs(np.corrcoef(one.T) - np.eye(6)).max() < 0.04
    assert abs((np.abs(one) > 1.96).mean() - 0.05) < 0.005 and (one == V.deviates(h, 6, 5)).all() and not (one == V.deviates(h, 6, 6)).all()

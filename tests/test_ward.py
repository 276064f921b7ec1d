"""Ward's method by rounds of mutual neighbours, beside a plain agglomeration; copies, lattices, more points than before."""

import numpy as np
import pytest

from nimbora.operators import cluster as K


def plain(x, k):
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        far = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: far(groups[p[0]], groups[p[1]]))
        groups[j] += groups.pop(i)
    return {frozenset(g) for g in groups}


def sets(label):
    return {frozenset(np.flatnonzero(label == c).tolist()) for c in set(label.tolist())}


def test_same_tree_as_plain():
    rng = np.random.default_rng(3)
    for dims in (1, 2, 5):
        x = rng.normal(size=(60, dims)) * rng.uniform(0.2, 3, (60, 1))
        merges = K.ward_merges(x)
        assert len(merges) == 59 and all(sets(K.cut_tree(merges, 60, k)) == plain(x, k) for k in (1, 2, 3, 7, 20, 59))


def test_equal_distances_take_few_rounds(monkeypatch):
    rounds = []
    monkeypatch.setattr(K, "_closest", lambda rows, *a, f=K._closest: rounds.append(len(rows)) or f(rows, *a))
    line = np.arange(3_000.0)[:, None]
    copies = np.repeat(np.random.default_rng(0).normal(size=(50, 4)), 40, 0) + 1e-15 * np.random.default_rng(1).normal(size=(2_000, 4))
    for x in (line, copies, np.zeros((500, 2))):
        rounds.clear()
        assert len(K.ward_merges(x)) == len(x) - 1 and len(rounds) < 80
    assert len(sets(K.cut_tree(K.ward_merges(copies), 2_000, 50))) == 50
    assert sets(K.cut_tree(K.ward_merges(copies), 2_000, 50)) == {frozenset(range(40 * i, 40 * i + 40)) for i in range(50)}


def test_more_than_five_thousand_points(spark, monkeypatch):
    """They were refused; and what executors work out is what the driver would."""
    rng = np.random.default_rng(4)
    middle = rng.normal(0, 20, (4, 3))
    x = np.concatenate([m + rng.normal(size=(1_500, 3)) for m in middle])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {r.id: r.label for r in K.ward(frame, "id", "v", 4).collect()}
    label = np.array([got[i] for i in range(6_000)])
    assert all(len(set(label[1_500 * g : 1_500 * (g + 1)].tolist())) == 1 for g in range(4)) and len(set(label.tolist())) == 4
    monkeypatch.setattr(K, "ALONE", 1 << 12)
    few = x[::10]
    assert K.ward_merges(few, spark) == K.ward_merges(few)
    with pytest.raises(ValueError):
        K.ward(frame, "id", "v", 4, most=5_999)

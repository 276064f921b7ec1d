"""Many k-means and mixture fits at once: each pass over the points serves every fit that is not done.

A fit may look at its own part of the points (a subsample by hash), at some dimensions only, or
at points with noise; all of that is made in the pass from the point and a hash of its id, so
it is the same in every pass and on every executor.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nimbora.sources.scratch import ship


#: Numbers in the partial sums of a pass that the driver may add up by itself (32 MB).
FEW = 1 << 22


@dataclass(frozen=True)
class Fit:
    """``share``: of the points that take part; ``noise``: deviation of what is added to them."""

    k: int
    seed: int = 42
    dims: tuple[int, ...] | None = None
    share: float = 1.0
    noise: float = 0.0


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters neighbours."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _draw(h: np.ndarray, seed: int, stream: int = 0) -> np.ndarray:
    return _mixed(_mixed(h + np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))) + np.uint64(stream * 0xD1342543DE82EF95 % (1 << 64)))


@cache
def _normals() -> np.ndarray:
    """Quantiles of the normal distribution at the middles of 65,536 equal shares, of deviation 1."""
    table = np.array([NormalDist().inv_cdf((i + 0.5) / 65_536) for i in range(65_536)])
    return table / table.std()


def deviates(h: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """Normal deviates of points with hashes ``h``; a draw of 64 bits gives four of them."""
    draws = _draw(h[:, None] + np.arange(-(-dims // 4), dtype=np.uint64), seed, 1)
    return _normals()[draws.view(np.uint16)[:, :dims]]


def seen(fit: Fit, x: np.ndarray, h: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``fit`` sees of points ``x`` with hashes ``h``, and its hashes; ``limit`` bounds the top 16 bits of its draw."""
    if fit.share < 1:
        ok = (_draw(h, fit.seed) >> np.uint64(48)).astype(np.int64) < limit
        x, h = x[ok], h[ok]
    if fit.noise:
        x = x + fit.noise * deviates(h, x.shape[1], fit.seed)
    return (x if fit.dims is None else x[:, fit.dims]), h


def view(fit: Fit, x: np.ndarray, h: np.ndarray, limit: int) -> np.ndarray:
    return seen(fit, x, h, limit)[0]


def reduced(data: DataFrame, fold: Callable[[np.ndarray, np.ndarray], np.ndarray], few: bool = False) -> np.ndarray | None:
    """Sum of ``fold(vectors, hashes)`` over all rows of ``data`` (v, h); partial sums meet in a tree, or, if they are ``few``, on the driver."""

    def rows(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                one = fold(x, batch.column(1).to_numpy().view(np.uint64))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    if few:
        each = [np.frombuffer(x.as_buffer()) for x in data.mapInArrow(rows, "sums binary").toArrow().column(0)]
        return np.sum(each, 0) if each else None
    parts = data.mapInArrow(rows, "sums binary").rdd.map(lambda r: np.frombuffer(bytes(r[0])))
    both = lambda a, b: b if a is None else a if b is None else a + b
    return parts.treeAggregate(None, both, both)


def hashed(points: DataFrame, id_: str, vector: str) -> DataFrame:
    spark = points.sparkSession
    ship(spark)
    rows = points.select(F.col(vector).cast("array<double>").alias("v"), F.xxhash64(id_).alias("h"))
    few = 2 * spark.sparkContext.defaultParallelism
    return rows.repartition(few, "h") if rows.rdd.getNumPartitions() < few else rows  # each pass is work for all cores


def limits(data: DataFrame, fits: list[Fit]) -> list[int]:
    """Per fit the bound of the draws' top 16 bits that leaves its share of the points."""
    seeds = sorted({f.seed for f in fits if f.share < 1})
    if not seeds:
        return [1 << 16] * len(fits)
    fold = lambda x, h: np.concatenate([np.bincount((_draw(h, s) >> np.uint64(48)).astype(np.int64), minlength=1 << 16).astype(float) for s in seeds])
    found = reduced(data, fold)
    table = dict(zip(seeds, np.cumsum(found.reshape(len(seeds), -1), 1), strict=True))
    return [int(np.searchsorted(table[f.seed], f.share * table[f.seed][-1], "right")) if f.share < 1 else 1 << 16 for f in fits]


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)


def _drawn(data: DataFrame, fits: list[Fit], bounds: list[int], have: list[np.ndarray], counts: list[int], turn: int) -> list[np.ndarray]:
    """For each fit ``counts`` of the points it sees, drawn without replacement in proportion to their
    squared distances to the nearest of ``have`` (all alike where it has none yet).

    A point's key is an exponential deviate, made of its hash, over its weight; the points of the least
    keys are such a draw, in each task as in the whole, so few rows leave a task.
    """
    jobs = list(zip(fits, bounds, have, counts, strict=True))

    def rows(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            h = batch.column(1).to_numpy().view(np.uint64)
            for j, (f, lim, c, n) in enumerate(jobs):
                y, g = seen(f, x, h, lim)
                weight = _squares(y, c).min(1) if len(c) else np.ones(len(y))
                u = ((_draw(g, f.seed, 16 + turn) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
                ok = np.flatnonzero(weight > 0)
                keys, y = -np.log(u[ok]) / weight[ok], y[ok]
                if j in best:
                    keys, y = np.concatenate([best[j][0], keys]), np.concatenate([best[j][1], y])
                at = np.argsort(keys, kind="stable")[:n]
                best[j] = keys[at], y[at]
        for j, (keys, y) in best.items():
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array([j] * len(keys), pa.int32()), pa.array(keys), pa.array(list(y), pa.list_(pa.float64()))], names=["fit", "key", "v"])

    table = data.mapInArrow(rows, "fit int, key double, v array<double>")
    n = F.element_at(F.array(*map(F.lit, counts)), F.col("fit") + 1)
    first = table.withColumn("r", F.row_number().over(Window.partitionBy("fit").orderBy("key"))).filter(F.col("r") <= max(counts)).filter(F.col("r") <= n)
    found: list[list] = [[] for _ in fits]
    for r in first.select("fit", "v", "r").orderBy("fit", "r").collect():  # at most ``counts`` a fit
        found[r["fit"]].append(r["v"])
    return [np.array(v, float) if v else np.zeros((0, 0)) for v in found]


def _starts(data: DataFrame, fits: list[Fit], bounds: list[int], rounds: int) -> list[np.ndarray]:
    """Centers by k-means||: a first point, then in each round 2 k points drawn by their squared distances
    to those so far, over all points; what was drawn, weighted by the points nearest to it, is
    reduced to k centers. Each round is one pass for all fits."""
    have = _drawn(data, fits, bounds, [np.zeros((0, 0))] * len(fits), [1] * len(fits), 0)
    if not all(map(len, have)):  # a share of few points may be none of them: these start from all
        bounds = [lim if len(c) else 1 << 16 for lim, c in zip(bounds, have, strict=True)]
        have = _drawn(data, fits, bounds, [np.zeros((0, 0))] * len(fits), [1] * len(fits), 0)
    for turn in range(1, rounds + 1):
        more = _drawn(data, fits, bounds, have, [2 * f.k for f in fits], turn)
        have = [np.concatenate([c, m]) if len(m) else c for c, m in zip(have, more, strict=True)]

    def fold(x: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = []
        for f, lim, c in zip(fits, bounds, have, strict=True):
            y = view(f, x, h, lim)
            out.append(np.bincount(_squares(y, c).argmin(1), minlength=len(c)).astype(float) if len(y) else np.zeros(len(c)))
        return np.concatenate(out)

    weights = np.split(reduced(data, fold), np.cumsum([len(c) for c in have])[:-1])
    return [_reduced_to(c, w, f.k, f.seed) for f, c, w in zip(fits, have, weights, strict=True)]


def _reduced_to(x: np.ndarray, weight: np.ndarray, k: int, seed: int, steps: int = 20) -> np.ndarray:
    """k centers of a few weighted points: k-means++ and some iterations, the best of five."""
    rng = np.random.default_rng(seed)
    best, least = x[:1].repeat(k, 0), np.inf
    pick = lambda p: x[rng.choice(len(x), p=p / p.sum())] if p.sum() > 0 else x[rng.integers(len(x))]
    for _ in range(5):
        c = pick(weight)[None]
        while len(c) < k:
            c = np.concatenate([c, pick(weight * ((x[:, None] - c[None]) ** 2).sum(2).min(1))[None]])
        for _ in range(steps):
            d = ((x[:, None] - c[None]) ** 2).sum(2)
            one = np.eye(k)[d.argmin(1)] * weight[:, None]
            c = np.where(one.sum(0)[:, None] > 0, one.T @ x / np.maximum(one.sum(0), 1e-300)[:, None], c)
        cost = (weight * ((x[:, None] - c[None]) ** 2).sum(2).min(1)).sum()
        if cost < least:
            best, least = c, cost
    return best


def _steps(jobs: list[tuple[Fit, int, np.ndarray]], x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each (fit, limit, centers) the sizes of its groups, their sums and the cost, one after the other.

    Fits that look at the points as they are share two products, with the centers of all of them in a row: dimensions
    that a fit leaves out are 0 in its centers. Those with noise have products of their own."""
    dims, out = x.shape[1], [np.zeros(len(c) * (c.shape[1] + 1) + 1) for _, _, c in jobs]
    plain = [j for j, (f, _, _) in enumerate(jobs) if not f.noise]
    at = np.concatenate([[0], np.cumsum([len(jobs[j][2]) for j in plain])]).astype(int)
    centers, masks = np.zeros((at[-1], dims)), np.ones((dims, len(plain)))
    for i, j in enumerate(plain):
        f, _, c = jobs[j]
        centers[at[i] : at[i + 1], slice(None) if f.dims is None else list(f.dims)] = c
        if f.dims is not None:
            masks[:, i] = 0
            masks[list(f.dims), i] = 1
    length = (centers * centers).sum(1)
    for lo in range(0, len(x), 2_048):
        y, g = x[lo : lo + 2_048], h[lo : lo + 2_048]
        each = np.arange(len(y))
        if plain:
            norm, d = (y * y) @ masks, length - 2 * (y @ centers.T)
            one = np.zeros(d.shape)
            for i, j in enumerate(plain):
                f, lim, _ = jobs[j]
                part = d[:, at[i] : at[i + 1]]
                label = part.argmin(1)
                near = np.maximum(part[each, label] + norm[:, i], 0)
                rows = each if f.share >= 1 else np.flatnonzero((_draw(g, f.seed) >> np.uint64(48)).astype(np.int64) < lim)
                one[rows, at[i] + label[rows]] = 1
                out[j][-1] += near[rows].sum()
            sizes, sums = one.sum(0), one.T @ y
            for i, j in enumerate(plain):
                f, k = jobs[j][0], at[i + 1] - at[i]
                part = sums[at[i] : at[i + 1]]
                out[j][:k] += sizes[at[i] : at[i + 1]]
                out[j][k:-1] += (part if f.dims is None else part[:, list(f.dims)]).ravel()
        for j, (f, lim, c) in enumerate(jobs):
            if f.noise:
                z = view(f, y, g, lim)
                d = _squares(z, c)
                label = d.argmin(1) if len(z) else np.zeros(0, int)
                one = np.zeros((len(z), len(c)))
                one[np.arange(len(z)), label] = 1
                out[j] += np.concatenate([one.sum(0), (one.T @ z).ravel(), [d[np.arange(len(z)), label].sum()]])
    return np.concatenate(out)


def kmeans_fits(points: DataFrame, id_: str, vector: str, fits: list[Fit], steps: int = 100, tol: float = 1e-6, rounds: int = 4) -> list[tuple[np.ndarray, float]]:
    """(centers, cost) of each fit: Lloyd's iterations from k-means|| starts of so many rounds; each
    round and each iteration is one pass over all points for all fits. A center without points stays."""
    data = hashed(points, id_, vector).persist()
    try:
        if data.isEmpty():
            return [(np.zeros((0, 0)), 0.0) for _ in fits]
        parts, bounds = data.rdd.getNumPartitions(), limits(data, fits)
        centers = _starts(data, fits, bounds, rounds)
        cost, live = [0.0] * len(fits), list(range(len(fits)))
        for _ in range(steps):
            now = [(fits[j], bounds[j], centers[j]) for j in live]

            sums, at, going = reduced(data, lambda x, h, now=now: _steps(now, x, h), parts * sum(c.size + len(c) + 1 for _, _, c in now) < FEW), 0, []
            for j in live:
                k, d = centers[j].shape
                n, total, cost[j] = sums[at : at + k], sums[at + k : at + k + k * d].reshape(k, d), float(sums[at + k + k * d])
                at += k + k * d + 1
                new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centers[j])
                if np.abs(new - centers[j]).max(initial=0) > tol:
                    going.append(j)
                centers[j] = new
            live = going
            if not live:
                break
        return list(zip(centers, cost, strict=True))
    finally:
        data.unpersist()


@dataclass(frozen=True)
class Mixture:
    """A mixture's inverse roots, constants and means; called, a batch's (responsibilities, log-likelihood), by
    logarithms, so that many dimensions don't underflow."""

    roots: np.ndarray
    ground: np.ndarray
    means: np.ndarray

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        logs = np.zeros((len(x), len(self.ground)))
        for lo in range(0, len(x), 512):  # what a core's cache holds
            y = x[lo : lo + 512]
            for i, (g, m, root) in enumerate(zip(self.ground, self.means, self.roots, strict=True)):
                z = (y - m) @ root
                logs[lo : lo + 512, i] = g - np.einsum("ij,ij->i", z, z) / 2
        top = logs.max(1, keepdims=True)
        likely = np.exp(logs - top)
        each = likely.sum(1, keepdims=True)
        return likely / each, float((top + np.log(each)).sum())


def mixture_score(weights: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> Mixture:
    roots = np.stack([np.linalg.inv(np.linalg.cholesky(c)).T for c in covariances])
    return Mixture(roots, np.log(weights) + np.log(np.diagonal(roots, axis1=1, axis2=2)).sum(1) - means.shape[1] / 2 * np.log(2 * np.pi), means)


def _products(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum of the outer products of points with weights; those of no weight take no part."""
    some = w > 0
    if not some.all():
        x, w = x[some], w[some]
    return ((x * w[:, None]).T @ x).ravel()


def mixture_fits(points: DataFrame, id_: str, vector: str, fits: list[Fit], steps: int = 100, tol: float = 1e-3, ridge: float = 1e-6, starts: list | None = None) -> list[tuple[float, tuple]]:
    """(log-likelihood, (weights, means, covariances)) of each fit with full covariances: expectation
    and maximization from k-means groups until the mean log-likelihood gains less than ``tol``, in
    one pass a step for all fits. ``starts``: what ``kmeans_fits`` found for the same fits, if it is known."""
    starts = kmeans_fits(points, id_, vector, fits) if starts is None else starts
    context = points.sparkSession.sparkContext
    data = hashed(points, id_, vector).persist()
    try:
        first = reduced(data, lambda x, h: np.append(x.sum(0), len(x)))
        n, center = first[-1], first[:-1] / first[-1]
        d = len(center)
        near = [c - center for c, _ in starts]
        models: list = [None] * len(fits)
        fitted, live = [-np.inf] * len(fits), list(range(len(fits)))
        for step in range(steps + 1):
            sent = context.broadcast([(mixture_score(*models[j]) if step else None, near[j]) for j in live])

            def fold(x: np.ndarray, h: np.ndarray, sent=sent) -> np.ndarray:
                x, out = x - center, []
                for score, c in sent.value:
                    r, fit = score(x) if score else (np.eye(len(c))[_squares(x, c).argmin(1)], 0.0)
                    out += [r.sum(0), (r.T @ x).ravel(), *[_products(x, w) for w in r.T], [fit]]
                return np.concatenate(out)

            sums, at, going = reduced(data, fold), 0, []
            sent.destroy()  # else the models of all steps stay on the driver
            for j in live:
                k = fits[j].k
                part = sums[at : at + k + k * d + k * d * d + 1]
                at += len(part)
                if step and (abs(part[-1] / n - fitted[j] / n) < tol or step == steps):
                    fitted[j] = float(part[-1])
                    continue
                if step:
                    fitted[j] = float(part[-1])
                weight = part[:k] + 10 * np.finfo(float).eps
                means = part[k : k + k * d].reshape(k, d) / weight[:, None]
                products = part[k + k * d : -1].reshape(k, d, d) / weight[:, None, None]
                models[j] = (weight / weight.sum(), means, products - means[:, :, None] * means[:, None, :] + ridge * np.eye(d))
                going.append(j)
            live = going
            if not live:
                break
        return [(like, (w, m + center, c)) for like, (w, m, c) in zip(fitted, models, strict=True)]
    finally:
        data.unpersist()


def labelled(points: DataFrame, vector: str, assign: list[Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """``points`` with ``labels``: for each of ``assign`` the group of the point."""

    ship(points.sparkSession)

    def rows(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        x = np.stack(v.to_numpy()).astype(float)
        return pd.Series(list(np.stack([a(x) for a in assign], 1).astype(np.int32)))

    return points.withColumn("labels", F.pandas_udf(rows, "array<int>")(F.col(vector).cast("array<double>")))


def by_centers(centers: np.ndarray, dims: tuple[int, ...] | None = None) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: _squares(x if dims is None else x[:, dims], centers).argmin(1)


def by_mixture(model: tuple) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: mixture_score(*model)(x)[0].argmax(1)


def spread(points: DataFrame, vector: str, groups: list[int]) -> list[tuple[float, float | None]]:
    """(inertia, Calinski and Harabasz's ratio) of each entry of ``labels``, in one pass; ``groups``: their numbers of groups."""
    data = points.select(F.concat(F.transform("labels", lambda x: x.cast("double")), F.col(vector).cast("array<double>")).alias("v"), F.lit(0).cast("long").alias("h")).persist()
    try:
        m = len(groups)
        first = reduced(data, lambda x, h: np.append(x[:, m:].sum(0), len(x)))
        n, center = first[-1], first[:-1] / first[-1]

        def fold(x: np.ndarray, h: np.ndarray) -> np.ndarray:
            y, out = x[:, m:] - center, []
            for i, k in enumerate(groups):
                one = np.eye(k)[x[:, i].astype(int)]
                out += [one.sum(0), (one.T @ y).ravel()]
            return np.concatenate([*out, [(y * y).sum()]])

        sums, at, found = reduced(data, fold), 0, []
        for k in groups:
            d = len(center)
            size, total = sums[at : at + k], sums[at + k : at + k + k * d].reshape(k, d)
            at += k + k * d
            between = float(((total**2).sum(1) / np.maximum(size, 1)).sum())
            inside, some = float(sums[-1]) - between, int((size > 0).sum())
            found.append((inside, float(between / (some - 1) / (inside / (n - some))) if some > 1 and n > some and inside > 0 else None))
        return found
    finally:
        data.unpersist()

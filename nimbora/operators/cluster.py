"""Fitted models: k-means, Ward, Gaussian mixtures, principal components, and their stability."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nimbora.operators.fits import Fit, _mixed, by_centers, by_mixture, hashed, kmeans_fits, labelled, limits, mixture_fits, reduced, spread, view
from nimbora.operators.pairs import silhouette_means
from nimbora.sources.scratch import ship


def _vectors(points: DataFrame, vector: str) -> DataFrame:
    return points.withColumn("features", array_to_vector(F.col(vector)))


def kmeans(points: DataFrame, vector: str, k: int, restarts: int = 10, seed: int = 42, id_: str = "") -> DataFrame:
    """``points`` with ``label``: the restart of least cost. All restarts share their passes over the points."""
    fits = [Fit(k, seed + i) for i in range(restarts)]
    centers, _ = min(kmeans_fits(points, id_ or points.columns[0], vector, fits), key=lambda f: f[1])
    return labelled(points, vector, [by_centers(centers)]).withColumn("label", F.col("labels")[0]).drop("labels")


def relabel(labelled: DataFrame, by: str) -> DataFrame:
    """Labels renumbered by ascending mean of a column."""
    order = labelled.groupBy("label").agg(F.avg(by).alias("m")).select(F.col("label").alias("old"), (F.row_number().over(Window.orderBy("m", "label")) - 1).alias("new"))
    return labelled.join(F.broadcast(order), F.col("label") == F.col("old")).withColumn("label", F.col("new")).drop("old", "new")  # as many rows as groups


def criterion(likelihood: float, n: int, k: int, dims: int) -> float:
    """The Bayesian information criterion of a mixture of ``k`` groups with full covariances."""
    free = k - 1 + k * dims + k * dims * (dims + 1) / 2
    return -2 * likelihood + free * float(np.log(max(1, n)))


def gaussian_mixture(points: DataFrame, vector: str, k: int, dims: int, restarts: int = 3, seed: int = 42, id_: str = "", **more) -> tuple[DataFrame, float]:
    """``points`` with ``label``, and the Bayesian information criterion, of the best of ``restarts`` fits."""
    likelihood, model = max(mixture_fits(points, id_ or points.columns[0], vector, [Fit(k, seed + i) for i in range(restarts)], **more), key=lambda f: f[0])
    return labelled(points, vector, [by_mixture(model)]).withColumn("label", F.col("labels")[0]).drop("labels"), criterion(likelihood, points.count(), k, dims)


def ward_labels(x: np.ndarray, k: int) -> np.ndarray:
    return cut_tree(ward_merges(x), len(x), k)


#: Pairs of clusters that the driver compares by itself; more of them are a job.
ALONE = 1 << 26


def _closest(rows: np.ndarray, c: np.ndarray, size: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For each of ``rows`` the other cluster (center, size, name) of least Ward distance. Among equals, up to rounding, a
    hash of the names decides, the same for both of its sides, so that many of them choose each other."""
    norm = (c * c).sum(1)
    slack = 1e-15 * c.shape[1] * float(norm.max(initial=0))
    found, step = np.zeros(len(rows), np.int64), max(1, (1 << 20) // max(1, len(c)))
    for lo in range(0, len(rows), step):
        some = rows[lo : lo + step]
        d = norm[some, None] + norm[None] - 2 * (c[some] @ c.T)
        np.maximum(d, 0, out=d)
        d[np.arange(len(some)), some] = np.inf
        d *= size / (size[some, None] + size)  # twice the row's own size is left out, as it is the same for a row
        least = d.min(1)
        limit = least * (1 + 1e-12) + slack
        near = d <= limit[:, None]
        found[lo : lo + step] = d.argmin(1)
        many = np.flatnonzero(near.sum(1) > 1)
        r, j = np.nonzero(near[many])
        if len(r):
            i, k = names[some[many[r]]], names[j]
            mark = _mixed((np.minimum(i, k).astype(np.uint64) << np.uint64(32)) ^ np.maximum(i, k).astype(np.uint64))
            order = np.lexsort((mark, r))
            first = order[np.concatenate([[True], np.diff(r[order]) > 0])]
            found[lo + many[r[first]]] = j[first]
    return found


def _closest_of(rows: np.ndarray, c: np.ndarray, size: np.ndarray, names: np.ndarray, spark: SparkSession | None) -> np.ndarray:
    if spark is None or len(rows) * len(c) <= ALONE:
        return _closest(rows, c, size, names)
    ship(spark)
    sent = spark.sparkContext.broadcast((c, size, names))  # a center per cluster
    try:
        parts = np.array_split(rows, max(spark.sparkContext.defaultParallelism, min(len(rows), -(-len(rows) * len(c) // (ALONE << 3)))))
        return np.concatenate(spark.sparkContext.parallelize(parts, len(parts)).map(lambda part: _closest(part, *sent.value)).collect())
    finally:
        sent.destroy()


def ward_merges(x: np.ndarray, spark: SparkSession | None = None) -> list[tuple[float, int, int]]:
    """Ward's agglomeration: (height, a, b). In each round all pairs of clusters that are each other's nearest are merged;
    they would be sooner or later, as no merge brings a third cluster nearer. A cluster is its center and size, so
    memory is in proportion to the points; only clusters that are new or have lost their nearest look for it again."""
    x = np.asarray(x, float)
    n = len(x)
    if n < 2:
        return []
    c, size, height, merges = x - x.mean(0), np.ones(n), np.zeros(n), []
    _, first, at = np.unique(c, axis=0, return_index=True, return_inverse=True)
    rep = first[at.ravel()]
    merges += [(0.0, int(rep[i]), int(i)) for i in np.flatnonzero(rep != np.arange(n))]  # copies
    size = np.bincount(rep, minlength=n).astype(float)
    alive = size > 0
    nearest, stale = np.full(n, -1), alive.copy()
    while alive.sum() > 1:
        here = np.flatnonzero(alive)
        where = np.full(n, -1)
        where[here] = np.arange(len(here))
        rows = np.flatnonzero(stale)
        nearest[rows] = here[_closest_of(where[rows], c[here], size[here], here, spark)]
        stale[:] = False
        a = here[(nearest[nearest[here]] == here) & (here < nearest[here])]
        far = lambda i, j: 2 * size[i] * size[j] / (size[i] + size[j]) * ((c[i] - c[j]) ** 2).sum(-1)
        if not len(a):  # rounding made a circle of equals
            i = here[[int(far(here, nearest[here]).argmin())]]
            a = np.minimum(i, nearest[i])
            b = np.maximum(i, nearest[i])
        else:
            b = nearest[a]
        h = np.maximum(far(a, b), np.maximum(height[a], height[b]))
        merges += list(zip(h.tolist(), a.tolist(), b.tolist(), strict=True))
        c[a] = (size[a, None] * c[a] + size[b, None] * c[b]) / (size[a] + size[b])[:, None]
        size[a] += size[b]
        height[a], alive[b] = h, False
        gone = np.zeros(n, bool)
        gone[a] = gone[b] = True
        stale = alive & (gone | gone[nearest])
    return merges


def cut_tree(merges: list[tuple[float, int, int]], n: int, k: int) -> np.ndarray:
    """Labels of the ``k`` groups that are left after the lowest merges."""
    up = list(range(n))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for _, a, b in sorted(merges)[: max(0, n - k)]:
        up[top(b)] = top(a)
    _, label = np.unique([top(i) for i in range(n)], return_inverse=True)
    return label


def ward_many(points: DataFrame, id_: str, vector: str, ks: list[int], most: int | None = None) -> DataFrame:
    """(id, labels): the groups for each k, of one tree. The driver keeps a center per cluster; which clusters are nearest
    to each other is worked out by all executors. With ``most``, more points than that are refused."""
    rows = points.select(id_, F.col(vector).cast("array<double>").alias("v"))
    if most is not None and rows.limit(most + 1).count() > most:
        raise ValueError(f"Ward's method takes time in the square of the points; {most} points at most")
    table = rows.orderBy(id_).toArrow().combine_chunks()  # the points themselves
    n = table.num_rows
    if not n:
        return points.select(id_, F.array(F.lit(0)).alias("labels")).limit(0)
    x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    merges = ward_merges(x, points.sparkSession)
    labels = np.stack([cut_tree(merges, n, k) for k in ks], 1).astype(np.int32)
    cells = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(ks)), pa.array(labels.ravel()))
    return points.sparkSession.createDataFrame(pa.table({id_: table.column(id_), "labels": cells}))


def ward(points: DataFrame, id_: str, vector: str, k: int, most: int | None = None) -> DataFrame:
    """(id, label) of ``k`` groups by Ward's method."""
    return ward_many(points, id_, vector, [k], most).select(id_, F.col("labels")[0].alias("label"))


def principal_components(points: DataFrame, id_: str, vector: str, k: int) -> tuple[DataFrame, list[float], np.ndarray]:
    """(id, pc1..pck), explained variance ratios, loadings; the largest loading of each is positive."""
    data = _vectors(points, vector)
    model = PCA(k=k, inputCol="features", outputCol="pcs").fit(data)
    loadings = model.pc.toArray()
    sign = np.sign(loadings[np.abs(loadings).argmax(0), np.arange(loadings.shape[1])])
    scores = model.transform(data).withColumn("p", vector_to_array("pcs"))
    return scores.select(id_, *[(F.col("p")[i] * float(sign[i])).alias(f"pc{i + 1}") for i in range(k)]), [float(v) for v in model.explainedVariance], loadings * sign


def sweep(points: DataFrame, id_: str, vector: str, dims: int, ks: list[int], restarts: int = 10, seed: int = 42, mixtures: int = 3, most: int | None = None) -> list[tuple]:
    """(algorithm, k, silhouette, calinski_harabasz, inertia, bic) for k-means, Ward and mixtures,
    the best of ``restarts`` and ``mixtures`` fits; with ``most``, Ward's values are null where there are more points.

    All fits of a kind share their passes, and all groupings one pass over the pairs."""
    points = points.select(id_, vector)
    n = points.count()
    refused = most is not None and n > most
    jobs = [(k, i) for k in ks for i in range(restarts)]
    means = kmeans_fits(points, id_, vector, [Fit(k, seed + i) for k, i in jobs])
    begun = [means[a * restarts + i] for a in range(len(ks)) for i in range(mixtures)] if mixtures <= restarts else None  # the same fits
    mixed = mixture_fits(points, id_, vector, [Fit(k, seed + i) for k in ks for i in range(mixtures)], starts=begun)
    best = [min(means[i * restarts : (i + 1) * restarts], key=lambda f: f[1])[0] for i in range(len(ks))]
    likely = [max(mixed[i * mixtures : (i + 1) * mixtures], key=lambda f: f[0]) for i in range(len(ks))]
    table = labelled(points, vector, [by_centers(c) for c in best] + [by_mixture(m) for _, m in likely])
    groups, names = [*ks, *ks], [("kmeans", k) for k in ks] + [("gmm", k) for k in ks]
    if not refused:
        trees = ward_many(points, id_, vector, ks, most).withColumnRenamed("labels", "trees")
        table = table.join(trees, id_).withColumn("labels", F.concat("labels", "trees")).drop("trees")
        groups, names = [*groups, *ks], names + [("ward", k) for k in ks]
    table = table.persist()
    try:
        outlines = silhouette_means(table, id_, vector, dims, [None] * len(groups), groups)
        found = {x: (s, c, w) for x, s, (w, c) in zip(names, outlines, spread(table, vector, groups), strict=True)}
    finally:
        table.unpersist()
    none = (None, None, None)
    bic = {k: criterion(like, n, k, dims) for k, (like, _) in zip(ks, likely, strict=True)}
    return [(a, k, *found.get((a, k), none), bic[k] if a == "gmm" else None) for k in ks for a in ("kmeans", "ward", "gmm")]


def choose_k(results: list[tuple], least: int = 5) -> int:
    """Of the k-means rows with k >= least: the greatest silhouette, the smallest k of equals."""
    return min((r for r in results if r[0] == "kmeans" and r[1] >= least), key=lambda r: (-r[2], r[1]))[1]


def stability(points: DataFrame, id_: str, vector: str, dims: int, k: int, repeats: int = 25, share: float = 0.8, noise: float = 0.1, seed: int = 42) -> list[tuple]:
    """(kind, mean, population deviation) of the adjusted Rand index of refits on subsamples and
    on noisy copies against the first fit; subsamples are judged on the points they hold. All
    refits share their passes."""
    points = points.select(id_, vector)
    parts = [Fit(k, seed + i, share=share) for i in range(repeats)]
    moved = [Fit(k, seed + 1000 + i, noise=noise) for i in range(repeats)]
    found = kmeans_fits(points, id_, vector, [Fit(k, seed + i) for i in range(3)] + parts + moved)
    base = min(found[:3], key=lambda f: f[1])[0]
    data = hashed(points, id_, vector).persist()
    try:
        bounds = limits(data, parts + moved)
        refits = [(f, lim, c) for f, lim, (c, _) in zip(parts + moved, bounds, found[3:], strict=True)]

        def fold(x: np.ndarray, h: np.ndarray) -> np.ndarray:
            out, first = [], by_centers(base)(x)
            for f, lim, c in refits:
                y = view(f, x, h, lim)
                mark = view(Fit(f.k, f.seed, share=f.share), np.stack([first, first], 1), h, lim)[:, 0].astype(int)
                out.append(np.bincount(mark * k + by_centers(c)(y), minlength=k * k).astype(float))
            return np.concatenate(out)

        tables = reduced(data, fold).reshape(-1, k, k)
    finally:
        data.unpersist()
    scores = [rand_of(t) for t in tables]
    return [(kind, float(np.mean(x)), float(np.std(x))) for kind, x in (("subsample", scores[:repeats]), ("noise", scores[repeats:]))]


def rand_of(table: np.ndarray) -> float:
    """The adjusted Rand index of a contingency table."""
    pairs = lambda n: float((n * (n - 1) / 2).sum())
    both, rows, columns, every = pairs(table), pairs(table.sum(1)), pairs(table.sum(0)), pairs(table.sum())
    expected = rows * columns / every if every else 0.0
    return (both - expected) / ((rows + columns) / 2 - expected) if (rows + columns) / 2 != expected else 1.0


def feature_ablation(points: DataFrame, id_: str, vector: str, names: list[str], k: int, seed: int = 42, restarts: int = 2) -> list[tuple]:
    """(feature left out, silhouette, adjusted Rand index against the full fit), the best of
    ``restarts`` fits each; all fits share their passes, and all groupings one over the pairs."""
    dims = len(names)
    points = points.select(id_, vector)
    uses = [None] + [tuple(j for j in range(dims) if j != i) for i in range(dims)]
    found = kmeans_fits(points, id_, vector, [Fit(k, seed + r, u) for u in uses for r in range(restarts)])
    best = [min(found[i * restarts : (i + 1) * restarts], key=lambda f: f[1])[0] for i in range(len(uses))]
    table = labelled(points, vector, [by_centers(c, u) for c, u in zip(best, uses, strict=True)]).persist()
    try:
        outlines = silhouette_means(table, id_, vector, dims, [list(u) if u else None for u in uses], [k] * len(uses))
        cells = table.select(F.col("labels")[0].alias("one"), F.posexplode("labels").alias("which", "two")).groupBy("which", "one", "two").agg(F.count("*").alias("n")).collect()  # k * k per feature at most
    finally:
        table.unpersist()
    counts = np.zeros((len(uses), k, k))
    for r in cells:
        counts[r["which"], r["one"], r["two"]] = r["n"]
    return [(name, outlines[i + 1], rand_of(counts[i + 1])) for i, name in enumerate(names)]

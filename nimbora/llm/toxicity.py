"""Toxic spans by a linear-chain conditional random field over hashed word features.

Labels are of documents. A short lexicon of features (a word, its beginnings and ends) that
explains the toxic documents of a bounded sample and hardly occurs in its clean ones gives
token labels; on these the field is trained. Forward-backward marginals of every token of a
whole text then give its spans and, through a logistic curve fitted on the sample, its score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbora.llm import words as W
from nimbora.llm.store import Scratch, arrow_batches, gather, take


@dataclass(frozen=True)
class Field:
    """``sample``: labelled training rows of each class that the model is fitted on, at most
    (those of least hash), and ``sample_bytes``: bytes of all their whole texts, at most. Of their
    segments (of ``segment`` words), the field itself is trained on all that hold a toxic word and
    on a random share of the others, three to one: a part of the bounded sample. ``precision``, ``support`` and ``support_share``: a lexicon feature explains that many
    and that share of the toxic sample documents, after a different word in ``spread`` of them, and occurs in at most (1 - precision) of its
    rate among the clean ones."""

    sample: int = 1500
    sample_bytes: int = 1 << 24
    buckets: int = 1 << 22
    precision: float = 0.95
    support: int = 5
    support_share: float = 0.012
    spread: float = 0.25
    cover: int = 6
    segment: int = 32
    epochs: int = 25
    rate: float = 0.5
    seed: int = 3


PARTS = 8


def features(data: np.ndarray, bounds: np.ndarray, field: Field) -> tuple[W.Words, np.ndarray, np.ndarray]:
    """Bare words, and per word the buckets of: itself, its first 3 to 6 bytes, its last 3 to 5;
    and 16 more bits of each, by which a scored feature is told from a trained one of its bucket."""
    words = W.find_words(data, bounds, lower=True, gap=W.PUNCTUATION)
    values = W.LOWER[data].astype(np.uint64) + np.uint64(1)
    up, down = W.powers(len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    spans = [(words.start, words.end)]
    spans += [(words.start, np.minimum(words.start + k, words.end)) for k in (3, 4, 5, 6)]
    spans += [(np.maximum(words.end - k, words.start), words.end) for k in (3, 4, 5)]
    out, check = np.empty((len(words.start), PARTS), np.int32), np.empty((len(words.start), PARTS), np.uint16)
    for i, (a, b) in enumerate(spans):
        h = W.mix((total[b] - total[a]) * down[a] + np.uint64(i << 40))
        out[:, i] = (h % np.uint64(field.buckets)).astype(np.int32)
        check[:, i] = (h >> np.uint64(48)).astype(np.uint16)
    return words, out, check


def blocks(emission: np.ndarray, first: np.ndarray, size: int = 64):
    """Tokens of texts in rows of ``size``: (texts' first rows, row x place -> token or -1)."""
    counts = np.diff(first)
    rows = -(-counts // size)
    row_first = np.concatenate([[0], np.cumsum(rows)])
    text = np.repeat(np.arange(len(counts)), rows)
    start = first[:-1][text] + (np.arange(row_first[-1]) - row_first[text]) * size
    at = start[:, None] + np.arange(size)
    return row_first, np.where(at < first[1:][text][:, None], at, -1)


def marginals(emission: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """P(toxic) of every token. emission: score of toxic against clean; trans: 2 x 2 scores;
    start: scores of the first label. Exact: products of 2 x 2 matrices over blocks of each
    text carry messages across blocks, so that all blocks are computed side by side."""
    if not len(emission):
        return np.zeros(0)
    row_first, at = blocks(emission, first)
    n, size = at.shape
    ok = at >= 0
    e = np.exp(np.clip(np.where(ok, emission[at], 0.0), -30, 30))
    t, s = np.exp(trans), np.exp(start)
    head = np.zeros(n, bool)
    head[row_first[:-1][np.diff(row_first) > 0]] = True

    # Each row's matrix: from the label before it to the label at its end.
    m = np.broadcast_to(np.eye(2), (n, 2, 2)).copy()
    for j in range(size):
        new = np.empty_like(m)
        new[:, :, 0] = m[:, :, 0] * t[0, 0] + m[:, :, 1] * t[1, 0]
        new[:, :, 1] = (m[:, :, 0] * t[0, 1] + m[:, :, 1] * t[1, 1]) * e[:, j, None]
        new /= new.sum((1, 2), keepdims=True)
        m = np.where(ok[:, j, None, None], new, m)
    # Messages into rows, row by row of all texts at once.
    texts = np.flatnonzero(np.diff(row_first))
    depth = int(np.diff(row_first).max())
    into = np.zeros((n, 2))
    back = np.ones((n, 2))
    # Before the first token: a vector that gives the start scores after one transition.
    origin = np.linalg.solve(t.T, s) if abs(t[0, 0] * t[1, 1] - t[0, 1] * t[1, 0]) > 1e-12 else np.array([1.0, 0.0])
    into[row_first[texts]] = origin
    for k in range(1, depth):
        rows = row_first[texts[np.diff(row_first)[texts] > k]] + k
        v = np.einsum("ni,nij->nj", into[rows - 1], m[rows - 1])
        into[rows] = v / v.sum(1, keepdims=True)
    for k in range(1, depth):
        rows = row_first[texts + 1][np.diff(row_first)[texts] > k] - 1 - k
        v = np.einsum("nij,nj->ni", m[rows + 1], back[rows + 1])
        back[rows] = v / v.sum(1, keepdims=True)
    alpha = np.empty((size, n, 2))
    v = into
    for j in range(size):
        new = np.stack([v[:, 0] * t[0, 0] + v[:, 1] * t[1, 0], (v[:, 0] * t[0, 1] + v[:, 1] * t[1, 1]) * e[:, j]], 1)
        new /= new.sum(1, keepdims=True)
        v = np.where(ok[:, j, None], new, v)
        alpha[j] = v
    out = np.zeros(len(emission))
    v = back
    for j in range(size - 1, -1, -1):
        p = alpha[j] * v
        p = p[:, 1] / p.sum(1)
        out[at[ok[:, j], j]] = p[ok[:, j]]
        new = np.stack([v[:, 0] * t[0, 0] + v[:, 1] * t[0, 1] * e[:, j], v[:, 0] * t[1, 0] + v[:, 1] * t[1, 1] * e[:, j]], 1)
        new /= new.sum(1, keepdims=True)
        v = np.where(ok[:, j, None], new, v)
    return out


def pair_marginals(e: np.ndarray, ok: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Of segments (rows) with emissions e: token marginals, and expected label pairs."""
    t, ex = np.exp(trans), np.exp(np.clip(e, -30, 30))
    n, size = e.shape
    alpha, beta = np.empty((size, n, 2)), np.empty((size, n, 2))
    v = np.stack([np.full(n, np.exp(start[0])), np.exp(start[1]) * ex[:, 0]], 1)
    alpha[0] = v / v.sum(1, keepdims=True)
    for j in range(1, size):
        v = alpha[j - 1] @ t * np.stack([np.ones(n), ex[:, j]], 1)
        alpha[j] = np.where(ok[:, j, None], v / v.sum(1, keepdims=True), alpha[j - 1])
    beta[size - 1] = 1
    for j in range(size - 1, 0, -1):
        v = (beta[j] * np.stack([np.ones(n), ex[:, j]], 1)) @ t.T
        beta[j - 1] = np.where(ok[:, j, None], v / v.sum(1, keepdims=True), beta[j])
    p = alpha * beta
    p = (p[:, :, 1] / p.sum(2)).T
    pairs = np.zeros((2, 2))
    for j in range(1, size):
        x = alpha[j - 1][:, :, None] * t * (np.stack([np.ones(n), ex[:, j]], 1) * beta[j])[:, None, :]
        x /= x.sum((1, 2), keepdims=True)
        pairs += x[ok[:, j]].sum(0)
    return p, pairs


def lexicon(parts: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, field: Field) -> np.ndarray:
    """Buckets that explain the toxic texts: greedily the one that most texts still lack
    (each wants ``cover`` of them), among those precise enough. parts: (text, buckets) of the
    words of some texts each; they are gone through one by one to keep memory small."""
    n_bad, n_ok = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    least = max(field.support, field.support_share * n_bad)

    def pairs(text: np.ndarray, feats: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = np.unique((text[:, None].astype(np.int64) * field.buckets + feats)[mask])
        return found // field.buckets, found % field.buckets

    hits, false = np.zeros(field.buckets, np.int32), np.zeros(field.buckets, np.int32)
    for text, feats in parts:
        hits += np.bincount(pairs(text, feats, np.broadcast_to(toxic[text][:, None], feats.shape))[1], minlength=field.buckets).astype(np.int32)
    good = hits >= least
    for text, feats in parts:
        false += np.bincount(pairs(text, feats, good[feats] & ~toxic[text][:, None])[1], minlength=field.buckets).astype(np.int32)
    good &= false / n_ok <= (1 - field.precision) * hits / n_bad
    # In copies of one text a word always has the same neighbour: such words don't count.
    met = []
    for text, feats in parts:
        before = np.where(np.append(True, text[1:] != text[:-1]), -1, np.roll(feats[:, 0], 1))
        seen = good[feats] & toxic[text][:, None]
        met.append(np.unique(feats[seen].astype(np.int64) * (field.buckets + 1) + np.broadcast_to(before[:, None], feats.shape)[seen] + 1))
    met = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
    good &= np.bincount(met // (field.buckets + 1), minlength=field.buckets) >= np.maximum(field.support, field.spread * hits)
    chosen = [pairs(text, feats, good[feats] & toxic[text][:, None]) for text, feats in parts]
    text, bucket = (np.concatenate(x) for x in zip(*chosen, strict=True)) if chosen else (np.zeros(0, int), np.zeros(0, int))
    name, bucket = np.unique(bucket, return_inverse=True)
    want, out = np.full(len(toxic), field.cover), []
    while len(text):
        gain = np.bincount(bucket, minlength=len(name))
        best = int(gain.argmax())
        if gain[best] < least:
            break
        out.append(name[best])
        want[text[bucket == best]] -= 1
        left = (bucket != best) & (want[text] > 0)
        text, bucket = text[left], bucket[left]
    return np.array(out, int)


@dataclass
class Model:
    weights: np.ndarray
    check: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    curve: np.ndarray

    def emission(self, feats: np.ndarray, check: np.ndarray) -> np.ndarray:
        return np.where(self.check[feats] == check, self.weights[feats], 0).sum(1, dtype=np.float64)


def summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: 1, greatest marginal, log(1 + mass), mass per token; mass is the sum of the
    marginals from 0.5 on, so that a long clean text can't gather one from many small ones."""
    n = len(first) - 1
    counts = np.diff(first)
    text = np.repeat(np.arange(n), counts)
    top = np.zeros(n)
    np.maximum.at(top, text, p)
    mass = np.bincount(text, np.where(p >= 0.5, p, 0.0), n)
    return np.stack([np.ones(n), top, np.log1p(mass), mass / np.maximum(counts, 1)], 1)


def fit(texts: pa.Array, toxic: np.ndarray, field: Field) -> Model | None:
    """None if either class is missing."""
    if not toxic.any() or toxic.all():
        return None
    parts, firsts, checks = [], [], []
    for lo, _, data, bounds in W.slices(texts):
        words, feats, check = features(data, bounds, field)
        parts.append((lo + words.text_of(), feats))
        firsts.append(words.first)
        checks.append(check)
    listed = np.zeros(field.buckets, bool)
    listed[lexicon(parts, toxic, field)] = True
    # Segments with a toxic word, and some of the others.
    rng = np.random.default_rng(field.seed)
    cut = []
    for (text, feats), first in zip(parts, firsts, strict=True):
        label = listed[feats].any(1) & toxic[text]
        _, at = blocks(np.zeros(len(feats)), first, field.segment)
        cut.append((label, at, (label[at] & (at >= 0)).any(1)))
    some, rest = sum(int(has.sum()) for _, _, has in cut), sum(int((~has).sum()) for _, _, has in cut)
    share = min(1.0, (3 * some + 100) / max(1, rest))
    xs, ys, oks, seen = [], [], [], np.zeros(field.buckets, np.uint16)
    for toxic_ones in (False, True):  # of two trained features in a bucket, the toxic one is told
        for (_, feats), (label, _, _), check in zip(parts, cut, checks, strict=True):
            seen[feats[label == toxic_ones]] = check[label == toxic_ones]
    for (_, feats), (label, at, has) in zip(parts, cut, strict=True):
        at = at[has | (rng.random(len(has)) < share)]
        oks.append(at >= 0)
        ys.append(label[at] & oks[-1])
        xs.append(feats[at])
    x, y, ok = np.concatenate(xs), np.concatenate(ys), np.concatenate(oks)
    del xs, ys, oks, cut
    pairs = np.array([[(ok[:, 1:] & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    begin = np.array([(~y[:, 0]).sum(), y[:, 0].sum()], float)
    # Weights of the buckets that occur, numbered closely.
    used = np.zeros(field.buckets, bool)
    used[x] = True
    names = np.flatnonzero(used)
    number = np.zeros(field.buckets, np.int32)
    number[names] = np.arange(len(names), dtype=np.int32)
    x = number[x]
    del used, number
    v, trans, start = np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2)
    gv, gt, gs = np.full(len(names), 1e-8), np.full((2, 2), 1e-8), np.full(2, 1e-8)
    for _ in range(field.epochs):  # Adagrad over the whole sample, some segments at a time
        d, got, first_on = -0.1 * v, np.zeros((2, 2)), 0.0
        for lo in range(0, len(x), 4096):
            part = slice(lo, lo + 4096)
            p, seen_pairs = pair_marginals(np.where(ok[part], v[x[part]].sum(2), 0.0), ok[part], trans, start)
            got += seen_pairs
            first_on += p[:, 0].sum()
            d += np.bincount(x[part][ok[part]].reshape(-1), np.repeat((y[part] - p)[ok[part]], PARTS), len(names))
        gv += d * d
        v += field.rate * d / np.sqrt(gv)
        d = pairs - got
        gt += d * d
        trans += field.rate * d / np.sqrt(gt)
        d = begin - np.array([len(x) - first_on, first_on])
        gs += d * d
        start += field.rate * d / np.sqrt(gs)
    w = np.zeros(field.buckets, np.float32)
    w[names] = v
    del x, y, ok
    model = Model(w, seen, trans, start, np.zeros(4))
    s = np.concatenate([summary(marginals(model.emission(feats, check), first, trans, start), first) for (_, feats), first, check in zip(parts, firsts, checks, strict=True)])
    c, target = np.zeros(4), toxic.astype(float)
    for _ in range(50):  # Newton's method with a small ridge
        q = 1 / (1 + np.exp(-np.clip(s @ c, -30, 30)))
        gradient = s.T @ (target - q) - 0.1 * c
        hessian = (s * (q * (1 - q))[:, None]).T @ s + 0.1 * np.eye(4)
        c = c + np.linalg.solve(hessian, gradient)
    model.curve = c
    return model


def sample(docs: DataFrame, labels: DataFrame, field: Field, keep) -> tuple[pa.Array, np.ndarray]:
    """Texts and labels of at most 2 * ``field.sample`` labelled rows that ``keep`` admits."""
    one = labels.filter(keep & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = [F.xxhash64("doc_id", F.lit(field.seed)), F.col("doc_id")]
    picked = one.filter("toxic = 0").orderBy(*order).limit(field.sample).union(one.filter("toxic = 1").orderBy(*order).limit(field.sample))
    picked = picked.select(F.col("doc_id").alias("labelled"), "toxic")
    # One pass over the documents; all else reads the few that are labelled and picked.
    few = Scratch(docs.sparkSession, "toxic").save("labelled", docs.join(F.broadcast(picked), F.col("doc_id") == F.col("labelled")).drop("labelled"))
    found = [gather(few.filter(F.col("toxic") == kind).drop("toxic"), order[:1], field.sample, field.sample_bytes // 2).column("text").combine_chunks() for kind in (0, 1)]
    texts = pa.concat_arrays([x.cast(pa.large_string()) for x in found])
    return texts, np.repeat([False, True], [len(x) for x in found])


RESULT = "doc_id long, score double, spans array<struct<start: long, end: long>>"
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _score(model: Model | None, field: Field):
    def rows(batches):
        for batch in batches:
            for lo, hi, data, bounds in W.slices(batch.column(1)):
                n = hi - lo
                found: list[list[dict]] = [[] for _ in range(n)]
                if model is None:
                    score = np.zeros(n)
                else:
                    words, feats, check = features(data, bounds, field)
                    p = marginals(model.emission(feats, check), words.first, model.trans, model.start)
                    score = 1 / (1 + np.exp(-np.clip(summary(p, words.first) @ model.curve, -30, 30)))
                    hit = np.flatnonzero(p >= 0.5)
                    if len(hit):
                        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                        text = words.text_of()
                        new = np.ones(len(hit), bool)
                        new[1:] = (np.diff(hit) > 1) | (text[hit[1:]] != text[hit[:-1]])
                        a = np.flatnonzero(new)
                        b = np.append(a[1:], len(hit)) - 1
                        for i, s, e in zip(text[hit[a]].tolist(), words.start[hit[a]].tolist(), words.end[hit[b]].tolist(), strict=True):
                            zero = chars[bounds[i]]
                            found[i].append({"start": int(chars[s] - zero), "end": int(chars[e] - zero)})
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(score), pa.array(found, pa.list_(SPAN))], names=["doc_id", "score", "spans"])

    return rows


def score_toxicity(docs: DataFrame, labels: DataFrame, field: Field = Field(), keep=None) -> DataFrame:
    """One row per row of ``docs``: doc_id, score, spans (code points, end exclusive).

    Reads ``doc_id`` and ``text``, and ``doc_id`` and ``toxic`` of the labels, where ``keep`` (a
    condition on these two) holds; other columns don't matter, whatever their names. A null text
    is empty; a null doc_id is scored and never learnt from. Very long texts are scored whole.
    Without labels of both classes every score is 0. Rows that repeat a doc_id get a row each;
    of several labels of a document, the greater counts; rows that tie for the sample's last
    place are taken by doc_id. An empty table gives an empty result.
    """
    arrow_batches(docs.sparkSession)
    plain = take(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = take(labels, "doc_id", "toxic")
    model = fit(*sample(plain, labels, field, F.lit(True) if keep is None else keep), field)
    return plain.mapInArrow(_score(model, field), RESULT)

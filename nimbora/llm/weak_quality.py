"""Quality classifier from weak labels: expectation-maximisation over heuristic labellers.

Each labeller votes good (1), bad (-1) or nothing (0) on a document. Votes of all documents
are counted by their pattern, of which there are at most 3 ** (number of labellers), and
EM over the patterns estimates the labellers' accuracies and each pattern's posterior. A
hashed linear scorer is then trained on the posteriors of a bounded sample and scores all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbora.llm import words as W
from nimbora.llm.store import arrow_batches, gather, take

# Frequent function words of English, German, French and Spanish.
STOP = "the of and to in is that for it as with der die das und ist nicht mit von den zu le la les de des et est une que pour dans el los las y en un no por se para"


@dataclass(frozen=True)
class Weak:
    """``sample``, ``sample_bytes``: documents the linear scorer is fitted on, at most (those of
    least hash), and bytes of their whole texts, at most."""

    sample: int = 6000
    sample_bytes: int = 1 << 25
    buckets: int = 1 << 16
    rounds: int = 60
    epochs: int = 40
    rate: float = 0.3
    keep: float = 0.5
    seed: int = 5


LABELLERS = ("words", "symbols", "upper", "word_length", "variety", "stop_words", "repeated_lines", "letters", "neighbours", "pipes")


def _stop_hashes() -> np.ndarray:
    data = np.frombuffer(STOP.encode(), np.uint8)
    return np.unique(W.find_words(data, np.array([0, len(data)])).hash)


def measures(data: np.ndarray, bounds: np.ndarray) -> tuple[W.Words, dict[str, np.ndarray]]:
    """Numbers of each text that the labellers and the scorer look at."""
    n = len(bounds) - 1
    words = W.find_words(data, bounds, lower=True, gap=W.PUNCTUATION)
    text = words.text_of()
    count = words.counts
    size = np.maximum(np.diff(bounds), 1)
    of = np.repeat(np.arange(n), np.diff(bounds))
    share = lambda mask: np.bincount(of[mask], minlength=n) / size
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)
    upper = (data >= 65) & (data <= 90)
    order = np.lexsort((words.hash, text))
    h, t = words.hash[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    variety = np.bincount(t[new], minlength=n)
    some = np.maximum(count, 1)
    stop = np.bincount(text, np.isin(words.hash, _stop_hashes()), n) / some
    same = np.zeros(n)
    if len(h) > 1:
        twin = (words.hash[1:] == words.hash[:-1]) & (text[1:] == text[:-1])
        same = np.bincount(text[1:], twin, n) / some
    symbol = np.isin(data, np.frombuffer(b"#*$%&<>{}[]~^_=\\@!", np.uint8))
    # Lines: the line feed as the only gap.
    gap = np.zeros(256, bool)
    gap[10] = True
    lines = W.find_words(data, bounds, gap=gap)
    lt = lines.text_of()
    order = np.lexsort((lines.hash, lt))
    lh, lo = lines.hash[order], lt[order]
    again = np.zeros(len(lh), bool)
    again[1:] = (lh[1:] == lh[:-1]) & (lo[1:] == lo[:-1])
    repeated = np.bincount(lo[again], minlength=n) / np.maximum(lines.counts, 1)
    return words, {
        "words": count.astype(float), "symbols": share(symbol), "upper": np.bincount(of[upper], minlength=n) / np.maximum(np.bincount(of[letter], minlength=n), 1),
        "word_length": np.bincount(text, words.end - words.start, n) / some, "variety": variety / np.sqrt(some), "stop_words": stop, "repeated_lines": repeated,
        "letters": share(letter), "neighbours": same, "pipes": share(data == 124),
    }


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """Text x labeller, -1, 0 or 1."""
    vote = lambda bad, good: np.where(bad, -1, np.where(good, 1, 0))
    x = m
    return np.stack([
        vote(x["words"] < 4, (x["words"] >= 40) & (x["words"] < 20000)),
        vote(x["symbols"] > 0.04, x["symbols"] < 0.005),
        vote(x["upper"] > 0.4, x["upper"] < 0.1),
        vote((x["word_length"] < 2.5) | (x["word_length"] > 12), (x["word_length"] > 3) & (x["word_length"] < 9)),
        vote((x["variety"] < 2.5) & (x["words"] > 30), (x["variety"] > 4) & (x["words"] > 30)),
        vote((x["stop_words"] < 0.05) & (x["words"] > 10), x["stop_words"] > 0.15),
        vote(x["repeated_lines"] > 0.3, (x["repeated_lines"] < 0.05) & (x["words"] > 0)),
        vote(x["letters"] < 0.6, x["letters"] > 0.75),
        vote(x["neighbours"] > 0.2, (x["neighbours"] < 0.05) & (x["words"] > 10)),
        vote(x["pipes"] > 0.01, x["pipes"] == 0),
    ], 1).astype(np.int8)


def pattern_of(v: np.ndarray) -> np.ndarray:
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(1)


def em(patterns: np.ndarray, counts: np.ndarray, labellers: int, rounds: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good per pattern, P(vote | class, it votes) as labeller x class x vote, prior).

    Starts from a vote in which bad counts fivefold, as labellers call bad only what is
    far off; one pseudo-count per cell. Classes can't swap, since a
    labeller's votes stay more likely in their own class."""
    v = patterns[:, None] // 3 ** np.arange(labellers) % 3 - 1
    q = 1 / (1 + np.exp(5.0 * (v < 0).sum(1) - (v > 0).sum(1)))
    for _ in range(rounds):
        prior = float((q * counts).sum() + 1) / (counts.sum() + 2)
        table = np.empty((labellers, 2, 3))
        for c, weight in ((0, (1 - q) * counts), (1, q * counts)):
            for s in (-1, 1):
                table[:, c, s + 1] = ((v == s) * weight[:, None]).sum(0) + 1
        table[:, :, 1] = 0
        table /= table.sum(2, keepdims=True)
        table[:, :, 1] = 1  # not to vote says nothing, else short texts would count as bad
        good, bad = np.log(table[np.arange(labellers), 1, v + 1]).sum(1), np.log(table[np.arange(labellers), 0, v + 1]).sum(1)
        q = 1 / (1 + np.exp(-np.clip(good - bad + np.log(prior / (1 - prior)), -30, 30)))
    return q, table, prior


def vectors(words: W.Words, m: dict[str, np.ndarray], weak: Weak):
    """Hashed features: (text, bucket, value) of words (root of their share) and numbers' bins."""
    n = len(words.first) - 1
    text = words.text_of()
    key = text.astype(np.int64) * weak.buckets + (words.hash % np.uint64(weak.buckets)).astype(np.int64)
    key, times = np.unique(key, return_counts=True)
    t, b = key // weak.buckets, key % weak.buckets
    value = np.sqrt(times / np.maximum(words.counts, 1)[t])
    bins = []
    for i, name in enumerate(LABELLERS):
        level = np.minimum(np.log2(1 + 100 * m[name]), 15).astype(np.int64)
        bins.append(W.mix((level + 16 * i + 1).astype(np.uint64)) % np.uint64(weak.buckets))
    k = len(bins)
    return np.concatenate([t, np.repeat(np.arange(n), k)]), np.concatenate([b, np.stack(bins, 1).reshape(-1).astype(np.int64)]), np.concatenate([value, np.ones(n * k)])


def _votes(batches):
    for batch in batches:
        for lo, hi, data, bounds in W.slices(batch.column(1)):
            _, m = measures(data, bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(pattern_of(votes(m)))], names=["doc_id", "pattern"])


def _score(weights: np.ndarray, weak: Weak):
    def rows(batches):
        for batch in batches:
            for lo, hi, data, bounds in W.slices(batch.column(1)):
                words, m = measures(data, bounds)
                t, b, x = vectors(words, m, weak)
                z = np.bincount(t, weights[b] * x, hi - lo) + weights[-1]
                pattern = pattern_of(votes(m))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(pattern), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "pattern", "score"])

    return rows


def fit_scorer(texts: pa.Array, posterior, weak: Weak) -> np.ndarray:
    """Logistic weights, the bias last, by Adagrad on the posterior labels. posterior: patterns -> P(good)."""
    parts, base, target = [], 0, []
    for lo, hi, data, bounds in W.slices(texts):
        words, m = measures(data, bounds)
        t, b, x = vectors(words, m, weak)
        parts.append((t + base, b, x))
        base += hi - lo
        target.append(posterior(pattern_of(votes(m))))
    weights = np.zeros(weak.buckets + 1)
    if not base:
        return weights
    t, b, x = (np.concatenate(c) for c in zip(*parts, strict=True))
    y, g = np.concatenate(target), np.full(weak.buckets + 1, 1e-6)
    for _ in range(weak.epochs):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(t, weights[b] * x, base) + weights[-1], -30, 30)))
        d = np.append(np.bincount(b, (y - p)[t] * x, weak.buckets), (y - p).sum()) - 0.01 * weights
        g += d * d
        weights += weak.rate * d / np.sqrt(g)
    return weights


def classify(docs: DataFrame, weak: Weak = Weak()) -> DataFrame:
    """One row per row of ``docs``: doc_id, posterior (of its votes), score, kept.

    Reads ``doc_id`` and ``text``; other columns don't matter, whatever their names. A null text
    is empty. Repeated rows get equal rows; a null doc_id stays null. Very long texts are
    measured whole. A score of exactly ``keep`` is kept. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    plain = take(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    k = len(LABELLERS)
    counted = plain.mapInArrow(_votes, "doc_id long, pattern long").groupBy("pattern").agg(F.count("*").alias("n"))
    found = sorted((r["pattern"], r["n"]) for r in counted.collect())  # at most 3 ** 10 rows
    patterns, counts = np.array([p for p, _ in found], np.int64), np.array([n for _, n in found], float)
    q, _, prior = em(patterns, counts, k, weak.rounds) if len(found) else (np.zeros(0), None, 0.5)
    lookup = dict(zip(patterns.tolist(), q.tolist(), strict=True))
    posterior = lambda p: np.array([lookup.get(int(x), prior) for x in p])
    known = plain.filter("doc_id is not null")
    texts = gather(known, [F.xxhash64("doc_id", F.lit(weak.seed))], weak.sample, weak.sample_bytes).column("text").combine_chunks()
    weights = fit_scorer(texts, posterior, weak)
    scored = plain.mapInArrow(_score(weights, weak), "doc_id long, pattern long, score double")
    table = spark.createDataFrame([(int(p), float(x)) for p, x in zip(patterns, q, strict=True)], "voted long, posterior double")
    met = scored.join(F.broadcast(table), F.col("pattern") == F.col("voted"), "left")  # as many rows as patterns
    return met.select("doc_id", "posterior", "score", (F.col("score") >= weak.keep).alias("kept"))

"""A hierarchical Pitman-Yor language model over the whole vocabulary, and probabilities of documents.

Restaurants: one per context, which is any word of the training texts or a text's start; all have one
parent over all words and the end of a text, whose base is uniform over these and one unknown word. So
the model is a proper distribution. No word, context or pair is left out or merged with others.

Seating is sampled by Gibbs moves: a customer leaves a table (tables of a dish weighted by their
customers) and sits down again, at a table with weight (customers - discount) or at a new one with
weight (strength + discount * tables) * P(dish | parent); a new table sends a customer to the parent.
Samples are averaged.

Pairs (context, word) are dealt by context to buckets of bounded size, once, with the texts that have
them, and stored there, from where the pairs' values go back to their runs of texts; ``Seating`` moves a customer of each of a bucket's dishes at a time. A context
that holds 1 / ``head`` of all tokens is frequent: its pairs are dealt by both words to buckets of their
own, whose seatings know the tables of the rest of their restaurant as of the round before. Words' tables
and probabilities are exchanged with the buckets as rows (bucket, word). What is dealt and stored are
Arrow records, compressed, whose pairs are indexes of their distinct words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbora.llm import words as W
from nimbora.llm.store import Scratch, arrow_batches, take
from nimbora.sources.scratch import shuffles_dropped


END, START = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
_PAIR = np.uint64(0xD1B54A32D192ED03)
DEALT = "b int, first long, pairs binary, texts binary, ids array<long>, sizes array<int>"
ANSWERS = "b int, w array<long>, p array<float>, c array<long>"
ANSWERED = "b int, first long, ids array<long>, sizes array<int>, texts binary"
SUMS = "doc_id long, n_tokens long, n_known long, base_score double, score double"


@dataclass(frozen=True)
class Restaurant:
    """``moves``: Gibbs moves per dish and sweep, at most one per customer. ``burn`` sweeps go
    before the ``samples`` that are averaged; the parent is resampled between ``rounds``.
    ``head`` tells which contexts are dealt over many buckets, ``bucket`` the tokens of one; neither leaves anything out."""

    head: int = 2048
    held_out: int = 7
    remainder: int = 2
    discount: float = 0.8
    strength: float = 5.0
    parent_discount: float = 0.85
    parent_strength: float = 10.0
    rounds: int = 2
    burn: int = 2
    samples: int = 3
    moves: int = 8
    seed: int = 11
    bucket: int = 2_500_000


def seat(counts: np.ndarray, base: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> list[list[int]]:
    """A first seating of each dish's customers, as the sizes of its tables. (One restaurant, plainly;
    ``Seating`` is for many.)

    Tables of a dish grow as in the process itself, in blocks of a hundredth of the
    customers so far, so that a dish of n customers takes log n steps.
    """
    sizes: list[list[int]] = []
    tables = len(counts)
    for n, p in zip(counts.tolist(), base.tolist(), strict=True):
        sat, t = 1, 1
        while sat < n:
            block = min(n - sat, max(1, sat // 100))
            fresh = (strength + discount * tables) * p
            more = int(rng.binomial(block, fresh / (fresh + max(sat - discount * t, 1e-9))))
            t, tables, sat = t + more, tables + more, sat + block
        # Sizes: one customer each, the rest by preference for tables that are there longer.
        share = rng.dirichlet(1.0 / np.arange(1, t + 1)) if t > 1 else np.ones(1)
        extra = rng.multinomial(n - t, share)
        sizes.append((extra + 1).tolist())
    return sizes


def sweep(counts: np.ndarray, base: np.ndarray, sizes: list[list[int]], discount: float, strength: float, moves: int, rng: np.random.Generator) -> int:
    """Gibbs moves in place; the number of tables after them."""
    tables = sum(map(len, sizes))
    for d, own in enumerate(sizes):
        n = int(counts[d])
        if n < 2:
            continue
        u = rng.random((min(n, moves), 2))
        for leave, join in u.tolist():
            at, k = leave * n, 0
            while at >= own[k] and k < len(own) - 1:
                at -= own[k]
                k += 1
            own[k] -= 1
            if not own[k]:
                own[k] = own[-1]
                own.pop()
                tables -= 1
            old = n - 1 - discount * len(own)
            fresh = (strength + discount * tables) * base[d]
            at = join * (old + fresh)
            if at >= old or not own:
                own.append(1)
                tables += 1
                continue
            k = 0
            while k < len(own) - 1 and at >= own[k] - discount:
                at -= own[k] - discount
                k += 1
            own[k] += 1
    return tables


def predictive(counts, base, discount, strength, burn, samples, moves, rng):
    """(averaged probability of a dish beyond its base's share, averaged weight of the base,
    averaged tables per dish)."""
    sizes = seat(counts, base, discount, strength, rng)
    total = counts.sum()
    direct, weight, per_dish = np.zeros(len(counts)), 0.0, np.zeros(len(counts))
    for i in range(burn + samples):
        tables = sweep(counts, base, sizes, discount, strength, moves, rng)
        if i >= burn:
            t = np.array([len(s) for s in sizes], float)
            direct += np.maximum(counts - discount * t, 0) / (total + strength)
            weight += (strength + discount * tables) / (total + strength)
            per_dish += t
    return direct / samples, weight / samples, per_dish / samples


class _Few:
    """Tables of dishes with ``least`` to ``most`` customers: a row per place for a table, 0 where it is free."""

    def __init__(self, d: np.ndarray, n: np.ndarray, least: int, most: int):
        self.d, self.n, self.least, self.most = d, n, least, most
        self.every = np.arange(len(d))
        self.size = np.zeros((most, len(d)), np.int8)

    def leave(self, step: int, rng: np.random.Generator) -> np.ndarray:
        """A customer of each dish that has more than ``step`` goes; the dishes whose table went with it."""
        self.on = self.every if step < self.least else np.flatnonzero(self.n > step)
        x = (rng.random(len(self.on)) * self.n[self.on]).astype(np.int8)
        up, k = np.zeros(len(x), np.int8), np.zeros(len(x), np.int64)
        for row in self._places()[:-1]:
            up += row
            k += up <= x
        self.size[k, self.on] -= 1
        return self.d[self.on[self.size[k, self.on] == 0]]

    def join(self, old: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
        """It sits down again; the dishes with a new table."""
        at = rng.random(len(old)) * (old + fresh)
        up, k = np.zeros(len(at)), np.zeros(len(at), np.int64)
        weight = np.append(0.0, np.arange(1, self.most + 1) - discount)
        for row in self._places()[:-1]:
            up += weight[row]
            k += up <= at
        new = (at >= old) | (self.size[k, self.on] == 0)
        k[new] = (self.size[:, self.on[new]] == 0).argmax(axis=0)
        self.size[k, self.on] += 1
        return self.d[self.on[new]]

    def _places(self) -> np.ndarray:
        return self.size if self.on is self.every else self.size[:, self.on]

    def moved(self) -> np.ndarray:
        return self.d[self.on]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        place, i = np.nonzero(self.size)
        return self.d[i], self.size[place, i].astype(np.int64)


class _Many:
    """Tables of dishes with any number of customers, one after another, by dish."""

    most = 1 << 62

    def __init__(self, d: np.ndarray, n: np.ndarray, dish: np.ndarray, size: np.ndarray):
        self.d, self.n, self.dish, self.size = d, n, dish, size

    def leave(self, step: int, rng: np.random.Generator) -> np.ndarray:
        self.on = np.flatnonzero(self.n > step)
        self.first = np.searchsorted(self.dish, self.on)
        up = np.cumsum(self.size)
        x = (rng.random(len(self.on)) * self.n[self.on]).astype(np.int64)
        left = np.searchsorted(up, up[self.first] - self.size[self.first] + x, "right")
        self.size[left] -= 1
        return self.d[self.on[self.size[left] == 0]]

    def join(self, old: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
        last = np.searchsorted(self.dish, self.on, "right") - 1
        weight = np.where(self.size > 0, self.size - discount, 0.0)
        up = np.cumsum(weight)
        at = rng.random(len(old)) * (old + fresh)
        to = np.clip(np.searchsorted(up, up[self.first] - weight[self.first] + at, "right"), self.first, last)
        new = (at >= old) | (self.size[to] == 0)
        self.size[to[~new]] += 1
        self.size = np.insert(self.size, last[new] + 1, 1)
        self.dish = np.insert(self.dish, last[new] + 1, self.on[new])
        there = self.size > 0
        self.size, self.dish = self.size[there], self.dish[there]
        return self.d[self.on[new]]

    def moved(self) -> np.ndarray:
        return self.d[self.on]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        return self.d[self.dish], self.size


class Seating:
    """The tables of many restaurants' dishes, moved together: a step moves one customer of each dish.

    ``counts`` and ``base`` of each dish, its restaurant ``of``, and ``others``: tables of a restaurant
    that are not among these dishes'.
    """

    def __init__(self, counts, base, of, others, discount: float, strength: float, rng: np.random.Generator):
        self.n, self.base, self.of, self.rng = counts.astype(np.int64), base, of, rng
        self.discount, self.strength = discount, strength
        self.t = np.ones(len(counts), np.int64)
        self.all = others + np.bincount(of, minlength=len(others))
        # As in seat(): blocks of a hundredth of the customers so far.
        sat, live = np.ones(len(counts), np.int64), np.flatnonzero(self.n > 1)
        while len(live):
            block = np.minimum(self.n[live] - sat[live], np.maximum(1, sat[live] // 100))
            fresh = self._fresh(live)
            chance = fresh / (fresh + np.maximum(sat[live] - discount * self.t[live], 1e-9))
            more = (rng.random(len(live)) < chance).astype(np.int64)
            several = np.flatnonzero(block > 1)
            more[several] = rng.binomial(block[several], chance[several])
            self._count(live, more)
            sat[live] += block
            live = live[sat[live] < self.n[live]]
        dish = np.repeat(np.arange(len(counts)), self.t)
        last = np.cumsum(self.t)
        first = last - self.t
        place = np.arange(len(dish)) - first[dish]
        share = rng.standard_gamma(1.0 / (place + 1)) + 1e-12
        up = np.cumsum(share)
        before = np.append(0.0, up)[first]
        whole = np.append(0.0, up)[last] - before
        to = np.rint((up - before[dish]) / whole[dish] * (self.n - self.t)[dish]).astype(np.int64)
        to[last - 1] = self.n - self.t
        extra = to.copy()
        extra[1:] -= to[:-1]
        extra[first] = to[first]
        size = extra + 1
        # Alike dishes are moved at once: those of few customers place by place.
        self.kinds = []
        for least, most in ((2, 2), (3, 3), (4, 4), (5, 8), (9, 16), (17, 1 << 62)):
            d = np.flatnonzero((self.n >= least) & (self.n <= most))
            if not len(d):
                continue
            mine = (self.n[dish] >= least) & (self.n[dish] <= most)
            at = np.searchsorted(d, dish[mine])
            if most < 1 << 62:
                kind = _Few(d, self.n[d], least, most)
                kind.size[place[mine], at] = size[mine]
            else:
                kind = _Many(d, self.n[d], at, size[mine])
            self.kinds.append(kind)

    def _fresh(self, d):
        return (self.strength + self.discount * self.all[self.of[d]]) * self.base[d]

    def _count(self, d, more) -> None:
        self.t[d] += more
        if 8 * len(d) < len(self.all):
            np.add.at(self.all, self.of[d], more)
        else:
            self.all += np.bincount(self.of[d], np.broadcast_to(more, len(d)), len(self.all))

    def sweep(self, moves: int) -> None:
        for step in range(moves):
            kinds = [kind for kind in self.kinds if kind.most > step]
            for kind in kinds:
                self._count(kind.leave(step, self.rng), -1)
            joined = []
            for kind in kinds:
                d = kind.moved()
                joined.append(kind.join(self.n[d] - 1 - self.discount * self.t[d], self._fresh(d), self.discount, self.rng))
            for d in joined:
                self._count(d, 1)

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        single = np.flatnonzero(self.n == 1)
        dish, size = (np.concatenate(x) for x in zip((single, np.ones(len(single), np.int64)), *[kind.tables() for kind in self.kinds], strict=True))
        order = np.argsort(dish, kind="stable")
        return dish[order], size[order]

    @property
    def dish(self) -> np.ndarray:
        """The dish of each table."""
        return self._tables()[0]

    @property
    def size(self) -> np.ndarray:
        """The customers of each table."""
        return self._tables()[1]

    def mean_tables(self, burn: int, samples: int, moves: int) -> np.ndarray:
        total = np.zeros(len(self.n))
        for i in range(burn + samples):
            self.sweep(moves)
            if i >= burn:
                total += self.t
        return total / samples


def _symbols(words: W.Words) -> np.ndarray:
    """Hashes of every text's words and its end."""
    size = words.counts + 1
    symbol = np.full(int(size.sum()), END)
    inner = np.ones(len(symbol), bool)
    inner[np.cumsum(size) - 1] = False
    symbol[inner] = words.hash
    return symbol


def _key(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return W.mix(W.mix(context * _PAIR) + symbol)


def _is_in(hashes: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(hashes):
        return np.zeros(len(x), bool)
    return hashes[np.minimum(np.searchsorted(hashes, x), len(hashes) - 1)] == x


def _bucket(context: np.ndarray, symbol: np.ndarray, frequent: np.ndarray, buckets: int) -> np.ndarray:
    """By context; a frequent one's pairs by word, and those of two frequent ones by both."""
    many = _is_in(frequent, context)
    word = np.where(_is_in(frequent, symbol) | (symbol == END), _key(context, symbol), symbol)
    return (W.mix(np.where(many, word, context)) % np.uint64(buckets)).astype(np.int64) + many * buckets


def _by_bucket(b: np.ndarray) -> np.ndarray:
    return np.argsort(b.astype(np.uint16) if len(b) and b.max() < 1 << 16 else b, kind="stable")


def _list(values: np.ndarray, bounds: np.ndarray, kind=pa.int64()) -> pa.Array:
    values = values.view(np.int64) if values.dtype == np.uint64 else values
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values).cast(kind))


def _flat(column, dtype=np.int64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)


def _common(head: int):
    """Words that are frequent in a slice of the texts (so all that are frequent altogether), and a row of totals."""

    def rows(batches):
        for batch in batches:
            for lo, hi, data, bounds in W.slices(batch.column(0), 1 << 21):
                train = batch.column(1)[lo:hi].to_numpy(zero_copy_only=False)
                words = W.find_words(data, bounds, lower=True)
                used = int(words.counts[train].sum())
                h, n = np.unique(words.hash, return_counts=True)
                some = n * head >= len(words.hash)
                word = pa.concat_arrays([W.as_long(h[some]), pa.nulls(1, pa.int64())])
                yield pa.RecordBatch.from_arrays([word, W.as_long(np.append(n[some], len(words.hash) + hi - lo)), W.as_long(np.append(n[some] * 0, used)), W.as_long(np.append(n[some] * 0, int(train.sum())))], names=["word", "n", "used", "texts"])

    return rows


def _record(**columns: np.ndarray) -> bytes:
    """Columns of any lengths as one compressed Arrow record."""
    batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in columns.values()], names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _columns(record: pa.Scalar) -> list[np.ndarray]:
    with pa.ipc.open_stream(record.as_buffer()) as lines:
        return [column.flatten().to_numpy(zero_copy_only=False) for column in lines.read_next_batch().columns]


def _dealt(b: list[int], first: list, pairs: list, texts: list, ids: list, sizes: list) -> pa.Table:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
    return pa.table([pa.array(x, kind) for x, kind in zip((b, first, pairs, texts, ids, sizes), kinds, strict=True)], names=["b", "first", "pairs", "texts", "ids", "sizes"])


def _deal(frequent: np.ndarray, buckets: int, limit: int = 1 << 21):
    """(doc_id, text, train, row), rows numbered in turn -> for runs of texts of about ``limit`` tokens, a row per
    bucket: its distinct words, its pairs as indexes of them with their training tokens (0 where only held-out texts
    have one), and the texts that have them. A run's first row also has its texts' ids and sizes."""

    def row_batches(held, first, ids):
        symbol, train, sizes = ([h[i] for h in held] for i in range(3))
        held.clear()
        symbol, train, sizes = np.concatenate([*symbol, [START]]), np.concatenate(train), np.concatenate(sizes)
        # Words by their place among the run's, so that pairs and texts are sorted as one number.
        order = np.argsort(symbol)
        symbol = symbol[order]
        new = np.ones(len(symbol), bool)
        new[1:] = symbol[1:] != symbol[:-1]
        words, at = symbol[new], np.empty(len(symbol), np.int32)
        del symbol
        at[order] = np.cumsum(new, dtype=np.int32) - 1
        del order, new
        both = np.empty(len(at) - 1, np.int64)
        both[1:] = at[:-2]
        both[np.cumsum(sizes) - sizes] = at[-1]
        wide, low = max(1, (len(words) - 1).bit_length()), (len(train) - 1).bit_length()
        both <<= wide
        both |= at[:-1]
        del at
        both <<= low
        both |= np.repeat(np.arange(len(sizes)), sizes)
        both.sort()
        link = np.ones(len(both), bool)
        link[1:] = both[1:] != both[:-1]
        links = np.flatnonzero(link)
        times = np.diff(np.append(links, len(both))).astype(np.int32)
        code, doc = both[links] >> low, (both[links] & ((1 << low) - 1)).astype(np.int16)
        del both, link
        pair = np.ones(len(code), bool)
        pair[1:] = code[1:] != code[:-1]
        pairs = np.flatnonzero(pair)
        n = np.add.reduceat(times * train[doc], pairs)
        u, w = (code[pairs] >> wide).astype(np.int32), (code[pairs] & ((1 << wide) - 1)).astype(np.int32)
        del code, pair, links
        ends = np.append(pairs, len(doc))
        part = range(0, len(u), 1 << 18)
        b = np.concatenate([_bucket(words[u[i : i + part.step]], words[w[i : i + part.step]], frequent, buckets) for i in part])
        order = _by_bucket(b)
        of, start = np.unique(b[order], return_index=True)
        rank = np.empty(len(words), np.int32)
        for i, (bucket, lo, hi) in enumerate(zip(of.tolist(), start.tolist(), np.append(start[1:], len(order)).tolist(), strict=True)):
            mine = order[lo:hi]
            some = np.unique(np.concatenate([u[mine], w[mine]]))
            rank[some] = np.arange(len(some))
            each = ends[mine + 1] - ends[mine]
            own = np.repeat(ends[mine] - np.cumsum(each) + each, each) + np.arange(each.sum())
            record = _record(words=words[some], u=rank[u[mine]], w=rank[w[mine]], n=n[mine].astype(np.int32))
            texts = _record(links=each.astype(np.int32), doc=doc[own], times=times[own])
            none = i > 0
            yield _dealt([bucket], [first], [record], [texts], [None if none else pa.concat_arrays(ids).to_pylist()], [None if none else sizes]).to_batches()[0]

    def rows(batches):
        held, ids, first, texts, size = [], [], 0, 0, 0
        for batch in batches:
            for lo, hi, data, bounds in W.slices(batch.column(1)):
                words = W.find_words(data, bounds, lower=True)
                symbol = _symbols(words)
                # A very long text stays alone.
                if held and (size + len(symbol) > limit + (1 << 20) or texts + hi - lo > 1 << 15):
                    yield from row_batches(held, first, ids)
                    held, ids, texts, size = [], [], 0, 0
                if not held:
                    first = batch.column(3)[lo].as_py()
                held.append((symbol, batch.column(2)[lo:hi].to_numpy(zero_copy_only=False), words.counts + 1))
                ids.append(batch.column(0)[lo:hi])
                texts, size = texts + hi - lo, size + len(symbol)
                if size >= limit:
                    yield from row_batches(held, first, ids)
                    held, ids, texts, size = [], [], 0, 0
        if held:
            yield from row_batches(held, first, ids)

    return rows


def _merge(rows: pa.Table) -> pa.Table:
    """A bucket's rows -> first one of its distinct pairs, by context and word, then for each run its texts, with their
    pairs' places there (as steps)."""
    parts = [_columns(x) for x in rows["pairs"]]
    words, at = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
    codes, first, wide = [], 0, max(1, (len(words) - 1).bit_length())
    for own, u, w, _ in parts:
        here = at[first : first + len(own)]
        codes.append(here[u] << wide | here[w])
        first += len(own)
    found = np.unique(np.concatenate(codes))
    n, texts = np.zeros(len(found), np.int64), []
    for x, code, part in zip(rows["texts"], codes, parts, strict=True):
        place = np.searchsorted(found, code)
        n[place] += part[3]
        links, doc, times = _columns(x)
        texts.append(_record(steps=np.diff(place, prepend=0).astype(np.int32), links=links, doc=doc, times=times))
    u, w = found >> wide, found & ((1 << wide) - 1)
    kind = np.int32 if n.max() < 1 << 31 else np.int64
    pairs = _record(words=words, u=u.astype(np.int32), w=w.astype(np.int32), n=n.astype(kind))
    b, none = rows["b"].to_pylist(), [None] * len(rows)
    head = _dealt(b[:1], [None], [pairs], [None], [None], [None])
    rest = _dealt(b, rows["first"].to_pylist(), none, texts, rows["ids"].to_pylist(), rows["sizes"].to_pylist())
    return pa.concat_tables([head, rest])


def _requests(buckets: int):
    """Of each bucket: its words with (contexts, tokens) in training texts, and its frequent contexts (``of_context``)."""

    def rows(batches):
        for batch in batches:
            for b, record in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words, u, w, n = _columns(record)
                for of_context, index in ((False, w), (True, u)):
                    if of_context and b < buckets:
                        continue
                    x, c = np.bincount(index, n > 0, len(words)), np.bincount(index, n, len(words))
                    k = np.flatnonzero(np.bincount(index, minlength=len(words)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), b, np.int32)), pa.array(np.full(len(k), of_context)), W.as_long(words[k]), W.as_long(x[k]), W.as_long(c[k])], names=["b", "of_context", "key", "tables", "c"])

    return rows


def _parent(tables: float, share: float, base: float, model: Restaurant, round_: int, limit: int = 1 << 18):
    """Mean tables of words (word, c1, c) in the parent, up to ``limit`` of them (and a frame) together; ``tables`` of
    all words as of the round before, ``share`` a word's."""

    def seated(pdf: pd.DataFrame, i: int) -> pd.DataFrame:
        c1 = pdf["c1"].to_numpy()
        rng = np.random.default_rng([model.seed, 1 << 21, round_, i, int(c1.sum()), len(pdf)])
        others = np.array([max(0.0, tables - share * len(pdf))])
        seating = Seating(c1, np.full(len(c1), base), np.zeros(len(c1), np.int64), others, model.parent_discount, model.parent_strength, rng)
        return pdf[["word", "c1", "c"]].assign(t1=seating.mean_tables(model.burn, model.samples, model.moves))

    def rows(frames):
        held, size, i = [], 0, 0
        for pdf in frames:
            held.append(pdf)
            size += len(pdf)
            if size >= limit:
                yield seated(pd.concat(held, ignore_index=True), i)
                held, size, i = [], 0, i + 1
        if size:
            yield seated(pd.concat(held, ignore_index=True), i)

    return rows


def _pack(batches, limit: int = 1 << 19):
    """Rows (b, w, p, c) -> a row per bucket of up to ``limit`` of them."""

    def row_batches(held):
        b, w, p, c = (np.concatenate(x) for x in zip(*held, strict=True))
        order = _by_bucket(b)
        ids, first = np.unique(b[order], return_index=True)
        bounds = np.append(first, len(b))
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), _list(w[order], bounds), _list(p[order], bounds, pa.float32()), _list(c[order], bounds)], names=["b", "w", "p", "c"])

    held, size = [], 0
    for batch in batches:
        if len(batch):
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            size += len(batch)
        if size >= limit:
            yield from row_batches(held)
            held, size = [], 0
    if held:
        yield from row_batches(held)


@dataclass(frozen=True)
class _Frequent:
    """Frequent contexts: hashes (sorted), training tokens, and tables after the round before."""

    hashes: np.ndarray
    tokens: np.ndarray
    tables: np.ndarray


def _seated(b: int, words, u, w, n, known: pa.Table, unknown: float, frequent: _Frequent, buckets: int, model: Restaurant, round_: int):
    """(mean tables of each pair, restaurant of each, its tokens, its mean tables among these pairs, P of each of
    ``words``, their counts, contexts) of a bucket; ``u`` and ``w`` are places in ``words``, which are sorted."""
    p, c = np.full(len(words), unknown), np.zeros(len(words), np.int64)
    place = np.searchsorted(words, _flat(known["w"]).view(np.uint64))
    p[place], c[place] = _flat(known["p"], float), _flat(known["c"])
    context = np.zeros(len(words), bool)
    context[u] = True
    contexts, of = words[context], (np.cumsum(context) - 1)[u]
    seen = n > 0
    tokens, others = np.bincount(of, n, len(contexts)), np.zeros(len(contexts))
    if b >= buckets:
        i = np.searchsorted(frequent.hashes, contexts)
        tokens = frequent.tokens[i].astype(float)
        others = np.maximum(0.0, frequent.tables[i] - np.bincount(of[seen], minlength=len(contexts)))
    rng = np.random.default_rng([model.seed, round_, b])
    t = np.zeros(len(n))
    t[seen] = 1.0
    more = n > 1  # a single customer has a table always
    others = others + np.bincount(of[seen & ~more], minlength=len(contexts))
    if more.any():
        t[more] = Seating(n[more], p[w[more]], of[more], others, model.discount, model.strength, rng).mean_tables(model.burn, model.samples, model.moves)
    return t, of, tokens, np.bincount(of, t, len(contexts)), p, c, contexts


def _tables(unknown: float, frequent: _Frequent, buckets: int, model: Restaurant, round_: int):
    """Customers that a bucket sends to the parent, by word, and tables of its frequent contexts (``of_context``)."""

    def rows(key, pairs: pa.Table, known: pa.Table) -> pa.Table:
        words, u, w, n = _columns(pairs["pairs"][0])
        b = key[0].as_py()
        t, _, _, mine, _, _, contexts = _seated(b, words, u, w, n, known, unknown, frequent, buckets, model, round_)
        sent = np.bincount(w, t, len(words))
        some = np.flatnonzero(sent)
        if b < buckets:
            contexts, mine = contexts[:0], mine[:0]
        of_context = np.append(np.zeros(len(some), bool), np.ones(len(mine), bool))
        return pa.table([pa.array(of_context), W.as_long(np.append(words[some], contexts)), pa.array(np.append(sent[some], mine))], names=["of_context", "key", "tables"])

    return rows


def _values(b: int, words, u, w, n, known: pa.Table, unknown: float, frequent: _Frequent, totals: np.ndarray, buckets: int, model: Restaurant, round_: int):
    """(log10 P, count of the word) of each pair of a bucket; ``totals``: mean tables of the frequent contexts in this very round."""
    t, of, customers, tables, p, c, contexts = _seated(b, words, u, w, n, known, unknown, frequent, buckets, model, round_)
    if b >= buckets:
        tables = totals[np.searchsorted(frequent.hashes, contexts)]
    # A context without customers has its parent's probabilities.
    all_ = customers + model.strength
    return np.log10((n - model.discount * t) / all_[of] + ((model.strength + model.discount * tables) / all_)[of] * p[w]), c[w]


def _answer(*scoring):
    """A bucket as it is stored -> for each run its texts there, with the values of their pairs. So what is sent is in
    proportion to the pairs of the runs, however many buckets a text meets."""

    def rows(key, stored: pa.Table, known: pa.Table) -> pa.Table:
        (record,) = (x for x in stored["pairs"] if x.is_valid)
        logp, c = _values(key[0].as_py(), *_columns(record), known, *scoring)
        logp, c = logp.astype(np.float32), c.astype(np.int32 if c.max() < 1 << 31 else np.int64)
        rest = stored.filter(pc.is_valid(stored["texts"]))
        texts = []
        for steps, links, doc, times in map(_columns, rest["texts"]):
            at = np.cumsum(steps)
            texts.append(_record(links=links, doc=doc, times=times, logp=logp[at], c=c[at]))
        return rest.select(["b", "first", "ids", "sizes"]).append_column("texts", pa.array(texts, pa.binary()))

    return rows


def _add_up(texts: int, parts, denominator: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Known tokens, base and score of each of a run's texts, from parts (links, doc, times, log10 P, count)."""
    known, base, score = np.zeros((3, texts))
    for links, doc, times, logp, c in parts:
        for total, x in ((known, c > 0), (base, np.log10((c + 1) / denominator)), (score, logp)):
            total += np.bincount(doc, times * np.repeat(x, links), texts)
    return known.astype(np.int64), base, score


def _sums(denominator: float):
    """What a run's buckets answered -> a row per text."""

    def rows(answered: pa.Table) -> pa.Table:
        answered = answered.take(pc.sort_indices(answered["b"]))
        one = answered.filter(pc.is_valid(answered["sizes"])).combine_chunks()
        ids, sizes = one["ids"].combine_chunks().flatten(), _flat(one["sizes"])
        sums = _add_up(len(sizes), map(_columns, answered["texts"]), denominator)
        return pa.table([ids, W.as_long(sizes), *map(pa.array, sums)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return rows


def _score(unknown: float, frequent: _Frequent, totals: np.ndarray, buckets: int, denominator: float, model: Restaurant, round_: int):
    """Both steps, for one bucket's pairs (u, w, n) and runs (first, pair, links, doc, times, sizes) given by hashes."""

    def rows(key, pairs: pa.Table, both: pa.Table) -> pa.Table:
        known, runs = both.filter(pc.is_valid(both["w"])).select(["w", "p", "c"]), both.filter(pc.is_valid(both["pair"]))
        u, w, n = _flat(pairs["u"]).view(np.uint64), _flat(pairs["w"]).view(np.uint64), _flat(pairs["n"])
        words, at = np.unique(np.append(u, w), return_inverse=True)
        logp, c = _values(key[0].as_py(), words, at[: len(u)], at[len(u) :], n, known, unknown, frequent, totals, buckets, model, round_)
        pair = _key(u, w)
        order = np.argsort(pair)
        tables = []
        for i in range(len(runs)):
            run, links, doc, times, sizes = (_flat(runs[x][i : i + 1]) for x in ("pair", "links", "doc", "times", "sizes"))
            at = order[np.searchsorted(pair, run.view(np.uint64), sorter=order)]
            sums = _add_up(len(sizes), [(links, doc, times, logp[at], c[at])], denominator)
            tables.append(pa.table([W.as_long(runs["first"][i].as_py() + np.arange(len(sizes))), *map(pa.array, sums)], names=["row", "known", "base", "score"]))
        return pa.concat_tables(tables)

    return rows


def held_out(model: Restaurant):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % model.held_out == model.remainder


def score_documents(docs: DataFrame, model: Restaurant = Restaurant()) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Reads ``doc_id`` and ``text``; other columns don't matter, whatever their names. A null or
    empty text has its end as its only token. Rows that repeat a doc_id get a row each; a null
    doc_id hashes as an empty string and stays null. Very long texts are scored whole. An empty
    table gives an empty result; without training rows every token is unknown.
    """
    with shuffles_dropped(docs.sparkSession):
        return _fit_and_score(docs, model)


def _fit_and_score(docs: DataFrame, model: Restaurant) -> DataFrame:
    spark = docs.sparkSession
    arrow_batches(spark)
    store = Scratch(spark, "pitman-yor")
    plain = take(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = plain.select("text", (~held_out(model)).alias("train"))
    common = store.save("common", marked.mapInArrow(_common(model.head), "word long, n long, used long, texts long").groupBy("word").agg(*[F.sum(x).alias(x) for x in ("n", "used", "texts")]))
    whole = common.filter("word is null").first()
    tokens, used, texts = (whole["n"], whole["used"], whole["texts"]) if whole else (0, 0, 0)
    total = used + texts
    often = [r["word"] for r in common.filter(F.col("word").isNotNull() & (F.col("n") * model.head >= tokens)).collect()]  # at most ``head``
    hashes = np.unique(np.append(np.array(often, np.int64).view(np.uint64), START))
    buckets = 1 + tokens // model.bucket

    numbered = plain.withColumn("train", ~held_out(model)).withColumn("row", F.monotonically_increasing_id())
    stored = store.save("pairs", numbered.mapInArrow(_deal(hashes, buckets), DEALT).groupBy("b").applyInArrow(_merge, DEALT), key="b", files=1 + buckets // 2)
    pairs = stored.filter("pairs is not null").select("b", "pairs")
    asked = pairs.mapInArrow(_requests(buckets), "b int, of_context boolean, key long, tables long, c long")
    words = store.save("words", asked.filter("not of_context").groupBy(F.col("key").alias("word")).agg(F.sum("tables").alias("c1"), F.sum("c").alias("c")).filter("c > 0"))
    vocabulary = words.count()
    denominator = float(total + vocabulary + 1)
    unit = 1.0 / (vocabulary + 1)
    often_pairs = pairs.filter(F.col("b") >= buckets)
    often_asked = often_pairs.mapInArrow(_requests(buckets), asked.schema)
    frequent = _Frequent(hashes, *_of_contexts(often_asked, hashes, "c", "tables"))

    def probabilities(words: DataFrame, tables: float, round_: int):
        """Words with P(word) of the parent, that of an unknown word, and all tables."""
        customers = words.agg(F.coalesce(F.sum("c1"), F.lit(0))).first()[0]
        sat = store.save(f"parent{round_}", words.mapInPandas(_parent(tables, tables * 1.0 / max(1, vocabulary), unit, model, round_), "word long, c1 long, c long, t1 double"))
        tables = float(sat.agg(F.coalesce(F.sum("t1"), F.lit(0.0))).first()[0])
        spread = (model.parent_strength + model.parent_discount * tables) / (customers + model.parent_strength) * unit
        p = (F.col("c1") - model.parent_discount * F.col("t1")) / F.lit(customers + model.parent_strength) + F.lit(spread)
        return sat.select("word", "c", p.cast("float").alias("p")), spread, tables

    def answers(asked: DataFrame, words: DataFrame) -> DataFrame:
        return asked.filter("not of_context").select("b", F.col("key").alias("w")).join(words, F.col("w") == F.col("word")).select("b", "w", "p", "c").mapInArrow(_pack, ANSWERS)

    tables = float(vocabulary)
    for r in range(model.rounds - 1):
        known, unknown, tables = probabilities(words, tables, r)
        sent = store.save(f"sent{r}", pairs.groupBy("b").cogroup(answers(asked, known).groupBy("b")).applyInArrow(_tables(unknown, frequent, buckets, model, r), "of_context boolean, key long, tables double"))
        frequent = _Frequent(hashes, frequent.tokens, *_of_contexts(sent, hashes, "tables"))
        counts = sent.filter("not of_context").groupBy(F.col("key").alias("word")).agg(F.ceil(F.sum("tables")).cast("long").alias("c1"))
        words = store.save(f"words{r}", counts.join(words.select("word", "c"), "word"))
    last = model.rounds - 1
    known, unknown, _ = probabilities(words, tables, last)
    # Frequent contexts' tables of the last round: the same seating as in the scores, whose parts meet here.
    seated = often_pairs.groupBy("b").cogroup(answers(often_asked, known).groupBy("b")).applyInArrow(_tables(unknown, frequent, buckets, model, last), "of_context boolean, key long, tables double")
    (totals,) = _of_contexts(seated, hashes, "tables")

    answered = stored.groupBy("b").cogroup(answers(asked, known).groupBy("b")).applyInArrow(_answer(unknown, frequent, totals, buckets, model, last), ANSWERED)
    out = answered.groupBy("first").applyInArrow(_sums(denominator), SUMS)
    store.drop("common", *[f"{x}{r}" for r in range(last) for x in ("parent", "sent")])
    return out.select("doc_id", held_out(model).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _of_contexts(rows: DataFrame, hashes: np.ndarray, *columns: str) -> list[np.ndarray]:
    """Sums of ``columns`` of the frequent contexts, in the order of ``hashes``: at most ``head`` + 1 rows."""
    found = {r["key"]: r for r in rows.filter("of_context").groupBy("key").agg(*[F.sum(c).alias(c) for c in columns]).collect()}
    return [np.array([found[h][c] if h in found else 0 for h in hashes.view(np.int64).tolist()], float) for c in columns]

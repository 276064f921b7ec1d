"""Substring deduplication by relative Lempel-Ziv parsing.

The reference is the whole corpus, cut into blocks at content-defined anchors: of every
``width``-word window, the least hash among its ``anchor``-word runs. Two documents that
share a window share its anchor. The blocks of one anchor are factored in the order of their
documents: at each word the index of all earlier documents' blocks tells a reference whose next
``width`` words are the same, and the factor goes on for as long as the words agree, word by
word. Shorter factors are literals. The first window that crosses a factor's end is looked up
next, so none is lost where the greedy parse changes its reference. A document's factors are then
strung together over its blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbora.llm import words as W
from nimbora.llm.store import Scratch, arrow_batches, take


@dataclass(frozen=True)
class Factors:
    """A window of ``width`` words contains ``width - anchor + 1`` runs of ``anchor`` words."""

    width: int = 50
    anchor: int = 25
    #: Ids of documents up to which they are broadcast (8 MB), to leave other texts unshuffled; more are joined.
    broadcast_ids: int = 1_000_000
    #: Different blocks of one anchor up to which one index holds them; those of more are looked up window by window,
    #: in a join that spreads them.
    group_blocks: int = 4096


def least_of(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every ``span`` neighbours, by doubling."""
    out, have = values, 1
    while have < span:
        step = min(have, span - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def window_anchors(words: W.Words, f: Factors) -> tuple[np.ndarray, np.ndarray]:
    """First word of every window, and its anchor's hash. Runs that cross a text's end can
    only count in windows that do, which are left out."""
    n = len(words.hash)
    last = np.repeat(words.first[1:], words.counts)
    at = np.flatnonzero(np.arange(n) + f.width <= last)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    run = np.arange(n - f.anchor + 1)
    runs = W.run_hashes(words.hash, run, run + f.anchor, 0xE7037ED1A0B428DB)
    return at, least_of(runs, f.width - f.anchor + 1)[at]


def parse(hits: list[dict], n: int, width: int) -> list[tuple[int, int, int, int]]:
    """(first word, words, reference document, its first word) of a document's factors.

    A hit is a run of windows that one reference document holds in a row. Greedy from the
    left: a factor takes the hit that reaches furthest, then goes on while the next hit of
    the same reference continues it. Where it ends, the windows across its boundary belong
    to the factor that begins there, so factors may overlap by less than a window.
    """
    out: list[list[int]] = []
    done = -1
    for h in sorted(hits, key=lambda h: (h["place"], -h["n"])):
        first, last = (0, n - width) if h["n"] < 0 else (h["place"], h["place"] + h["n"] - 1)
        if last <= done or last < first:
            continue
        if out and out[-1][2] == h["ref"] and first <= done + 1 and first - out[-1][0] == h["ref_place"] - out[-1][3]:
            out[-1][1] = last + width - out[-1][0]
        else:
            skip = max(0, done + 1 - first)
            out.append([first + skip, last + width - first - skip, h["ref"], h["ref_place"] + skip])
        done = last
    return [tuple(x) for x in out]


def _sliced(batch, index: int):
    for lo, hi, data, bounds in W.slices(batch.column(index)):
        yield lo, hi, data, W.find_words(data, bounds)


SPOT = "anchor long, doc_id long, place int, run long, n int"
WINDOW = 0x8EBC6AF09C88C6E3


def _spots(f: Factors, full: bool):
    """(doc_id, text), and th without ``full`` -> a row per run of consecutive windows of one anchor: with ``full``
    the run's first window, the hash of all its words, and its number of windows."""

    def rows(batches):
        for batch in batches:
            for lo, hi, _, words in _sliced(batch, 1):
                at, hashes = window_anchors(words, f)
                text = words.text_of()[at] if len(at) else at
                new = np.ones(len(at), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
                first = np.flatnonzero(new)
                row = pa.array(lo + text[first], pa.int64())
                anchors = W.as_long(hashes[first])
                if not full:
                    yield pa.RecordBatch.from_arrays([anchors, batch.column(2).take(row)], names=["anchor", "th"])
                    continue
                bounds = np.append(first, len(at))
                ends = at[bounds[1:] - 1] + f.width if len(first) else first
                run = W.run_hashes(words.hash, at[first], ends, 0x589965CC75374CC3)
                place = pa.array((at[first] - words.first[text[first]]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([anchors, batch.column(0).take(row), place, W.as_long(run), pa.array(np.diff(bounds).astype(np.int32))], names=["anchor", "doc_id", "place", "run", "n"])

    return rows


BLOCK = "window long, doc_id long, place long, anchor long, words binary"


def _blocks_at(f: Factors):
    """(doc_id, text, spans of place, n and anchor) -> a row per span: the words of its windows, joined by one space. Spans
    without an anchor give a row per window instead: its words' hash."""

    def rows(batches):
        for batch in batches:
            for lo, hi, data, words in _sliced(batch, 1):
                raw = data.tobytes()
                for i in range(hi - lo):
                    first, last = int(words.first[i]), int(words.first[i + 1])
                    top = last - first - f.width  # of rows that repeat a doc_id, another may be longer
                    spans = [x for x in batch.column(2)[lo + i].as_py() if x["place"] <= top]
                    blocks = [x for x in spans if x["anchor"] is not None]
                    loose = [np.arange(x["place"], min(x["place"] + x["n"], top + 1)) for x in spans if x["anchor"] is None]
                    at = np.unique(np.concatenate(loose)) if loose else np.zeros(0, np.int64)
                    windows = W.run_hashes(words.hash, first + at, first + at + f.width, WINDOW).view(np.int64).tolist()
                    texts = []
                    for x in blocks:
                        a, b = first + x["place"], min(first + x["place"] + x["n"] + f.width - 1, last)
                        texts.append(b" ".join(raw[s:e] for s, e in zip(words.start[a:b].tolist(), words.end[a:b].tolist(), strict=True)))
                    none, m = [None], len(blocks)
                    cols = [
                        (none * m + windows, pa.int64()),
                        ([batch.column(0)[lo + i].as_py()] * (m + len(at)), pa.int64()),
                        ([x["place"] for x in blocks] + at.tolist(), pa.int64()),
                        ([x["anchor"] for x in blocks] + none * len(at), pa.int64()),
                        (texts + none * len(at), pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], names=["window", "doc_id", "place", "anchor", "words"])

    return rows


class References:
    """The blocks of one anchor, in the order of their documents, and where each of their windows stands first.

    Windows are found by a hash and compared by their bytes. Blocks of the document that is
    being parsed wait until it is done, so that a document is no reference of its own.
    """

    def __init__(self, width: int):
        self.width = width
        self.at: dict[int, list[tuple[int, int]]] = {}
        self.blocks: list[tuple[int, int, list[bytes]]] = []  # document, its first word, words
        self.doc: int | None = None
        self.waiting: dict[bytes, tuple[int, list[tuple[int, int, int, int]]]] = {}

    def _windows(self, text: bytes, words: list[bytes]) -> list[bytes]:
        starts = list(accumulate((len(w) + 1 for w in words), initial=0))
        return [text[starts[i] : starts[i + self.width] - 1] for i in range(len(words) - self.width + 1)]

    def _find(self, window: bytes) -> tuple[int, int] | None:
        for block, i in self.at.get(hash(window), ()):
            if b" ".join(self.blocks[block][2][i : i + self.width]) == window:
                return block, i
        return None

    def _take_up(self) -> None:
        for text, (place, _) in self.waiting.items():
            words = text.split(b" ")
            self.blocks.append((self.doc, place, words))
            for i, window in enumerate(self._windows(text, words)):
                if self._find(window) is None:
                    self.at.setdefault(hash(window), []).append((len(self.blocks) - 1, i))
        self.waiting = {}

    def factors(self, doc: int, place: int, text: bytes) -> list[tuple[int, int, int, int]]:
        """(first window, windows, reference document, its first word) of a block's factors of ``width`` words and more."""
        if doc != self.doc:
            self._take_up()
            self.doc = doc
        if text not in self.waiting:
            words = text.split(b" ")
            windows = self._windows(text, words) if self.at else []
            found, i = [], 0
            while i < len(windows):
                hit = self._find(windows[i])
                if hit is None:
                    i += 1
                    continue
                ref, ref_place, source = self.blocks[hit[0]]
                more = self.width
                while i + more < len(words) and hit[1] + more < len(source) and words[i + more] == source[hit[1] + more]:
                    more += 1
                found.append((i, more - self.width + 1, ref, ref_place + hit[1]))
                i += more - self.width + 1
            self.waiting[text] = (place, found)
        return [(place + i, n, ref, at) for i, n, ref, at in self.waiting[text][1]]


def _factor(f: Factors):
    """(anchor, doc_id, place, words) in this order -> a row per factor of a block."""

    def rows(batches) -> Iterator[pa.RecordBatch]:
        anchor, known = None, References(f.width)
        for batch in batches:
            out: list[tuple] = []
            for a, doc, place, words in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if a != anchor:
                    anchor, known = a, References(f.width)
                out += [(doc, *x) for x in known.factors(doc, place, words)]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "place", "n", "ref", "ref_place"])

    return rows


FACTOR = pa.struct([("start", pa.int64()), ("words", pa.int64()), ("ref_doc", pa.int64()), ("ref_start", pa.int64())])
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, factors array<struct<start: long, words: long, ref_doc: long, ref_start: long>>"


def _apply(f: Factors):
    """(doc_id, text, hits) -> RESULT."""

    def rows(batches):
        for batch in batches:
            out = []
            for lo, hi, data, words in _sliced(batch, 1):
                raw = data.tobytes()
                for i in range(hi - lo):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    spans = parse(batch.column(2)[lo + i].as_py() or [], b - a, f.width)
                    cut = np.zeros(b - a, bool)
                    for start, n, _, _ in spans:
                        cut[start : start + n] = True
                    left = np.flatnonzero(~cut) + a
                    text = b" ".join(raw[s:e] for s, e in zip(words.start[left].tolist(), words.end[left].tolist(), strict=True))
                    found = [dict(zip(("start", "words", "ref_doc", "ref_start"), x, strict=True)) for x in spans]
                    out.append((batch.column(0)[lo + i].as_py(), b - a, int(cut.sum()), hashlib.sha256(text).hexdigest(), text.decode(), found))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(FACTOR)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "factors"])

    return rows


def remove_repeats(docs: DataFrame, f: Factors = Factors()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, kept_text, factors.

    A word goes if a window that covers it also starts in a document of smaller doc_id.
    Reads ``doc_id`` and ``text``; other columns don't matter, whatever their names. A null or
    empty text has no words. Very long texts are parsed whole; a document's hits (at most one
    per window) meet in one row. Of reference documents that tie, the smallest id is named. A
    document with a null doc_id is compared with none. Rows that repeat a doc_id are one
    document: neither removes from the other. An empty table gives an empty result.

    Two documents with a window in common have its anchor in common. Runs of windows of one
    anchor with the same words are one class; all but its first document lose them whole.
    The first documents of different classes of one anchor are factored by their words; where
    there are more than ``group_blocks`` classes, they meet by window instead, with the same result.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    store = Scratch(spark, "factors")
    plain = take(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    known = plain.filter("doc_id is not null")
    tagged = known.select("doc_id", "text", F.xxhash64("text").alias("th"))

    # Anchors of two different texts at least; copies of one text are matched by the text.
    index = tagged.mapInArrow(_spots(f, False), "anchor long, th long").groupBy("anchor").agg(F.min("th").alias("lo"), F.max("th").alias("hi"))
    index = store.save("index", index.filter("lo <> hi").select(F.col("anchor").alias("shared")))
    spots = known.mapInArrow(_spots(f, True), SPOT)
    spots = store.save("spots", spots.join(index, spots["anchor"] == index["shared"], "left_semi"))

    classes = spots.groupBy("anchor", "run").agg(F.min(F.struct("doc_id", "place")).alias("low"))
    classes = store.save("classes", classes.select(F.col("anchor").alias("ca"), F.col("run").alias("cr"), F.col("low.doc_id").alias("ref"), F.col("low.place").alias("ref_place")))
    same = (F.col("anchor") == F.col("ca")) & (F.col("run") == F.col("cr"))
    whole_runs = spots.join(classes, same).filter("doc_id > ref").select("doc_id", "place", "n", "ref", "ref_place")
    mixed = classes.groupBy("ca").agg(F.count("*").alias("runs")).filter("runs > 1").select(F.col("ca").alias("ma"), "runs")
    heads = spots.join(classes.join(mixed, F.col("ca") == F.col("ma")), same & (F.col("doc_id") == F.col("ref")))
    indexed = F.when(F.col("runs") <= f.group_blocks, F.col("ca")).alias("anchor")
    wanted = store.save("wanted", heads.groupBy("doc_id").agg(F.collect_list(F.struct("place", "n", indexed)).alias("spans")).withColumnRenamed("doc_id", "head"))

    def with_texts(ids: DataFrame, name: str) -> DataFrame:
        """The rows of ``plain`` with these ids: only their texts are shuffled."""
        one = ids.select(name)
        return plain.join(F.broadcast(one) if one.count() <= f.broadcast_ids else one, plain["doc_id"] == one[name], "left_semi")

    texts = with_texts(wanted, "head").join(wanted, F.col("doc_id") == F.col("head")).select("doc_id", "text", "spans")
    blocks = store.save("blocks", texts.mapInArrow(_blocks_at(f), BLOCK))
    in_order = blocks.filter("anchor is not null").select("anchor", "doc_id", "place", "words").repartition("anchor").sortWithinPartitions("anchor", "doc_id", "place")
    factored = in_order.mapInArrow(_factor(f), "doc_id long, place long, n long, ref long, ref_place long")
    single = blocks.filter("anchor is null").select("window", "doc_id", "place")
    least = single.groupBy("window").agg(F.min(F.struct("doc_id", "place")).alias("low"))
    least = least.select(F.col("window").alias("w"), F.col("low.doc_id").alias("ref"), F.col("low.place").alias("ref_place"))
    one_by_one = single.join(least, F.col("window") == F.col("w")).filter("doc_id > ref").select("doc_id", "place", F.lit(1).cast("long").alias("n"), "ref", "ref_place")

    prints = [F.xxhash64("text").alias("ha"), F.xxhash64(F.lit(1), "text").alias("hb"), F.length("text").alias("hl")]
    texts = known.select("doc_id", *prints)
    firsts = texts.groupBy("ha", "hb", "hl").agg(F.min("doc_id").alias("ref"))
    copies = texts.join(firsts, ["ha", "hb", "hl"]).filter("doc_id > ref").select("doc_id", F.lit(0).alias("place"), F.lit(-1).alias("n"), "ref", F.lit(0).alias("ref_place"))

    # A document's hits are at most its windows.
    hits = whole_runs.union(factored).union(one_by_one).union(copies)
    hits = store.save("hits", hits.groupBy("doc_id").agg(F.collect_list(F.struct("place", "n", "ref", "ref_place")).alias("hits")))
    store.drop("index", "spots", "classes", "wanted", "blocks")
    hits = hits.withColumnRenamed("doc_id", "hit")
    found = with_texts(hits, "hit").join(hits, F.col("doc_id") == F.col("hit")).select("doc_id", "text", "hits")
    ids = hits.select("hit")
    ids = F.broadcast(ids) if ids.count() <= f.broadcast_ids else ids
    rest = plain.join(ids, plain["doc_id"] == ids["hit"], "left_anti").select("doc_id", "text", F.lit(None).cast(hits.schema["hits"].dataType).alias("hits"))
    return found.union(rest).mapInArrow(_apply(f), RESULT)


def removed_spans(factors: Column) -> Column:
    """Stretches of words that factors cover, as ``first:end`` (end exclusive) by place, comma-joined. Factors come in
    the order of their first words, which is that of their ends."""
    end = lambda x: x["start"] + x["words"]
    first = F.filter(factors, lambda x, i: (i == 0) | (x["start"] > end(F.get(factors, i - 1))))
    last = F.filter(factors, lambda x, i: (i == F.size(factors) - 1) | (F.get(factors, i + 1)["start"] > end(x)))
    return F.array_join(F.zip_with(first, last, lambda a, b: F.concat_ws(":", a["start"].cast("string"), end(b).cast("string"))), ",")

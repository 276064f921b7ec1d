"""Packing documents into sequences: cutting stock by column generation.

One pass tokenises the texts and writes their pieces: whole sequences of a long
document, and what is left of each document, which stays in one piece. The lengths'
histogram (at most ``size`` numbers) goes to the driver, where a linear program over
patterns is solved by column generation; patterns are rounded down, the few pieces
over are packed longest first. Pieces of one length are interchangeable: ranked in
salted groups, each finds its sequence by rank in a table of the patterns.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nimbora.llm.store import Scratch, arrow_batches, take

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

# Fixed value: the split pattern of the public byte-level BPE vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Pack:
    """``tokenizer``: path of a byte-level BPE for ``tokenizers``; empty: the public
    byte_bpe_50k.json where it is installed. Column generation ends within ``gap`` of a lower
    bound (of the tokens over ``size``, or Farley's); ``rounds`` only guards against cycling.
    Both change how full sequences are, never which pieces there are."""

    tokenizer: str = ""
    size: int = 2048
    end_id: int = 1
    rounds: int = 100_000
    gap: float = 5e-4
    #: Pieces a ranking group holds on average, for lengths that many pieces have.
    group_rows: int = 5_000


_encoders: dict[str, object] = {}

# A longer run of white space is beyond the stack of tiktoken's regular expressions.
LONG_SPACE = re.compile(r"\s{4096}")


def same_splits(spec: dict) -> bool:
    """Whether tiktoken with SPLIT and the file's ids as ranks does what the file describes: a
    byte-level BPE without normaliser, prefix space or word marks, whose merges are in the order of their ids."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    plain = plain and model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain:
        return False
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [model["vocab"].get("".join(p), -1) for p in pairs]
    return all(len(p) == 2 for p in pairs) and all(a < b for a, b in zip(made, made[1:])) and len({*model["vocab"]} - {x["content"] for x in spec.get("added_tokens", [])}) == len(made) + 256


def encoder(path: str):
    """text -> ids, as ``tokenizers`` gives them with add_special_tokens=False. Where the file
    allows it, texts without a special token's string or an endless run of white space go
    through tiktoken with the same vocabulary, which is faster and gives the same ids."""
    if path not in _encoders:
        import tiktoken
        from tokenizers import Tokenizer

        if not path:
            import public_tokenizers

            path_ = public_tokenizers.path("byte_bpe_50k.json")
        else:
            path_ = path
        slow = Tokenizer.from_file(str(path_))
        with open(path_, encoding="utf-8") as f:
            spec = json.load(f)

        def exact(text: str) -> np.ndarray:
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

        _encoders[path] = exact
        if same_splits(spec):
            special = [x["content"] for x in spec.get("added_tokens", [])]
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
            ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
            fast = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

            def encode(text: str) -> np.ndarray:
                if any(s in text for s in special) or LONG_SPACE.search(text):
                    return exact(text)
                return np.array(fast.encode_to_numpy(text), np.uint32)

            _encoders[path] = encode
    return _encoders[path]


def pieces(pack: Pack):
    """Arrow function from (doc_id, text) to PIECES."""

    def rows(batches):
        encode, end = encoder(pack.tokenizer), np.array([pack.end_id], np.uint32)
        for batch in batches:
            ids, starts, lengths, crcs, totals = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.concatenate([encode(text.as_py() or ""), end]).astype("<u4")
                for at in range(0, len(tokens), pack.size):
                    part = tokens[at : at + pack.size]
                    ids.append(doc)
                    starts.append(at)
                    lengths.append(len(part))
                    crcs.append(zlib.crc32(part.tobytes()))
                    totals.append(len(tokens))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, lengths, crcs, totals)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return rows


def _greedy(lengths: np.ndarray, counts: np.ndarray, size: int):
    """Longest first over a histogram: (pattern, how often), each using up one length at least."""
    left = counts.astype(np.float64 if counts.dtype.kind == "f" else np.int64).copy()
    out = []
    top = len(lengths) - 1
    while top >= 0:
        if left[top] <= 0:
            top -= 1
            continue
        room, pattern, i = size, {}, top
        while i >= 0 and room >= lengths[0]:
            if left[i] > 0 and lengths[i] <= room:
                n = int(min(room // lengths[i], left[i] if left.dtype.kind == "i" else room))
                if n:
                    pattern[i] = n
                    room -= n * int(lengths[i])
            i = min(i - 1, int(np.searchsorted(lengths, room, "right")) - 1)
        times = min(left[i] / n if left.dtype.kind == "f" else left[i] // n for i, n in pattern.items())
        for i, n in pattern.items():
            left[i] -= times * n
            if left.dtype.kind == "f" and left[i] < 1e-9:
                left[i] = 0
        out.append((pattern, times))
    return out


def _best_pattern(lengths: np.ndarray, values: np.ndarray, size: int) -> tuple[float, dict[int, int]]:
    """Unbounded knapsack by dynamic programming over the room."""
    best, took = np.zeros(size + 1), np.full(size + 1, -1)
    fit = np.searchsorted(lengths, np.arange(size + 1), "right")
    for room in range(1, size + 1):
        best[room], took[room] = best[room - 1], -1
        if k := fit[room]:
            gain = best[room - lengths[:k]] + values[:k]
            j = int(gain.argmax())
            if gain[j] > best[room] + 1e-12:
                best[room], took[room] = gain[j], j
    pattern: dict[int, int] = {}
    room = size
    while room > 0:
        j = took[room]
        if j < 0:
            room -= 1
        else:
            pattern[int(j)] = pattern.get(int(j), 0) + 1
            room -= int(lengths[j])
    return float(best[size]), pattern


def cut_patterns(lengths: np.ndarray, counts: np.ndarray, pack: Pack) -> tuple[list[tuple[dict[int, int], int]], float]:
    """Integer pattern counts that cover ``counts`` pieces of ``lengths`` (ascending) exactly,
    and a lower bound of the number of sequences.

    The first basis comes from a fractional longest-first packing: each of its patterns
    uses up one length, so the columns are triangular and the basis regular. Each round
    prices the best new column by knapsack and pivots it in; Farley's bound ends it.
    """
    m = len(lengths)
    if not m:
        return [], 0.0
    columns, pivots, gone, left = [], [], set(), counts.astype(float).copy()
    for pattern, times in _greedy(lengths, counts.astype(float), pack.size):
        for i, n in pattern.items():
            left[i] -= times * n
        done = [i for i in pattern if i not in gone and left[i] < 1e-9]
        gone.update(done)
        # One pivot per pattern; lengths that end with it get a column of their own.
        columns += [pattern if j == 0 else {i: max(1, pack.size // int(lengths[i]))} for j, i in enumerate(done)]
        pivots += done
    if len(pivots) != m:
        columns, pivots = [{i: max(1, pack.size // int(n))} for i, n in enumerate(lengths)], list(range(m))
    # Forward substitution over the sparse columns: small, and without a threaded library.
    place = {i: j for j, i in enumerate(pivots)}
    rows: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    for j, pattern in enumerate(columns):
        for i, n in pattern.items():
            rows[place[i]].append((j, n))
    inverse = np.zeros((m, m))
    for j, row in enumerate(rows):
        inverse[j, pivots[j]] = 1
        for k, n in row:
            if k != j:
                inverse[j] -= n * inverse[k]
        inverse[j] /= columns[j][pivots[j]]
    x = (inverse * counts).sum(1)
    bound = float((lengths * counts).sum() / pack.size)
    for _ in range(pack.rounds):
        if x.sum() <= (1 + pack.gap) * bound:
            break
        duals = inverse.sum(0)
        value, pattern = _best_pattern(lengths, duals, pack.size)
        bound = max(bound, float(x.sum()) / max(value, 1.0))
        if value <= 1 + 1e-9:
            break
        step = sum(n * inverse[:, i] for i, n in pattern.items())
        ok = step > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, np.maximum(x, 0) / np.where(ok, step, 1), np.inf)
        r = int(ratio.argmin())
        x = x - ratio[r] * step
        x[r] = ratio[r]
        inverse[r] /= step[r]
        step[r] = 0
        moved = np.flatnonzero(step)
        inverse[moved] -= step[moved, None] * inverse[r]
        columns[r] = pattern
    left, out = counts.astype(np.int64).copy(), []
    for pattern, times in sorted(zip(columns, np.floor(np.maximum(x, 0) + 1e-9).astype(np.int64), strict=True), key=lambda p: -p[1]):
        times = min(int(times), *(int(left[i] // n) for i, n in pattern.items()))
        if times > 0:
            out.append((pattern, times))
            for i, n in pattern.items():
                left[i] -= times * n
    return out + [(p, int(t)) for p, t in _greedy(lengths, left, pack.size)], bound


def placement(lengths: np.ndarray, patterns: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """(length, first rank, pieces per sequence, first sequence, first offset) of each pattern's
    use of a length, by length and rank: a few thousand rows, whatever the input."""
    table: list[tuple[int, int, int, int, int]] = []
    ranks = dict.fromkeys(range(len(lengths)), 0)
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for i in sorted(pattern, reverse=True):
            n = pattern[i]
            table.append((int(lengths[i]), ranks[i], n, sequence, offset))
            ranks[i] += n * times
            offset += n * int(lengths[i])
        sequence += times
    return np.array(sorted(table), np.int64).reshape(-1, 5)


PLACED = PIECES + ", sequence_id long, offset long"


def place(table: np.ndarray):
    """Arrow function from PIECES and a rank to PLACED, by binary search in the table."""

    def rows(batches):
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            spot = table[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            at = rank - spot[:, 1]
            new = [pa.array(spot[:, 3] + at // spot[:, 2]), pa.array(spot[:, 4] + at % spot[:, 2] * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *new], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return rows


def pack_documents(docs: DataFrame, pack: Pack = Pack()) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Reads ``doc_id`` and ``text``; other columns don't matter, whatever their names. A null or
    empty text has the end id only. Each row is a document, also one that repeats a doc_id; a
    null doc_id stays null. A very long text is tokenised whole, its row's ids in one worker.
    Pieces of one length that tie in doc_id, start and ids are alike; which of them goes
    where is left open. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    arrow_batches(spark, rows=500)
    store = Scratch(spark, "pack")
    plain = take(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = store.save("pieces", plain.mapInArrow(pieces(pack), PIECES))
    histogram = sorted((r["length"], r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect())  # at most pack.size rows
    lengths, counts = np.array([x for x, _ in histogram], int), np.array([n for _, n in histogram], np.int64)
    table = placement(lengths, cut_patterns(lengths, counts, pack)[0])

    groups = max(1, -(-int(counts.sum()) // pack.group_rows)) if len(counts) else 1
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    # Pieces before a salt: those of the blocks of salts before its own, and those before it in its block. Blocks are as
    # long as there are blocks, so no window has more rows than the root of the number of salts.
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("salt") / max(1, isqrt(groups))))
    prior = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sizes.groupBy("length", "block").agg(F.sum("n").alias("n"))
    blocks = blocks.select(F.col("length").alias("bl"), F.col("block").alias("bb"), prior(Window.partitionBy("length").orderBy("block")).alias("below"))
    inside = sizes.select("length", "salt", "block", prior(Window.partitionBy("length", "block").orderBy("salt")).alias("inside"))
    base = inside.join(blocks, (F.col("length") == F.col("bl")) & (F.col("block") == F.col("bb")))
    base = base.select(F.col("length").alias("len_"), F.col("salt").alias("salt_"), (F.col("below") + F.col("inside")).alias("base"))
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("local", local).join(base, (F.col("length") == F.col("len_")) & (F.col("salt") == F.col("salt_")))
    return ranked.select(*cut.columns, (F.col("base") + F.col("local")).alias("rank")).mapInArrow(place(table), PLACED)

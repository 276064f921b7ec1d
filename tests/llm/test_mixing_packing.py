import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nimbora.llm.mixing import Mix, mixed, replicate
from nimbora.llm.packing import Pack, cut_patterns, encoder, pack_documents, same_splits


def u(seed, doc, draw):
    return int(hashlib.md5(f"{seed}:{doc}:{draw}".encode()).hexdigest()[:13], 16) / 16**13


def quantile(x, rate):
    k, p = 0, math.exp(-rate)
    c = p
    while c <= x and k < 10_000:
        k += 1
        p *= rate / k
        c += p
    return k


def test_copies_are_poisson_quantiles(spark):
    docs = [(i, f"text {i}", "hot" if i % 3 else f"s{i % 7}") for i in range(600)] + [(None, None, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "9 as copy", "'x' as s", "'q' as TEXT", "'p' as `Source`", "1 as `a.b`")
    out, copy, key = replicate(frame)
    assert (copy, key) == ("copy_", "shuffle_key") and out.columns == [*frame.columns, copy, key]
    got = Counter(r.doc_id for r in out.select("doc_id").collect())
    n = Counter(s for _, _, s in docs)
    total = sum(math.sqrt(x) for x in n.values())
    for i, _, s in docs:
        rate = math.sqrt(n[s]) * len(docs) / (total * n[s])
        assert got.get(i, 0) == quantile(u(13, "" if i is None else i, 1), rate)
    assert out.groupBy("doc_id", copy).count().filter("count > 1").count() == 0
    order = [r.doc_id for r in out.select("doc_id").collect()]
    assert order != sorted(order, key=lambda x: x or -1)
    assert mixed(frame).columns == frame.columns


def test_high_rates_split_into_draws_and_weights(spark):
    frame = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "doc_id long, text string, source string")
    mix = Mix(weights={"x": 1.0, "y": 0.0}, size=300.0, max_rate=200.0)
    got = Counter(r.doc_id for r in replicate(frame, mix=mix)[0].collect())
    assert got == {1: sum(quantile(u(13, 1, j), 180.0) for j in range(1, 6))}
    spread = replicate(frame, mix=Mix(broadcast_sources=0))[0].count()
    assert spread == replicate(frame)[0].count()


def test_repeated_rows_and_long_texts_are_copied_whole(spark):
    long = "word " * 100_000
    frame = spark.createDataFrame([(1, long, "x"), (1, long, "x"), (2, None, "x"), (3, "", None)], "doc_id long, text string, source string")
    got = Counter((r.doc_id, r.text) for r in mixed(frame, mix=Mix(size=6.0)).collect())
    assert got[1, long] % 2 == 0 and got[1, long] > 0 and set(got) <= {(1, long), (2, None), (3, "")}


def test_mixing_nothing(spark):
    assert replicate(spark.createDataFrame([], "doc_id long, text string, source string"))[0].collect() == []


@pytest.mark.parametrize("n", [0, 1, 7, 400, 6000])
def test_patterns_cover_all_and_fit(n):
    rng = np.random.default_rng(n)
    lengths, counts = np.unique(np.minimum(2048, 1 + (np.exp(rng.normal(5.5, 1.2, n))).astype(int)), return_counts=True)
    used, sequences = np.zeros(len(lengths), int), 0
    patterns, bound = cut_patterns(lengths, counts, Pack())
    for pattern, times in patterns:
        assert sum(lengths[i] * k for i, k in pattern.items()) <= 2048
        sequences += times
        for i, k in pattern.items():
            used[i] += k * times
    assert (used == counts).all()
    assert (lengths * counts).sum() / 2048 <= bound + 1e-9 and bound <= sequences + 1e-9
    if n >= 400:
        assert sequences <= 1.001 * bound + 2


def test_patterns_where_lengths_do_not_fill_a_sequence():
    """Two of 700 leave 648 free: the bound of the tokens is out of reach, Farley's is met."""
    lengths, counts = np.array([700, 1100]), np.array([100, 10])
    patterns, bound = cut_patterns(lengths, counts, Pack())
    assert sum(t for _, t in patterns) == 55 and 54.9 < bound <= 55


@pytest.mark.parametrize("text", [" " * 1_000_000, " \n" * 500_000, "x" * 300_000 + "\u3000" * 5000 + "y", "ab" * 200_000])
def test_endless_runs_are_encoded(text):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    assert encoder("")(text).tolist() == Tokenizer.from_file(path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


def test_other_tokenizer_files_are_not_taken_for_plain_byte_level_ones():
    import json

    from public_tokenizers import path
    from tokenizers import Tokenizer

    with open(path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    assert same_splits(spec)
    assert not same_splits({**spec, "normalizer": {"type": "Lowercase"}})
    assert not same_splits({**spec, "pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}})
    assert not same_splits({**spec, "model": {**spec["model"], "merges": spec["model"]["merges"][1:] + spec["model"]["merges"][:1]}})
    other = path("word_bpe_49k.json")
    assert encoder(other)("It's A  test").tolist() == Tokenizer.from_file(other).encode("It's A  test", add_special_tokens=False).ids


def test_pieces_round_trip(spark):
    texts = ["a b c", "", None, "  two  spaces\n\n", "word " * 5000, "<|endoftext|> inside", "Üß ñ 漢字 🙂", "x" * 9000, " \n" * 300_000, *[f"copy number {i % 3}" for i in range(60)]]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, "a b c"), (None, "n")], "doc_id long, text string").withColumn("start", F.lit("x")).selectExpr("*", "'q' as TEXT")
    rows = pack_documents(frame, Pack(group_rows=4)).collect()
    from public_tokenizers import path
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path("byte_bpe_50k.json"))
    ids = {i: [*slow.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    ids[None] = [*slow.encode("n", add_special_tokens=False).ids, 1]
    seen, places = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        seen[r.doc_id].append((r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    for i, t in ids.items():
        want = len(t) * (2 if i == 0 else 1)
        assert sum(n for _, n in seen[i]) == want
    for spans in places.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        assert sum(n for _, n in spans) <= 2048
    assert sorted(places) == list(range(len(places)))


def test_encoder_equals_tokenizers():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(path("byte_bpe_50k.json")), encoder("")
    for t in ["it's we'll  x\t\ny", "  a b", "1234,56 7", "aé́ ＡＢ", "a\r\n\r\n b ", "\x1c\x85 z"]:
        assert fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids


def test_packing_nothing(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []

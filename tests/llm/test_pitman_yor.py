import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from nimbora.llm import pitman_yor as P
from nimbora.llm.pitman_yor import Restaurant, Seating, _Frequent, _key, _list, _score, predictive, score_documents, seat, sweep

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")), None]


def base(docs, mod=7, rest=2):
    out_of = {i: zlib.crc32(str(i).encode()) % mod == rest for i, _ in docs}
    c = Counter(w for i, t in docs if not out_of[i] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {i: (out_of[i], len(w := tokens(t)), sum(x in c for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for i, t in docs}


def corpus(count=300, seed=3):
    rng = random.Random(seed)
    nouns = [f"n{i}" for i in range(200)]
    docs = []
    for i in range(count):
        text = " ".join(f"the {rng.choice(nouns)} of {nouns[int(rng.paretovariate(1)) % 200]} is rare{rng.randrange(4000)}" for _ in range(rng.randrange(1, 30)))
        docs.append((i, text))
    return [*docs, (1000, None), (1001, ""), (1002, "THE Of\tunseen")]


def test_base_equals_brute_force_and_model_beats_it(spark):
    docs = corpus()
    got = {r.doc_id: r for r in score_documents(spark.createDataFrame(docs, "doc_id long, text string"), Restaurant(head=64)).collect()}
    want = base(docs)
    assert got.keys() == want.keys()
    for i, w in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9)
        assert r.score < 0
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.1 * sum(r.n_tokens for r in out)


def test_predictive_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    counts, parent = np.array([50, 9, 3, 1, 1]), np.array([0.4, 0.2, 0.2, 0.1, 0.05])
    direct, weight, tables = predictive(counts, parent, 0.8, 5.0, 2, 5, 8, rng)
    assert direct.sum() + weight == pytest.approx(1, abs=1e-9)
    assert (tables >= 1).all() and (tables <= counts).all()


def test_seating_keeps_customers():
    rng = np.random.default_rng(1)
    counts, parent = np.array([1, 2, 500, 40]), np.array([0.1, 0.2, 0.3, 0.4])
    sizes = seat(counts, parent, 0.7, 2.0, rng)
    for _ in range(5):
        tables = sweep(counts, parent, sizes, 0.7, 2.0, 8, rng)
        assert [sum(s) for s in sizes] == counts.tolist()
        assert tables == sum(map(len, sizes)) and all(min(s) > 0 for s in sizes)


def test_edge_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert score_documents(empty).collect() == []
    odd = spark.createDataFrame([(None, "a b"), (3, "a"), (3, "a")], "doc_id long, text string").selectExpr("*", "1 as word", "'x' as n", "2 as row", "'q' as TEXT", "4 as `Doc_Id`")
    rows = score_documents(odd).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in rows) == [(-1, 3), (3, 2), (3, 2)]
    assert len({(r.score, r.base_score) for r in rows if r.doc_id == 3}) == 1
    long = spark.createDataFrame([(1, "a b " * 150_000), (2, "a b"), (4, "a")], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in score_documents(long).collect()} == {1: 300_001, 2: 3, 4: 2}


def test_rare_words_are_contexts_and_symbols(spark):
    """Both held-out texts have the same words, all too rare for a share of all tokens; only one has them in a known order."""
    follow = {i: (i * 7 + 3) % 1500 for i in range(1500)}
    ids = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 7 != 2]
    docs = [(ids[k], f"a{k % 1500} b{follow[k % 1500]}") for k in range(6000)]
    out = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 7 == 2][:20]
    tests = [(out[2 * j], f"a{j} b{follow[j]}") for j in range(10)] + [(out[2 * j + 1], f"a{j} b{follow[j + 1]}") for j in range(10)]
    got = {r.doc_id: r for r in score_documents(spark.createDataFrame(docs + tests, "doc_id long, text string")).collect()}
    for j in range(10):
        right, wrong = got[out[2 * j]], got[out[2 * j + 1]]
        assert right.base_score == pytest.approx(wrong.base_score)
        assert right.score > wrong.score + 2


def test_many_buckets_give_what_one_gives(spark):
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    one, many = ({r.doc_id: r for r in score_documents(frame, Restaurant(head=16, bucket=n)).collect()} for n in (1 << 30, 1500))
    for i, r in one.items():
        assert (r.n_tokens, r.n_known, r.held_out) == (many[i].n_tokens, many[i].n_known, many[i].held_out)
        assert many[i].base_score == pytest.approx(r.base_score, rel=1e-9)
    # Seatings are random, but not what they amount to.
    assert sum(r.score for r in many.values()) == pytest.approx(sum(r.score for r in one.values()), rel=0.01)


def test_seating_of_many_is_that_of_one():
    counts, base = np.array([60, 9, 3, 2, 1]), np.array([0.3, 0.2, 0.2, 0.1, 0.1])
    plain = np.mean([predictive(counts, base, 0.8, 5.0, 5, 20, 60, np.random.default_rng(s))[2] for s in range(20)], axis=0)
    many = Seating(np.tile(counts, 200), np.tile(base, 200), np.repeat(np.arange(200), 5), np.zeros(200), 0.8, 5.0, np.random.default_rng(1))
    assert many.mean_tables(5, 20, 60).reshape(200, 5).mean(axis=0) == pytest.approx(plain, rel=0.06)
    assert (np.bincount(many.dish, many.size) == np.tile(counts, 200)).all() and (np.bincount(many.dish) == many.t).all() and (many.size > 0).all()
    assert many.all == pytest.approx(np.bincount(many.of, many.t))


def test_every_context_sums_to_one():
    words = np.arange(1, 7, dtype=np.uint64)  # the last is unknown
    u, w = np.repeat(np.array([11, 12, 13], np.uint64), 6), np.tile(words, 3)
    n = np.array([9, 2, 1, 0, 0, 0, 0, 40, 0, 7, 1, 0, 0, 0, 0, 0, 0, 0])  # the last context has no training tokens
    p, unknown = np.array([0.3, 0.3, 0.2, 0.1, 0.06]), 0.04
    whole = np.array([0, 18])
    pairs = pa.table({"b": pa.array([0], pa.int32()), "u": _list(u, whole), "w": _list(w, whole), "n": _list(n, whole, pa.int32())})
    known = pa.table({"w": _list(words[:5], np.array([0, 5])), "p": _list(p, np.array([0, 5]), pa.float64()), "c": _list(np.arange(1, 6), np.array([0, 5]))})
    ones = np.ones(18, np.int64)
    tokens = pa.table({"first": pa.array([100], pa.int64()), "pair": _list(_key(u, w), whole), "links": _list(ones, whole, pa.int32()), "doc": _list(np.arange(18), whole, pa.int16()), "times": _list(ones, whole, pa.int32()), "ids": _list(np.arange(18), whole), "sizes": _list(ones, whole, pa.int32())})
    none = _Frequent(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    got = _score(unknown, none, np.zeros(0), 1, 100.0, Restaurant(), 0)((pa.scalar(0),), pairs, pa.concat_tables([known, tokens], promote_options="default")).to_pandas()
    got = got.groupby("row").sum().loc[range(100, 118)]
    each = 10 ** got["score"].to_numpy().reshape(3, 6)
    assert each.sum(axis=1) == pytest.approx(np.ones(3), abs=1e-9)
    assert each[2] == pytest.approx(np.append(p, unknown))
    assert got["known"].tolist() == [1, 1, 1, 1, 1, 0] * 3
    assert got["base"].to_numpy()[:6] == pytest.approx(np.log10(np.array([2, 3, 4, 5, 6, 1]) / 100))


def test_dealt_records_hold_all_pairs_and_texts_in_few_bytes():
    """Pairs with their texts take under 12 bytes each to be dealt (two exchanges of hashes took 38), whatever the buckets."""
    docs = [(i, " ".join(f"w{int(x)}" for x in np.random.default_rng(i).zipf(1.3, 400) % 5000) if i % 50 else None) for i in range(500)]
    train = [i % 3 > 0 for i, _ in docs]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs]), pa.array(train), pa.array(range(100, 600))], names=["doc_id", "text", "train", "row"])
    hashes = P.W.find_words(np.frombuffer(b"w1 w2", np.uint8), np.array([0, 5])).hash
    hash_of = {w: int(h) for w in {w for _, t in docs for w in tokens(t)} - {None} for h in P.W.find_words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)])).hash}
    hash_of[None] = int(P.END)
    want, of_text = Counter(), Counter()
    for i, text in docs:
        before = int(P.START)
        for w in tokens(text):
            pair = (before, hash_of[w])
            want[pair] += train[i]
            of_text[i, pair] += 1
            before = pair[1]
    dealt = pa.Table.from_batches(list(P._deal(np.sort(hashes), 3, limit=50_000)(batch.slice(i, 100) for i in range(0, 500, 100))))
    assert len(set(dealt["first"].to_pylist())) > 2 and len(set(dealt["b"].to_pylist())) == 6
    links = 0
    for b in set(dealt["b"].to_pylist()):
        stored = P._merge(dealt.filter(pa.compute.equal(dealt["b"], b))).to_pylist()
        words, u, w, n = P._columns(pa.scalar(stored[0]["pairs"]))
        pairs = list(zip(words[u].tolist(), words[w].tolist(), strict=True))
        assert len(set(pairs)) == len(pairs)
        for pair, count in zip(pairs, n.tolist(), strict=True):
            assert want.pop(pair) == count
        for r in stored[1:]:
            steps, each, doc, times = P._columns(pa.scalar(r["texts"]))
            for at, d, k in zip(np.repeat(np.cumsum(steps), each).tolist(), doc.tolist(), times.tolist(), strict=True):
                assert of_text.pop((r["first"] - 100 + d, pairs[at])) == k
                links += 1
    assert not want and not of_text
    sizes = {r["first"]: (r["ids"], r["sizes"]) for r in dealt.to_pylist() if r["sizes"]}
    assert [x for f in sorted(sizes) for x in sizes[f][0]] == [i for i, _ in docs]
    assert [x for f in sorted(sizes) for x in sizes[f][1]] == [len(tokens(t)) for _, t in docs]
    assert sum(len(x.as_py()) for name in ("pairs", "texts") for x in dealt[name]) < 12 * links

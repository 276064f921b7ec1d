import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from nimbora.llm.quality_rules import LineLimits, keep_clean, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats(words, width=5):
    seen, out = Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1)), set()
    for i in range(len(words) - width + 1):
        if seen[tuple(words[i : i + width])] > 1:
            out.update(range(i, i + width))
    return len(out)


def brute(rows, limits):
    key = lambda line: " ".join(WORD.findall(line.lower())) or None
    docs, lines = Counter(h for _, _, h in rows), defaultdict(int)
    for _, t, h in rows:
        for k in {key(x) for x in (t or "").split("\n")} - {None}:
            lines[h, k] += 1
    bad = {x for x, n in lines.items() if n >= limits.min_docs and n >= limits.share * docs[x[0]]}
    out = []
    for i, t, h in rows:
        t = t or ""
        w, parts = WORD.findall(t), t.split("\n")
        left = [x for x in parts if (h, key(x)) not in bad]
        n_left = len(WORD.findall("\n".join(left)))
        with_word = [x for x in parts if WORD.search(x)]
        failed = len(w) < limits.min_words or 100 * repeats(w) > limits.max_repeat_pct * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(with_word) - len(set(with_word)), repeats(w), failed, len(parts) - len(left), n_left, not failed and n_left >= limits.min_left * len(w), "\n".join(left)))
    return out


def corpus():
    rng = random.Random(2)
    words = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(40)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for i in range(120):
        host = "hot" if i % 3 == 0 else rng.choice(["a", "b", None])
        lines = [line(rng.randrange(1, 9)) for _ in range(rng.randrange(1, 6))]
        if rng.random() < 0.4:
            lines.insert(0, rng.choice(["All rights reserved by us", "ALL  rights\treserved by US "]))
        if rng.random() < 0.2:
            lines += [lines[0]] * 3
        rows.append((i, "\n".join(lines) + rng.choice(["", "\n\n", " #$"]), host))
    return [*rows, (500, None, "a"), (501, "", "hot"), (502, "x " * 30_000, "hot"), (503, "All rights reserved by us", "hot"), (3, rows[3][1], rows[3][2])]


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_equals_brute_force(spark, broadcast):
    limits, rows = LineLimits(broadcast_rows=broadcast), corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as rules", "'x' as kept", "2 as h", "'q' as TEXT", "'p' as `Source`", "1 as `a.b`")
    found, out = quality_rules(frame, limits=limits)
    assert found.columns[:-1] == frame.columns and out == "rules_"
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_lines", "n_left_words", "kept", "clean_text")
    got = sorted((r.doc_id, *(r[out][n] for n in names)) for r in found.collect())
    want = brute(rows, limits)
    assert any(w[-4] for w in want) and not all(w[-2] for w in want)
    assert got == sorted(want)
    kept = keep_clean(frame, limits=limits)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted((w[0], w[-1]) for w in want if w[-2])


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, source string")
    assert quality_rules(frame)[0].collect() == [] and keep_clean(frame).collect() == []

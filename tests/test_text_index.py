"""Search by n-grams against reading all texts."""

import random

from pyspark.sql import functions as F

from nimbora.operators import text_index as T
from nimbora.plans import api
from nimbora.sources.records import write_clustered


def test_search_equals_a_whole_scan(spark, tmp_path):
    rng = random.Random(2)
    letters = "abAB éß1-"
    rows = [(f"{i:04d}", rng.choice([None, "".join(rng.choice(letters) for _ in range(rng.randrange(12)))]), rng.choice(["CA", "Ny", None])) for i in range(400)]
    stations = spark.createDataFrame(rows, "station_id string, name string, state string")
    index = T.postings(api.search_text(stations), "station_id", "text")
    write_clustered(index, str(tmp_path / "grams"), "gram")
    stored = spark.read.parquet(str(tmp_path / "grams"))
    texts = ["", "a", "ab", "AB", "éa", "b A", "abab", "0123", "ca 01", "aba1-", "zzz", "  "] + ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 5))) for _ in range(12)]
    for text in texts:
        want = [tuple(r) for r in api.search(stations, text).collect()]
        assert [tuple(r) for r in api.search(stations, text, index=stored).collect()] == want, text
        low = [(" ".join(x for x in (n, s, i) if x is not None)).lower() for i, n, s in rows]
        assert want == ([r for r, t in zip(rows, low, strict=True) if text.lower() in t][:12] if len(text) > 1 else [])


def test_only_holders_of_all_grams_are_looked_at(spark):
    rows = spark.createDataFrame([(1, "abcd"), (2, "abc bcd"), (3, "bcd abc"), (4, "xyz"), (5, None), (6, "a")], "id long, text string")
    index = T.postings(rows, "id", "text")
    assert sorted(r.id for r in T.holders(index, "id", "abcd").collect()) == [1, 2, 3]
    assert sorted(r.id for r in T.holders(index, "id", "ab").collect()) == [1, 2, 3]
    assert T.grams("abcd") == ["abc", "bcd"] and T.grams("aaaa") == ["aaa"] and T.grams("ab") == ["ab"] and T.grams("a") == []
    assert index.groupBy("id", "gram").count().filter("count > 1").count() == 0
    assert index.filter(F.col("id") == 1).count() == 5

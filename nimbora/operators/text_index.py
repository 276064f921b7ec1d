"""An inverted index of character n-grams: who may hold a text, without reading all texts.

Texts of three characters and more are looked up by their trigrams, shorter ones by bigrams. Whoever
holds a text holds all its n-grams; the reverse has to be verified. Stored in the order of the grams
(``records.write_clustered``), a lookup opens the row groups of its grams only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lengths of the n-grams that are kept.
SIZES = (2, 3)


def grams(text: str) -> list[str]:
    """The different n-grams that a text is looked up by; none of a text that is too short."""
    n = min(max(SIZES), len(text))
    return sorted({text[i : i + n] for i in range(len(text) - n + 1)}) if n in SIZES else []


def postings(rows: DataFrame, id_: str, text: str) -> DataFrame:
    """(gram, id): each different n-gram of each row's text, made in one narrow pass; null texts have none."""
    length = F.length(text)
    of = lambda n: F.when(length >= n, F.transform(F.sequence(F.lit(1), length - n + 1), lambda i: F.substr(F.col(text), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(*[of(n) for n in SIZES]))
    return rows.filter(F.col(text).isNotNull()).select(F.explode(every).alias("gram"), id_)


def holders(index: DataFrame, id_: str, text: str) -> DataFrame:
    """(id) of the rows that have all n-grams of ``text``; everyone, where it is too short for any."""
    wanted = grams(text)
    if not wanted:
        return index.select(id_).distinct()
    met = index.filter(F.col("gram").isin(wanted)).groupBy(id_).agg(F.count_distinct("gram").alias("n"))
    return met.filter(F.col("n") == len(wanted)).select(id_)

"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbora.llm.quality_rules import let
from nimbora.llm.store import Scratch, free_name, numbered


@dataclass(frozen=True)
class Mix:
    """Target weight of a source: ``weights[source]``, or (number of its documents) ** ``power``
    where no weights are given (then every source has one). A source without a weight gets no
    copies. ``size``: expected number of copies in all, as a multiple of the documents."""

    power: float = 0.5
    weights: dict = field(default_factory=dict)
    size: float = 1.0
    seed: int = 13
    #: A rate beyond this is split into that many equal Poisson draws, so exp(-rate) stays exact.
    max_rate: float = 200.0
    #: Sources up to which their table is broadcast; each row has a few KB at most.
    broadcast_sources: int = 5_000


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits (52 bits) of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def rates(docs: DataFrame, by: str, mix: Mix) -> DataFrame:
    """Per source: draws (how many Poisson draws) and cdf (array) of one of them."""
    n = docs.groupBy(F.col(by).alias("s")).agg(F.count("*").alias("n"))
    if mix.weights:
        weight = F.lit(0.0)
        for name, value in mix.weights.items():
            weight = F.when(F.col("s") == name, F.lit(float(value))).otherwise(weight)
    else:
        weight = F.pow(F.col("n").cast("double"), F.lit(mix.power))
    table = n.withColumn("w", weight)
    total = table.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    rate = F.coalesce(F.try_divide(F.col("w") * F.col("all_n") * F.lit(mix.size), F.col("all_w") * F.col("n")), F.lit(0.0))
    table = table.crossJoin(F.broadcast(total)).select("s", rate.alias("rate"))  # the right side is one row
    table = table.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / mix.max_rate)).cast("int"))
    one = F.col("rate") / F.col("draws")
    # Beyond this many terms the tail of a Poisson of mean ``one`` is under 2**-53.
    steps = F.sequence(F.lit(1), (F.ceil(one + 12 * F.sqrt(one)) + 40).cast("int"))
    first = F.exp(-one)
    start = F.struct(first.alias("p"), F.array(first).alias("c"))
    grow = lambda a, k: let(a["p"] * one / k, lambda p: F.struct(p.alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + p)).alias("c")))
    return table.select("s", "rate", "draws", F.aggregate(steps, start, grow, lambda a: a["c"]).alias("cdf"))


def replicate(docs: DataFrame, by: str = "source", mix: Mix = Mix()) -> tuple[DataFrame, str, str]:
    """A row for each copy, in a global random order, and the names of the two columns that
    are new: the copy's number from 1, and the key of the order.

    Needs ``doc_id`` and ``by``; all columns stay, whatever their names, texts of any length and
    null or empty ones too. The number of copies
    is the quantile, at a hash of (seed, doc_id, draw), of the Poisson distribution of the
    source's rate: it depends on nothing else, so a lost task gives the same copies again.
    A null source is a source; a null doc_id hashes as an empty string; rows that repeat a
    doc_id get as many copies each; copies that tie in the order's key are equal up to their
    text and lie in any order. An empty table gives an empty result.
    """
    given = docs.columns
    names, docs = numbered(docs)
    copy, key = free_name(given, "copy"), free_name(given, "shuffle_key")
    by, id_ = names[given.index(by)], F.col(names[given.index("doc_id")])
    s, d, c = "mix_s", "mix_draws", "mix_cdf"
    table = Scratch(docs.sparkSession, "mix").save("rates", rates(docs, by, mix)).select(F.col("s").alias(s), F.col("draws").alias(d), F.col("cdf").alias(c))
    if table.count() <= mix.broadcast_sources:
        table = F.broadcast(table)
    met = docs.join(table, F.col(by).eqNullSafe(F.col(s)))
    below = lambda u: F.size(F.filter(F.col(c), lambda x: x <= u))
    draws = F.transform(F.sequence(F.lit(1), F.col(d)), lambda j: let(uniform(mix.seed, id_, j), below))
    count = F.aggregate(draws, F.lit(0), lambda a, x: a + x)
    copies = let(count, lambda n: F.when(n > 0, F.sequence(F.lit(1), n)))
    out = met.select(*names, F.explode(copies).alias("copy"))
    out = out.withColumn("key", F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.lit("order"), F.coalesce(id_.cast("string"), F.lit("")), F.col("copy"))))
    # The key's hash says where a copy goes and the key in which order it lies there: a random
    # permutation in one exchange, without the sampling pass of a range partitioning.
    ties = [F.xxhash64(names[given.index("text")])] if "text" in given else []
    return out.repartition(F.col("key"), *ties).sortWithinPartitions("key").toDF(*given, copy, key), copy, key


def mixed(docs: DataFrame, by: str = "source", mix: Mix = Mix()) -> DataFrame:
    """The copies with the columns of ``docs`` only, in their random order. Nulls, ties, repeated
    rows, very long texts, clashing names and empty tables as in ``replicate``."""
    names, out = numbered(replicate(docs, by, mix)[0])
    return out.select(*names[:-2]).toDF(*docs.columns)

"""What the operators share: Arrow batches, columns by position, bounded samples."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.sources.scratch import Scratch, ship

__all__ = ["Scratch", "arrow_batches", "free_name", "gather", "numbered", "take"]


def arrow_batches(spark: SparkSession, rows: int = 1000, mb: int = 8) -> None:
    """Make Python workers ready: the package, and Arrow batches bounded for texts of any length."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def free_name(taken: list[str], name: str) -> str:
    """``name``, lengthened until no column (in any case) has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def numbered(frame: DataFrame) -> tuple[list[str], DataFrame]:
    """Names c0, c1, ... and ``frame`` under these: columns can be addressed whatever they were
    called, dots and names that differ in case only included. ``toDF`` gives the old names back."""
    names = [f"c{i}" for i in range(len(frame.columns))]
    return names, frame.toDF(*names)


def take(frame: DataFrame, *wanted: str) -> DataFrame:
    """The columns of exactly these names, whatever else ``frame`` has."""
    names, plain = numbered(frame)
    return plain.select(*[F.col(names[frame.columns.index(w)]).alias(w) for w in wanted])


def gather(frame: DataFrame, order: list, rows: int, size: int) -> pa.Table:
    """At most ``rows`` rows of ``frame`` (doc_id, text, ...), first in ``order``, whose whole texts
    have at most ``size`` bytes together: a text that doesn't fit any more is passed over. Equal
    rows are taken once. Ties in ``order`` go by doc_id and the text's hash. The lists go to the
    driver first, so that no task and no driver ever gathers more."""
    marked = frame.withColumn("text_hash", F.xxhash64("text"))
    length = F.octet_length(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("length")
    keys = [f"order_{i}" for i in range(len(order))]
    # Without the texts before the sort: every task sends its first rows to the driver.
    slim = marked.select(*[x.alias(k) for x, k in zip(order, keys, strict=True)], "doc_id", "text_hash", length)
    left, chosen = size, []
    for r in slim.orderBy(*keys, "doc_id", "text_hash").select("doc_id", "text_hash", "length").limit(rows).collect():
        if r["length"] <= left:
            left -= r["length"]
            chosen.append((r["doc_id"], r["text_hash"]))
    ids = frame.sparkSession.createDataFrame(chosen, "id_ long, hash_ long")
    met = marked.join(F.broadcast(ids), (F.col("doc_id") == F.col("id_")) & (F.col("text_hash") == F.col("hash_")), "left_semi")
    return met.dropDuplicates(["doc_id", "text_hash"]).toArrow().sort_by([("doc_id", "ascending"), ("text_hash", "ascending")])

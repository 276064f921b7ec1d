"""Quality rules from cross-document line frequency, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbora.llm.store import Scratch, free_name, numbered

SPACES = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class LineLimits:
    """A line of a host is boilerplate if at least ``min_docs`` of the host's documents
    and at least ``share`` of them have it. A document is depleted if less than
    ``min_left`` of its words are left without boilerplate."""

    min_docs: int = 5
    share: float = 0.1
    min_left: float = 0.3
    min_words: int = 10
    max_repeat_pct: int = 20
    #: Frequent lines, in all and of one host, up to which they are broadcast by host.
    broadcast_rows: int = 200_000
    broadcast_host_rows: int = 2_000


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also inside the lambdas of ``body``."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def line_keys(text: Column) -> Column:
    """Hash of each line without regard to case and white space; null without a word. Case and
    white space go from the whole text at once, not line by line."""
    lines = F.split(F.lower(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")), "\n")
    key = lambda x: F.when(x != "", F.xxhash64(x))
    return F.transform(lines, lambda x: key(F.trim(x)))


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words inside ``width``-word windows that occur twice or more in ``words``.

    Windows are compared by a 64-bit hash of their words' hashes. Positions are
    sorted by window, so the cost stays n log n for texts of any repetition.
    """

    def covered(windows: Column) -> Column:
        order = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(o: Column) -> Column:
            n = F.size(o)
            same = lambda x, j: (j >= 0) & (j < n) & (F.get(o, j)["h"] == x["h"])
            hit = F.filter(o, lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False)))
            return F.sort_array(F.transform(hit, lambda x: x["i"]))

        first = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(F.lit(width), s - a["last"])).alias("n"))
        return let(order, lambda o: F.aggregate(starts(o), first, step, lambda a: a["n"]))

    def windows(hashes: Column) -> Column:
        spots = F.sequence(F.lit(0), F.size(hashes) - width)
        return F.transform(spots, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))

    none = F.lit(0).cast("long")
    twice = lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(none)
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) >= width, let(hashed, lambda h: let(windows(h), twice))).otherwise(none)


def line_counts(docs: DataFrame, host: str, text: Column) -> DataFrame:
    """(host, key, n): documents of each host that hold a line. Each row counts as one document, and
    a line once in it; counts combine before the shuffle, so a hot host or line is no hot task."""
    keys = F.array_distinct(F.filter(line_keys(text), lambda k: k.isNotNull()))
    one = docs.select(F.col(host).alias("host"), keys.alias("keys"))
    # A null key stands for the document itself: one pass counts lines and documents.
    rows = one.select("host", F.explode(F.concat(F.col("keys"), F.array(F.lit(None).cast("long")))).alias("key"))
    return rows.groupBy("host", "key").agg(F.count("*").alias("n"))


def _above(counts: DataFrame, limits: LineLimits) -> DataFrame:
    total = counts.filter("key is null").select(F.col("host").alias("h"), F.col("n").alias("docs"))
    # Lines under min_docs can't pass for any host: they go before the join.
    lines = counts.filter((F.col("key").isNotNull()) & (F.col("n") >= limits.min_docs))
    return lines.join(total, F.col("host").eqNullSafe(F.col("h"))).filter(F.col("n") >= limits.share * F.col("docs")).select("host", "key")


def quality_rules(docs: DataFrame, host: str = "source", limits: LineLimits = LineLimits()) -> tuple[DataFrame, str]:
    """``docs`` with one more struct column, and that column's name.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs),
    base_failed, n_removed_lines, n_left_words (longs), kept, clean_text.

    Needs the columns ``text`` and ``host``; any others pass through, clashing names
    too, also those that differ in case only. A null text counts as empty: no words,
    base_failed, not kept. A null host is a host of its own. Repeated rows are documents
    of their own and get equal results. Very long texts are taken whole, at n log n. A
    line at exactly a limit is boilerplate. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    store = Scratch(spark, "quality")
    given = docs.columns
    names, docs = numbered(docs)
    host, text = names[given.index(host)], F.coalesce(F.col(names[given.index("text")]), F.lit(""))
    counts = store.save("line_counts", line_counts(docs, host, text))
    bad = store.save("frequent", _above(counts, limits))
    store.drop("line_counts")
    rows, widest = bad.groupBy("host").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    mark = "bad_keys"
    if rows <= limits.broadcast_rows and widest <= limits.broadcast_host_rows:
        per_host = bad.groupBy(F.col("host").alias(mark + "h")).agg(F.collect_set("key").alias(mark))
        marked = docs.join(F.broadcast(per_host), F.col(host).eqNullSafe(F.col(mark + "h")), "left").drop(mark + "h")
    else:
        # More boilerplate than may be broadcast: each text's own frequent lines, found by a join on (host, line).
        keyed = docs.select(F.col(host).alias("h"), F.xxhash64(text).alias("t"), F.explode(F.array_distinct(line_keys(text))).alias("k"))
        found = keyed.join(bad, (F.coalesce(F.col("h"), F.lit("")) == F.coalesce(F.col("host"), F.lit(""))) & F.col("h").eqNullSafe(F.col("host")) & (F.col("k") == F.col("key")))
        per_text = found.groupBy(F.col("h").alias(mark + "h"), F.col("t").alias(mark + "t")).agg(F.collect_set("k").alias(mark))
        marked = docs.join(per_text, (F.xxhash64(text) == F.col(mark + "t")) & F.col(host).eqNullSafe(F.col(mark + "h")), "left").drop(mark + "h", mark + "t")

    lines = F.split(text, "\n")
    with_word = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup_lines = let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
    gone = lambda keys, i: F.coalesce(F.array_contains(F.col(mark), F.get(keys, i)), F.lit(False))
    # Lines are looked up one by one only where some line of the text is frequent.
    some = lambda keys: F.when(F.arrays_overlap(keys, F.col(mark)), F.filter(lines, lambda _, i: ~gone(keys, i)))
    parts = F.when(F.col(mark).isNotNull(), let(line_keys(text), some))

    def fields(words: Column) -> Column:
        n = F.size(words).cast("long")
        chars = F.length(F.array_join(words, "")).cast("long")
        symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")

        def verdict(left: Column) -> Column:
            clean = F.when(left.isNull(), text).otherwise(F.array_join(left, "\n"))
            gone = F.when(left.isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(left)).cast("long")
            n_left = F.when(gone == 0, n).otherwise(F.size(words_of(F.array_join(left, "\n"))).cast("long"))

            def judged(repeat: Column) -> Column:
                failed = (n < limits.min_words) | (100 * repeat > limits.max_repeat_pct * n)
                return F.struct(
                    n.alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"), dup_lines.alias("n_dup_lines"), repeat.alias("n_repeat_words"),
                    failed.alias("base_failed"), gone.alias("n_removed_lines"), n_left.alias("n_left_words"),
                    (~failed & (n_left >= limits.min_left * n)).alias("kept"), clean.alias("clean_text"),
                )

            return let(repeated_words(words), judged)

        return let(parts, verdict)

    out = free_name(given, "rules")
    # The outer lambda binds the words once for all measures.
    return marked.withColumn("rules", let(words_of(text), fields)).drop(mark).toDF(*given, out), out


def keep_clean(docs: DataFrame, host: str = "source", limits: LineLimits = LineLimits()) -> DataFrame:
    """The documents kept, with boilerplate lines out of their texts; columns as in ``docs``.

    Null and empty texts go, as they have no words. Repeated rows stay or go together. Ties, very
    long texts, clashing names and empty tables as in ``quality_rules``."""
    ruled, _ = quality_rules(docs, host, limits)
    names, plain = numbered(ruled)
    text, rules = docs.columns.index("text"), names[-1]
    kept = plain.filter(F.col(f"{rules}.kept"))
    return kept.select(*[F.col(f"{rules}.clean_text") if i == text else F.col(n) for i, n in enumerate(names[:-1])]).toDF(*docs.columns)

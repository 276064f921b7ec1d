"""The queries of this subpackage, over the whole table ``documents``, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.llm import factor_dedup as _factors
from nimbora.llm import fingerprints as _prints
from nimbora.llm import media as _media
from nimbora.llm import merkle as _merkle
from nimbora.llm import minhash as _near
from nimbora.llm import mixing as _mix
from nimbora.llm import packing as _pack
from nimbora.llm import pitman_yor as _lm
from nimbora.llm import quality_rules as _rules
from nimbora.llm import secret_scan as _secrets
from nimbora.llm import toxicity as _toxic
from nimbora.llm import vector_codes as _codes
from nimbora.llm import weak_quality as _weak
from nimbora.llm.oracle import OP11_SQL, codes_sql, fingerprint_sql
from nimbora.llm.store import take


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled, out = _rules.quality_rules(documents(spark, sf_dir))
    ruled = take(ruled, "doc_id", out)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "n_left_words")
    return ruled.select("doc_id", *[F.col(f"{out}.{n}").alias(n) for n in names])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = _toxic.score_toxicity(documents(spark, sf_dir), labels, keep=remainder != 1)
    spot = lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))
    offsets = F.array_join(F.transform("spans", spot), ",").alias("offsets")
    # A null doc_id hashes as an empty string (crc32 0), so it is never held out.
    return found.select("doc_id", (F.coalesce(remainder, F.lit(0)) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), offsets)


def op3_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weak.classify(documents(spark, sf_dir))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _, _ = _mix.replicate(documents(spark, sf_dir))
    return out


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pack.pack_documents(documents(spark, sf_dir))


def op6_factor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _factors.remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256", _factors.removed_spans(F.col("factors")).alias("spans"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _secrets.digest(_secrets.find_secrets(documents(spark, sf_dir)))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _media.media_digest(_media.text_media(documents(spark, sf_dir)))


def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lm.score_documents(documents(spark, sf_dir))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near.near_duplicates(documents(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merkle.digest(_merkle.manifest(documents(spark, sf_dir)))


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prints.compare_edits(documents(spark, sf_dir))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes.digest(_codes.encode_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def queries() -> dict:
    found = (
        op1_quality_rules, op2_toxicity, op3_weak_quality, op4_mix_sources, op5_pack_sequences, op6_factor_dedup, op7_secret_scan, op8_media_columns, op9_pitman_yor, op10_minhash_dedup,
        op11_merkle_manifest, op12_winnowing, op13_vector_codes,
    )
    return {f.__name__: f for f in found}


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, string_split(text, chr(10)) AS lines FROM d),
l AS (SELECT r, source, i, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS k
      FROM (SELECT r, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM w)),
hosts AS (SELECT source, count(*) AS docs FROM d GROUP BY 1),
bad AS (SELECT f.source, f.k FROM (SELECT source, k, count(DISTINCT r) AS n FROM l WHERE k <> '' GROUP BY 1, 2) f
        JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source WHERE f.n >= 5 AND f.n >= 0.1 * h.docs),
marked AS (SELECT l.*, b.k IS NOT NULL AS gone FROM l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.k = b.k),
per_line AS (SELECT r, count(*) FILTER (WHERE k <> '') - count(DISTINCT line) FILTER (WHERE k <> '') AS n_dup_lines,
             count(*) FILTER (WHERE gone) AS n_removed_lines,
             coalesce(sum(len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) FILTER (WHERE NOT gone), 0) AS n_left_words
             FROM marked GROUP BY r),
pos AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
win AS (SELECT r, i, word, lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2, lead(word, 3) OVER o AS w3, lead(word, 4) OVER o AS w4
        FROM pos WINDOW o AS (PARTITION BY r ORDER BY i)),
dup AS (SELECT r, i, count(*) OVER (PARTITION BY r, word, w1, w2, w3, w4) AS n FROM win WHERE w4 IS NOT NULL),
starts AS (SELECT r, i, least(5, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), i - 5)) AS gain FROM dup WHERE n > 1),
rep AS (SELECT r, sum(gain) AS n_repeat_words FROM starts GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, length(list_aggregate(words, 'string_agg', '') )::BIGINT AS word_chars,
       length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
       (len(words) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * len(words)) AS base_failed,
       NOT (len(words) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * len(words)) AND n_left_words >= 0.3 * len(words) AS kept,
       n_removed_lines::BIGINT AS n_removed_lines, n_left_words::BIGINT AS n_left_words
FROM w JOIN per_line USING (r) LEFT JOIN rep USING (r)
"""


OP4_SQL = """
WITH RECURSIVE n AS (SELECT source AS s, count(*) AS n FROM documents GROUP BY 1),
total AS (SELECT sum(n) AS all_n, sum(w) AS all_w FROM (SELECT n, pow(n::DOUBLE, 0.5) AS w FROM n)),
rate AS (SELECT s, pow(n::DOUBLE, 0.5) * all_n::DOUBLE * 1.0 / (all_w * n::DOUBLE) AS rate FROM n, total),
cdf AS (SELECT s, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rate
        UNION ALL SELECT s, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate)) + 40),
u AS (SELECT *, ('0x' || substr(md5('13:' || coalesce(doc_id::VARCHAR, '') || ':1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
drawn AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, (SELECT count(*) FROM cdf WHERE cdf.s IS NOT DISTINCT FROM u.source AND cdf.c <= u.u) AS copies FROM u)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy, md5('13:order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy) AS shuffle_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM drawn)
"""


OP6_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM d WHERE len(words) >= 50),
win AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM s),
low AS (SELECT h, min(doc_id) AS m FROM win GROUP BY 1),
hit AS (SELECT doc_id, list(i) AS starts FROM win JOIN low USING (h) WHERE m < doc_id GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(flatten(list_transform(starts, lambda i: range(i, i + 50)))) AS p FROM hit),
pos AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM d),
kept AS (SELECT pos.doc_id, count(*) FILTER (WHERE gone.p IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY pos.p) FILTER (WHERE gone.p IS NULL) AS t
         FROM pos LEFT JOIN gone ON pos.doc_id = gone.doc_id AND pos.p = gone.p GROUP BY 1),
part AS (SELECT doc_id, min(p) - 1 AS a, max(p) AS b FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM gone) GROUP BY doc_id, g),
told AS (SELECT doc_id, string_agg(a::VARCHAR || ':' || b::VARCHAR, ',' ORDER BY a) AS spans FROM part GROUP BY 1)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN told USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    w, c = _prints.Winnow(), _codes.Codes()
    return {
        "op6_factor_dedup": OP6_SQL, "op1_quality_rules": OP1_SQL, "op4_mix_sources": OP4_SQL, "op11_merkle_manifest": OP11_SQL,
        "op12_winnowing": fingerprint_sql(w.gram, w.window, _prints.BASE, _prints.DROPPED), "op13_vector_codes": codes_sql(c.parts, c.entries, c.rounds, c.scale),
    }

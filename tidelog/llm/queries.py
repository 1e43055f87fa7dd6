"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import exact_dedup, langid, lm, mixing, ngram_join, packing, quality, suffix_dedup, token_counts, warc
from tidelog.llm.common import new_path
from tidelog.llm.tokens import added_tokens

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), added=added_tokens())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = token_counts.revision(table(spark, sf_dir, "documents"))
    return token_counts.count_with_edits(docs, "edits")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id"), 4, 2))
    return langid.predict(docs, langid.train(docs.where("not held_out")), extra=("held_out",))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    found = warc.read_archives(spark, path).where("gap_reason is null")
    page = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]*)[.]", 1).try_cast("long")
    return found.select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.when(F.col("record_type") == "revisit", page("refers_to")).alias("refers_to"),
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lm.train_rows(table(spark, sf_dir, "documents"))
    scored = lm.score(docs, "_train")
    return scored.select("doc_id", langid.held_out(F.col("doc_id"), 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality.judge(docs.select("doc_id", "text"), quality.train(docs, table(spark, sf_dir, "labels")))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "content_words", "content_share"
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_ngram_join": op2_ngram_join,
    "op3_token_counts": op3_token_counts,
    "op4_mixing": op4_mixing,
    "op5_langid": op5_langid,
    "op6_warc": op6_warc,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_quality": op8_quality,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_exact_dedup": op10_exact_dedup,
}

_OP10 = r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM (SELECT *, first(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY norm) AS group_size FROM d)
"""

_OP4 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         -ln((CAST(concat('0x', substr(md5(CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
         / CASE WHEN length(coalesce(text, '')) > 0
                THEN 1.0::DOUBLE + 3.0::DOUBLE * length(translate(text, '#*$%&|<>!', ''))::DOUBLE / length(text)::DOUBLE
                ELSE 1.0::DOUBLE END AS key
  FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) OVER o, 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM totals
  WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size,
         CASE WHEN cap / w > level THEN w * max(CASE WHEN cap / w > level THEN level END) OVER () ELSE cap END AS target
  FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM goals),
ordered AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS LAST, size DESC
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized)
SELECT o.doc_id, o.size, p.source_size, p.target,
       CAST(p.epochs * o.size + greatest(0, least(o.size, CAST(floor(p.target - p.epochs * p.source_size + 0.5) AS BIGINT) - o.before)) AS BIGINT) AS taken
FROM ordered o JOIN plan p ON o.source IS NOT DISTINCT FROM p.source
"""

ORACLES: dict[str, str] = {"op4_mixing": _OP4, "op10_exact_dedup": _OP10}

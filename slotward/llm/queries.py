"""Registered queries of the operators: whole tables in, digest columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    byte_bpe, chat, common, decontamination, line_dedup, minhash, pii, quality, ranked_search, segmentation, substring_dedup, token_counts, toxicity,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate class."""
    return minhash.classes(common.table(spark, sf_dir, "documents"))


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its spans of personal data."""
    spans = common.pinned(pii.annotated(common.table(spark, sf_dir, "documents")).select("doc_id", "_spans"))
    return pii.report(pii.decided(spans, pii.fit(pii.patterns(spans))))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity score."""
    docs, labels = (common.table(spark, sf_dir, name) for name in ("documents", "labels"))
    return toxicity.detect(docs, labels).select("doc_id", "held_out", "score", "predicted")


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items found in it."""
    docs, items = (common.table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return decontamination.contaminated(docs, items)


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its base measures and the verdict of the rule cascade."""
    found = quality.judged(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", *quality.BASE, "base_failed", "kept")


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of tokens."""
    found = token_counts.counted(common.table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return found.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op10_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document, with digests and scores."""
    return segmentation.digests(common.table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, line, v,
         sum(length(v) + 1) OVER (PARTITION BY doc_id ORDER BY line) - 1 AS fin,
         lower(trim(regexp_replace(v, '[ \t\r\x0b\f]+', ' ', 'g'), ' ')) AS unit
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS v,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents)
), begun AS (
  SELECT *, unit <> '' AND coalesce(lag(unit) OVER (PARTITION BY doc_id ORDER BY line), '') = '' AS begins FROM lines
), placed AS (
  SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY line) AS para FROM begun
), paragraphs AS (
  SELECT doc_id, para, min(line) AS line, string_agg(unit, ' ' ORDER BY line) AS unit
  FROM placed WHERE unit <> '' GROUP BY doc_id, para HAVING count(*) > 1
), units AS (
  SELECT doc_id, line, NULL AS para, unit FROM lines WHERE unit <> ''
  UNION ALL SELECT doc_id, line, para, unit FROM paragraphs
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY unit ORDER BY doc_id, line) AS nth FROM units
), gone AS (
  SELECT doc_id, line FROM ranked WHERE nth > 1 AND para IS NULL
  UNION SELECT p.doc_id, p.line FROM placed p JOIN ranked r ON p.doc_id = r.doc_id AND p.para = r.para AND nth > 1 WHERE p.unit <> ''
), marked AS (
  SELECT p.*, g.line IS NOT NULL AS goes FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.line = g.line
), left_over AS (
  SELECT doc_id, coalesce(string_agg(v, chr(10) ORDER BY line) FILTER (WHERE NOT goes), '') AS kept,
         coalesce(sum(length(v)) FILTER (WHERE goes), 0)::BIGINT AS n_removed, count(*) FILTER (WHERE goes) AS n_spans,
         coalesce(string_agg((fin - length(v))::BIGINT || ':' || fin::BIGINT, ',' ORDER BY line) FILTER (WHERE goes), '') AS spans
  FROM marked GROUP BY doc_id
)
SELECT doc_id, length(kept)::BIGINT AS n_chars, n_removed, n_spans, spans, sha256(kept) AS kept_sha256 FROM left_over
"""


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the spans of lines and paragraphs that occur earlier, and what is left."""
    return line_dedup.report(common.table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|im_', '<| im_') AS said FROM conversations
), people AS (
  SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> 'system'
), seen AS (
  SELECT t.conv_id, perspective, turn, role, role = perspective AS is_target, said,
         '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system'
                                ELSE 'user name=' || replace(role, '<|im_', '<| im_') END || chr(10) AS header
  FROM turns t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), whole AS (
  SELECT *, header || said || '<|im_end|>' || chr(10) AS segment FROM seen
), placed AS (
  SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, segment
                                       ROWS UNBOUNDED PRECEDING)::BIGINT AS fin FROM whole
)
SELECT conv_id, perspective, turn, role, is_target, fin - length(segment) AS start, fin AS "end",
       CASE WHEN is_target THEN fin - length(segment) + length(header) END AS mask_start,
       CASE WHEN is_target THEN fin - 1 END AS mask_end, md5(segment) AS segment_md5
FROM placed
"""


@query
def op5_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as rendered for every participant, with its place, mask and digest."""
    found = chat.rotated(common.table(spark, sf_dir, "conversations"))
    return found.withColumn("segment_md5", F.md5("segment")).drop("segment")


ORACLES |= {"op5_chat_rotation": OP5_SQL, "op9_line_dedup": OP9_SQL}


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what remains after the removal of repeated 200-byte strings."""
    return substring_dedup.report(common.table(spark, sf_dir, "documents"))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector with its whitened components."""
    return whitening.components(common.table(spark, sf_dir, "embeddings"))


@query
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with digests of its ids and of what they decode to."""
    return byte_bpe.digests(common.table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of every benchmark item."""
    postings = ranked_search.index(common.table(spark, sf_dir, "documents"))
    return ranked_search.search(postings, common.table(spark, sf_dir, "benchmark"))

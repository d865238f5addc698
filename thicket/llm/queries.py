"""The registered queries of this subpackage, with production parameters, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm import bpe, crf, gif, language, line_dedup, mixing, oph, simhash, suffix_dedup, window_dedup

#: Most times that mixing repeats a source.
REPEATS = 2.0
#: Vocabulary of the byte-level BPE queries.
RANKS = "byte_bpe_multi_50k.tiktoken"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose fingerprints differ in at most two bits."""
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_oph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-permutation MinHash of whole texts, their edited texts and their next documents."""
    pairs = oph.edited_pairs(_documents(spark, sf_dir))
    return pairs.select(
        "doc_id",
        F.col("n_chars").cast("long"),
        F.sha2("edited", 256).alias("edited_sha256"),
        oph.packed(F.col("bins")).alias("fingerprint"),
        oph.packed(F.col("edited_bins")).alias("edited_fingerprint"),
        oph.likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"),
        oph.likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )


def _fold(divisor: int) -> Column:
    """The remainder by which a contract holds out documents; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of whole texts by a convolutional network over bytes."""
    docs = _documents(spark, sf_dir)
    model = language.fit_from(docs, _fold(5) != 0)
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def toxicity_model(spark: SparkSession, sf_dir: str) -> crf.Model | None:
    """The field fitted to the labels that may be learned from."""
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return crf.fit_from(docs, labels, _fold(3) != 1)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of whole texts by a linear-chain conditional random field."""
    scored = crf.score_texts(_documents(spark, sf_dir).select("doc_id", "text"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete bytes of repeated strings of 100 bytes."""
    kept = suffix_dedup.dedupe(_documents(spark, sf_dir), size=100)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = """
WITH raw AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), starts AS (
  SELECT doc_id, h, unnest(generate_series(1, n - 99)) AS i FROM raw WHERE n >= 100
), keyed AS (
  SELECT doc_id, i, md5(substr(h, 2 * i - 1, 200)) AS body FROM starts
), late AS (
  SELECT doc_id, i FROM keyed QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, i) > 1
), cut AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER w <= 100 THEN 0 ELSE 1 END AS new FROM late WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM cut
), spans AS (
  SELECT doc_id, min(i) AS s, max(i) + 99 AS e FROM numbered GROUP BY doc_id, run
), pieces AS (
  SELECT x.doc_id, s, e, substr(h, 2 * coalesce(lag(e) OVER w, 0) + 1, 2 * (s - 1 - coalesce(lag(e) OVER w, 0))) AS piece
  FROM spans x JOIN raw USING (doc_id) WINDOW w AS (PARTITION BY x.doc_id ORDER BY s)
), kept AS (
  SELECT doc_id, sum(e - s + 1) AS removed, count(*) AS spans, max(e) AS last, string_agg(piece, '' ORDER BY s) AS front FROM pieces GROUP BY doc_id
)
SELECT r.doc_id, r.n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM raw r LEFT JOIN kept k ON r.doc_id = k.doc_id
"""


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text."""
    import public_tokenizers

    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN).drop("text")


def op7_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts stored as GIF samples, read back and summed up."""
    return gif.round_trip(_documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws that mix sources by a temperature under which none is repeated more than twice."""
    return mixing.draws(_documents(spark, sf_dir), max_repeats=REPEATS)


OP8_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS tokens FROM documents
), sums AS (
  SELECT source, sum(tokens)::BIGINT AS t FROM docs GROUP BY source
), ends AS (
  SELECT max(t)::DOUBLE AS largest, min(t)::DOUBLE AS smallest FROM sums WHERE t > 0
), bisect AS (
  SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high, largest, smallest FROM ends
  UNION ALL
  SELECT step + 1,
         CASE WHEN pow(largest / smallest, 1.0 - (low + high) / 2) <= 2.0 THEN low ELSE (low + high) / 2 END,
         CASE WHEN pow(largest / smallest, 1.0 - (low + high) / 2) <= 2.0 THEN (low + high) / 2 ELSE high END,
         largest, smallest
  FROM bisect WHERE step < 60
), parts AS (
  SELECT source, t, CASE WHEN t > 0 THEN greatest(t, floor(pow(largest, 1.0 - high) * pow(t::DOUBLE, high) + 0.5)::BIGINT) ELSE t END AS part
  FROM sums, bisect WHERE step = 60
), plan AS (
  SELECT source, CASE WHEN t > 0 THEN part // t ELSE 1 END AS blocks, part - CASE WHEN t > 0 THEN part // t ELSE 1 END * t AS rest FROM parts
), rows AS (
  SELECT doc_id, source, tokens, blocks, rest, unnest(generate_series(0, blocks - CASE WHEN rest > 0 THEN 0 ELSE 1 END)) AS block FROM docs JOIN plan USING (source)
), placed AS (
  SELECT *, row_number() OVER w - 1 AS place, sum(tokens) OVER (w ROWS UNBOUNDED PRECEDING) - tokens AS used
  FROM (SELECT *, md5(concat('42:', source, ':', block, ':', doc_id)) AS k FROM rows)
  WINDOW w AS (PARTITION BY source, block ORDER BY k, doc_id, tokens)
)
SELECT doc_id, source, block::BIGINT AS block, place::BIGINT AS place, tokens FROM placed WHERE block < blocks OR used < rest
"""


def op9_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete words of repeated windows of 20 words."""
    kept = window_dedup.dedupe(_documents(spark, sf_dir), size=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), placed AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM split
), windows AS (
  SELECT doc_id, i, count(*) OVER w AS n, md5(string_agg(word, ' ') OVER w) AS body
  FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), late AS (
  SELECT doc_id, i FROM windows WHERE n = 20 QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS i FROM late
), kept AS (
  SELECT p.doc_id, count(g.i) AS n_removed, string_agg(p.word, ' ' ORDER BY p.i) FILTER (WHERE g.i IS NULL) AS rest
  FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id
)
SELECT s.doc_id, len(s.words)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.rest, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete later copies of repeated runs of lines that aren't all blank."""
    kept = line_dedup.dedupe(_documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: All runs of lines, of any length, with a word in them.
OP10_SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1)::BIGINT AS pos FROM split
), named AS (
  SELECT *, dense_rank() OVER (ORDER BY line) AS id, regexp_matches(line, '[^\x20\x09-\x0D]') AS words FROM lines
), listed AS (
  SELECT doc_id, list(id ORDER BY pos) AS ids, list(words ORDER BY pos) AS words FROM named GROUP BY doc_id
), starts AS (
  SELECT doc_id, ids, words, unnest(generate_series(1, len(ids))) AS s FROM listed
), runs AS (
  SELECT doc_id, s, e, md5(array_to_string(list_slice(ids, s, e), ',')) AS body
  FROM (SELECT doc_id, ids, words, s, unnest(generate_series(s, len(ids))) AS e FROM starts) WHERE list_bool_or(list_slice(words, s, e))
), late AS (
  SELECT doc_id, s, e FROM runs QUALIFY row_number() OVER (PARTITION BY e - s, body ORDER BY doc_id, s) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(s, e)) AS pos FROM late
)
SELECT c.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
       sha256(coalesce(string_agg(c.line, chr(10) ORDER BY c.pos) FILTER (WHERE g.pos IS NULL), '')) AS kept_sha256
FROM named c LEFT JOIN gone g ON c.doc_id = g.doc_id AND c.pos = g.pos
GROUP BY c.doc_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_oph": op2_oph,
    "op3_language": op3_language,
    "op4_toxicity": op4_toxicity,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_gif": op7_gif,
    "op8_mixing": op8_mixing,
    "op9_window_dedup": op9_window_dedup,
    "op10_line_dedup": op10_line_dedup,
}

ORACLES: dict[str, str] = {
    "op5_suffix_dedup": OP5_SQL,
    "op8_mixing": OP8_SQL,
    "op9_window_dedup": OP9_SQL,
    "op10_line_dedup": OP10_SQL,
}

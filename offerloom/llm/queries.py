"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm import bpe, embeddings, licenses, lines, mixing, periods, pieces, quality, simhash, sketches, spelling, suffixes, token_files
from offerloom.llm.common import documents


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding them gives its text back."""
    decoded = pieces.encode_pieces(documents(spark, sf_dir), with_text=True)
    return decoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("text", 256).alias("decoded_sha256"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op4_license_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements wrapped over lines too; op4_licenses keeps the lines and shares of its SQL."""
    return licenses.license_statements(documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.drop_passages(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = sketches.edited_pairs(documents(spark, sf_dir))
    return pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketches.printed(F.col("sketch")).alias("fingerprint"),
        sketches.printed(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_table(documents(spark, sf_dir))


def _repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Of one document in ten: a tail of words that repeats its first part three times or more."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    a, times = h // 10 % n, 3 + h // 10 % 8
    places = np.arange(n)
    return np.where(places < a, places, a + (places - a) % (1 + (n - a) // times))


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(documents(spark, sf_dir), edit=_repeated_tail)
    found = found.select("doc_id", "runs", "collapsed", periods.greatest(F.col("runs")).alias("best"))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def _misspelled(doc_id: Column, run: Column) -> Column:
    """One run in 31 without one of its characters."""
    h = F.crc32(F.encode(F.concat(doc_id.cast("string"), F.lit(":"), run), "UTF-8"))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(h % 31 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(spelling.word_table(documents(spark, sf_dir), edit=_misspelled))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_bpe(documents(spark, sf_dir), with_text=True)
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_simhash": op1_simhash, "op2_pieces": op2_pieces, "op3_embeddings": op3_embeddings, "op4_licenses": op4_licenses, "op5_quality": op5_quality, "op6_suffixes": op6_suffixes,
    "op7_lines": op7_lines, "op8_mixing": op8_mixing, "op9_sketches": op9_sketches, "op10_tokens": op10_tokens,
    "op4_license_statements": op4_license_statements, "op11_periods": op11_periods, "op12_spelling": op12_spelling, "op13_bpe": op13_bpe,
}

_KEY = "trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
OP7_SQL = f"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT doc_id, line, pos, {_KEY} AS key FROM split),
shared AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT k.doc_id, k.line, k.pos, s.last IS NOT NULL AND s.last <> k.doc_id AS gone FROM keyed k LEFT JOIN shared s USING (key))
SELECT doc_id, count(*) AS n_lines, count_if(gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""

OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5(doc_id::VARCHAR || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS hash
  FROM documents),
named AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total,
    [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
filled AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM named),
goals AS (
  SELECT source, source_size, CASE WHEN lvl * weight >= cap THEN cap
    ELSE (max(CASE WHEN lvl * weight < cap THEN lvl END) OVER ()) * weight END AS target FROM filled),
budgets AS (SELECT *, floor(target / source_size)::BIGINT AS base, greatest(target - floor(target / source_size) * source_size, 0) AS budget FROM goals),
running AS (
  SELECT s.source, hash, sum(s.size) AS n, sum(sum(s.size)) OVER (PARTITION BY s.source ORDER BY hash) AS upto
  FROM sized s WHERE s.size > 0 GROUP BY s.source, hash),
edges AS (
  SELECT r.source, CASE WHEN upto - budget < budget - (upto - n) THEN hash + 1 ELSE hash END AS edge
  FROM running r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source WHERE upto - n <= budget AND budget < upto)
SELECT doc_id, size, source_size, target,
  (size * (base + CASE WHEN base < 2 AND hash < edge THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source JOIN edges e ON s.source IS NOT DISTINCT FROM e.source"""

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_PHRASES = ", ".join(f"({_list(phrase.split())}, '{label}')" for phrase, label in licenses.PHRASES.items())
_TEMPLATES = ", ".join(
    f"({_list(sorted(set(words)))}, '{label}', {len(set(words)) if len(words) <= 9 else 0}, {_list(keys)}::VARCHAR[])"
    for (label, text), keys in zip(licenses.TEMPLATES, licenses.KEYS) for words in [re.findall("[0-9a-z]+", text.lower())])
OP4_SQL = f"""
WITH lowered AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORDS}') AS w FROM lowered),
phrases(p, label) AS (VALUES {_PHRASES}),
places AS (
  SELECT doc_id, label, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i:i + len(p) - 1] = p)) - 1 AS pos FROM words, phrases),
base AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places GROUP BY doc_id),
blocks AS (
  SELECT doc_id, list_distinct(regexp_extract_all(line, '{_WORDS}')) AS b, ' ' || array_to_string(regexp_extract_all(line, '{_WORDS}'), ' ') || ' ' AS spaced
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM lowered)),
templates(p, label, least, keys) AS (VALUES {_TEMPLATES}),
hits AS (
  SELECT doc_id, label, len(list_intersect(p, b)) / len(p)::DOUBLE AS share FROM blocks, templates
  WHERE len(list_intersect(p, b)) >= greatest(ceil(0.8 * len(p)), least) AND len(list_filter(keys, lambda k: NOT contains(spaced, ' ' || k || ' '))) = 0),
best AS (SELECT doc_id, max(share) AS share FROM hits GROUP BY doc_id),
labelled AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0) END AS score
FROM words LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN labelled USING (doc_id)"""

OP3_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98),
reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
lowest AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN lowest USING (vec_id) LEFT JOIN counted ON a = e.vec_id"""

ORACLES = {"op3_embeddings": OP3_SQL, "op4_licenses": OP4_SQL, "op7_lines": OP7_SQL, "op8_mixing": OP8_SQL}

"""What plain SQL can say of the corpus operators' results: the same queries cut to those columns, and their SQL.

Each goes through the whole operator; only the columns that SQL has no words
for are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, media, mixing, secret_scan, weighted_sampling

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

EDITS = """WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS nxt FROM d)
SELECT doc_id, length(text) AS n_chars, sha256(substring(text, 1, length(text) - length(text) // 3) || substring(nxt, 1, length(text) // 3)) AS edited_sha256 FROM n"""

MEDIA = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), n AS (SELECT doc_id, b, octet_length(b) AS n_bytes FROM d),
p AS (SELECT *, CASE WHEN n_bytes = 0 THEN 64 ELSE (n_bytes + 63) // 64 * 64 END AS payload_bytes FROM n)
SELECT doc_id, n_bytes, payload_bytes, sha256(b || encode(repeat(chr(0), (payload_bytes - n_bytes)::INT))) AS payload_sha256,
  payload_bytes + length('P5' || chr(10) || '64 ' || payload_bytes // 64 || chr(10) || '255' || chr(10)) AS media_bytes FROM p"""

SECRETS = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, len(list_filter(regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 12)) AS n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 16)) AS n_hex FROM d"""

MIX = rf"""WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")}) AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 2 * source_size / w, source) AS k, sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS full_below,
  sum(w) OVER (ORDER BY 2 * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_from FROM s),
level AS (SELECT max((1.5 * (SELECT sum(source_size) FROM s) - coalesce(full_below, 0)) / w_from) AS l FROM o WHERE (1.5 * (SELECT sum(source_size) FROM s) - coalesce(full_below, 0)) / w_from <= 2 * source_size / w)
SELECT doc_id, size, source_size::BIGINT AS source_size, round(least(2 * source_size, w * l), 4) AS target FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source, level"""

LICENSES = rf"""WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z]+|[^\x00-\x7F]+') AS parts, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT * FROM (VALUES (['under', 'the', 'mit', 'license'], 'mit'), (['apache', 'license', 'version', '2'], 'apache-2'), (['cc', 'by', 'nc'], 'cc-by-nc')) t(p, label)),
f AS (SELECT doc_id, label, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i:i + len(p) - 1] = p)) - 1 AS at FROM w, p)
SELECT w.doc_id, len(w.w) AS n_words, count(f.at) AS n_base, min(f.at) AS first_word, max(f.at) AS last_word, coalesce(string_agg(DISTINCT f.label, ',' ORDER BY f.label), '') AS base_labels FROM w LEFT JOIN f ON f.doc_id = w.doc_id GROUP BY w.doc_id, w.w"""

Query = Callable[[SparkSession, str], DataFrame]


def _media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.op7_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes")


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.op5_document_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def _secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.op8_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def _mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op9_mixing_sources(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def _licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op10_license_scans(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


BASE: dict[str, tuple[Query, str]] = {
    "base_document_fingerprints": (_edits, EDITS),
    "base_media_columns": (_media, MEDIA),
    "base_secret_scans": (_secrets, SECRETS),
    "base_mixing_sources": (_mix, MIX),
    "base_license_scans": (_licenses, LICENSES),
}

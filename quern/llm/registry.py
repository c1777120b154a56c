"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import base, filter_audit, licenses, lm_score, media, mixing, packing, quality, secret_scan, simhash, spelling, token_counts, topk, weighted_sampling

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_quality_classifier": quality.op1_quality_classifier,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_document_fingerprints": weighted_sampling.op5_document_fingerprints,
        "op6_lm_scoring": lm_score.op6_lm_scoring,
        "op7_media_columns": media.op7_media_columns,
        "op8_secret_scans": secret_scan.op8_secret_scans,
        "op9_mixing_sources": mixing.op9_mixing_sources,
        "op10_license_scans": licenses.op10_license_scans,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_exact_topk": topk.op12_exact_topk,
        "op13_spelling_variants": spelling.op13_spelling_variants,
        **{name: query for name, (query, _) in base.BASE.items()},
    }


def oracle_sql() -> dict[str, str]:
    whole = {"op11_filter_audit": filter_audit.SQL, "op12_exact_topk": topk.SQL, "op13_spelling_variants": spelling.SQL}
    return whole | {name: sql for name, (_, sql) in base.BASE.items()}

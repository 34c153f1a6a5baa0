"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontamination, fingerprints, jaccard_join, packing, quality, ranking, secrets, substring_dedup, suffix_dedup, token_counts, url_filters, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontamination.digest,
        "op2_jaccard_join": jaccard_join.digest,
        "op3_substring_dedup": substring_dedup.digest,
        "op4_token_counts": token_counts.digest,
        "op5_suffix_array_dedup": suffix_dedup.digest,
        "op6_quality_classifier": quality.digest,
        "op7_url_filters": url_filters.digest,
        "op8_packing": packing.digest,
        "op9_fingerprints": fingerprints.digest,
        "op10_secret_scans": secrets.digest,
        "op11_chat_formatting": chat.digest,
        "op12_ranked_search": ranking.digest,
        "op13_whitening": whitening.digest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filters": url_filters.SQL}

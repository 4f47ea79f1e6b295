"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trajspark.llm import decontamination, fingerprints, language, near_duplicates, personal, pieces, quality, secrets, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.query,
    "op2_url_filters": urls.query,
    "op3_sentencepiece": pieces.query,
    "op4_language_id": language.query,
    "op5_pii": personal.query,
    "op6_secret_scans": secrets.query,
    "op7_quality": quality.query,
    "op8_decontamination": decontamination.query,
    "op9_fingerprints": fingerprints.query,
    "op10_near_dedup": near_duplicates.query,
}
SQL: dict[str, str] = {"op2_url_filters": urls.ORACLE, "op8_decontamination": decontamination.ORACLE}

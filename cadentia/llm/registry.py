"""The corpus queries and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, language_id, lexical_search, line_dedup, minhash_dedup, pii_sanitise, quality_rules, secret_scan, source_mixing, suffix_dedup, toxicity, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": minhash_dedup.query,
    "op2_line_dedup": line_dedup.query,
    "op3_suffix_dedup": suffix_dedup.query,
    "op4_pii_sanitise": pii_sanitise.query,
    "op5_source_mixing": source_mixing.query,
    "op6_language_id": language_id.query,
    "op7_secret_scan": secret_scan.query,
    "op8_toxicity": toxicity.query,
    "op9_decontaminate": decontaminate.query,
    "op10_quality_rules": quality_rules.query,
    "op11_exact_dedup": exact_dedup.query,
    "op12_lexical_search": lexical_search.query,
    "op13_vector_codes": vector_codes.query,
}
ORACLES: dict[str, str] = {
    "op1_minhash_dedup": minhash_dedup.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
    "op11_exact_dedup": exact_dedup.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}

"""The operators' queries and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Module of each query; a module has SQL if SQL can express the query.
MODULES = {
    "op1_secret_scan": "secret_scan",
    "op2_quality_rules": "quality_rules",
    "op3_language_id": "language_id",
    "op4_token_counts": "token_counts",
    "op5_exact_dedup": "exact_dedup",
    "op6_mixing": "mixing",
    "op7_suffix_array_dedup": "suffix_array_dedup",
    "op8_substring_dedup": "substring_dedup",
    "op9_minhash_dedup": "minhash_dedup",
    "op10_packing": "packing",
    "op11_source_divergence": "divergence",
    "op12_toxicity": "toxicity",
    "op13_phrases": "phrases",
}


def queries() -> dict:
    return {name: getattr(import_module(f"orebody.llm.{m}"), name) for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"orebody.llm.{m}"), "SQL", None) for name, m in MODULES.items()}
    return {k: v for k, v in found.items() if v}

"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: query: (module, has SQL)
_QUERIES = {
    "op1_exact_dedup": ("exact_dedup", True),
    "op2_line_dedup": ("line_dedup", True),
    "op3_best_fit_packing": ("packing", False),
    "op4_warc": ("warc", True),
    "op5_ngram_jaccard_join": ("ngram_join", False),
    "op6_url_filters": ("url_filters", True),
    "op7_toxicity": ("toxicity", False),
    "op8_language_id": ("language_id", False),
    "op9_quality_rules": ("quality_rules", True),
    "op10_mixing": ("mixing", True),
    "op11_hard_negatives": ("hard_negatives", True),
    "op12_merkle": ("merkle", True),
    "op13_substring_dedup": ("substring_dedup", True),
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, (module, _) in _QUERIES.items()}


def oracle_sql() -> dict:
    return {name: import_module(f"{__package__}.{module}").ORACLE for name, (module, sql) in _QUERIES.items() if sql}

"""Operators of a training-data pipeline; nothing else in the library imports this package."""

from __future__ import annotations

from importlib import import_module

#: (query, module, whether the module's SQL gives the same rows)
REGISTER = [
    ("op3_jaccard_join", "jaccard", True),
    ("op2_substring_dedup", "substring", True),
    ("op5_suffix_dedup", "suffix", False),
    ("op8_decontamination", "decontam", True),
    ("op9_toxicity", "toxicity", False),
    ("op6_pii", "pii", True),
    ("op4_top_k", "topk", True),
    ("op1_language_id", "langid", False),
    ("op10_token_ids", "tokens", False),
    ("op7_mixing", "mixing", True),
    ("op11_secrets", "secrets", True),
    ("op12_conversation_repair", "conversations", True),
    ("op13_periodic_runs", "periods", True),
]


def queries() -> dict:
    return {name: getattr(import_module(f"{__name__}.{module}"), name) for name, module, _ in REGISTER}


def oracle_sql() -> dict:
    return {name: import_module(f"{__name__}.{module}").SQL for name, module, sql in REGISTER if sql}

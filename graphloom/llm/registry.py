"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

#: query -> module that defines it
MODULES = {
    "op1_exact_top_k": "topk",
    "op2_token_counts": "tokens",
    "op3_quality": "quality",
    "op4_byte_bpe": "bpe",
    "op5_pattern_packing": "packing",
    "op6_near_duplicates": "minhash",
    "op7_language_id": "langid",
    "op8_repeated_strings": "suffix_dedup",
    "op9_toxicity": "toxicity",
    "op10_embedding_near_dedup": "embed_dedup",
    "op11_vector_codes": "vector_codes",
    "op12_whitening": "whitening",
    "op13_url_filter": "url_filter",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in dict.fromkeys(MODULES.values()):
        found |= getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", {})
    return found

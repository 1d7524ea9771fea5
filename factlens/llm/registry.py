"""The queries and oracle SQL of all operators in this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ("url_filters", "quality_rules", "secret_scans", "decontamination", "html_extraction", "sharding", "sentencepiece_codec", "toxicity", "near_dedup", "suffix_dedup", "cross_tokenizer", "fill_in_middle", "max_score")


def _all(kind: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"factlens.llm.{m}"), kind).items()}


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")

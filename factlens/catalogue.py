"""The registered queries and their oracle SQL, gathered from the modules that define them."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("facts", "texts", "stored", "statements")


def _all(kind: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"factlens.plans.{m}"), kind).items()}


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")

"""Every registered query with its SQL twin, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ["texts", "groups", "language", "models", "more"]


def _all(what: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"glossa.plans.{m}"), what)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")

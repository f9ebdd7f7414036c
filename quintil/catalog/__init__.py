"""Registered queries and their SQL twins, by operator family."""

from __future__ import annotations

from importlib import import_module

from quintil.catalog.base import QUERIES, TWINS

_MODULES = ("dataset", "splits", "diagnostics", "explore", "models", "closed_forms", "runs")


def load() -> tuple[dict, dict]:
    for module in _MODULES:
        import_module(f"quintil.catalog.{module}")
    return QUERIES, TWINS

"""Collects the library's own queries and their SQL."""

from __future__ import annotations

import importlib

#: Modules of this package with a QUERIES and an ORACLES dictionary.
MODULES: tuple[str, ...] = ("tables", "learning")


def _collect(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(importlib.import_module(f"stagekit.plans.{module}"), name)
    return found


def all_queries() -> dict:
    return _collect("QUERIES")


def all_oracles() -> dict:
    return _collect("ORACLES")

"""Registry of all queries and their oracles."""

from __future__ import annotations

import importlib

MODULES = ["corpus", "chunks", "search", "answers", "evals", "graphs", "traces", "streams"]


def _collect(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"attestry.plans.{name}"), attribute)
        clash = set(out) & set(part)
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracles() -> dict[str, str]:
    return _collect("ORACLES")

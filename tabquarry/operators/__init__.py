"""Registry of the engine's queries.

Every module of this package exposes ``QUERIES`` (name -> callable(spark, sf_dir) -> DataFrame)
and ``ORACLE`` (name -> DuckDB SQL of the same rows).
"""

from __future__ import annotations

import importlib

MODULES: list[str] = ["profile", "quality", "impute", "relations", "outliers", "drift", "prep", "planned", "summaries"]


def collect(kind: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(importlib.import_module(f"{__name__}.{name}"), kind))
    return out

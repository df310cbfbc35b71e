"""The queries of this package, for the driver's entry file."""

from __future__ import annotations

from . import chat, mixing, neardup, neighbours, packing, pii, quality, sharding, substrings, topk

PARTS = (mixing, quality, substrings, topk, neighbours, neardup, pii, chat, sharding, packing)
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLE = {name: sql for part in PARTS for name, sql in part.ORACLE.items()}

"""Queries and SQL of the training-data operators, by registered name."""

from __future__ import annotations

from . import fingerprints, lines, media, mixing, packing, secrets, sharding, simhash, substrings, toxicity

_MODULES = [fingerprints, lines, media, mixing, packing, secrets, sharding, simhash, substrings, toxicity]

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL = {name: q for m in _MODULES for name, q in m.ORACLE_SQL.items()}

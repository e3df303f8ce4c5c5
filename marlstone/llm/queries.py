"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, decontamination, language, media, packing, pii, repeats, scoring, sharding, similarity

MODULES = [chat, sharding, similarity, media, language, decontamination, pii, packing, repeats, scoring]

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in getattr(module, "ORACLES", {}).items()}

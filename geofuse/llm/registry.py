"""Every query of the subpackage, with its SQL where SQL can express it."""

from __future__ import annotations

import importlib

MODULES = ("pii", "decontaminate", "exact_dedup", "mixing", "token_counts", "warc", "html_text", "simhash", "token_ids", "quality", "periodic", "alignment", "topk")
_loaded = [importlib.import_module(f"geofuse.llm.{m}") for m in MODULES]

QUERIES = {k: f for m in _loaded for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in _loaded for k, q in getattr(m, "ORACLES", {}).items()}

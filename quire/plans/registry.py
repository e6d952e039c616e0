"""Collects the registered queries and their check SQL from the query modules."""

from __future__ import annotations

import importlib

MODULES = ["q_text", "q_blocks", "q_segment", "q_elements", "q_quality", "q_align", "q_overview", "q_translate",
           "q_edits", "q_highlights", "q_tables", "q_jobs"]


def load() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"quire.plans.{name}")
        for target, source in ((queries, module.QUERIES), (oracles, module.ORACLES)):
            clash = target.keys() & source.keys()
            if clash:
                raise ValueError(f"query registered twice: {sorted(clash)}")
            target.update(source)
    return queries, oracles

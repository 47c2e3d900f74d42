"""Registered queries over the driver tables."""

from __future__ import annotations

import importlib

from claimgrid.workload.registry import ORACLES, QUERIES

MODULES = ["q_state", "q_reconcile", "q_amend", "q_text", "q_documents", "q_grid", "q_lineage", "q_risk", "q_store", "q_sources", "q_flows"]


def _load():
    for m in MODULES:
        importlib.import_module(f"claimgrid.workload.{m}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict:
    _load()
    return dict(ORACLES)

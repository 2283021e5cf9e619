"""Collects the registered queries and SQL twins of every area module."""

from __future__ import annotations

import importlib

AREAS = ["spc", "profile", "prep", "clean", "timeseries", "explore", "pipeline", "ml"]


def _modules():
    return [importlib.import_module(f"kiln.workloads.{a}") for a in AREAS]


def queries():
    out = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def oracle_sql():
    out = {}
    for m in _modules():
        out.update(getattr(m, "SQL", {}))
    return out

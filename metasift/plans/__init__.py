"""Checked queries, one module per inventory section."""

from __future__ import annotations

import importlib

MODULES = [
    "payloads", "detection", "references", "lineage", "configs", "quality", "ingestion", "activities",
    "inventory", "extraction", "code", "jobspecs", "files", "streams",
]


def load_all():
    """Import every query module and return the catalog."""
    from metasift.plans import catalog

    for m in MODULES:
        try:
            importlib.import_module(f"metasift.plans.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"metasift.plans.{m}":
                raise
    return catalog.ENTRIES

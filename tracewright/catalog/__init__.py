"""Registered queries by area; importing an area fills the registry."""

from importlib import import_module

AREAS = ["scans", "runblocks", "lifecycles", "waits", "turns", "runfiles", "evaluate", "stats", "documents", "heads", "streams"]


def all_queries():
    for a in AREAS:
        import_module(f"tracewright.catalog.{a}")
    from tracewright.catalog.base import REGISTRY

    return REGISTRY

"""Named queries with their SQL equivalents."""

import importlib

MODULES = ("series", "scoring", "ledger", "dedup", "sources", "funnels", "streams")


def load():
    from pulsetrail.catalog import registry
    for m in MODULES:
        try:
            importlib.import_module(f"pulsetrail.catalog.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"pulsetrail.catalog.{m}":
                raise
    return registry

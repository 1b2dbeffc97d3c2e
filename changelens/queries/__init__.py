"""Registered queries: one per operator, each with the SQL that an independent engine must agree with."""

import importlib
import pkgutil

from changelens.queries.registry import ORACLES, QUERIES


def load() -> None:
    """Import every query module, which registers its queries."""
    for module in sorted(item.name for item in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")


__all__ = ["ORACLES", "QUERIES", "load"]

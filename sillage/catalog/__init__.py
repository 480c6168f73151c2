"""Registered queries with the SQL that gives the same rows."""

from __future__ import annotations

import importlib
import pkgutil

from sillage.catalog.base import ORACLES, QUERIES

for _module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name != "base"):
    importlib.import_module(f"{__name__}.{_module}")

__all__ = ["ORACLES", "QUERIES"]

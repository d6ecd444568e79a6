"""Operators for training-data pipelines. Nothing else in the library imports this package."""

from __future__ import annotations

import importlib
import pkgutil

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

for _info in pkgutil.iter_modules(__path__):
    _module = importlib.import_module(f"{__name__}.{_info.name}")
    QUERIES.update(getattr(_module, "QUERIES", {}))
    ORACLES.update(getattr(_module, "ORACLES", {}))

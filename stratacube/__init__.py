"""Raster time-series analytics on PySpark: cubes, pyramids, temporal deltas, products, stores.

The verbs of the package; the modules below it have the rest. They are loaded when they are first used.
"""

from __future__ import annotations

import importlib
from typing import Any

__version__ = "0.2.0"

#: Name -> module and name there.
_PUBLIC = {
    "open": ("sources.store", "load"),
    "read": ("sources.store", "read"),
    "write": ("sources.store", "write"),
    "append": ("sources.store", "append"),
    "is_store": ("sources.store", "is_store"),
    "StoreSource": ("sources.store", "StoreSource"),
    "Cube": ("sources.metadata", "Cube"),
    "Band": ("sources.metadata", "Band"),
    "SchemaError": ("sources.metadata", "SchemaError"),
    "new_cube": ("sources.metadata", "new_cube"),
    "convert": ("operators.convert", "convert"),
    "validate": ("operators.validate", "problems"),
    "doctor": ("operators.validate", "doctor"),
    "export": ("sources.geotiff", "export"),
    "stac_documents": ("sources.stac", "documents"),
}
__all__ = ["__version__", *_PUBLIC]


def __getattr__(name: str) -> Any:
    if name not in _PUBLIC:
        raise AttributeError(f"{__name__} has no {name}")
    module, there = _PUBLIC[name]
    return getattr(importlib.import_module(f"{__name__}.{module}"), there)


def __dir__() -> list[str]:
    return sorted({*globals(), *_PUBLIC})

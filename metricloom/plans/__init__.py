"""Registered queries and their independent SQL statements."""

from __future__ import annotations

import importlib
import pkgutil

from metricloom.plans import registry


def _load() -> None:
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")


def queries() -> dict:
    _load()
    return dict(registry.QUERIES)


def statements() -> dict[str, str]:
    _load()
    return dict(registry.STATEMENTS)


def coverage() -> dict[str, str]:
    _load()
    return dict(registry.COVERS)

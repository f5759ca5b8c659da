"""Registered queries over the test tables."""

from __future__ import annotations

from importlib import import_module
from types import ModuleType

MODULES = ["telemetry", "failure_queries", "feature_queries", "evaluation_queries", "model_queries"]


def load() -> ModuleType:
    """Import every query module and return the registry."""
    for name in MODULES:
        import_module(f"fleetpulse.catalog.{name}")
    return import_module("fleetpulse.catalog.registry")

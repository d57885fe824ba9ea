"""Adapters from the driver tables to the operators, and the query registry."""

import importlib

MODULES = ["market", "forecasting", "strategy", "valuing", "reference", "text", "feeds", "estimates", "sources", "grounded", "datasets"]


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")

"""Imports every family so that its queries are registered."""

import importlib

FAMILIES = ["cleaning", "facts", "features", "detectors", "events", "rules", "evaluation", "candidates", "models", "reports", "sources", "runs", "backtests", "modelling", "closing", "checking", "reviewing"]

for _name in FAMILIES:
    importlib.import_module(f"orderpulse.catalog.{_name}")

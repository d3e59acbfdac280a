"""Composed queries over the driver tables, with their checking SQL."""

from __future__ import annotations

import importlib

MODULES = ["index_plans", "grid_plans", "series_plans", "ensemble_plans", "score_plans", "catalog_plans", "store_plans"]


def load_all() -> None:
    """Import every plan module, which registers its queries."""
    for name in MODULES:
        importlib.import_module(f"gridseries.plans.{name}")

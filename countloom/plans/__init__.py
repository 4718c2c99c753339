"""Named queries over the driver tables."""

from __future__ import annotations

import importlib
import pkgutil


def load_catalog():
    """Import every query module and return (queries, oracle SQL)."""
    from countloom.plans import catalog

    for module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("study_")):
        importlib.import_module(f"{__name__}.{module}")
    return catalog.QUERIES, catalog.ORACLES

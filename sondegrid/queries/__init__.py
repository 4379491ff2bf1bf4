"""Registry of queries. Each module of this package has QUERIES (name to function of session and folder) and SQL (name to text)."""

from __future__ import annotations

import importlib
import pkgutil


def _modules():
    for m in sorted(x.name for x in pkgutil.iter_modules(__path__) if not x.name.startswith("_")):
        yield importlib.import_module(f"{__name__}.{m}")


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _modules() for k, s in m.SQL.items()}


def flagship(spark, sf_dir):
    return queries()["jn01_point_raster_lookup"](spark, sf_dir)

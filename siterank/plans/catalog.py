"""All registered queries."""

import importlib

from siterank.plans.registry import ORACLES, QUERIES

for _part in ("scans", "projections", "joins", "aggregates", "windows", "scalars", "fitting", "streams"):
    importlib.import_module(f"siterank.plans.{_part}")

__all__ = ["ORACLES", "QUERIES"]

"""Importing this module registers every query."""

import importlib
import pkgutil

from veriledger import plans
from veriledger.plans.catalog import ORACLES, QUERIES

for _module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
    if _module.startswith("q_"):
        importlib.import_module(f"veriledger.plans.{_module}")

__all__ = ["ORACLES", "QUERIES"]

"""All registered queries, by section of the inventory."""

import importlib
import pkgutil

import bedside.plans as _plans
from bedside.plans.registry import QUERIES, SQL  # noqa: F401

for _m in sorted(m.name for m in pkgutil.iter_modules(_plans.__path__) if m.name.startswith("on_")):
    importlib.import_module(f"bedside.plans.{_m}")

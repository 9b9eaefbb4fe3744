"""All registered queries of the reference's operators, with their SQL oracles."""

from __future__ import annotations

import importlib
import pkgutil

import tidemark.plans as plans
from tidemark.plans.registry import ORACLES, QUERIES, Query


def _load() -> None:
    for module in pkgutil.iter_modules(plans.__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"tidemark.plans.{module.name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)

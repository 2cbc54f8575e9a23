"""All registered queries and the SQL which checks them."""

from __future__ import annotations

import importlib

from deltatree.plans.common import ORACLES, QUERIES, Plan, compose

MODULES = ("relational", "decomposition", "anomaly", "statistics", "events", "whatif", "quality", "reports", "drilldown", "streams")

for _name in MODULES:
    importlib.import_module(f"deltatree.plans.{_name}")


def all_queries() -> dict[str, Plan]:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return {name: compose(sql) for name, sql in ORACLES.items()}

"""All registered queries of the library and the SQL that states the same results."""

from __future__ import annotations

import importlib
import pkgutil

from corpusmill import plans
from corpusmill.plans.registry import QUERIES, SQL, Query

for module in pkgutil.iter_modules(plans.__path__):
    importlib.import_module(f"corpusmill.plans.{module.name}")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

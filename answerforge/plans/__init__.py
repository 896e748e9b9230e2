"""Named queries over the test tables."""

import importlib
import pkgutil

from answerforge.plans.registry import ORACLES, QUERIES


def load_queries():
    """(queries, sql) of every module of this package."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return QUERIES, ORACLES

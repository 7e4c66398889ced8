"""Tamarack: a model-and-query layer over Spark DataFrames.

Tables are declared as models with typed fields and foreign keys; queries are written as lookup
paths, from which the joins and groups they imply are planned into one lazy DataFrame.

The public names of the modules below can be taken from here; they are imported on first use,
so that Python workers do not load what they do not need.
"""

import importlib

_MODULES = ("errors", "fields", "functions.expressions", "model", "operators.query", "operators.dml", "settings")


def __getattr__(name: str):
    if not name.startswith("_"):
        for module in _MODULES:
            found = getattr(importlib.import_module(f"tamarack.{module}"), name, None)
            if found is not None:
                return found
    raise AttributeError(name)

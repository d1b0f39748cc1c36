"""All queries of the library and their SQL; those of the training-data package only if it is there."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("siftmill.plans.general", "siftmill.plans.records", "siftmill.plans.search", "siftmill.plans.images", "siftmill.plans.measures")


def _gather(attribute: str, modules: tuple[str, ...]) -> dict:
    out: dict = {}
    for name in modules:
        found = getattr(importlib.import_module(name), attribute)
        if twice := out.keys() & found.keys():
            raise ValueError(f"queries named twice: {sorted(twice)}")
        out |= found
    return out


def queries(modules: tuple[str, ...] = MODULES) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _gather("QUERIES", modules)


def oracles(modules: tuple[str, ...] = MODULES) -> dict[str, str]:
    return _gather("ORACLES", modules)

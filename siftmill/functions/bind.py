"""Values that are named more than once but computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often the body names it.

    Projections find common parts by themselves; filters and generators don't.
    """
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)

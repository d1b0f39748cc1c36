"""Joins against a table of unique keys that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.session import is_small

#: Rows from which a key counts as hot. Of N rows at most N / HOT_ROWS keys are hot.
HOT_ROWS = 1_000_000
#: Hot keys that may be broadcast; where there are more, only keys of still more rows are taken as hot.
MAX_HOT_KEYS = 200_000


def lookup(
    rows: DataFrame,
    unique: DataFrame,
    keys: list[str],
    weight: str,
    spread: Column,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    max_hot: int = MAX_HOT_KEYS,
) -> DataFrame:
    """Join ``rows`` with ``unique`` on ``keys``; ``unique[weight]`` says how many rows a key has.

    Keys with ``hot_rows`` or more rows are joined by broadcast: there are few of them by count, which
    is checked (with more than ``max_hot`` the bound is raised until no more are left). The rest is shuffled by key with no key above ``hot_rows``. ``spread`` is any expression
    on ``rows`` with many values; it only places rows that have found their hot key. ``how`` is inner or
    left. Rows with a NULL key find nothing. No row is lost or doubled; the other columns of ``unique``
    are appended. ``unique`` should be cheap to read twice (a written table).
    """
    values = [c for c in unique.columns if c not in (*keys, weight)]
    hot = unique.where(F.col(weight) >= hot_rows)
    while not is_small(hot, max_hot):
        hot_rows *= 2
        hot = unique.where(F.col(weight) >= hot_rows)
    if hot.isEmpty():
        return rows.join(unique.drop(weight), keys, how)
    packed = hot.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.struct(F.lit(True).alias("__hit"), *values).alias("__hot"))
    cold = unique.where(F.col(weight) < hot_rows).select(
        *[F.col(k).alias(f"__c{i}") for i, k in enumerate(keys)], F.struct(F.lit(True).alias("__hit"), *values).alias("__cold"), F.lit(-1).alias("__place")
    )
    first = rows.join(F.broadcast(packed), [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(keys)], "left")
    first = first.withColumn("__at", F.when(F.col("__hot").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(spread), F.lit(1 << 30)).cast("int")))
    # A row that has its answer gets a place no cold key has, so it is spread and matches nothing.
    first = first.select(*rows.columns, "__hot", *[F.when(F.col("__hot").isNull(), F.col(k)).alias(f"__r{i}") for i, k in enumerate(keys)], "__at")
    both = first.join(cold, [F.col("__at") == F.col("__place"), *[F.col(f"__r{i}") == F.col(f"__c{i}") for i, _ in enumerate(keys)]], "left")
    got = F.coalesce("__hot", "__cold")
    if how == "inner":
        both = both.where(got.isNotNull())
    return both.select(*rows.columns, *[got[v].alias(v) for v in values])

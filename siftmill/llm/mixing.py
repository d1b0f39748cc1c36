"""Mixing sources to target shares of all tokens.

Tokens are summed by source and hash bucket; the bucket in which a source's budget ends is found, only that bucket
is summed again by the next bits of the hash, and so on until one record is left in it. The budget is then a single
hash threshold for a source: records below it are taken once more than the others. Nothing is sorted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftmill.llm.encode import VOCABULARY, token_counts
from siftmill.session import broadcast_if_small, materialise

BITS = 12
LEVELS = 5
#: Sources with a target; a plan beyond it is refused.
MAX_SOURCES = 10_000


@dataclass
class Mix:
    """``picked``: (key, source, n_tokens, copies) of every record taken. ``report``: one row a source."""

    picked: DataFrame
    report: DataFrame


def _bucket(level: int):
    return F.shiftright("h", BITS * (LEVELS - 1 - level))


def mix_sources(rows: DataFrame, targets: DataFrame, key: str, text: str, source: str, total_tokens: int | None = None, path: str = VOCABULARY) -> Mix:
    """Take records so that each source makes up its ``target_share`` of all tokens.

    ``targets(source, target_share, max_repeats)`` has one row a source (of repeated ones the least counts); NULL
    or negative shares count as 0, NULL repeats as 1. Shares hold among the sources that have any tokens; a source
    without any is reported with 0. ``total_tokens`` is the size of the mix; by default it is the greatest at which no
    source needs more than ``max_repeats`` copies. With a greater one, sources give what they have and the report
    tells the shares reached. A source comes as near to its budget as whole records in hash order allow: it misses it
    by at most half the record the budget ends in. Every record of a source is taken equally often but for one time. Records with NULL
    source or one without a target aren't taken; NULL and empty texts have 0 tokens and come with their hash.
    Records with one and the same key stand or fall together. Empty tables give an empty mix.
    """
    base = rows.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    sized = token_counts(base, ["key", "source"], "text", path)
    sized = materialise(sized.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.col("key"), F.lit("mix")), 64 - BITS * LEVELS)), "sized")
    goals = targets.where(F.col("source").isNotNull()).groupBy(F.col("source").cast("string").alias("source")).agg(
        F.min(F.struct(F.coalesce("target_share", F.lit(0.0)).cast("double").alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("reps"))).alias("t")
    )
    asked = {r.source: (max(0.0, r.t.share), max(0, r.t.reps)) for r in goals.limit(MAX_SOURCES + 1).collect()}
    if len(asked) > MAX_SOURCES:
        raise ValueError("too many sources")
    spark = rows.sparkSession
    names = spark.createDataFrame([(s,) for s in asked], "source string")
    wanted = sized.join(broadcast_if_small(names), "source", "left_semi")
    have = {r.source: r.n for r in wanted.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    live = {s: v for s, v in asked.items() if have.get(s) and v[0] > 0 and v[1] > 0}
    whole = sum(share for share, _ in live.values())
    total = total_tokens
    if total is None:
        total = int(min((have[s] * reps * whole / share for s, (share, reps) in live.items()), default=0))
    plan = {}
    for s, (share, reps) in live.items():
        budget = int(total * share / whole)
        full = min(reps, budget // have[s])
        plan[s] = [full, 0 if full == reps else budget - full * have[s], 0]
    # Where the rest of each budget ends: prefix of the hash, and tokens below it.
    open_ = {s: (0, 0) for s, (_, rest, _) in plan.items() if rest > 0}
    held = sized
    for level in range(LEVELS):
        if not open_:
            break
        at = spark.createDataFrame([(s, prefix, plan[s][1] - below) for s, (prefix, below) in open_.items()], "source string, prefix bigint, rest bigint")
        inside = held.join(broadcast_if_small(at), "source").where((F.shiftright("h", BITS * (LEVELS - level)) == F.col("prefix")) if level else F.lit(True))
        if level == 1:
            # The buckets in which budgets end are all that later levels read: one in 4,096 of each source.
            inside = materialise(inside, "bucket")
            held = inside.select("key", "source", "n_tokens", "h")
        sums = inside.groupBy("source", "prefix", "rest", _bucket(level).alias("b")).agg(F.sum("n_tokens").alias("n"), F.countDistinct("key").alias("d") if level == LEVELS - 1 else F.count("*").alias("d"))
        run = sums.withColumn("upto", F.sum("n").over(W.partitionBy("source").orderBy("b")))
        ends = run.where(F.col("upto") > F.col("rest")).groupBy("source", "rest").agg(F.min(F.struct("b", "upto", "n", "d")).alias("e")).collect()
        after = {}
        for r in ends:
            below = open_[r.source][1] + r.e.upto - r.e.n
            plan[r.source][2] = r.e.b << (BITS * (LEVELS - 1 - level))
            if r.e.d > 1 and level < LEVELS - 1:
                after[r.source] = (r.e.b, below)
            elif below + r.e.n - plan[r.source][1] < plan[r.source][1] - below:
                # The record the budget ends in is taken if that comes nearer to it.
                plan[r.source][2] += 1 << (BITS * (LEVELS - 1 - level))
        for s in open_:
            # All of the prefix fits.
            if s not in {r.source for r in ends}:
                plan[s][2] = (open_[s][0] + 1) << (BITS * (LEVELS - level))
        open_ = after
    steps = spark.createDataFrame([(s, f, t) for s, (f, _, t) in plan.items()], "source string, full int, upto bigint")
    picked = sized.join(broadcast_if_small(steps), "source").withColumn("copies", F.col("full") + (F.col("h") < F.col("upto")).cast("int"))
    picked = picked.where(F.col("copies") > 0).select(F.col("key").alias(key), F.col("source").alias(source), "n_tokens", "copies")
    taken = picked.groupBy(F.col(source).alias("source")).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("taken"), F.count("*").alias("records"), F.max("copies").alias("most"))
    stock = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    goal = spark.createDataFrame([(s, *v, int(total * v[0] / whole) if s in live else 0) for s, v in asked.items()], "source string, target_share double, max_repeats int, budget bigint")
    both = stock.join(broadcast_if_small(goal), "source", "full").join(broadcast_if_small(taken), "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    all_ = F.sum(zero("taken")).over(W.partitionBy())
    report = both.select(
        "source",
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        zero("max_repeats").alias("max_repeats"),
        zero("tokens").alias("available_tokens"),
        zero("budget").alias("budget_tokens"),
        zero("taken").alias("taken_tokens"),
        zero("records").alias("records"),
        zero("most").alias("most_copies"),
        F.when(all_ > 0, zero("taken") / all_).otherwise(0.0).alias("reached_share"),
    )
    return Mix(picked, report)

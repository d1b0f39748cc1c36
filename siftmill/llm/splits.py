"""Splits that keep related records together.

Related rows share a record number, a picture or a path, also over a chain of rows. Keys, not rows, are the
nodes of the graph: a row hangs on its first key, and only a key value that ties different first keys makes
an edge. Forests are built where the edges lie (union-find in each partition), then two and two are merged to
one, level by level, each handing on only the nodes other forests know as well, until one is left. Groups go,
largest first, to the split furthest below its target.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftmill.functions.text import dn_of, fold_code, is_missing
from siftmill.operators.skew import HOT_ROWS, lookup
from siftmill.session import broadcast_if_small, materialise

#: Rounds are bounded only as a guard against a fault; each at least halves the longest chain.
MAX_ROUNDS = 60
#: Edges a single task may hold in its forest.
FOREST_ROWS = 500_000
#: How a split may be written, in lower case without padding. Fixed values.
SPLIT_NAMES = {"train": "train", "training": "train", "val": "val", "valid": "val", "validation": "val", "test": "test", "testing": "test"}


def split_name(value: Column) -> Column:
    bare = F.lower(F.trim(F.regexp_replace(fold_code(value), r"^\s+|\s+$", "")))
    return F.coalesce(*[F.when(bare == k, F.lit(v)) for k, v in SPLIT_NAMES.items()])


def path_key(path: Column) -> Column:
    """One form of a path: percent codes decoded, full width folded, one kind of slash. Case stays."""
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    plain = F.regexp_replace(fold_code(plain), r"[\\/]+", "/")
    return F.when(~is_missing(path), F.regexp_replace(F.trim(plain), r"^(\./)+", ""))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one partition; each node but a root comes out once, with its root,
    the least node of its tree."""
    yield from _union(batches, ())


def _numbered_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same with the number of the partition, and with roots too."""
    yield from _union(batches, (TaskContext.get().partitionId(),))


def _union(batches: Iterator[pa.RecordBatch], number: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}

    def find(x):
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.types[0]
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                low, high = (ra, rb) if ra < rb else (rb, ra)
                parent[high] = low
                parent.setdefault(low, low)
    nodes = [n for n in parent if number or find(n) != n]
    size = 1 << 16
    for i in range(0, len(nodes), size):
        part = nodes[i : i + size]
        more = [pa.array([n] * len(part), pa.int32()) for n in number]
        yield pa.RecordBatch.from_arrays([*more, pa.array(part, kind), pa.array([find(n) for n in part], kind)], [*["p"][: len(more)], "a", "b"])


def components(edges: DataFrame, forest_rows: int = FOREST_ROWS) -> DataFrame:
    """``(node, root)`` for each node of ``edges(a, b)`` (of any one ordered type) that isn't the least of its component.

    The edges are laid into as many partitions as it takes for none to hold more than ``forest_rows``, each of which makes
    a forest. Two and two are then merged to one, level by level. A node that only one forest of a level knows is settled:
    it is written with its root and goes no further; only nodes that several forests know, and their roots, are handed on.
    From the last level down, settled nodes look up what became of their roots. Only where a level hands on more than its
    tasks may hold (a graph without parts that hang together loosely) rounds of star building take over from there, which
    have no task that must hold a component. Self loops and repeated edges change nothing; rows with a NULL end are ignored.
    """
    kind = edges.schema["a"].dataType.simpleString()
    now = edges.select("a", "b").where(F.col("a") != F.col("b")).distinct()
    now = materialise(now, "edges")
    count = now.count()
    tasks = 1
    while tasks * forest_rows < count:
        tasks *= 2
    settled = []
    while tasks > 1:
        # At first by both ends, so that no hub has all its edges in one task; a later level as its forests lay.
        laid = now.repartition(tasks, "a", "b") if not settled else now
        forest = materialise(laid.mapInArrow(_numbered_forest, f"p int, a {kind}, b {kind}"), "forest")
        known = forest.groupBy("a").agg(F.countDistinct("p").alias("n"))
        shared = materialise(forest.join(known.where("n > 1").select("a"), "a", "left_semi"), "shared")
        settled.append(materialise(forest.join(known.where("n = 1").select("a"), "a", "left_semi").where(F.col("a") != F.col("b")).select("a", "b"), "settled"))
        # Roots tie the shared nodes of a forest to one another.
        handed = shared.where(F.col("a") != F.col("b"))
        tasks //= 2
        if handed.count() > tasks * forest_rows:
            return _resolve(settled, _stars(handed.select("a", "b")))
        now = handed.repartitionById(tasks, F.col("p") % tasks).select("a", "b")
    return _resolve(settled, now.coalesce(1).mapInArrow(_forest, f"a {kind}, b {kind}"))


def _resolve(settled: list[DataFrame], last: DataFrame) -> DataFrame:
    """Roots of all nodes, from those of the last level down to those that settled first. The root of a forest is its least
    node and goes on with what it hands on, so the last root is the least of all."""
    roots = materialise(last.select(F.col("a").alias("node"), F.col("b").alias("root")), "roots")
    for level in reversed(settled):
        up = roots.select(F.col("node").alias("b"), "root").groupBy("b").agg(F.min("root").alias("root"))
        sizes = level.groupBy("b").agg(F.count("*").alias("n"))
        found = lookup(level, materialise(up.join(sizes, "b"), "up"), ["b"], "n", F.col("a"), "left")
        roots = materialise(roots.unionByName(found.select(F.col("a").alias("node"), F.coalesce("root", "b").alias("root"))), "roots")
    return roots


def _stars(now: DataFrame) -> DataFrame:
    """``(a, b)``: each node but roots with its root, by rounds of large and small stars."""
    for _ in range(MAX_ROUNDS):
        # Large star: all a node ties to greater ones goes to the least it knows.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
        least = materialise(least, "least")
        large = lookup(both, least, ["a"], "n", F.col("b")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.where(F.col("a") != F.col("b")).distinct(), "large")
        # Small star: the lesser neighbours of a node, and the node, go to the least of them.
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
        small = lookup(large, least, ["a"], "n", F.col("b"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        after = materialise(small.where(F.col("a") != F.col("b")).distinct(), "forest")
        # Done when each node knows one root and no root has another.
        open_ = after.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        if not open_ and after.select("b").distinct().join(after.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count() == 0:
            return after
        now = after
    raise RuntimeError("components did not settle")


def _digest(key: Column) -> Column:
    return F.unhex(F.md5(key.cast("binary")))


def _grouped(rows: DataFrame, row_id: str, path: str, sha: str, extra: dict[str, Column], hot_rows: int, forest_rows: int) -> DataFrame:
    """``(__id, group_id, *extra)`` of every row."""
    named = F.coalesce(F.concat(F.lit("d:"), dn_of(path_key(F.col(path)), folded=True)), F.concat(F.lit("p:"), path_key(F.col(path))))
    picture = F.when(~is_missing(F.col(sha)), F.concat(F.lit("s:"), F.lower(F.trim(F.col(sha)))))
    keyed = rows.select(F.col(row_id).alias("__id"), named.alias("__named"), picture.alias("__picture"), *[c.alias(n) for n, c in extra.items()])
    # The node of a row: its record or path, else its picture, else itself; 128-bit hashes stand for the keys.
    own = F.coalesce("__named", "__picture", F.concat(F.lit("r:"), F.coalesce(F.col("__id").cast("string"), F.lit(""))))
    keyed = keyed.select("__id", _digest(own).alias("node"), F.when(F.col("__picture").isNotNull(), _digest(F.col("__picture"))).alias("pic"), *extra)
    keyed = materialise(keyed, "label_keys")
    shown = keyed.where(F.col("pic").isNotNull())
    picked = shown.groupBy("pic").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n"))
    # A picture filed under one node only ties nothing.
    several = materialise(picked.where(F.col("low") != F.col("high")).select("pic", "low", "n"), "pictures")
    ties = lookup(shown.select("pic", "node").distinct(), several, ["pic"], "n", F.col("node"), hot_rows=hot_rows)
    roots = components(ties.select(F.col("node").alias("a"), F.col("low").alias("b")), forest_rows)
    weight = keyed.groupBy("node").agg(F.count("*").alias("n"))
    roots = materialise(roots.join(weight, "node", "inner"), "roots")
    found = lookup(keyed, roots, ["node"], "n", F.col("__id"), "left", hot_rows)
    return found.select("__id", F.coalesce("root", "node").alias("group_id"), *extra)


def related_groups(rows: DataFrame, row_id: str, path: str, sha: str, hot_rows: int = HOT_ROWS, forest_rows: int = FOREST_ROWS) -> DataFrame:
    """``(row_id, group_id)`` for every row: rows of one record, picture or path, over any chain, have one
    ``group_id``.

    A row without record number, path and picture (NULL, blank or a placeholder) is a group of its own; such
    rows without an id are one group. Repeated rows share their group. Other columns aren't read, so clashing
    names do no harm. An empty table gives none.
    """
    return _grouped(rows, row_id, path, sha, {}, hot_rows, forest_rows).select(F.col("__id").alias(row_id), F.lower(F.hex("group_id")).alias("group_id"))


def conflicts(rows: DataFrame, row_id: str, path: str, sha: str, split: str, hot_rows: int = HOT_ROWS, forest_rows: int = FOREST_ROWS) -> DataFrame:
    """``(first_id, other_id)`` of each group whose known splits differ: the least id, and every other."""
    tagged = materialise(_grouped(rows, row_id, path, sha, {"__split": split_name(F.col(split))}, hot_rows, forest_rows), "tagged")
    totals = tagged.groupBy("group_id").agg(
        F.min("__id").alias("first_id"), F.min("__split").alias("low"), F.max("__split").alias("high"), F.count("*").alias("n")
    )
    mixed = materialise(totals.where(F.col("low") != F.col("high")).select("group_id", "first_id", "n"), "mixed")
    out = lookup(tagged, mixed, ["group_id"], "n", F.col("__id"), hot_rows=hot_rows)
    return out.where(F.col("__id") != F.col("first_id")).select("first_id", F.col("__id").alias("other_id"))


def greedy_counts(short: dict[str, float], size: int, count: int) -> dict[str, int]:
    """How many of ``count`` groups of ``size`` rows each split gets when each goes to the split that lacks
    most rows (ties by name). ``short``, the rows each split lacks, is brought up to date.

    The greedy takes the greatest of all values short - j * size; how many of a split's lie above a level is
    plain arithmetic, so the level is searched and only what is left at it is dealt out one by one.
    """
    above = lambda level: {s: max(0, math.ceil((v - level) / size)) for s, v in short.items()}
    low, high = min(short.values()) - float(size) * (count + 1), max(short.values())
    for _ in range(200):
        mid = (low + high) / 2
        if sum(above(mid).values()) <= count:
            high = mid
        else:
            low = mid
    given = above(high)
    for s, n in given.items():
        short[s] -= n * size
    for _ in range(count - sum(given.values())):
        s = min(short, key=lambda n: (-short[n], n))
        given[s] += 1
        short[s] -= size
    return given


def assign_splits(groups: DataFrame, targets: DataFrame, bucket_groups: int = 100_000) -> DataFrame:
    """``(group_id, n_rows, split)``: groups, largest first, to the split furthest below its share.

    ``groups(group_id, n_rows)`` has one row a group; ``targets(split, share)`` doesn't grow (at most 1,000 rows
    are accepted). The greedy only depends on how many groups have each size: that histogram (at most the square
    root of twice the rows in length) is all the driver sees. Within a size, groups are told apart by hash buckets
    whose counts place each bucket, so only groups of one bucket are ever ranked together. Shares that don't
    add up to 1 are scaled; NULL or negative shares count as 0. Without targets nothing is assigned.
    """
    goals = targets.where(F.col("split").isNotNull()).groupBy("split").agg(F.sum(F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(0.0))).alias("share")).limit(1001).collect()
    if len(goals) > 1000:
        raise ValueError("too many splits")
    spark = groups.sparkSession
    whole = sum(g.share for g in goals)
    sizes = groups.groupBy("n_rows").agg(F.count("*").alias("n")).orderBy(F.desc("n_rows")).collect()
    if not goals or not whole:
        return groups.select("group_id", "n_rows", F.lit(None).cast("string").alias("split")).limit(0)
    rows = sum(s.n_rows * s.n for s in sizes)
    short = {g.split: rows * g.share / whole for g in goals if g.share > 0}
    quota = []
    for s in sizes:
        at = 0
        for name, n in sorted(greedy_counts(short, s.n_rows, s.n).items()):
            if n:
                quota.append((s.n_rows, at, at + n, name))
            at += n
    plan = spark.createDataFrame(quota, "n_rows bigint, lo bigint, hi bigint, split string")
    buckets = max(64, -(-sum(x.n for x in sizes) // bucket_groups))
    placed = groups.withColumn("__h", F.xxhash64("group_id")).withColumn("__b", F.pmod("__h", F.lit(buckets)))
    counts = placed.groupBy("n_rows", "__b").agg(F.count("*").alias("n"))
    before = counts.withColumn("start", F.sum("n").over(W.partitionBy("n_rows").orderBy("__b")) - F.col("n"))
    ranked = placed.withColumn("__r", F.row_number().over(W.partitionBy("n_rows", "__b").orderBy("__h", "group_id")))
    seat = ranked.join(before.select("n_rows", "__b", "start"), ["n_rows", "__b"]).withColumn("__at", F.col("start") + F.col("__r") - 1)
    chosen = seat.join(broadcast_if_small(plan), [seat["n_rows"] == plan["n_rows"], F.col("__at") >= F.col("lo"), F.col("__at") < F.col("hi")])
    return chosen.select("group_id", seat["n_rows"], "split")

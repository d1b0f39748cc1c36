"""One surviving record for each group of duplicates.

Two ways to choose the value of a field:

``survivors``: a ladder of rules (fullness of the text, trust of the origin, latest, least order). It is one
aggregation with partial results before the shuffle.

``fuse``: Bayesian fusion with copy detection. Accuracies of the origins and their dependence (origins that share
false values more often than independent ones would) are estimated in turn with the posteriors of the values; copied
votes are discounted. It chooses the value of the greatest posterior.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftmill.functions.text import PLACEHOLDERS, dn_of, fold_code, is_missing, present
from siftmill.session import broadcast_if_small, materialise, numbered, spread

#: Fields whose survivors are reported.
FIELDS = ("lot_id", "machine", "defect_type", "edx_elements", "total_wafers", "text_content")
#: Origins whose statistics are held in memory, as matrices; those of more are tables, with the same results.
OWN_ORIGINS = 1_000
#: Claims of an item that are paired with as many others under one key.
PAIR_BLOCK = 1_024

_IS = r"\s*+(?:为|是|:)?+\s*+"
_NOT = r"(?!(?:" + "|".join(p for p in PLACEHOLDERS if p) + r")\s*(?:[,。;\s]|$|于|平台|站点))"
_CODE = _NOT + r"[A-Za-z0-9]"
_VALUE = _NOT + r"[^,。;\s]"
#: How a text states each of the 16 business fields, after folding. Placeholders state nothing; 0 is a count.
STATES = {
    "dn_no": r"DN\s*(?:编号|号)" + _IS + r"DN-[A-Za-z0-9]",
    "class_type": r"(?<!缺陷)(?:类型|类别)" + _IS + _NOT + r"Class\s*\d",
    "lot_id": r"(?:Lot\s*ID\s*(?:\([^)]*\))?|批次编号|批次号|批号)" + _IS + _CODE,
    "product_id": r"产品(?:编号|ID)?" + _IS + _CODE,
    "platform": r"(?<![A-Za-z0-9_.-])" + _NOT + r"[A-Za-z0-9][A-Za-z0-9_.-]*\s*平台",
    "station": r"平台(?:的|下)?\s*" + _CODE + r"[A-Za-z0-9_.-]*\s*站点",
    "machine": r"(?:扫描机器|扫描机|机器|机台)" + _IS + _CODE,
    "scan_time": r"于\s*\d{4}[/-]\d{1,2}[/-]\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}\s*完成(?:了)?扫描",
    "total_wafers": r"Wafer总数" + _IS + r"\d",
    "scanned_wafers": r"扫描过的Wafer数量" + _IS + r"\d",
    "bad_wafers": r"坏的Wafer数量" + _IS + r"\d",
    "defect_type": r"缺陷类型" + _IS + _CODE,
    "edx_elements": r"EDX检测到的元素" + _IS + _VALUE,
    "edx_bg": r"EDX背景" + _IS + _VALUE,
    "map_location": r"Map(?:上面)?分布的位置" + _IS + _VALUE,
    "dft_location": r"DFT(?:上面)?分布的位置" + _IS + _VALUE,
}
#: A text states its own number behind this label; numbers it only refers to have none.
OWN_DN = r"(?i)DN\s*(?:编号|号)" + _IS + r"(DN[-_\s]*\d{8}[-_\s]+\d{2,})"


def stated_fields(folded: Column) -> Column:
    """How many of the 16 fields a folded text states."""
    return sum((folded.rlike("(?i)" + p).cast("int") for p in STATES.values()), F.lit(0))


def group_of(dn_no: Column, record_id: Column, folded_text: Column) -> Column:
    """The record number a row belongs to: its own, else its record id's, else the one its text states."""
    return F.coalesce(dn_of(dn_no), dn_of(record_id), dn_of(F.regexp_extract(folded_text, OWN_DN, 1), folded=True))


def _ranked(rows: DataFrame, trust: DataFrame) -> DataFrame:
    """Group, rank keys and value marks of each row with a record number; the values themselves stay behind."""
    known = trust.where(F.col("origin").isNotNull()).groupBy("origin").agg(F.min("trust_rank").alias("__rank"))
    base = spread(rows.select("ord", "dn_no", "record_id", "origin", "updated_at", *FIELDS)).withColumn("__text", fold_code(F.col("text_content")))
    base = base.withColumn("dn", group_of(F.col("dn_no"), F.col("record_id"), F.col("__text"))).where(F.col("dn").isNotNull())
    told = {f: ~is_missing(F.col(f)) for f in FIELDS if f != "total_wafers"} | {"total_wafers": F.coalesce(F.col("total_wafers"), F.lit(0)) != 0}
    base = base.join(broadcast_if_small(known), "origin", "left")
    return base.select(
        "dn",
        "ord",
        F.coalesce("__rank", F.lit(2**31 - 1)).alias("rank"),
        # Later first; NULL is last.
        F.coalesce(-F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(2**63 - 1)).alias("age"),
        F.when(told["text_content"], -stated_fields(F.col("__text"))).alias("gap"),
        *[told[f].alias(f"has_{f}") for f in FIELDS],
    )


def survivors(rows: DataFrame, trust: DataFrame) -> DataFrame:
    """``(dn_no, field_name, ord)``: of each record with two rows or more, and each field, the row whose value survives.

    Placeholders, blanks, NULL and a total of 0 are no value; a field without any value has no row. The most
    trusted origin wins (one that ``trust`` lacks is last; of repeated ones the least rank counts), then the latest
    ``updated_at`` (NULL last), then the least ``ord``. For ``text_content`` the text that states most business fields
    wins before these. Rows without a record number belong nowhere; rows delivered twice are two rows. An empty table
    gives none; unknown further columns aren't read. Groups of any size are reduced before they are moved.
    """
    ranked = _ranked(rows, trust)
    plain = F.struct("rank", "age", "ord")
    full = F.struct("gap", "rank", "age", "ord")
    best = [F.min(F.when(F.col(f"has_{f}"), full if f == "text_content" else plain)).alias(f) for f in FIELDS]
    one = ranked.groupBy("dn").agg(F.count("*").alias("n"), *best).where(F.col("n") >= 2)
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f)["ord"].alias("ord"), F.col(f).isNotNull().alias("told")) for f in FIELDS]))
    return one.select(F.col("dn").alias("dn_no"), cells.alias("c")).where(F.col("c.told")).select("dn_no", "c.field_name", "c.ord")


def _with_values(picked: DataFrame, rows: DataFrame) -> DataFrame:
    """``picked(field_name, ord, ...)`` with the value that row ``ord`` has in that field, as text."""
    values = rows.select("ord", *[F.col(f).cast("string").alias(f"__{f}") for f in FIELDS])
    value = F.coalesce(*[F.when(F.col("field_name") == f, F.col(f"__{f}")) for f in FIELDS])
    return picked.join(values, "ord").select(*picked.columns, value.alias("value"))


def _records(cells: DataFrame) -> DataFrame:
    out = cells.groupBy("dn_no").pivot("field_name", list(FIELDS)).agg(F.first("value"))
    return out.withColumn("total_wafers", F.col("total_wafers").cast("int"))


def surviving_records(rows: DataFrame, trust: DataFrame) -> DataFrame:
    """``(dn_no, *fields)``: the built record of each group of two rows or more. ``ord`` must be unique."""
    return _records(_with_values(survivors(rows, trust), rows))


@dataclass
class Fusion:
    """``values``: (dn_no, field_name, value, posterior, ord). ``accuracies``: (origin, accuracy) of all origins;
    ``copies``: (origin, other, copying) of all pairs that told of one item: the probability that one copies of the other.
    ``accuracy`` and ``copying`` give the same of the ``named`` origins, those with most rows; 0 for pairs that never met."""

    values: DataFrame
    accuracies: DataFrame
    copies: DataFrame
    named: list[str]

    @cached_property
    def accuracy(self) -> dict[str, float]:
        return {r.origin: r.accuracy for r in self.accuracies.where(F.col("origin").isin(self.named)).orderBy("origin").collect()}

    @cached_property
    def copying(self) -> dict[tuple[str, str], float]:
        met = self.copies.where(F.col("origin").isin(self.named) & F.col("other").isin(self.named)).collect()
        return dict.fromkeys(itertools.combinations(sorted(self.named), 2), 0.0) | {(r.origin, r.other): r.copying for r in met}

    def records(self) -> DataFrame:
        """``(dn_no, *fields)``: each record built of its values of greatest posterior."""
        return _records(self.values)


@dataclass
class Claims:
    """Claims of items that have equally many, (items, claims): origin, hash of the value, row; the most accurate first."""

    item: np.ndarray
    origin: np.ndarray
    ord: np.ndarray
    same: np.ndarray
    weight: np.ndarray
    copying: np.ndarray


def _claims(batch: pa.RecordBatch, accuracy: np.ndarray, copying: np.ndarray, false_values: int) -> Iterator[Claims]:
    column = batch.column("claims")
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    flat = column.flatten()
    origin, h, row = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    for m in np.unique(sizes):
        items = np.flatnonzero(sizes == m)
        step = max(1, (1 << 20) // int(m * m))
        for i in range(0, len(items), step):
            some = items[i : i + step]
            at = starts[some][:, None] + np.arange(m)
            order = np.argsort(-accuracy[origin[at]], axis=1, kind="stable")
            at = np.take_along_axis(at, order, axis=1)
            o, v = origin[at], h[at]
            a = accuracy[o]
            yield Claims(some, o, row[at], v[:, :, None] == v[:, None, :], np.log(false_values * a / (1 - a)), copying[o[:, :, None], o[:, None, :]])


def _votes(c: Claims, false_values: int) -> np.ndarray:
    """Posterior of each claim's value: (items, claims). Votes for a value are counted from the most accurate origin
    on; each later one counts as much as it is independent of those before it."""
    items, m = c.origin.shape
    score = np.zeros((items, m))
    for j in range(m):
        free = np.ones((items, m))
        for q in range(j):
            # In the vote for claim i's value, origin j copies of q if both say it.
            free *= 1 - 0.8 * c.copying[:, j, q, None] * (c.same[:, :, j] & c.same[:, :, q])
        score += np.where(c.same[:, :, j], c.weight[:, j, None] * free, 0)
    # One share for each distinct value: the first claim that says it stands for it.
    lead = np.argmax(c.same, axis=2) == np.arange(m)
    top = score.max(axis=1, keepdims=True)
    mass = np.exp(score - top)
    # All the values nobody told have weight 1 each.
    rest = np.maximum(0, false_values + 1 - lead.sum(axis=1, keepdims=True)) * np.exp(-top)
    return mass / ((mass * lead).sum(axis=1, keepdims=True) + rest + 1e-300)


def _estimate(accuracy: np.ndarray, copying: np.ndarray, false_values: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of one partition, by pair of origins that told of one item: agreement on true values, on false ones,
    dissent; of an origin with itself: posterior and number of its claims."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(accuracy)
        true_, false_, apart = np.zeros((n, n)), np.zeros((n, n)), np.zeros((n, n))
        for batch in batches:
            for c in _claims(batch, accuracy, copying, false_values):
                post = _votes(c, false_values)
                a, b = np.broadcast_arrays(c.origin[:, :, None], c.origin[:, None, :])
                other = ~np.eye(c.origin.shape[1], dtype=bool)[None]
                agree, share = c.same & other, post[:, :, None]
                np.add.at(true_, (a, b), agree * share)
                np.add.at(false_, (a, b), agree * (1 - share))
                np.add.at(apart, (a, b), ~c.same & other)
                # The diagonal is free for what an origin says alone.
                np.add.at(true_, (c.origin, c.origin), post)
                np.add.at(apart, (c.origin, c.origin), 1)
        a, b = np.nonzero(true_ + false_ + apart)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int32()), pa.array(b, pa.int32()), *[pa.array(x[a, b], pa.float64()) for x in (true_, false_, apart)]], ["a", "b", "t", "f", "d"]
        )

    return run


def _copy_probability(t: float, f: float, d: float, a1: float, a2: float, false_values: int, prior: float = 0.1, rate: float = 0.8) -> float:
    """Of one origin copying of the other, from how often they share true and false values and how often they
    differ. Shared false values are what independent origins rarely have."""
    st, sf = a1 * a2, (1 - a1) * (1 - a2) / false_values
    sd = max(1e-9, 1 - st - sf)
    mean = (a1 + a2) / 2
    alone = t * math.log(st) + f * math.log(sf) + d * math.log(sd)
    copied = t * math.log(rate * mean + (1 - rate) * st) + f * math.log(rate * (1 - mean) + (1 - rate) * sf) + d * math.log((1 - rate) * sd)
    odds = math.log(prior / (1 - prior)) + copied - alone
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def _choose(accuracy: np.ndarray, copying: np.ndarray, false_values: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, chance = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for c in _claims(batch, accuracy, copying, false_values):
                post = np.round(_votes(c, false_values), 9)
                # The greatest posterior; of equals the least ord.
                best = np.where(post == post.max(axis=1, keepdims=True), c.ord, np.iinfo(np.int64).max).argmin(axis=1)
                some = np.arange(len(best))
                row[c.item], chance[c.item] = c.ord[some, best], post[some, best]
            yield pa.RecordBatch.from_arrays([batch.column("dn"), batch.column("field_name"), pa.array(row), pa.array(chance)], ["dn_no", "field_name", "ord", "posterior"])

    return run


def fuse(rows: DataFrame, trust: DataFrame, rounds: int = 4, false_values: int = 20, own_origins: int = OWN_ORIGINS) -> Fusion:
    """Value of greatest posterior for each record of two rows or more and each field, the text included.

    Each origin's claim on a field is its latest value (ties by the least ``ord``); values are compared folded. Accuracies
    start from the trust ranks and are clamped to [0.05, 0.95]; ``false_values`` is how many wrong values a field may have.
    NULL origins are one origin. Every origin has its own accuracy and its own copying with each it meets. Statistics of up to
    ``own_origins`` origins are held in memory; those of more are tables, and the results are the same. An item is one row with a
    claim an origin at most; statistics of a round are sums by pair of origins that meet. ``ord`` must be unique. An empty table gives none.

    Texts are voted on like other values, moved as hashes only. They tell nothing about accuracies and copying, which are
    estimated on the other fields: two texts that say the same in other words differ, but neither is false.
    """
    named = rows.withColumn("__origin", F.coalesce("origin", F.lit("")))
    known = named.groupBy("__origin").agg(F.count("*").alias("n"))
    most = [r["__origin"] for r in known.orderBy(F.desc("n"), "__origin").limit(own_origins + 1).collect()]
    base = spread(named.select("ord", "dn_no", "record_id", "__origin", "updated_at", *[F.col(f).cast("string").alias(f) for f in FIELDS])).withColumn("__text", fold_code(F.col("text_content")))
    base = base.withColumn("dn", group_of(F.col("dn_no"), F.col("record_id"), F.col("__text"))).where(F.col("dn").isNotNull())
    value = lambda f: F.when(F.col(f) != "0", present(F.col(f))) if f == "total_wafers" else present(F.col(f))
    folded = lambda f: F.col("__text") if f == "text_content" else fold_code(F.col(f))
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), value(f).isNotNull().alias("has"), F.xxhash64(F.lower(F.trim(folded(f)))).alias("h")) for f in FIELDS]))
    told = base.select("dn", "ord", "__origin", F.coalesce(-F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(2**63 - 1)).alias("age"), cells.alias("c"))
    told = told.select("dn", "c.field_name", "__origin", F.when(F.col("c.has"), F.struct("age", "ord", "c.h")).alias("c"))
    # A claim an origin first, so that the list of an item is no longer than there are origins.
    claims = told.groupBy("dn", "field_name", "__origin").agg(F.count("*").alias("n"), F.min("c").alias("c"))
    ranks = trust.groupBy(F.col("origin").alias("__origin")).agg(F.min("trust_rank").alias("rank"))
    if len(most) <= own_origins:
        picked, accuracies, copies = _fuse_in_memory(claims, sorted(most), ranks, rounds, false_values)
    else:
        picked, accuracies, copies = _fuse_in_tables(claims, known, ranks, rounds, false_values)
    return Fusion(_with_values(picked, rows).select("dn_no", "field_name", "value", "posterior", "ord"), accuracies, copies, most[:own_origins])


def _fuse_in_memory(claims: DataFrame, origins: list[str], ranks: DataFrame, rounds: int, false_values: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    spark = claims.sparkSession
    n = len(origins)
    numbers = spark.createDataFrame([(o, i) for i, o in enumerate(origins)], "__origin string, o int")
    claims = claims.join(broadcast_if_small(numbers), "__origin")
    one = F.when(F.col("c").isNotNull(), F.struct("o", F.col("c.h").alias("h"), F.col("c.ord").alias("ord")))
    items = claims.groupBy("dn", "field_name").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(one)).alias("claims"))
    items = materialise(items.where((F.col("n") >= 2) & (F.size("claims") > 0)).select("dn", "field_name", "claims"), "claims")
    rank = {r["__origin"]: r["rank"] for r in ranks.join(broadcast_if_small(numbers), "__origin", "left_semi").collect()}
    accuracy = np.array([min(0.9, max(0.55, 0.95 - 0.1 * (rank.get(o) or 5))) for o in origins])
    copying = np.zeros((n, n))
    for _ in range(rounds if origins else 0):
        sums = items.where(F.col("field_name") != "text_content").mapInArrow(_estimate(accuracy, copying, false_values), "a int, b int, t double, f double, d double")
        stats = sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("t", "f", "d")]).collect()
        if not stats:
            break
        for r in stats:
            if r.a == r.b and r.d:
                accuracy[r.a] = min(0.95, max(0.05, r.t / r.d))
        for r in stats:
            if r.a != r.b:
                copying[r.a, r.b] = _copy_probability(r.t, r.f, r.d, accuracy[r.a], accuracy[r.b], false_values)
    picked = items.mapInArrow(_choose(accuracy, copying, false_values), "dn_no string, field_name string, ord bigint, posterior double")
    a, b = np.nonzero(np.triu(copying))
    names = pa.array(origins, pa.string())
    pairs = pa.table({"origin": names.take(pa.array(a, pa.int64())), "other": names.take(pa.array(b, pa.int64())), "copying": pa.array(copying[a, b], pa.float64())})
    accuracies = spark.createDataFrame([(o, float(x)) for o, x in zip(origins, accuracy, strict=True)], "origin string, accuracy double")
    return picked, accuracies, spark.createDataFrame(pairs, "origin string, other string, copying double")


def _meetings(told: DataFrame) -> DataFrame:
    """``(item, text, a, b, h, same)``: claims of two origins on one item, each pair once, a < b. Claims of an item lie in blocks
    of ``PAIR_BLOCK`` on average, and every two blocks meet under a key of their own: an item of very many origins is no task of its own."""
    laid = told.withColumn("k", F.ceil(F.col("m") / PAIR_BLOCK).cast("int")).withColumn("at", F.pmod(F.xxhash64("o"), F.col("k")).cast("int"))
    left = laid.select("item", "text", F.col("at").alias("p"), F.explode(F.sequence("at", F.col("k") - 1)).alias("q"), F.col("o").alias("o1"), "h")
    right = laid.select("item", F.explode(F.sequence(F.lit(0), "at")).alias("p"), F.col("at").alias("q"), F.col("o").alias("o2"), F.col("h").alias("h2"))
    both = left.hint("merge").join(right, ["item", "p", "q"]).where("p < q or o1 < o2")
    return both.select("item", "text", F.least("o1", "o2").alias("a"), F.greatest("o1", "o2").alias("b"), "h", (F.col("h") == F.col("h2")).alias("same"))


def _copy_column(t: Column, f: Column, d: Column, a1: Column, a2: Column, false_values: int, prior: float = 0.1, rate: float = 0.8) -> Column:
    """``_copy_probability`` as a column."""
    st, sf = a1 * a2, (1 - a1) * (1 - a2) / false_values
    sd = F.greatest(F.lit(1e-9), 1 - st - sf)
    mean = (a1 + a2) / 2
    alone = t * F.log(st) + f * F.log(sf) + d * F.log(sd)
    copied = t * F.log(rate * mean + (1 - rate) * st) + f * F.log(rate * (1 - mean) + (1 - rate) * sf) + d * F.log((1 - rate) * sd)
    odds = math.log(prior / (1 - prior)) + copied - alone
    return 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), odds))))


def _fuse_in_tables(claims: DataFrame, known: DataFrame, ranks: DataFrame, rounds: int, false_values: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``_fuse_in_memory``, for any number of origins: claims are rows, not lists, and statistics of origins and of pairs are tables."""
    numbers = materialise(numbered(known.select("__origin").orderBy("__origin"), "o"), "origins")
    claims = materialise(claims, "claims")
    items = claims.groupBy("dn", "field_name").agg(F.sum("n").alias("n"), F.count("c").alias("m")).where("n >= 2 and m > 0")
    items = materialise(items.select(F.monotonically_increasing_id().alias("item"), "dn", "field_name", "m"), "items")
    told = claims.where(F.col("c").isNotNull()).join(items, ["dn", "field_name"]).join(broadcast_if_small(numbers), "__origin")
    told = materialise(told.select("item", "m", (F.col("field_name") == "text_content").alias("text"), "o", "c.h", "c.ord"), "told")
    rank = F.coalesce(F.nullif("rank", F.lit(0)), F.lit(5))
    start = numbers.join(ranks, "__origin", "left").select("o", F.least(F.lit(0.9), F.greatest(F.lit(0.55), 0.95 - 0.1 * rank)).alias("accuracy"))
    accuracy = materialise(start, "accuracy")
    met = materialise(_meetings(told.where("not text")).groupBy("a", "b").agg(F.count("*").alias("met"), F.sum(F.col("same").cast("bigint")).alias("agreed")), "met")
    # Only a pair that agrees somewhere discounts a vote.
    agreed = materialise(_meetings(told).where("same").select("item", "text", "a", "b", "h"), "agreed")

    def votes(accuracy: DataFrame, copies: DataFrame | None, on: str) -> DataFrame:
        """``(item, h, share)``: posterior of each value of the items ``on``."""
        said = told.where(on).join(broadcast_if_small(accuracy), "o")
        weight = F.log(false_values * F.col("accuracy") / (1 - F.col("accuracy")))
        if copies is not None:
            # Of two that agree, the less accurate one's vote is discounted; of equals the later one's.
            shed = agreed.where(on).join(copies.select("a", "b", "later", "shed"), ["a", "b"]).groupBy("item", F.col("later").alias("o")).agg(F.sum("shed").alias("shed"))
            said = said.join(shed, ["item", "o"], "left")
            weight = weight * F.exp(F.coalesce("shed", F.lit(0.0)))
        of = W.partitionBy("item")
        score = said.groupBy("item", "h").agg(F.sum(weight).alias("score")).select("*", F.max("score").over(of).alias("top"), F.count("*").over(of).alias("values"))
        mass = F.exp(F.col("score") - F.col("top"))
        rest = F.greatest(F.lit(0), false_values + 1 - F.col("values")) * F.exp(-F.col("top"))
        return materialise(score.select("item", "h", (mass / (F.sum(mass).over(of) + rest + 1e-300)).alias("share")), "votes")

    copies = None
    for _ in range(rounds):
        share = votes(accuracy, copies, "not text")
        right = told.where("not text").join(share, ["item", "h"]).groupBy("o").agg(F.avg("share").alias("right"))
        # An origin that told of texts only keeps what it starts with.
        now = F.when(F.col("right").isNull(), F.col("accuracy")).otherwise(F.least(F.lit(0.95), F.greatest(F.lit(0.05), F.col("right"))))
        accuracy = materialise(accuracy.join(right, "o", "left").select("o", now.alias("accuracy")), "accuracy")
        t = agreed.where("not text").join(share, ["item", "h"]).groupBy("a", "b").agg(F.sum("share").alias("t"))
        pairs = met.join(t, ["a", "b"], "left").withColumn("t", F.coalesce("t", F.lit(0.0)))
        for side in ("a", "b"):
            pairs = pairs.join(broadcast_if_small(accuracy.select(F.col("o").alias(side), F.col("accuracy").alias(f"{side}_right"))), side)
        copying = _copy_column(F.col("t"), F.col("agreed") - F.col("t"), F.col("met") - F.col("agreed"), F.col("a_right"), F.col("b_right"), false_values)
        later = F.when(F.col("a_right") >= F.col("b_right"), F.col("b")).otherwise(F.col("a"))
        pairs = pairs.select("a", "b", copying.alias("copying"), later.alias("later"))
        copies = materialise(pairs.withColumn("shed", F.log(1 - 0.8 * F.col("copying"))), "copies")
    best = F.min(F.struct((-F.round("share", 9)).alias("less"), "ord")).alias("best")
    picked = told.join(votes(accuracy, copies, "true"), ["item", "h"]).groupBy("item").agg(best).join(items, "item")
    picked = picked.select(F.col("dn").alias("dn_no"), "field_name", F.col("best.ord").alias("ord"), (-F.col("best.less")).alias("posterior"))
    name = lambda o, out: broadcast_if_small(numbers.select(F.col("o").alias(o), F.col("__origin").alias(out)))
    pairs = copies if copies is not None else met.select("a", "b", F.lit(0.0).alias("copying"))
    pairs = pairs.join(name("a", "origin"), "a").join(name("b", "other"), "b").select("origin", "other", "copying")
    return picked, accuracy.join(name("o", "origin"), "o").select("origin", "accuracy"), pairs

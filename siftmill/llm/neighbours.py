"""The k most similar vectors for every vector.

A random-projection tree, fitted on a bounded sample, cuts space into regions small enough for one task; each
vector is a member of its own region and also asks the regions across the planes it lies close to. It finds them
by a descent that keeps the few best branches, so its cost grows with the depth of the tree, not with the regions.
A region with more members than one task should hold is cut into slices, all of which are asked, by blocks of those that ask.
In a slice a forest of random-projection trees over its members is searched through one priority queue for each
query: leaves of all trees are opened in the order of their margins, the home leaves first. Only the best so far
are kept. Their cosines are exact.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from siftmill.functions.vector import finite
from siftmill.session import broadcast_if_small, materialise

#: Members a region should have, and most of one slice of it.
REGION_ROWS, SLICE_ROWS = 65_536, 131_072
#: Vectors the region tree is fitted on, at least and at most; the sample is by hash of the id.
SAMPLE_ROWS = (4_096, 262_144)
#: Fewest of them a region is cut from.
REGION_SAMPLE = 32
#: Cosine from which two unit vectors (of single precision) have one direction.
SAME = 1 - 1e-6


def one_thread() -> None:
    """Matrix products of a task stay on its own core: further threads of the library would only wait beside those of
    the executor's other tasks, at full load."""
    try:
        with open("/proc/self/maps") as f:
            found = {line.split()[-1] for line in f if "blas" in line.rpartition("/")[2]}
        for path in found:
            library = ctypes.CDLL(path)
            for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if hasattr(library, name):
                    getattr(library, name)(1)
    except OSError:
        pass


def _top(ways: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, column)`` of the ``n`` greatest of each row; of equals at the end as many as there is room for."""
    rows, columns = ways.shape
    if n >= columns:
        return np.repeat(np.arange(rows), columns), np.tile(np.arange(columns), rows)
    last = np.partition(ways, columns - n, axis=1)[:, columns - n, None]
    row, col = np.nonzero(ways >= last)
    over = np.flatnonzero(np.bincount(row, minlength=rows) > n)
    if len(over):
        fit = ~np.isin(row, over)
        best = np.argpartition(-ways[over], n - 1, axis=1)[:, :n]
        row, col = np.concatenate([row[fit], np.repeat(over, n)]), np.concatenate([col[fit], best.ravel()])
    return row, col


def _normal(points: np.ndarray, own: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The direction between two of the points; a random one where they are all the same."""
    for _ in range(4 if len(own) >= 2 else 0):
        a, b = rng.choice(own, 2, replace=False)
        gap = points[a] - points[b]
        if (length := np.linalg.norm(gap)) > 1e-6:
            return gap / length
    gap = rng.standard_normal(points.shape[1])
    return gap / np.linalg.norm(gap)


class Tree:
    """Planes of a random-projection tree in heap order: node i has the children 2i+1 and 2i+2.

    The points it is fitted on are halved by rank at each node, so ``leaves`` are of one size even where all points
    are the same.
    """

    def __init__(self, points: np.ndarray, depth: int, rng: np.random.Generator):
        inner = (1 << depth) - 1
        self.depth = depth
        self.normals = np.zeros((inner, points.shape[1]), np.float32)
        self.offsets = np.zeros(inner, np.float32)
        parts = [np.arange(len(points))]
        for level in range(depth):
            halves = []
            for i, own in enumerate(parts):
                node = (1 << level) - 1 + i
                self.normals[node] = normal = _normal(points, own, rng)
                side = points[own] @ normal.astype(np.float32)
                half = len(own) // 2
                order = np.argpartition(side, half) if len(own) > 1 else np.arange(len(own))
                self.offsets[node] = side[order[half]] if len(own) else 0.0
                halves += [own[order[:half]], own[order[half:]]]
            parts = halves
        #: Rows of the fitted points in each leaf.
        self.leaves = parts

    def margins(self, points: np.ndarray) -> np.ndarray:
        """For each leaf and point the least margin on the way there: not negative on the way to the home leaf,
        else minus the largest distance to a plane that must be crossed."""
        side = self.normals @ points.T - self.offsets[:, None]
        least = np.full((1, len(points)), np.inf, np.float32)
        first = 0
        for level in range(self.depth):
            width = 1 << level
            here = side[first : first + width]
            both = np.empty((2 * width, len(points)), np.float32)
            np.minimum(least, -here, out=both[0::2])
            np.minimum(least, here, out=both[1::2])
            least, first = both, first + width
        return least

    def best(self, points: np.ndarray, visits: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``visits`` leaves of greatest margin of each point, and the margins; the home leaf first.

        A branch that was crossed into keeps its margin on its own side, so the best leaves lie under the best
        branches of each level: no more than ``visits`` are followed.
        """
        node = np.zeros((len(points), 1), np.int64)
        least = np.full((len(points), 1), np.inf, np.float32)
        for _ in range(self.depth):
            side = np.einsum("nbd,nd->nb", self.normals[node], points) - self.offsets[node]
            node = np.concatenate([2 * node + 1, 2 * node + 2], axis=1)
            least = np.concatenate([np.minimum(least, -side), np.minimum(least, side)], axis=1)
            if node.shape[1] > visits:
                top = np.argpartition(-least, visits - 1, axis=1)[:, :visits]
                node, least = np.take_along_axis(node, top, axis=1), np.take_along_axis(least, top, axis=1)
        order = np.argsort(-least, axis=1, kind="stable")
        leaf = node - ((1 << self.depth) - 1)
        return np.take_along_axis(leaf, order, axis=1), np.take_along_axis(least, order, axis=1)


def _unit(points: np.ndarray) -> np.ndarray:
    return (points / np.linalg.norm(points.astype(np.float64), axis=1, keepdims=True)).astype(np.float32)


def _usable(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of vectors with ``dim`` finite numbers that aren't all 0, and their values."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float), nan=-1).astype(np.int64)
    fit = np.flatnonzero(sizes == dim)
    flat = column.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
    good = np.isfinite(flat).all(axis=1) & (flat != 0).any(axis=1)
    return fit[good], flat[good]


def _pack(flat: np.ndarray) -> pa.Array:
    """Vectors as bytes: halves if that loses nothing of any vector of the batch, else whole floats."""
    with np.errstate(over="ignore"):
        half = flat.astype(np.float16)
    data = half if np.array_equal(half.astype(np.float32), flat) else flat
    data = np.ascontiguousarray(data)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(data.itemsize * flat.shape[1]), len(flat), [None, pa.py_buffer(data)]).cast(pa.binary())


def _unpack(raw: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(raw), dim), np.float32)
    for kind in (np.float16, np.float32):
        at = [i for i, r in enumerate(raw) if len(r) == np.dtype(kind).itemsize * dim]
        if at:
            out[at] = np.frombuffer(b"".join([raw[i] for i in at]), kind).reshape(-1, dim)
    return out


@dataclass
class Regions:
    """Where vectors are searched for: the tree (None for one region), how many slices its members are cut into and how many
    blocks those that ask come in, by region; and directions that very many vectors of a region share."""

    tree: Tree | None
    slices: np.ndarray
    blocks: np.ndarray
    crowd_region: np.ndarray
    crowd: np.ndarray

    def crowded(self, home: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Which vectors have a direction that is crowded in their region."""
        out = np.zeros(len(home), bool)
        for region, direction in zip(self.crowd_region, self.crowd, strict=True):
            out |= (home == region) & (unit @ direction >= SAME)
        return out


def _place(where: Regions, dim: int, reach: float, visits: int, every: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each task a vector is a member in (every block of its slice) or asks in (its block of each slice).

    A vector of a crowded direction finds its like in its own slice and asks nowhere else, so a crowd costs no more than
    other rows, wherever it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                batch = whole.slice(i, 4096)
                at, flat = _usable(batch.column(2), dim)
                if not len(at):
                    continue
                ids, unit = batch.column(0).to_numpy()[at], _unit(flat)
                if where.tree is None:
                    leaf, margin = np.zeros((len(at), 1), np.int64), np.zeros((len(at), 1), np.float32)
                else:
                    leaf, margin = where.tree.best(unit, visits)
                ask = ids % every == 0
                go = (margin >= -reach) & (ask & ~where.crowded(leaf[:, 0], unit))[:, None]
                mix = ids * np.int64(-7046029254386353131)
                home = leaf[:, 0]
                own_slice = (mix >> 33) % where.slices[home]

                def own_block(rows: np.ndarray, region: np.ndarray, mix: np.ndarray = mix) -> np.ndarray:
                    return (mix[rows] >> 17) % where.blocks[region]

                # As a member: in every block of its slice; it asks in one of them.
                member = np.repeat(np.arange(len(at)), where.blocks[home])
                no = _runs(member)
                parts = [(member, home[member], own_slice[member], no, np.ones(len(member), bool), ask[member] & (no == own_block(member, home[member])))]
                # As one that asks: in its block of every other slice.
                row, col = np.nonzero(go)
                region = leaf[row, col]
                n = where.slices[region]
                row, col, region = np.repeat(row, n), np.repeat(col, n), np.repeat(region, n)
                no = _runs(row, col)
                other = (col > 0) | (no != own_slice[row])
                row, region, no = row[other], region[other], no[other]
                parts.append((row, region, no, own_block(row, region), np.zeros(len(row), bool), np.ones(len(row), bool)))
                rows, region, cut, block, member, asks = (np.concatenate(x) for x in zip(*parts, strict=True))
                picked = pa.array(at[rows])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(picked), *[pa.array(x, pa.int32()) for x in (region, cut, block)], batch.column(0).take(picked), pa.array(member), pa.array(asks), _pack(flat[rows])],
                    ["part", "region", "slice", "block", "id", "home", "asks", "raw"],
                )

    return run


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Number of each row in its run of equal keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    fresh = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]
    starts = np.flatnonzero(fresh)
    return np.arange(len(fresh)) - starts[np.cumsum(fresh) - 1]


class Best:
    """The ``keep`` best of each query so far, above a floor."""

    def __init__(self, queries: int, keep: int, floor: float):
        self.score = np.full((queries, keep), floor, np.float32)
        self.id = np.full((queries, keep), -1, np.int64)
        self.least = np.full(queries, floor, np.float32)

    def offer(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """Scores (queries, candidates) of the candidates ``ids``; ``own`` is the id of each query itself."""
        # Only queries for which there is something better than all before are looked at.
        better = np.flatnonzero(score.max(axis=1) > self.least[who])
        if not len(better):
            return
        keep = self.score.shape[1]
        part, who, own = score[better], who[better], own[better]
        top = min(keep + 1, part.shape[1])
        col = np.argpartition(-part, top - 1, axis=1)[:, :top] if top < part.shape[1] else np.broadcast_to(np.arange(top), part.shape)
        new_id, new_score = ids[col], np.take_along_axis(part, col, axis=1)
        # Itself and what another tree brought already count as nothing.
        known = (new_id == own[:, None]) | (new_id[:, :, None] == self.id[who][:, None, :]).any(axis=2)
        all_score = np.concatenate([self.score[who], np.where(known, -3, new_score)], axis=1)
        all_id = np.concatenate([self.id[who], new_id], axis=1)
        pick = np.argpartition(-all_score, keep - 1, axis=1)[:, :keep]
        self.score[who] = all_score = np.take_along_axis(all_score, pick, axis=1)
        self.id[who] = np.where(all_score > -2, np.take_along_axis(all_id, pick, axis=1), -1)
        self.least[who] = all_score.min(axis=1)


def _search(dim: int, k: int, least: float, trees: int, leaf_rows: int, leaves: float) -> Callable[[pa.Table], pa.Table]:
    """Neighbours found in one slice. Leaves are opened for each query in the order of one queue over all trees."""

    def run(table: pa.Table) -> pa.Table:
        one_thread()
        ids = table.column("id").to_numpy()
        home = table.column("home").to_numpy(zero_copy_only=False).astype(bool)
        flat = _unpack(table.column("raw").to_pylist(), dim)
        points = _unit(flat)
        members, asking = np.flatnonzero(home), np.flatnonzero(table.column("asks").to_numpy(zero_copy_only=False).astype(bool))
        if not len(members) or not len(asking):
            return pa.table({"vec_a": pa.array([], pa.int64()), "vec_b": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        rng = np.random.default_rng(len(members))
        depth = max(0, math.ceil(math.log2(len(members) / leaf_rows)))
        own = points[members]
        forest = [Tree(own, depth, rng) for _ in range(trees if depth else 1)]
        width, count = 1 << depth, len(forest) << depth
        opened = min(count, max(len(forest), math.ceil(leaves if leaves >= 1 else leaves * count)))
        whose, cells = [], []
        for i in range(0, len(asking), 4096):
            some = points[asking[i : i + 4096]]
            # Cells are numbered through all trees: the queue of a query is the order of all margins.
            ways = np.concatenate([t.margins(some) for t in forest]) if depth else np.zeros((1, len(some)), np.float32)
            row, cell = _top(np.ascontiguousarray(ways.T), opened)
            whose.append((row + i).astype(np.int32))
            cells.append(cell.astype(np.uint16 if count < 1 << 16 else np.uint32))
        cells = np.concatenate(cells)
        order = np.argsort(cells, kind="stable")
        bounds = np.searchsorted(cells[order], np.arange(count + 1))
        queries = np.concatenate(whose)[order]
        # A few more than k, for exact reranking.
        best = Best(len(asking), k + 2, least - 1e-4 if least > -1 else -2)
        for cell in range(count):
            who = queries[bounds[cell] : bounds[cell + 1]]
            inside = members[forest[cell // width].leaves[cell % width]]
            if not len(who) or not len(inside):
                continue
            there = np.ascontiguousarray(points[inside].T)
            for j in range(0, len(who), 2048):
                some = who[j : j + 2048]
                best.offer(some, points[asking[some]] @ there, inside, asking[some])
        row, col = np.nonzero(best.id >= 0)
        a, b = asking[row], best.id[row, col]
        exact = np.empty(len(a), np.float64)
        for i in range(0, len(a), 1 << 16):
            s = slice(i, i + (1 << 16))
            x, y = flat[a[s]].astype(np.float64), flat[b[s]].astype(np.float64)
            exact[s] = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
        keep = (exact >= least) & (ids[a] != ids[b])
        return pa.table({"vec_a": pa.array(ids[a[keep]], pa.int64()), "vec_b": pa.array(ids[b[keep]], pa.int64()), "cosine": pa.array(exact[keep], pa.float64())})

    return run


def _regions(lead: DataFrame, total: int, dim: int, visits: int, region_rows: int, slice_rows: int) -> Regions:
    """Regions, slices, blocks and crowds, all from one sample of the rows."""
    one = np.array([max(1, -(-total // slice_rows))])
    single = Regions(None, one, one, np.zeros(0, np.int64), np.zeros((0, dim), np.float32))
    depth = max(0, math.ceil(math.log2(max(1, total) / region_rows)))
    depth = min(depth, int(math.log2(SAMPLE_ROWS[1] / REGION_SAMPLE)))
    if not depth:
        return single
    want = min(max(SAMPLE_ROWS[0], 4 * REGION_SAMPLE << depth), SAMPLE_ROWS[1])
    share = max(1, total // want)
    sample = lead.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).select("vector").limit(2 * want).toArrow().column("vector")
    _, flat = _usable(sample, dim)
    if len(flat) < 2:
        return single
    unit = _unit(flat)
    tree = Tree(unit, depth, np.random.default_rng(7))
    home = np.concatenate([tree.best(unit[i : i + 4096], 1)[0][:, 0] for i in range(0, len(unit), 4096)])
    tree.leaves = []  # the sample's own rows aren't sent to the tasks
    held = np.bincount(home, minlength=1 << depth)
    scale = total / len(unit)
    slices = np.maximum(1, np.ceil(held * scale / slice_rows)).astype(np.int64)
    crowd_region, crowd, plain = [], [], held.astype(np.float64)
    rng = np.random.default_rng(11)
    for region in np.flatnonzero(slices > 1):
        rest = unit[home == region]
        least = max(8, len(rest) / (2 * slices[region]))
        # A direction as common as that is met among a few points by chance.
        for _ in range(4 * int(slices[region])):
            some = rest[rng.choice(len(rest), min(len(rest), 32), replace=False)] if len(rest) else rest
            same = some @ rest.T >= SAME
            if not len(rest) or same.sum(axis=1).max() < least:
                break
            top = same.sum(axis=1).argmax()
            crowd_region.append(region)
            crowd.append(some[top])
            plain[region] -= same[top].sum()
            rest = rest[~same[top]]
    # Rows that ask come from all around, each of them in one block.
    blocks = np.maximum(1, np.ceil(plain * scale * min(visits, 8) / (8 * slice_rows))).astype(np.int64)
    return Regions(tree, slices, blocks, np.array(crowd_region, np.int64), np.array(crowd, np.float32).reshape(-1, dim))


def nearest(
    rows: DataFrame,
    row_id: str,
    vector: str,
    part: str | None,
    k: int = 10,
    min_cosine: float = -1.0,
    dim: int = 64,
    reach: float = 0.06,
    visits: int = 5,
    trees: int = 3,
    leaf_rows: int = 512,
    leaves: float = 12,
    region_rows: int = REGION_ROWS,
    slice_rows: int = SLICE_ROWS,
    hot_copies: int | None = None,
    every: int = 1,
) -> DataFrame:
    """``(vec_a, vec_b, cosine)``: for each usable vector ``vec_a`` its ``k`` most similar ones in its part
    (modality), itself left out, ties by the lesser id; only those of ``min_cosine`` or more.

    Usable is a vector of ``dim`` finite numbers that aren't all 0; NULL vectors, NULL elements, other sizes and
    NULL ids are passed over. Length doesn't matter. NULL parts are one part. Rows that repeat an id with
    the same vector aren't neighbours of each other. An empty table gives none. Every usable row is indexed; those
    whose id is divisible by ``every`` are asked for. ``visits`` regions at most are asked, those reached within ``reach``
    of a plane; ``leaves`` leaves (below 1: that share of all) are opened in each slice, the home leaf of each tree at
    least. More of these, and more ``trees``, lose less. Groups of ``hot_copies`` (k + 2 if not given) or more equal
    vectors are represented by one of them.
    """
    base = rows.select(F.col(row_id).cast("bigint").alias("id"), F.coalesce(F.col(part).cast("string") if part else F.lit(""), F.lit("")).alias("part"), F.col(vector).alias("vector"))
    base = base.where(F.col("id").isNotNull() & (F.size("vector") == dim))
    # Groups of copies: counted by hash, so only numbers are moved.
    usable = finite(F.col("vector"), dim) & F.exists("vector", lambda x: x != 0)
    copies = base.where(usable).groupBy("part", F.xxhash64("vector").alias("h")).agg(F.count("*").alias("n"), F.min("id").alias("rep"))
    hot = materialise(copies.where(F.col("n") >= max(hot_copies or 0, k + 2)), "copies")
    total = rows.count()
    some_hot = hot.limit(1).count() > 0
    lead, tail = base, None
    if some_hot:
        tagged = base.withColumn("h", F.xxhash64("vector")).join(broadcast_if_small(hot.drop("n")), ["part", "h"], "left")
        lead = tagged.where(F.col("rep").isNull() | (F.col("id") == F.col("rep"))).select("id", "part", "vector")
        # The first of each group, as many as any list can name; window limits are applied before the shuffle.
        ranked = tagged.where(F.col("rep").isNotNull()).select("rep", "id").distinct()
        first = ranked.withColumn("r", F.row_number().over(W.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1)
        first = materialise(first, "copy_ids")
        tail = (ranked, first)
    where = _regions(lead, total, dim, visits, region_rows, slice_rows)
    placed = lead.mapInArrow(_place(where, dim, reach, visits, every), "part string, region int, slice int, block int, id bigint, home boolean, asks boolean, raw binary")
    # Slices are of one size: as many tasks as there may be of them, twice, keep those that share one few.
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * int((where.slices * where.blocks).sum()))
    schema = T.StructType([T.StructField("vec_a", T.LongType()), T.StructField("vec_b", T.LongType()), T.StructField("cosine", T.DoubleType())])
    own = ("part", "region", "slice", "block")
    near = placed.repartition(tasks, *own).groupBy(*own).applyInArrow(_search(dim, k, min_cosine, trees, leaf_rows, leaves), schema)
    # Whoever found a pair, both ends know of it; both are told in one pass, so that nothing is searched twice.
    ends = [F.struct(F.col(a).alias("vec_a"), F.col(b).alias("vec_b"), "cosine") for a, b in (("vec_a", "vec_b"), ("vec_b", "vec_a"))]
    near = near.select(F.explode(F.array(*ends)).alias("p")).select("p.*").where(F.pmod("vec_a", F.lit(every)) == 0)
    if tail is not None:
        ranked, first = tail
        # A named representative stands for the first of its copies; its own list is all copies.
        near = near.join(broadcast_if_small(first.select("rep").distinct()), near["vec_a"] == F.col("rep"), "left_anti")
        heads = first.select(F.col("rep").alias("vec_b"), F.col("id").alias("copy"))
        near = near.join(broadcast_if_small(heads), "vec_b", "left").select("vec_a", F.coalesce("copy", "vec_b").alias("vec_b"), "cosine")
        own = ranked.where(F.pmod("id", F.lit(every)) == 0).join(broadcast_if_small(first.select("rep", F.col("id").alias("vec_b"))), "rep")
        own = own.where(F.col("id") != F.col("vec_b")).select(F.col("id").alias("vec_a"), "vec_b", F.lit(1.0).alias("cosine"))
        near = near.unionByName(own.where(F.lit(1.0) >= min_cosine))
    order = W.partitionBy("vec_a").orderBy(F.desc("cosine"), "vec_b")
    return near.repartition(tasks, "vec_a").dropDuplicates(["vec_a", "vec_b"]).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k).drop("__r")


def near_pairs(near: DataFrame) -> DataFrame:
    """``(vec_a, vec_b)``, each pair once with the lesser id first, of the result of ``nearest``."""
    return near.select(F.least("vec_a", "vec_b").alias("vec_a"), F.greatest("vec_a", "vec_b").alias("vec_b")).distinct()

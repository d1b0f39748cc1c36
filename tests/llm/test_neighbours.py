import numpy as np
import pytest

from pyspark.sql import functions as F

from siftmill.llm import neighbours
from siftmill.llm.neighbours import Tree, near_pairs, nearest

SCHEMA = "vec_id bigint, modality string, vector array<float>, cosine int"


def data(n=1500, dim=64, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(1, n // 6), dim))
    pts = centres[rng.integers(len(centres), size=n)] + 0.12 * rng.standard_normal((n, dim))
    return (pts * rng.uniform(0.5, 4, (n, 1))).astype(np.float32)


def brute(ids, part, pts, k, least):
    unit = pts.astype(np.float64) / np.linalg.norm(pts.astype(np.float64), axis=1, keepdims=True)
    out = set()
    for p in set(part):
        at = [i for i, q in enumerate(part) if q == p]
        sims = unit[at] @ unit[at].T
        for i, a in enumerate(at):
            order = sorted((-sims[i, j], ids[b], b) for j, b in enumerate(at) if b != a)[:k]
            out |= {(ids[a], j) for s, j, _ in order if -s >= least}
    return out


@pytest.mark.parametrize("region_rows", [10_000, 300])
def test_recall_against_brute_force(spark, region_rows):
    pts = data()
    part = ["binmap" if i % 3 else "sem" for i in range(len(pts))]
    df = spark.createDataFrame([(i, part[i], pts[i].tolist(), 0) for i in range(len(pts))], SCHEMA)
    want = brute(list(range(len(pts))), part, pts, 10, 0.92)
    got = {(r.vec_a, r.vec_b) for r in nearest(df, "vec_id", "vector", "modality", 10, 0.92, region_rows=region_rows).collect()}
    assert len(got & want) / len(want) > 0.97 and len(got - want) <= 0.02 * len(want)
    pairs = near_pairs(nearest(df, "vec_id", "vector", "modality", 10, 0.92)).collect()
    assert all(r.vec_a < r.vec_b for r in pairs) and len(pairs) == len({tuple(r) for r in pairs})


def test_all_neighbours_small_exact(spark):
    pts = data(120)
    df = spark.createDataFrame([(i, "sem", pts[i].tolist(), 0) for i in range(120)], SCHEMA)
    got = {(r.vec_a, r.vec_b) for r in nearest(df, "vec_id", "vector", "modality", 3).collect()}
    assert got == brute(list(range(120)), ["sem"] * 120, pts, 3, -1)


def test_unusable_and_empty(spark):
    good = data(4)[0].tolist()
    rows = [(1, "sem", good, 0), (2, "sem", good, 0), (3, "sem", None, 0), (4, "sem", good[:60], 0), (5, "sem", [0.0] * 64, 0), (6, "sem", [float("nan"), *good[1:]], 0), (7, "sem", [None, *good[1:]], 0), (8, "binmap", good, 0), (None, "sem", good, 0), (9, None, good, 0), (10, None, [2 * v for v in good], 0), (11, "sem", [float("inf"), *good[1:]], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in near_pairs(nearest(df, "vec_id", "vector", "modality", 10, 0.92)).collect()} == {(1, 2), (9, 10)}
    assert nearest(df.limit(0), "vec_id", "vector", "modality").count() == 0


def test_a_group_of_copies_is_linear_and_exact(spark):
    pts = data(30, seed=3)
    same = pts[0]
    near = (same + 0.05 * np.abs(same)).astype(np.float32)
    rows = [(i, "sem", same.tolist(), 0) for i in range(100, 400)] + [(5, "sem", near.tolist(), 0)] + [(i, "sem", pts[i].tolist(), 0) for i in range(10, 20)] + [(i, "sem", [0.0] * 64, 0) for i in range(1000, 1400)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = nearest(df, "vec_id", "vector", "modality", 10, 0.92, hot_copies=50).collect()
    by = {}
    for r in got:
        by.setdefault(r.vec_a, []).append(r.vec_b)
    assert sorted(by[399]) == list(range(100, 110)) and sorted(by[100]) == list(range(101, 111)) and sorted(by[5]) == list(range(100, 110))
    assert not any(a >= 1000 for a in by)


def test_the_descent_finds_the_leaves_of_greatest_margin():
    pts = data(600)
    tree = Tree(pts[:400], 6, np.random.default_rng(0))
    margins = tree.margins(pts).T
    for visits in (1, 3, 64):
        leaf, margin = tree.best(pts, visits)
        assert np.allclose(margin, -np.sort(-margins, axis=1)[:, :visits], atol=1e-5)
        assert np.allclose(np.take_along_axis(margins, leaf, axis=1), margin, atol=1e-5)
    assert sum(map(len, tree.leaves)) == 400 and {len(x) for x in tree.leaves} <= {6, 7}


def test_leaves_of_equal_points_have_one_size():
    tree = Tree(np.ones((64, 8), np.float32), 3, np.random.default_rng(0))
    assert [len(x) for x in tree.leaves] == [8] * 8


@pytest.mark.parametrize("slice_rows", [100_000, 120])
def test_a_third_in_one_tight_cluster(spark, slice_rows):
    """Near copies, and copies that differ in length alone, crowd one corner; the rest keeps its neighbours."""
    pts, rng = data(1200, seed=4), np.random.default_rng(9)
    tight = pts[0] + 0.004 * rng.standard_normal((400, 64)).astype(np.float32)
    scaled = pts[1] * rng.uniform(0.5, 2, (200, 1)).astype(np.float32)
    every = np.concatenate([pts, tight, scaled])
    df = spark.createDataFrame([(i, "sem", v.tolist(), 0) for i, v in enumerate(every)], SCHEMA)
    want = {p for p in brute(list(range(len(every))), ["sem"] * len(every), every, 10, 0.92)}
    got = {}
    for r in nearest(df, "vec_id", "vector", "modality", 10, 0.92, region_rows=300, slice_rows=slice_rows, leaf_rows=64).collect():
        got.setdefault(r.vec_a, []).append((r.cosine, r.vec_b))
    rest = {p for p in want if 2 <= p[0] < 1200 and p[1] < 1200}
    assert len({(a, b) for a, b in rest if b in {x for _, x in got.get(a, [])}}) / len(rest) > 0.97
    unit = every.astype(np.float64) / np.linalg.norm(every.astype(np.float64), axis=1, keepdims=True)
    for i in [*range(1200, 1800, 7)]:
        exact = np.sort(np.delete(unit @ unit[i], i))[::-1][:10]
        assert len(got[i]) == 10 and min(c for c, _ in got[i]) > exact[-1] - 2e-4


def test_a_crowd_of_one_direction_asks_its_own_slice_only(spark):
    """A third of all vectors differ in length alone (by powers of two, so that no plane parts them)."""
    pts = data(1200, seed=4)
    scaled = pts[1] * 2.0 ** np.random.default_rng(2).integers(-8, 8, (600, 1)).astype(np.float32)
    every = np.concatenate([pts, scaled + 0]).astype(np.float32)
    df = spark.createDataFrame([(i, "sem", v.tolist(), 0) for i, v in enumerate(every)], SCHEMA)
    args = {"region_rows": 300, "slice_rows": 120, "leaf_rows": 64, "hot_copies": 10_000}
    where = neighbours._regions(df.select(F.col("vec_id").alias("id"), "vector"), len(every), 64, 5, 300, 120)
    assert len(where.crowd) and where.slices.max() >= 5 and len(set(where.crowd_region.tolist())) == 1
    sizes = []
    for batch in neighbours._place(where, 64, 0.06, 5, 1)(iter([df.select("vec_id", "modality", "vector").toArrow().combine_chunks().to_batches()[0]])):
        sizes += list(zip(*(batch.column(c).to_pylist() for c in ("region", "slice", "block")), strict=True))
    assert max(sizes.count(x) for x in set(sizes)) < 700
    got = {}
    for r in nearest(df, "vec_id", "vector", "modality", 10, 0.92, **args).collect():
        got.setdefault(r.vec_a, []).append((r.cosine, r.vec_b))
    for i in range(1200, 1800, 11):
        assert len(got[i]) == 10 and min(c for c, _ in got[i]) > 0.999999
    want = {(a, b) for a, b in brute(list(range(len(every))), ["sem"] * len(every), every, 10, 0.92) if a < 1200 and b < 1200 and a != 1}
    assert len({(a, b) for a, b in want if b in {x for _, x in got.get(a, [])}}) / len(want) > 0.95


def test_only_every_tenth_is_asked_for(spark):
    pts = data(1500, seed=2)
    df = spark.createDataFrame([(i, "sem", pts[i].tolist(), 0) for i in range(len(pts))], SCHEMA)
    got = {(r.vec_a, r.vec_b) for r in nearest(df, "vec_id", "vector", "modality", 5, reach=9.0, visits=64, leaves=0.5, region_rows=400, leaf_rows=50, every=10).collect()}
    want = {p for p in brute(list(range(len(pts))), ["sem"] * len(pts), pts, 5, -1) if p[0] % 10 == 0}
    assert all(a % 10 == 0 for a, _ in got) and len(got) == len(want) and len(got & want) / len(want) > 0.9

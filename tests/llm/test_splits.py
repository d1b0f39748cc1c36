import collections
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftmill.llm import splits
from siftmill.llm.splits import assign_splits, components, conflicts, greedy_counts, related_groups

SCHEMA = "label_id bigint, image_path string, label string, split string, image_sha string, group_id int"


def table(spark, rows):
    return spark.createDataFrame([(i, p, "A", s, h, 0) for i, p, s, h in rows], SCHEMA)


ROWS = [
    (1, "images\\class_a\\DN-20230327-01\\a.png", "train", "s1"),
    (2, "images/class_a/dn_20230327_01-b.png", "TEST ", None),
    (3, "x/DN%2D20230328%2D02/c.png", "val", "s2"),
    (4, "x/ＤＮ－２０２３０３２９－０３/d.png", "validation", "s2"),
    (5, "misc/IMG_1.png", "train", "s3"),
    (6, "misc//IMG_1.png", "testing", "s4"),
    (7, None, "train", "s4"),
    (8, "", "UNKNOWN", None),
    (9, None, None, None),
    (10, "z/DN-20230330-01/q.png", "train", "s5"),
    (10, "z/DN-20230330-01/q.png", "train", "s5"),
    (11, None, "test", "s1"),
]


def test_groups_and_conflicts(spark):
    df = table(spark, ROWS)
    got = collections.defaultdict(set)
    for r in related_groups(df, "label_id", "image_path", "image_sha").collect():
        got[r.group_id].add(r.label_id)
    assert sorted(map(sorted, got.values())) == [[1, 2, 11], [3, 4], [5, 6, 7], [8], [9], [10]]
    assert {tuple(r) for r in conflicts(df, "label_id", "image_path", "image_sha", "split").collect()} == {(1, 2), (1, 11), (5, 6), (5, 7)}
    # The same with every key hot and every component too large for one task.
    assert {tuple(r) for r in conflicts(df, "label_id", "image_path", "image_sha", "split", hot_rows=2, forest_rows=1).collect()} == {(1, 2), (1, 11), (5, 6), (5, 7)}


def test_empty(spark):
    none = table(spark, []).limit(0) if False else spark.createDataFrame([], SCHEMA)
    assert related_groups(none, "label_id", "image_path", "image_sha").count() == 0
    assert conflicts(none, "label_id", "image_path", "image_sha", "split").count() == 0


def test_components_against_brute_force(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1080)] + [(2000, i) for i in range(2001, 2100)] + [(7, 7), (7, 8), (7, 8)]
    home = {}

    def find(x):
        home.setdefault(x, x)
        while home[x] != x:
            x = home[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        home[b] = a
    want = {n: find(n) for n in list(home) if find(n) != n}
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(6)
    for limit in (1_000_000, 20):
        assert dict(map(tuple, components(df, limit).collect())) == want


def test_forests_are_merged_level_by_level(spark, monkeypatch):
    """Chains, and a hub, in 64 forests; no star building, and as many levels as it takes to halve them to one."""
    levels = []
    monkeypatch.setattr(splits, "_stars", lambda now: pytest.fail("stars"))
    kept = splits.materialise
    monkeypatch.setattr(splits, "materialise", lambda df, name: levels.append(name) or kept(df, name))
    edges = [(10 * c + i, 10 * c + i + 1) for c in range(160) for i in range(3)] + [(5000, i) for i in range(5001, 5200)]
    df = spark.createDataFrame([(b, a) for a, b in edges], "a bigint, b bigint")
    got = dict(map(tuple, components(df, 20).collect()))
    assert levels.count("settled") == 6
    assert got == {10 * c + i: 10 * c for c in range(160) for i in range(1, 4)} | {i: 5000 for i in range(5001, 5200)}
    wide = df.select(F.unhex(F.md5(F.col("a").cast("string").cast("binary"))).alias("a"), F.unhex(F.md5(F.col("b").cast("string").cast("binary"))).alias("b"))
    found = components(wide, 350).collect()
    assert len(found) == len(got) and len({bytes(r.root) for r in found}) == 161 and all(bytes(r.root) < bytes(r.node) for r in found)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from("abcd"), st.integers(-50, 400), min_size=1), st.integers(1, 30), st.integers(0, 300))
def test_greedy_counts(short, size, count):
    plain, given_ = dict(short), dict.fromkeys(short, 0)
    for _ in range(count):
        s = min(plain, key=lambda n: (-plain[n], n))
        given_[s] += 1
        plain[s] -= size
    left = {k: float(v) for k, v in short.items()}
    got = greedy_counts(left, size, count)
    assert sum(got.values()) == count
    # Equal levels may be dealt out in another order.
    assert sorted(left.values()) == sorted(map(float, plain.values()))


def test_assignment(spark):
    sizes = [500] + [50] * 10 + [7] * 40 + [1] * 900
    groups = spark.createDataFrame(list(enumerate(sizes)), "group_id bigint, n_rows bigint")
    targets = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1), ("none", 0.0), (None, 0.5)], "split string, share double")
    got = assign_splits(groups, targets, bucket_groups=3)
    assert got.count() == len(sizes) == got.select("group_id").distinct().count()
    rows = {r["split"]: r.n for r in got.groupBy("split").agg(F.sum("n_rows").alias("n")).collect()}
    total = sum(sizes)
    assert set(rows) == {"train", "val", "test"} and abs(rows["train"] - 0.8 * total) <= 1 and abs(rows["val"] - 0.1 * total) <= 1
    assert assign_splits(groups, targets.limit(0)).count() == 0
    assert assign_splits(groups.limit(0), targets).count() == 0

import itertools
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftmill.operators import drift

SCHEMA = "feed string, file_name string, exported_at timestamp, line_no int, raw string"


def lines(spark, files):
    rows = []
    for i, (name, objs) in enumerate(files):
        rows += [("f", name, f"2024-01-{i + 1:02d} 00:00:00", n, o if o is None or isinstance(o, str) else json.dumps(o, ensure_ascii=False)) for n, o in enumerate(objs, 1)]
    df = spark.createDataFrame(rows, "feed string, file_name string, exported_at string, line_no int, raw string")
    return df.withColumn("exported_at", F.to_timestamp("exported_at"))


def changes(spark, files):
    return {tuple(r)[1:] for r in drift.schema_changes(lines(spark, files)).collect()}


def rec(i, **more):
    return {"dn": f"DN-2024010{i}-01", "rid": f"1000{i}", **more}


def test_rename_add_remove_retype(spark):
    a = [rec(i, lot=f"L{i}", n=i, old="x") for i in range(8)]
    b = [{"dn": r["dn"], "record_id": r["rid"], "lotId": r["lot"], "n": str(r["n"]), "extra": True} for r in a]
    got = changes(spark, [("a", a), ("b", b)])
    assert got == {("b", "renamed", "record_id", "rid"), ("b", "renamed", "lotId", "lot"), ("b", "retyped", "n", ""), ("b", "removed", "old", ""), ("b", "added", "extra", "")}


def test_renamed_and_retyped(spark):
    a = [rec(i, lot=f"L{i}", el=["Si", f"O{i}"]) for i in range(6)]
    b = [{"dn": r["dn"], "rid": r["rid"], "lot": r["lot"], "edx": "/".join(r["el"])} for r in a]
    assert changes(spark, [("a", a), ("b", b)]) == {("b", "renamed", "edx", "el"), ("b", "retyped", "edx", "")}


def test_fraction_and_null(spark):
    a = [rec(i, t=25, u=None) for i in range(4)]
    b = [rec(i, t=25.0, u=3) for i in range(4)]
    assert changes(spark, [("a", a), ("b", b)]) == {("b", "retyped", "t", "")}


def test_rename_by_sketch_without_common_records(spark):
    a = [{"x": "alpha", "lot": f"L{i}"} for i in range(6)]
    b = [{"y": "alpha", "lot": f"M{i}"} for i in range(6)]
    assert changes(spark, [("a", a), ("b", b)]) == {("b", "renamed", "y", "x")}


def test_bad_lines_first_files_and_order(spark):
    a = [rec(1, k="v"), "", None, "# resumed", "null", "[1]", '{"cut": "of', rec(1, k="v")]
    assert changes(spark, [("b_first", a)]) == set()
    assert changes(spark, [("z", a), ("a", [rec(2)])]) == {("a", "removed", "k", "")}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert drift.schema_changes(none).count() == 0
    assert drift.unify(none, drift.schema_changes(none)).count() == 0


def test_field_in_any_line_counts(spark):
    assert changes(spark, [("a", [rec(1), rec(2, late=1)]), ("b", [rec(1), rec(2)])]) == {("b", "removed", "late", "")}


def test_unify(spark):
    a = [rec(i, lot_id=f"L{i}", total_wafers=5 + i, note="n") for i in range(6)]
    b = [{"dn": r["dn"], "rid": r["rid"], "LotNo": r["lot_id"], "total_wafers": str(r["total_wafers"]), "note": ["n", "m"]} for r in a]
    all_ = lines(spark, [("a", a), ("b", b)])
    out = drift.unify(all_, drift.schema_changes(all_)).collect()
    assert len(out) == 12 and {r.lot_id for r in out if r.file_name == "a"} == {r.lot_id for r in out if r.file_name == "b"}
    assert {r.total_wafers for r in out} == {5, 6, 7, 8, 9, 10} and all("dn" in r.extras for r in out)


def test_lists_of_text(spark):
    parts = ["缺陷类型为SlurryTrail_85", 'EDX："W/Si"', "路径 C:\\\\tmp\\n第二行", ":b", 7, True, None, " ", [["深"]]]
    rows = [
        {"text_content": parts, "edx_elements": ["W", "Si"], "lot_id": "L1"},
        {"text_content": {"zh": "甲：乙", "chars": 3}, "edx_elements": ["Cu"], "lot_id": 25.50},
        {"text_content": '[备注] 说 "甲" {乙}', "edx_elements": "W/Si", "lot_id": '{"a": "b"}'},
        {"text_content": {"n": 5, "m": {"k": -1.5}}, "edx_elements": None, "lot_id": None},
        {"text_content": [{"zh": "甲", "chars": 1}, {"zh": "乙", "chars": 1}], "edx_elements": [], "lot_id": ["x", "y"]},
    ]
    for ascii_ in (True, False):
        all_ = lines(spark, [("a", [json.dumps(r, ensure_ascii=ascii_) for r in rows])])
        got = drift.unify(all_, drift.schema_changes(all_)).orderBy("line_no").collect()
        whole = "；".join(["缺陷类型为SlurryTrail_85", 'EDX："W/Si"', "路径 C:\\\\tmp\\n第二行", ":b", "7", "true", "深"])
        assert [r.text_content for r in got] == [whole, "甲：乙", '[备注] 说 "甲" {乙}', "5；-1.5", "甲；乙"]
        assert [r.edx_elements for r in got] == ["W/Si", "Cu", "W/Si", None, ""]
        assert [r.lot_id for r in got] == ["L1", "25.5", '{"a": "b"}', None, "x；y"]


def test_counts_in_any_form(spark):
    forms = [25, 25.0, "25", " 25 ", "25.0", [25], ["25"], [25.0], {"n": 25}, 25.5, "25 pcs", [25, 3], None, "", True, 10**12]
    all_ = lines(spark, [("a", [{"total_wafers": f, "dn": i} for i, f in enumerate(forms)])])
    got = [r.total_wafers for r in drift.unify(all_, drift.schema_changes(all_)).orderBy("line_no").collect()]
    assert got == [25] * 9 + [None] * 7


def test_names_that_differ_in_case_and_joints(spark):
    rows = [{"waferNote": "a", "x1": 1}, {"wafer_note": "b"}, {"WaferNote": "c", "waferNote": "d", "__": 2}, {"Lot-ID": "L9"}]
    all_ = lines(spark, [("a", rows)])
    got = drift.unify(all_, drift.schema_changes(all_)).orderBy("line_no").collect()
    assert [len(r.extras) for r in got] == [2, 1, 2, 0] and len({k for r in got for k in r.extras if k.lower().startswith("wafer")}) == 1
    assert got[3].lot_id == "L9" and got[2].extras["__"] == "2"


def test_matching_by_parts_is_the_matching_of_all(spark):
    rng = random.Random(6)
    for _ in range(60):
        score = {(f"a{i}", f"b{j}"): rng.choice([0.2, 0.5, 0.9, 1.0]) + 0.001 * i for i in range(4) for j in range(4) if rng.random() < 0.35}
        pairs = drift._pairs(score)
        assert len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})
        best = max(sum(score.get((f"a{i}", f"b{j}"), 0) for i, j in enumerate(p)) for p in itertools.permutations(range(4)))
        assert sum(score[p] for p in pairs) == pytest.approx(best)


def test_long_leaves(spark):
    long = ["x" * 20_000 + '"' * 20_000, "\\" * 20_000, "y"]
    df = spark.createDataFrame([(json.dumps(long),)], "j string")
    assert list(df.select(drift.leaves_of(F.col("j")).alias("l")).first().l) == long


def test_names():
    assert drift.name_likeness("dnNo", "dn_no") == 1.0 and drift.name_likeness("edx", "platform") == 0.0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4).flatmap(lambda n: st.lists(st.lists(st.integers(-9, 9), min_size=n + 1, max_size=n + 1), min_size=n, max_size=n)))
def test_assignment_is_cheapest(cost):
    pick = drift.assignment([[float(v) for v in r] for r in cost])
    assert len(set(pick)) == len(pick)
    best = min(sum(cost[i][p[i]] for i in range(len(cost))) for p in itertools.permutations(range(len(cost[0])), len(cost)))
    assert sum(cost[i][j] for i, j in enumerate(pick)) == best

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from siftmill.functions.text import fold_code
from siftmill.llm.survivor import FIELDS, STATES, fuse, stated_fields, surviving_records, survivors

SCHEMA = "ord bigint, dn_no string, record_id string, text_content string, lot_id string, machine string, defect_type string, edx_elements string, total_wafers int, origin string, updated_at timestamp, rank int"
TRUST = [("mes", 1), ("man", 2), ("ppt", 2), ("csv", 3)]
T0 = dt.datetime(2024, 1, 1)


def table(spark, rows):
    keys = ("ord", "dn_no", "record_id", "text_content", "lot_id", "machine", "defect_type", "edx_elements", "total_wafers", "origin", "updated_at")
    return spark.createDataFrame([(*[r.get(k) for k in keys], 9) for r in rows], SCHEMA)


def trust(spark):
    return spark.createDataFrame(TRUST, "origin string, trust_rank int")


def found(spark, rows):
    return {(r.dn_no, r.field_name): r.ord for r in survivors(table(spark, rows), trust(spark)).collect()}


def test_rules(spark):
    d = "DN-20240101-01"
    rows = [
        {"ord": 1, "dn_no": d, "lot_id": "A", "machine": "M1", "origin": "csv", "updated_at": T0, "total_wafers": 0},
        {"ord": 2, "dn_no": "dn‑20240101‑01 ", "lot_id": "B", "machine": "未知", "origin": "man", "updated_at": T0, "total_wafers": 25},
        {"ord": 3, "dn_no": " ", "record_id": "ＤＮ－２０２４０１０１－０１", "lot_id": "C", "origin": "ppt", "updated_at": T0 + dt.timedelta(1), "defect_type": "无"},
        {"ord": 4, "dn_no": None, "record_id": "101286", "text_content": "本条DN编号是DN-20240101-01，参见DN-20250101-01。", "origin": None, "lot_id": "D"},
        {"ord": 5, "dn_no": "DN-20250101-01", "lot_id": "single", "origin": "mes"},
        {"ord": 6, "dn_no": "nan", "text_content": "参见DN-20240101-01的同类图形", "origin": "mes", "lot_id": "nobody"},
        {"ord": 7, "dn_no": d, "lot_id": "E", "origin": "ppt", "updated_at": None, "machine": "M7"},
    ]
    got = found(spark, rows)
    assert got == {(d, "lot_id"): 3, (d, "machine"): 7, (d, "defect_type"): 3, (d, "total_wafers"): 2, (d, "text_content"): 4}


def test_text_that_states_most(spark):
    d = "DN-20240101-01"
    short = "DN编号:DN-20240101-01，缺陷类型：PitCluster_1。"
    full = "DN编号:DN-20240101-01，缺陷类型：PitCluster_1，坏的Wafer数量为0，EDX背景为无，Map分布的位置为UNKNOWN，DFT分布的位置为未知。"
    rows = [{"ord": 1, "dn_no": d, "text_content": short + short, "origin": "mes", "updated_at": T0}, {"ord": 2, "dn_no": d, "text_content": full, "origin": "csv"}]
    assert found(spark, rows)[(d, "text_content")] == 2


def test_stated_fields(spark):
    text = (
        "当前记录DN编号为DN-20230216-01，EDX背景是无，扫描机器VLSCA01于2023/2/16 10:34:02完成扫描，产品ID为2204K02-105-H，EDX检测到的元素：无，核心缺陷类型为TintSpot_69，批次编号是BP000003，"
        "坏的Wafer数量是0，位于QX090EF平台下VI_POSTCMP_BF站点，实际扫描过的Wafer数量为19，Map分布的位置为Cluster，Wafer总数：25，DFT上面分布的位置为右下角，类型是Class1。"
    )
    hidden = text.replace("DN编号", "D​N编号").replace("VLSCA01", "VLЅCA01").replace("分布", "分­布")
    none = "核心缺陷类型为未知，类型为UNKNOWN，Map分布的位置是，批次号：nan，EDX背景为—。"
    df = spark.createDataFrame([(1, text), (2, hidden), (3, none), (4, text + text), (5, ""), (6, "缺陷类型为Class3")], "k int, t string")
    got = {r.k: r.n for r in df.select("k", stated_fields(fold_code(F.col("t"))).alias("n")).collect()}
    assert got == {1: 16, 2: 16, 3: 0, 4: 16, 5: 0, 6: 1} and len(STATES) == 16


def test_any_order_and_ties(spark):
    rng = random.Random(2)
    rows = [{"ord": i, "dn_no": f"DN-20240101-{i % 3:02d}", "lot_id": rng.choice(["A", "B", "", None]), "origin": rng.choice(["mes", "man", "zzz", None]), "updated_at": rng.choice([T0, T0, None])} for i in range(60)]
    want = {}
    ranks = dict(TRUST)
    for dn in {r["dn_no"] for r in rows}:
        own = [r for r in rows if r["dn_no"] == dn and r["lot_id"]]
        best = min(own, key=lambda r: (ranks.get(r["origin"], 99), -(r["updated_at"] or dt.datetime(1970, 1, 1)).timestamp(), r["ord"]))
        want[dn, "lot_id"] = best["ord"]
    assert found(spark, rows) == want
    rng.shuffle(rows)
    assert found(spark, rows) == want


def test_built_records_and_empty(spark):
    d = "DN-20240101-01"
    rows = [{"ord": 1, "dn_no": d, "lot_id": "A", "origin": "mes"}, {"ord": 2, "dn_no": d, "total_wafers": 7, "origin": "csv"}]
    r = surviving_records(table(spark, rows), trust(spark)).first()
    assert (r.dn_no, r.lot_id, r.total_wafers, r.machine) == (d, "A", 7, None)
    none = table(spark, rows).limit(0)
    assert survivors(none, trust(spark)).count() == 0 and fuse(none, trust(spark)).values.count() == 0
    assert set(FIELDS) <= set(none.columns)


def test_fusion_finds_copies_and_truth(spark):
    rng = random.Random(4)
    rows, truth, n = [], {}, itertools.count(1)
    for i in range(400):
        dn = f"DN-2024{i // 28 % 12 + 1:02d}{i % 28 + 1:02d}-{i % 90 + 10}"
        truth[dn] = rng.choice("ABCDEFGH")
        wrong = lambda dn=dn: rng.choice([c for c in "ABCDEFGH" if c != truth[dn]])
        bad = truth[dn] if rng.random() < 0.55 else wrong()
        said = {f"good{j}": truth[dn] if rng.random() < 0.8 else wrong() for j in range(1, 5)}
        said |= {"bad": bad, "copy1": bad, "copy2": bad if rng.random() < 0.95 else wrong()}
        rows += [{"ord": next(n), "dn_no": dn, "lot_id": v, "origin": o} for o, v in said.items()]
    out = fuse(table(spark, rows), trust(spark), rounds=5, false_values=8)
    assert out.copying[("bad", "copy1")] > 0.9 and out.copying[("good1", "good2")] < 0.5
    assert out.accuracy["good1"] > out.accuracy["bad"]
    value = {r["ord"]: r["lot_id"] for r in rows}
    picked = {r.dn_no: value[r.ord] for r in out.values.where("field_name = 'lot_id'").collect()}
    right = sum(picked[d] == truth[d] for d in truth) / len(truth)
    plain = 0
    for d in truth:
        votes = [r["lot_id"] for r in rows if r["dn_no"] == d]
        plain += max(sorted(set(votes)), key=votes.count) == truth[d]
    assert right > 0.9 and right > plain / len(truth) + 0.05


def test_fusion_of_texts(spark):
    d, e, f = "DN-20240101-01", "DN-20240101-02", "DN-20240101-03"
    rows = [
        {"ord": 1, "dn_no": d, "text_content": "缺陷类型为A_1。", "lot_id": "L1", "origin": "mes", "updated_at": T0},
        {"ord": 2, "dn_no": d, "text_content": "缺陷类型为B_2。", "lot_id": "L1", "origin": "man", "updated_at": T0},
        {"ord": 3, "dn_no": d, "text_content": "缺陷类型为Ｂ_2。", "origin": "ppt", "updated_at": T0},
        {"ord": 4, "dn_no": e, "text_content": "旧", "origin": "mes", "updated_at": T0},
        {"ord": 5, "dn_no": e, "text_content": "新", "origin": "mes", "updated_at": T0 + dt.timedelta(1)},
        {"ord": 6, "dn_no": f, "text_content": "未知", "machine": "M1", "origin": "mes"},
        {"ord": 7, "dn_no": f, "text_content": " ", "origin": "man"},
    ]
    out = fuse(table(spark, rows), trust(spark))
    got = {(r.dn_no, r.field_name): r.ord for r in out.values.collect()}
    # The text two origins share, whatever its letters; an origin's latest; no placeholders.
    assert got == {(d, "lot_id"): 1, (d, "text_content"): 2, (e, "text_content"): 5, (f, "machine"): 6}
    assert got.keys() == found(spark, rows).keys()
    values = {(r.dn_no, r.field_name): r.value for r in out.values.collect()}
    assert values[d, "text_content"] == "缺陷类型为B_2。" and values[f, "machine"] == "M1" and out.values.columns == ["dn_no", "field_name", "value", "posterior", "ord"]
    built = {r.dn_no: r for r in out.records().collect()}
    assert (built[d].lot_id, built[e].text_content, built[f].machine, built[f].text_content) == ("L1", "新", "M1", None)
    # Texts worded otherwise say nothing against their origins.
    bare = fuse(table(spark, [r | {"text_content": None} for r in rows]), trust(spark))
    assert out.accuracy == pytest.approx(bare.accuracy) and out.copying == pytest.approx(bare.copying)


def test_more_origins_than_have_an_accuracy_of_their_own(spark):
    """Origins beyond the bound still vote: each for itself, none is left out."""
    d = "DN-20240101-01"
    rows = [{"ord": i, "dn_no": d, "lot_id": "A" if i < 60 else "B", "origin": f"o{i}"} for i in range(100)] + [{"ord": 200, "dn_no": d, "lot_id": "B", "origin": "mes"}] * 1
    for own in (3, 1000):
        out = fuse(table(spark, rows), trust(spark), own_origins=own)
        r = out.values.first()
        assert (r.value, r.ord) == ("A", 0) and len(out.accuracy) == min(own, 101)


@pytest.mark.parametrize("block", [1024, 2])
def test_origins_beyond_those_in_memory_keep_their_accuracy_and_copying(spark, monkeypatch, block):
    """Whether statistics are matrices or tables, the results are the same, and no origin or pair of origins is left out."""
    monkeypatch.setattr("siftmill.llm.survivor.PAIR_BLOCK", block)
    rng = random.Random(7)
    rows, n = [], itertools.count(1)
    for i in range(60):
        dn = f"DN-202401{i % 28 + 1:02d}-{i + 10}"
        bad = rng.choice("BCD")
        said = {f"good{j}": "A" if rng.random() < 0.8 else rng.choice("BCD") for j in range(1, 4)} | {"bad": bad, "copy1": bad, "copy2": bad}
        rows += [{"ord": next(n), "dn_no": dn, "lot_id": v, "machine": rng.choice("MN"), "text_content": v, "origin": o, "total_wafers": 0} for o, v in said.items()]
    rows += [{"ord": next(n), "dn_no": "DN-20250101-10", "text_content": "T", "origin": o} for o in (None, "mes")]
    rows += [{"ord": next(n), "dn_no": "DN-20250101-11", "lot_id": "L", "origin": "alone"}]
    given, ranks = table(spark, rows), spark.createDataFrame([*TRUST, ("good1", 1), ("bad", 0), ("copy1", None)], "origin string, trust_rank int")
    held, laid = fuse(given, ranks, rounds=3), fuse(given, ranks, rounds=3, own_origins=2)

    def cells(out):
        return {(r.dn_no, r.field_name): (r.ord, r.value, pytest.approx(r.posterior, abs=1e-8)) for r in out.values.collect()}

    assert cells(laid) == {k: (o, v, p.expected) for k, (o, v, p) in cells(held).items()}
    origins = {r.origin: r.accuracy for r in laid.accuracies.collect()}
    assert origins == pytest.approx({r.origin: r.accuracy for r in held.accuracies.collect()}) and len(origins) == 9
    pairs = {(r.origin, r.other): r.copying for r in laid.copies.collect()}
    assert pairs == pytest.approx({(r.origin, r.other): r.copying for r in held.copies.collect()}) and len(pairs) == 15
    assert pairs["bad", "copy1"] > 0.9 and pairs["copy1", "copy2"] > 0.9 > 0.5 > pairs["good1", "good2"]
    assert len(laid.accuracy) == 2 and len(laid.copying) == 1
    value = {r.dn_no: r.value for r in laid.values.where("field_name = 'lot_id'").collect()}
    assert sum(v == "A" for v in value.values()) > 45

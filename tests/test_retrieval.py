import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmill import api
from siftmill.functions.tokens import tokens
from siftmill.operators import evidence as E
from siftmill.operators import facets as X
from siftmill.operators import images as I
from siftmill.operators import mlops as M
from siftmill.operators import retrieval as S

DOCS = [("d1", "scratch edge edge"), ("d2", "scratch ring"), ("d3", "ring ring ring ring"), ("d4", ""), ("d5", "x")]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(DOCS, "record_id string, text_content string")


def test_bm25_by_hand(corpus):
    got = {r.record_id: r.score for r in S.bm25(corpus, "record_id", "text_content", "edge scratch edge").collect()}
    n, avg = 5, (3 + 2 + 4 + 0 + 1) / 5
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    term = lambda tf, dl, df: idf(df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got == pytest.approx({"d1": term(2, 3, 1) + term(1, 3, 2), "d2": term(1, 2, 2)})
    assert S.bm25(corpus, "record_id", "text_content", "").count() == 0


def test_tfidf_by_hand(corpus):
    got = {r.record_id: r.score for r in S.tfidf(corpus, "record_id", "text_content", "ring").collect()}
    pairs = {d: {t[i : i + 2] for i in range(len(t) - 1)} for d, t in DOCS}
    df = {}
    for p in pairs.values():
        for t in p:
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(5 / (1 + c)) for t, c in df.items()}
    q = {t: idf.get(t, 0) for t in ("ri", "in", "ng")}
    want = {}
    for d, p in pairs.items():
        norm = math.sqrt(sum(idf[t] ** 2 for t in p))
        s = sum(q[t] * idf[t] for t in p if t in q) / (norm * math.sqrt(sum(v * v for v in q.values()))) if norm else 0
        if s > 0:
            want[d] = s
    assert got == pytest.approx(want)


def test_pair_cosine_keeps_all(corpus):
    got = {r.record_id: r.score for r in S.pair_cosine(corpus, "record_id", "text_content", "ring").collect()}
    assert set(got) == {d for d, _ in DOCS} and got["d4"] == 0 and got["d3"] > got["d2"] > 0


def test_fusion_keeps_lexical_only_and_rerank_turns(spark):
    a = spark.createDataFrame([("x", 0.9), ("y", 0.8)], "record_id string, score double")
    b = spark.createDataFrame([("z", 3.0), ("y", 1.0)], "record_id string, score double")
    got = {r.record_id: r.score for r in S.fuse_ranks({"dense": a, "lexical": b}, "record_id").collect()}
    assert got == pytest.approx({"x": 0.45 / 61, "y": 0.45 / 62 + 0.30 / 62, "z": 0.30 / 61})
    rows = spark.createDataFrame([("a", 1.0, "P1", "M1"), ("b", 0.8, "P2", "M2"), ("c", 0.0, None, "")], "record_id string, score double, platform string, machine string")
    r = S.rerank(rows, S.field_score({"platform": "P2", "machine": "m2"}), F.lit(0.0), F.lit(0.0)).orderBy(F.desc("final")).collect()
    assert [x.record_id for x in r] == ["b", "a", "c"] and r[2].final == 0
    none = S.rerank(rows.withColumn("score", F.lit(0.0)), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    assert {x.final for x in none.collect()} == {0.0}


def test_grain_score(spark):
    df = spark.createDataFrame([(["summary", "full"],), ([],), (["odd"],), (None,)], "g array<string>")
    assert [r.s for r in df.select(S.grain_score(F.col("g")).alias("s")).collect()] == [0.8, 0.0, 0.5, 0.0]
    assert S.GRAIN_WEIGHTS == {"defect_focus": 1.0, "machine_focus": 0.9, "summary": 0.8, "keywords": 0.8, "natural_language": 0.7, "full": 0.6}


def test_rings_and_cells_of_a_picture(spark):
    """Against the picture's own middle, corners and thirds, in numpy."""
    rng = np.random.default_rng(3)
    w, h = 40, 30
    pts = {"a": rng.integers(0, (w, h), (200, 2)), "b": np.array([[0, 0], [39, 29], [19, 14]]), "c": rng.integers((0, 0), (9, 9), (50, 2))}
    df = spark.createDataFrame([(k, int(x), int(y)) for k, v in pts.items() for x, y in v], "img string, x int, y int")
    rings = {(r.img, r.bin): r.share for r in I.radial_histogram(df, "img", "x", "y", F.lit(w), F.lit(h)).collect()}
    cells = {r.img: r for r in I.grid_dispersion(df, "img", "x", "y", F.lit(w), F.lit(h)).collect()}
    for k, v in pts.items():
        radius = np.sqrt(((v - [(w - 1) / 2, (h - 1) / 2]) ** 2).sum(axis=1)) / math.hypot((w - 1) / 2, (h - 1) / 2)
        want = np.histogram(radius, bins=np.linspace(0, 1, 9))[0] / len(v)
        assert [rings.get((k, i), 0) for i in range(8)] == pytest.approx(list(want), abs=1e-9)
        n = np.zeros((3, 3), int)
        np.add.at(n, (np.minimum(2, v[:, 1] * 3 // h), np.minimum(2, v[:, 0] * 3 // w)), 1)
        p = n[n > 0] / len(v)
        low, high = np.percentile(v[:, 0], [5, 95])
        assert cells[k].active_cells == (n >= max(4, math.ceil(0.06 * len(v)))).sum() and cells[k].dispersion == pytest.approx(-(p * np.log(p)).sum() / math.log(9), abs=1e-6)
        assert cells[k].x_span == pytest.approx((high - low + 1) / w, abs=1e-6)
    assert not cells["c"].spread_all_over


def test_filters(spark):
    assert X.clean_filters({"platform": "A", "machine": ["m", " M ", ""], "bad": ["x"]}) == {"platform": ["A"], "machine": ["m"]}
    rows = spark.createDataFrame([(1, "r1", "QX-1", "A_1"), (2, "r2", "qx-1 ", "A_2"), (3, "r3", "Z", "A_1")], "ord int, record_id string, platform string, defect_type string")
    assert sorted(r.ord for r in rows.where(X.any_of_each({"platform": ["QX-1", "z"], "defect_type": ["a_1"]})).collect()) == [1, 3]
    loose = X.exact_or_squeezed(rows, {"platform": "ＱＸ-1"}, "record_id", "ord", 10)
    assert [(r.ord, r.match_mode) for r in loose.collect()] == [(1, "normalized"), (2, "normalized")]
    assert [(r.ord, r.match_mode) for r in X.exact_or_squeezed(rows, {"platform": "QX-1"}, "record_id", "ord", 10).collect()] == [(1, "exact")]


def test_similar(spark):
    rows = spark.createDataFrame([("a", "QX040LP", "M1", "D1"), ("b", "QX040LP", "M1", "D1"), ("c", "QX040LP", "M2", "D2"), ("d", "QX040XX", "M1", "D1"), ("e", "ZZ", "M1", "D1")], "k string, platform string, machine string, defect_type string")
    assert {tuple(r) for r in X.similar_records(rows, "k", "a").collect()} == {("b", 1.0), ("c", 0.8), ("d", 0.8)}
    assert {r.k for r in X.similar_records(rows, "k", "a", "platform").collect() if r.score == 1.0} == {"b", "d", "e"}
    assert X.similar_records(rows, "k", "nobody").count() == 0


def test_images(spark):
    v = spark.createDataFrame([("A", 1, "binmap", [1.0, 0.0]), ("A", 2, "sem", [0.0, 1.0]), ("B", 3, "binmap", [0.8, 0.6])], "dn_no string, img int, modality string, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "query_id int, query_vector array<double>")
    s = I.similarities(v, q, "vector", "query_vector")
    assert {r.dn_no: round(r.score, 6) for r in I.max_then_mean(s, "dn_no", "query_id", 2).collect()} == {"A": 1.0, "B": 0.8}
    assert {r.dn_no: round(r.score, 6) for r in I.max_sim(s, "dn_no", "modality", "query_id", 2).collect()} == {"A": 1.0, "B": 0.8}
    m = {r.dn_no: (r.average_similarity, r.best_image) for r in I.mean_per_entity(s.where("query_id = 1"), "dn_no", "img").collect()}
    assert m == {"A": (0.5, 1), "B": (0.8, 3)}
    assert [r.dn_no for r in api.image_search(v, q).orderBy("rank").collect()] == ["A", "B"]


def test_local_scores(spark):
    b = spark.createDataFrame([("A", 0.9), ("A", 0.85), ("A", 0.5), ("B", 0.7)], "dn string, sim double")
    got = {r.dn: r for r in I.local_scores(b, "dn", 3, F.lit(0.6), F.lit(0.4)).collect()}
    top, cov = (0.9 + 0.85 + 0.5) / 3, 2 / 3
    local = max(0.94 * 0.9, 0.72 * top + 0.28 * cov)
    w = 0.12 * cov
    assert got["A"].final == pytest.approx((0.22 - w / 2) * 0.6 + (0.70 + w / 2) * local + 0.08 * 0.4, abs=1e-6)


def test_evidence(spark):
    h = spark.createDataFrame([("text", 0, 0, "r1", 0.5, None), ("image", 1, 0, "r1", 0.9, "M1"), ("text", 0, 1, "r2", 0.2, "M2"), ("text", 0, 2, "", 1.0, "M3")], "source string, source_ord int, row_ord int, record_id string, score double, machine string")
    got = [(r.record_id, r.score, r.sources, r.machine) for r in E.merge_evidence(h, ["machine"]).collect()]
    assert got == [("r1", 0.9, ["text", "image"], "M1"), ("r2", 0.2, ["text"], "M2")]
    merged, charts = api.report(h, ["machine"])
    assert merged.count() == 2 and charts.count() == 2


def test_api_search(spark):
    rows = spark.createDataFrame([("r1", "edge residue near the notch", "QX1", ["full"]), ("r2", "ring scratch", "QX2", []), ("r3", "edge", "QX1", None)], "record_id string, text_content string, platform string, matched_grains array<string>")
    found = api.search(rows, "edge residue")
    assert found.mode == "hybrid" and [r.record_id for r in found.rows.collect()][0] == "r1"
    found = api.search(rows, "平台为QX1")
    assert found.mode == "exact" and {r.record_id for r in found.rows.collect()} == {"r1", "r3"}
    assert {r.record_id for r in api.search(rows, "edge residue", filters={"platform": ["qx2"]}).rows.collect()} <= {"r2"}
    for bad in ("", "?!。"):
        with pytest.raises(ValueError):
            api.search(rows, bad)
    assert api.explain(spark, "右下角残留")["mode"] == "hybrid"
    assert api.health({"a": rows})["a"] == {"ok": True, "rows": 3}


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)], "t int, p int")
    m = M.metrics(df, "t", "p").first()
    assert m.accuracy == 0.6 and m.balanced_accuracy == pytest.approx((0.5 + 1 + 0) / 3, abs=1e-8)
    assert m.macro_f1 == pytest.approx((0.5 + 0.8 + 0) / 3, abs=1e-8)


def test_split_shrinks(spark):
    rows = spark.createDataFrame([(i, "a") for i in range(3)] + [(i, "b") for i in range(10, 20)] + [(i, "c") for i in range(20, 22)] + [(i, "d") for i in range(100, 104)], "k int, t string")
    got = {(r.t, r.split): r.n for r in M.stratified_split(rows, "k", "t", 0.4, 0.4).groupBy("t", "split").agg(F.count("*").alias("n")).collect()}
    assert got[("a", "train")] == got[("a", "val")] == got[("a", "test")] == 1
    assert got[("b", "val")] == 4 and got[("b", "test")] == 4 and got[("c", "too_few")] == 2
    assert got[("d", "train")] >= 1 and sum(v for (t, _), v in got.items() if t == "d") == 4


def test_early_stop(spark):
    h = spark.createDataFrame([(1, e, v) for e, v in enumerate([0.1, 0.3, 0.2, 0.3, 0.25, 0.4], 1)], "run int, epoch int, v double")
    got = M.early_stop(h, "run", "epoch", "v", 3).orderBy("epoch").collect()
    assert [r.improved for r in got] == [True, True, False, False, False, True] and [r.stopped for r in got] == [False] * 4 + [True, True]


def test_plans(spark, small):
    import __spark_entry__ as entry

    q = entry.queries()
    plan = lambda n: q[n](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan("dense_topk_threshold")
    text = plan("exact_filter_conj")
    assert "PushedFilters: [" in text and "EqualTo(platform,QX040LP)" in text
    for name in ("bm25_topk", "facet_value_counts", "merge_first_nonmissing_longest"):
        assert "CartesianProduct" not in plan(name)
    assert "text" not in plan("dedupe_best")
    assert tokens is not None


def test_too_many_query_images_are_refused(spark):
    v = spark.createDataFrame([("A", "binmap", [1.0, 0.0])], "dn_no string, modality string, vector array<double>")
    q = lambda n: spark.range(n).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("query_vector"))
    for mode in ("unified", "local"):
        assert [r.score for r in api.image_search(v, q(100), mode).collect()] == [1.0]
        with pytest.raises(ValueError):
            api.image_search(v, q(102), mode)


def test_geometry_of_several_maps(spark):
    maps = spark.createDataFrame([("A", [1.0, 0.0], 0.1), ("A", [0.0, 1.0], 0.1), ("B", [1.0, 1.0], 0.2), ("C", [0.0, 0.0], 0.0)], "dn string, rings array<double>, ratio double")
    queries = spark.createDataFrame([(1, [1.0, 0.0], 0.1), (2, [0.0, 2.0], 0.2)], "q int, rings array<double>, ratio double")
    got = {r.dn: r.geometry for r in I.geometry_scores(maps, queries, "dn", "q").collect()}
    b = (0.75 / math.sqrt(2) + 0.25 * 0.5 + 0.75 / math.sqrt(2) + 0.25) / 2
    assert got["A"] == pytest.approx((1.0 + 0.75 + 0.25 * 0.5) / 2) and got["B"] == pytest.approx(b) and got["C"] == pytest.approx(0, abs=1e-6)


def test_candidates_and_blocks(spark):
    rows = spark.createDataFrame([("f", 1, "M1", "x"), ("f", 2, " m1", "0"), ("f", 3, "M0", None), ("g", 4, "UNKNOWN", "y")], "file string, no int, machine string, lot_id string")
    got = {(r.file, r.field): r["values"] for r in X.candidates(rows, "file", "no", ["machine", "lot_id"]).collect()}
    assert got == {("f", "machine"): ["M1", "M0"], ("f", "lot_id"): ["x"], ("g", "lot_id"): ["y"]}
    blocks = spark.createDataFrame([("r", 2, 1), ("r", 1, 2), ("r", 1, 1), ("s", 5, 1)], "req string, q int, b int")
    assert {(r.req, r.q, r.b): r.display_id for r in I.request_blocks(blocks, ["req"], "q", "b").collect()} == {("r", 1, 1): 1, ("r", 1, 2): 2, ("r", 2, 1): 3, ("s", 5, 1): 1}


def test_pages_beyond_the_recall_are_refused(spark):
    rows = spark.createDataFrame([("r1", "edge")], "record_id string, text_content string")
    with pytest.raises(ValueError, match="limit"):
        api.search(rows, "edge", limit=10, offset=4_995)


def test_one_index_serves_many_questions(corpus):
    index = S.pair_index(corpus, "record_id", "text_content")
    for q in ("ring", "edge scratch", "zz", ""):
        own = {r.record_id: r.score for r in S.tfidf(corpus, "record_id", "text_content", q).collect()}
        assert own == pytest.approx({r.record_id: r.score for r in S.tfidf(corpus, "record_id", "text_content", q, index).collect()})


def test_requests_for_records(spark):
    rows = spark.createDataFrame([("DN-1", "QX1", "M1"), ("DN-2", "QX2", None)], "dn_no string, platform string, machine string")
    images = spark.createDataFrame([("dn-1", "Odd", "b.png"), ("DN-1", "DefectMapPost", "a.png"), ("DN-3", "Odd", "c.png")], "dn_no string, image_type string, file_name string")
    one = api.record(rows, images, " dn-1").collect()
    assert [(r.dn_no, r.machine, [i.file_name for i in r.images]) for r in one] == [("DN-1", "M1", ["a.png", "b.png"])]
    assert api.record(rows, images, "DN-2").count() == 0 and api.record(rows, images, "DN-3").first().has_record is False
    assert [r.dn_no for r in api.filter_search(rows, {"platform": "qx1", "bad": ["x"]}).collect()] == ["DN-1"]
    with pytest.raises(ValueError):
        api.filter_search(rows, {}, limit=5_001)
    assert [(r.field, r.value, r.n) for r in api.facet_counts(rows.union(rows.limit(1))).collect()] == [("machine", "M1", 2), ("platform", "QX1", 2), ("platform", "QX2", 1)]
    rows.createOrReplaceTempView("kept_rows")
    api.refresh(spark, ["kept_rows"])

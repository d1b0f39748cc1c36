import random

from pyspark.sql import functions as F

from siftmill.operators import records as R

SCHEMA = "ord bigint, point_id string, dn_no string, record_id string, text_content string, machine string, defect_type string, total_wafers int"


def points(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


ROWS = [
    (1, "p1", "DN-1", None, "short", "未知", "A_1", 0),
    (2, "p2", "dn-1 ", None, "a longer text", "M1", "B_2", 25),
    (3, "101", None, "DN-2", "UNKNOWN", " ", "无", None),
    (4, "102", "", "", None, "M9", None, 3),
    (5, None, "UNKNOWN_DN", "nan", "x", "M8", None, 3),
    (6, "p6", "DN-1", None, "also long txt", "M2", None, 13),
]


def test_merge(spark):
    got = {r.dn_no: r for r in R.merge_points(points(spark, ROWS)).collect()}
    assert set(got) == {"DN-1", "DN-2", "102"}
    one = got["DN-1"]
    assert (one.text_content, one.machine, one.defect_type, one.total_wafers, one.n_points) == ("a longer text", "M1", "A_1", 25, 3)
    assert got["DN-2"].text_content is None and got["DN-2"].defect_type == "无"


def test_merge_in_any_order(spark):
    want = sorted(map(tuple, R.merge_points(points(spark, ROWS)).collect()), key=str)
    for seed in range(3):
        rows = ROWS[:]
        random.Random(seed).shuffle(rows)
        assert sorted(map(tuple, R.merge_points(points(spark, rows).repartition(3)).collect()), key=str) == want


def test_parse(spark):
    text = "当前记录DN编号为DN-20230216-01，EDX背景是无，扫描机器VLSCA01于2023/2/16 10:34:02完成扫描，产品ID为2204K02-105-H，EDX检测到的元素：无，核心缺陷类型为TintSpot_69，Lot ID（批次编号为）AB12345.0067，坏的Wafer数量是4，位于QX090EF平台下VI_POSTCMP_BF站点，Map分布的位置为Cluster，Wafer总数：２５，类型是Class1。"
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    rows = R.parse_records(df, "t").collect()
    r = rows[0]
    assert (r.dn_no, r.lot_id, r.machine, r.scan_time, r.platform, r.station) == ("DN-20230216-01", "AB12345.0067", "VLSCA01", "2023/2/16 10:34:02", "QX090EF", "VI_POSTCMP_BF")
    assert (r.total_wafers, r.bad_wafers, r.scanned_wafers, r.edx_elements, r.class_type, r.defect_type) == (25, 4, None, "无", "Class1", "TintSpot_69")
    assert rows[1].dn_no is None and rows[2].dn_no is None
    compat = R.parse_records(df, "t", compat=True).collect()
    assert compat[0].scanned_wafers == 0 and compat[1].platform == "UNKNOWN"


def test_canonicalise_and_chunks(spark):
    df = points(spark, [(1, "p", "", "101", "DN编号:DN-20230216-01，缺陷类型：Blister_1。", None, None, None)])
    r = R.canonicalise(df).first()
    assert (r.dn_no, r.record_id, r.defect_type) == ("DN-20230216-01", "DN-20230216-01", "Blister_1")
    chunks = df.select(R.text_chunks(df).alias("c")).first()["c"]
    assert len(chunks) == 1
    assert R.describe(points(spark, [(1, "p", "DN-1", None, None, "M1", "—", 0)])).first()["description"] == "DN编号为DN-1；机器为M1。"
    assert R.describe(points(spark, [(1, "p", None, None, None, None, None, 0)])).first()["description"] == "原始记录未保存描述文本。"
    keyed = spark.createDataFrame([("UNKNOWN", "own", "other", None), (None, " ", "x", "y"), (None, None, None, "y")], "text_content string, description string, TEXT string, text string")
    assert [r.text_content for r in R.canonicalise(keyed).collect()] == ["own", "x", "y"]


def test_with_images(spark):
    records = spark.createDataFrame([("dn-1 ", "M1")], "dn_no string, machine string")
    images = spark.createDataFrame([("DN-1", "MoreImage", "z.png"), ("dn-1", "DefectMapPost", "b.png"), ("DN-1", "Odd", "a.png"), ("DN-1", "Odd", "a.png"), ("DN-2", "Odd", "q.png"), (" ", "Odd", "q.png"), (None, "Odd", "q")], "dn_no string, image_type string, file_name string")
    got = {r.dn_no: (r.has_record, r.machine, [i.file_name for i in r.images]) for r in R.with_images(records, images).collect()}
    assert got == {"DN-1": (True, "M1", ["b.png", "z.png", "a.png"]), "DN-2": (False, None, ["q.png"])}


def test_upsert_and_imports(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    once = R.upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, R.upsert(once, new, ["k"]).collect())) == sorted(map(tuple, once.collect()))
    files = spark.createDataFrame([("b.pptx", "h1"), ("a.pptx", "h1"), ("c.pptx", "h2")], "file_name string, sha256 string")
    ledger = spark.createDataFrame([("h2",)], "sha256 string")
    assert [r.file_name for r in R.new_imports(ledger, files, "sha256").collect()] == ["a.pptx"]


def test_roles(spark):
    df = spark.createDataFrame([("r", k, i) for i, k in enumerate(["binmap", "sem", "binmap", "sem", "sem"])], "rec string, kind string, y int")
    got = {r.y: r.role for r in R.assign_roles(df, ["rec"], "kind", ["y"]).collect()}
    assert got == {0: "DefectMapPost", 1: "TypicalDefectImage1", 2: "ImportedBinMap2", 3: "TypicalDefectImage2", 4: "ImportedSEMImage3"}


def test_grains(spark):
    df = spark.createDataFrame([("a", 0.5, "full", 1), ("a", 0.9, "summary", 2), ("a", 0.9, "full", 3), ("b", 0.1, None, 4), ("", 1.0, "x", 5)], "id string, score double, grain string, ord int")
    got = {r.id: (r.score, r.ord, r.matched_grains) for r in R.merge_grains(df, "id", "score", "grain", "ord").collect()}
    assert got == {"a": (0.9, 2, ["full", "summary", "full"]), "b": (0.1, 4, [])}


def test_slide(spark):
    lines = ["DN-20241106-02 Class3 2216K03-107-E VI_STRIP_DF NeedleMark_21", "QX040LP/TE000221.00/NG 5 AdhCANC 22 Total 25", "# 6 NeedleMark_22", "Map / Edge", "VLSCK12 2024/11/6 13:26:00", "Down", "Scrap"]
    df = spark.createDataFrame([(lines,), (["nothing"],)], "l array<string>")
    cols = R.slide_record(F.col("l"), F.lit("deck_7.pptx"), F.lit(3))
    a, b = df.select(*[c.alias(f) for f, c in cols.items()]).collect()
    assert (a.dn_no, a.station, a.platform, a.lot_id, a.bad_wafers, a.total_wafers, a.defect_type, a.map_location, a.machine, a.equipment_status, a.lot_status) == ("DN-20241106-02", "VI_STRIP_DF", "QX040LP", "TE000221.00", 5, 25, "NeedleMark_22", "Edge", "VLSCK12", "Down", "Scrap")
    assert b.dn_no == "PPT-deck_7-003" and b.platform is None


def test_tables(spark, tmp_path):
    from siftmill.operators import tables
    from siftmill.session import clear_tables, materialise
    from siftmill.sources.files import NOTE

    hits = spark.createDataFrame([("a", 0.2, 1, "M1"), ("a", 0.9, 2, "nan"), ("b", None, 3, "M3")], "record_id string, score double, ord int, machine string")
    got = [tuple(r) for r in tables.result_table(hits, "record_id", "score", "ord").collect()]
    assert got == [("b", 1.0, "M3"), ("a", 0.9, "未知")]
    notes = spark.createDataFrame([("k1", "T", None, None, ["x"], None, [], None)], NOTE)
    assert tables.knowledge_points(notes).first()["source_type"] == "analysis_knowledge"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS kept LOCATION 'file://{tmp_path}/kept'")
    tables.create_entities(spark, "kept.entities", buckets=2, recreate=True)
    assert spark.table("kept.entities").count() == 0
    spark.sql("DROP DATABASE kept CASCADE")
    kept = materialise(hits, "gone")
    assert kept.count() == 3
    clear_tables(spark)


def test_saved_tables_change_by_bucket(spark, tmp_path):
    from siftmill.operators import tables

    path = str(tmp_path / "kept")
    assert tables.stored(spark, path) is None
    df = lambda rows: spark.createDataFrame(rows, "dn_no string, v int")
    held = lambda: {r.dn_no: r.v for r in tables.stored(spark, path).collect()}
    assert tables.save(df([]), path, "dn_no").count() == 0
    tables.save(df([(f"DN-{i}", i) for i in range(40)]), path, "dn_no", 8)
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "kept").rglob("*.parquet")}
    for _ in range(2):
        assert tables.save(df([("DN-3", 99), ("DN-new", 1)]), path, "dn_no", 8).count() == 2
    assert held() == {f"DN-{i}": i for i in range(40)} | {"DN-3": 99, "DN-new": 1}
    assert sum(f.exists() for f in files) >= 6  # the other buckets weren't written


def test_sync_report(spark):
    r = spark.createDataFrame([("A",), ("B",)], "dn_no string")
    i = spark.createDataFrame([("A", "1"), ("A", "2"), ("C", "3")], "dn_no string, file_name string")
    assert {x.measure: x.n for x in R.sync_report(r, i).collect()} == {"dn_count": 2, "image_count": 3, "missing_images": 1, "orphan_image_dns": 1}
    assert {x.measure: x.n for x in R.sync_report(r.limit(0), i.limit(0)).collect()} == dict.fromkeys(["dn_count", "image_count", "missing_images", "orphan_image_dns"], 0)


def test_more_hot_keys_than_may_be_broadcast(spark):
    from siftmill.operators.skew import lookup

    rows = spark.createDataFrame([(k, i) for k in range(12) for i in range(2 + 3 * k)], "k int, i int")
    unique = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 10)
    for how in ("inner", "left"):
        got = lookup(rows, unique, ["k"], "n", F.col("i"), how, hot_rows=2, max_hot=3).collect()
        assert len(got) == rows.count() and all(r.v == 10 * r.k for r in got)


def test_spread_asks_no_shuffled_input(spark, small):
    from siftmill.session import spread

    rows = spark.read.parquet(f"{small}/documents.parquet")
    assert spread(rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    grouped = rows.groupBy("lang").agg(F.count("*").alias("n"))
    assert spread(grouped) is grouped and sorted(map(tuple, spread(rows).select("doc_id").collect())) == sorted(map(tuple, rows.select("doc_id").collect()))
    many = spark.range(0, 100, 1, 50)
    assert spread(many) is many

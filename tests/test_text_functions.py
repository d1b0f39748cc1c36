import random
import uuid
from urllib.parse import quote

from pyspark.sql import functions as F

from siftmill.functions import asked, box, ids, jsontext, paths, tokens
from siftmill.functions.parse import parse_fields
from siftmill.functions import vector as V
from siftmill.functions.text import dn_of, fold_code, is_missing


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first()["r"]


def test_fold_code(spark):
    assert one(spark, "ＤＮ－２０２４０１０１－０２", fold_code) == "DN-20240101-02"
    assert one(spark, "DΝ‑20240101​−02", fold_code) == "DN-20240101-02"
    assert one(spark, None, fold_code) is None


def test_dn_of(spark):
    for raw in ("dn-20240101-02 ", "DN_20240101_02", "DN‐20240101‐02", "x/DN20240101-02.png"):
        assert one(spark, raw, dn_of) == "DN-20240101-02"
    assert one(spark, "101286", dn_of) is None


def test_missing(spark):
    for raw, want in ((None, True), ("", True), (" 　", True), ("UNKNOWN_DN", True), ("未知", True), ("NaN ", True), ("—", True), ("无", False), ("0", False)):
        assert one(spark, raw, is_missing) is want


def test_tokens(spark):
    got = one(spark, "Residue_Web_132 右下角残留!", tokens.tokens)
    assert got[0] == "residue_web_132" and "右下" in got and "残留" in got
    assert {"bottom", "right", "residue"} <= set(got)
    assert one(spark, "", tokens.tokens) == []
    assert one(spark, "查询", tokens.tokens) == ["查", "询"]


def test_char_pairs(spark):
    assert one(spark, "aB\n", tokens.char_pairs) == ["ab", "b\n"]
    assert one(spark, "a", tokens.char_pairs) == [] and one(spark, None, tokens.char_pairs) == []


def test_url_quote(spark):
    for text in ("a b/c\\d.png", "100%+~*'()!&=#?", "图像/ＤＮ－１.png", "é\u200b🙂", "%2F", ""):
        assert one(spark, text, ids.url_quote) == quote(text, safe="")


def test_quoted_paths(spark, small):
    from siftmill.plans.records import QUERIES
    from siftmill.plans.tables import table

    want = {r.label_id: "/" + quote(r.image_path or "", safe="") for r in table(spark, small, "labels_example").collect()}
    got = QUERIES["quoted_urls"](spark, small).collect()
    assert len(got) == len(want) and {r.label_id: r.url for r in got} == want and any("%2F" in r.url for r in got)


def test_uuid5(spark):
    assert one(spark, "record:DN-1", ids.uuid5) == str(uuid.uuid5(uuid.NAMESPACE_URL, "record:DN-1"))


def test_image_roles(spark):
    names = {"Typeical-Defect Image1.PNG": "TypicalDefectImage1", "defect_map_post.jpg": "DefectMapPost", "OperatorSnapshot.png": "OperatorSnapshot", "a/b/TypicalMap2.bmp": "TypicalMap2"}
    for name, role in names.items():
        assert one(spark, name, paths.image_role) == role
    assert one(spark, "OperatorSnapshot", paths.modality) is None
    assert one(spark, "DefectMapPost", paths.modality) == "binmap"


def test_safe_name_and_resolve(spark):
    assert one(spark, "..a b?中.pptx", paths.safe_name) == "a_b_中.pptx"
    assert one(spark, "???", paths.safe_name) == "uploaded.pptx"
    assert one(spark, "../media/./i.png", lambda c: paths.resolve(F.lit("ppt/slides/s.xml"), c)) == "ppt/media/i.png"


def test_clean_json(spark):
    assert one(spark, '<think>{"x":1}</think>```json\n{"a":1}\n```', jsontext.clean_json) == '{"a":1}'
    assert one(spark, 'so: {"a":{"b":2}} done', jsontext.clean_json) == '{"a":{"b":2}}'
    assert one(spark, "[1,2]", jsontext.clean_json) is None and one(spark, "none", jsontext.clean_json) is None


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<float>, b array<float>")
    r = row.select(V.dot("a", "b").alias("d"), V.norm(F.col("a")).alias("n"), V.cosine(F.col("a"), F.col("b")).alias("c"), V.finite(F.col("a"), 2).alias("f")).first()
    assert (r.d, r.n, round(r.c, 6), r.f) == (24.0, 5.0, 0.96, True)


def test_boxes(spark):
    a = F.struct(F.lit(0).alias("left"), F.lit(0).alias("top"), F.lit(10).alias("right"), F.lit(10).alias("bottom"))
    b = F.struct(F.lit(5).alias("left"), F.lit(0).alias("top"), F.lit(25).alias("right"), F.lit(10).alias("bottom"))
    assert spark.range(1).select(box.overlap(a, b).alias("o")).first()["o"] == 0.5


QUESTIONS = {
    "平台为CL040LP": ({"platform": "CL040LP"}, True),
    "CL040LP平台": ({"platform": "CL040LP"}, True),
    "哪些 Buried_Particle_5 发生在 CL028HK": ({"defect_type": "Buried_Particle_5", "platform": "CL028HK"}, True),
    "右下角残留": ({}, False),
    "Residue缺陷": ({"defect_type": "Residue"}, False),
    "Residue_36缺陷": ({"defect_type": "Residue_36"}, True),
    "缺陷类型：Residue": ({"defect_type": "Residue"}, True),
    "": ({}, False),
    "请查 dn-20230216-01。": ({"dn_no": "dn-20230216-01"}, True),
    "LotID：ＡＢ12.01，机台 VLSCA01": ({"lot_id": "AB12.01", "machine": "VLSCA01"}, True),
    "批次等于BP000003": ({"lot_id": "BP000003"}, True),
    "Lot ID(批次编号)为AB12345.0067": ({"lot_id": "AB12345.0067"}, True),
    "产品ID=2204K02": ({"product_id": "2204K02"}, False),
    "缺陷类型为Class3": ({"class_type": "Class3", "defect_type": "Class3"}, True),
    "位于QX090EF平台下VI_POSTCMP_BF站点": ({"platform": "QX090EF", "station": "VI_POSTCMP_BF"}, True),
    "Map位置 Edge and Center 的记录": ({"map_location": "Edge and Center"}, True),
    "类别 Class5 wafer": ({"class_type": "Class5"}, False),
    "lots of scratches": ({}, False),
    "Tech: TR055BC": ({"platform": "TR055BC"}, True),
}


def test_questions(spark):
    df = spark.createDataFrame([(q,) for q in [*QUESTIONS, None]], "q string").withColumn("c", asked.conditions(F.col("q")))
    got = {r.q: (dict(r.c), r.e) for r in df.select("q", "c", asked.is_exact(F.col("q"), F.col("c")).alias("e")).collect()}
    assert got == QUESTIONS | {None: ({}, False)}
    assert asked.understand(spark, "CL040LP平台") == ({"platform": "CL040LP"}, True)


def test_marks_are_found_inside_one_another_and_values_in_their_clause(spark):
    text = "核心缺陷类型为A_1，EDX背景，EDX背景是Cu Si，扫描机器VLS于2023/2/16 10:34:02完成了扫描，产品名称无，产品编号：P-1；__QX1 平台的S_1站点。"
    df = spark.createDataFrame([(text,), ("平台" * 3000 + "x",), (None,)], "t string")
    a, b, c = (r.p for r in df.select(parse_fields(F.col("t")).alias("p")).collect())
    assert (a.defect_type, a.edx_bg, a.machine, a.scan_time, a.product_id, a.platform, a.station) == ("A_1", "Cu Si", "VLS", "2023/2/16 10:34:02", "P-1", "QX1", "S_1")
    assert b.platform is None and c.dn_no is None and c.total_wafers is None


def test_any_text_is_a_question(spark):
    rng = random.Random(1)
    signs = "DN-2023 平台产品缺陷类型LotID批次哪些发生在为是:=，。；()_.\\n\u0000é机台Class"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "q string").withColumn("c", asked.conditions(F.col("q")))
    rows = df.select("c", asked.is_exact(F.col("q"), F.col("c")).alias("e")).collect()
    assert len(rows) == 300 and all(isinstance(r.e, bool) and all(v for v in r.c.values()) for r in rows)

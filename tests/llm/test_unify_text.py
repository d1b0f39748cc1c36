import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from siftmill.llm.unify_text import canonical, compose_no, unify_text

CHANGED = {
    "Τotal 6": "Total 6", "НР002781": "HP002781", "ＴＥ００５４.００": "TE0054.00", "Ｓｃｒａｐ": "Scrap", "班长⼩杭": "班长小杭", "Åskar": "Åskar", "Si/О": "Si/O",
    "VLЅCA01": "VLSCA01", "Half Мoon": "Half Moon", "a​b": "ab", "Z​élia": "Zélia", "DN‐2024": "DN-2024", "Х-000013_А": "X-000013_A", "X−001‌": "X-001",
    "a b": "a b", "a　b": "a b", "Reνiewed": "Reviewed", "пpoверка": "проверка", "é": "é",
}
SAME = ["", "plain", "проверка камеры", "β相析出", "3σ", "Δ温度 3 度", "Brünnal", "17 Å", "ok，。；：（）？！", "a\nb\r\n", "осмотр WO-434/осмотр", "q́", "無", " x "]


def test_changed():
    for text, want in CHANGED.items():
        got, n = canonical(text)
        assert got == want and n > 0, text


def test_ordinary_text_stays():
    for text in SAME:
        assert canonical(text) == (text, 0), text


alphabet = st.sampled_from("aZ9 _-/éüΑοΔσВерп中小⼩Ａ９－，。：́̈​ 　Å‐\nＫ")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet, max_size=30))
def test_canonical_form_is_final_and_composed(text):
    once, n = canonical(text)
    assert canonical(once) == (once, 0)
    assert unicodedata.is_normalized("NFC", once)
    assert (n > 0) == (once != text) or n > 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_any_text(text):
    once, _ = canonical(text.encode("utf-8", "ignore").decode())
    assert canonical(once)[0] == once


WORDS = {
    "ｶﾞｽ": "ガス", "カﾞ": "ガ", "ﾊﾟﾀｰﾝ": "パターン", "한": "한", "한": "한", "ﾡ": "ᄀ", "ﬁlm": "film",
    "Ⅳ": "IV", "5 µm": "5 μm", "e​́": "é", "\U0002f800": "丽", "а́b": "áb", "W‍afer": "Wafer", "晶‌圆": "晶圆", "Ｅ́": "É",
}
SHAPED = ["👩\u200d🔬", "👩🏽\u200d🔬", "🏳️\u200d🌈", "می\u200cخواهم", "क्\u200dष", "5 μA", "ΔT", "ΔTx"]


def test_forms_of_other_scripts():
    for text, want in WORDS.items():
        got, n = canonical(text)
        assert got == want and n > 0, (text, got)


def test_joiners_that_shape_the_text_and_symbols_stay():
    for text in SHAPED:
        assert canonical(text) == (text, 0), text


def test_every_character_that_composed_text_lacks_is_known():
    never = {chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFC", chr(c)) != chr(c)}
    assert never == compose_no()


pieces = st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("ᄒ\u1161\u11ab하가\u0301\u0323\u200d\u200cｶﾞ\u05d0\u05bcАaΑ👩🔬می"))


@settings(max_examples=600, deadline=None)
@given(st.lists(pieces, max_size=24))
def test_texts_that_are_canonically_equal_meet(chars):
    text = "".join(chars)
    once = canonical(text)[0]
    assert canonical(once) == (once, 0) and unicodedata.is_normalized("NFC", once)
    assert {canonical(unicodedata.normalize(f, text))[0] for f in ("NFC", "NFD")} == {once}


def test_operator(spark):
    rows = [(1, "ＡＢ", 7), (1, "ＡＢ", 7), (2, None, 7), (3, "", 7), (4, "plain", 7), (5, "x" * 200_000 + "​", 7)]
    df = spark.createDataFrame(rows, "k bigint, t string, changes int")
    got = {(r.k, r.text if r.k != 5 else len(r.text), r.changes) for r in unify_text(df, "k", "t").collect()}
    assert got == {(1, "AB", 1), (2, None, 0), (3, "", 0), (4, "plain", 0), (5, 200_000, 1)}
    assert unify_text(df, "k", "t").count() == 6
    assert sorted(r.k for r in unify_text(df, "k", "t", only_changed=True).collect()) == [1, 1, 5]
    assert unify_text(df.limit(0), "k", "t").count() == 0
    padded = spark.createDataFrame([(1, "　BP1 ")], "k bigint, t string")
    assert unify_text(padded, "k", "t", strip=True).first()["text"] == "BP1"


def test_quick_check_agrees(spark):
    from pyspark.sql import functions as F

    from siftmill.llm.unify_text import quick_check

    texts = [*CHANGED, *SAME]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    passed = {r.t for r in df.where(~quick_check(F.col("t"))).collect()}
    assert not passed & set(CHANGED)

import base64

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftmill.llm.encode import PATTERN, VOCABULARY, encode, token_counts, tokenizer
from siftmill.llm.mixing import mix_sources
from siftmill.llm.pieces import LINE, PARAGRAPH, SENTENCE, RangeMax, cut_text, split_texts, strengths

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(texts):
    return [np.frombuffer(b, "<i4").tolist() for b in tokenizer().encode_many(texts)]


TEXTS = ["", "a", "hello world", "<|endoftext|>", "漢字かな交じり文", "ÄÖÜß" * 50, " \n\n  \t x", "it's we'll I'm", "🙂🙃", "x" * 5000, "EDXshowsCuoverSiO" * 200, "\u0000​"]


def test_against_a_plain_encoder(plain):
    assert ids(TEXTS) == [plain.encode_ordinary(t) for t in TEXTS]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=60), max_size=6))
def test_random_texts(plain, texts):
    assert ids(texts) == [plain.encode_ordinary(t) for t in texts]


def test_side_by_side_equals_alone():
    bpe = tokenizer()
    rng = np.random.default_rng(0)
    for size in (3, 8, 9, 33, 120):
        raw = [bytes(rng.choice(list(b"abcdehst "), size - i % 2).tolist()) for i in range(40)]
        assert bpe.merge_many(raw) == [bpe.merge_one(r) for r in raw]


def test_operator(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "hello world", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in encode(df, ["doc_id"], "text").collect())
    assert got == [(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, [])]
    assert sorted(r.n_tokens for r in token_counts(df, ["doc_id"], "text").collect()) == [0, 0, 2, 2]
    assert encode(df.limit(0), ["doc_id"], "text").count() == 0


# --- pieces ------------------------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-1, 6), min_size=1, max_size=200), st.data())
def test_range_max(values, data):
    index = RangeMax(np.array(values, np.int8), 64)
    for _ in range(10):
        low = data.draw(st.integers(0, len(values) - 1))
        high = data.draw(st.integers(low, min(len(values) - 1, low + 63)))
        best = max(values[low : high + 1])
        assert index.best(low, high) == max(i for i in range(low, high + 1) if values[i] == best)


def test_strengths():
    s = strengths("One. Two\n\nThree。四")
    assert s[4] == SENTENCE and s[10] == PARAGRAPH and s[16] == SENTENCE
    assert strengths("a\nb")[2] == LINE and strengths("3.14")[2] < SENTENCE


def check(text, limit=64, overlap=8, slack=8):
    bpe = tokenizer()
    out = cut_text(bpe, text, bpe.pieces([text])[0], limit, overlap, slack)
    whole = len(bpe.encode_many([text])[0]) // 4
    assert (len(out) > 1) == (whole > limit)
    assert out[0][0] == 0 and out[-1][1] == len(text)
    for (s, e, n), nxt in zip(out, [*out[1:], None], strict=True):
        assert n <= limit and n == len(bpe.encode_many([text[s:e]])[0]) // 4
        if nxt:
            # Whole characters back, so an overlap may lack less than one of them.
            assert s < nxt[0] < e < nxt[1] and len(bpe.encode_many([text[nxt[0] : e]])[0]) // 4 >= overlap - 4
    return out


def test_pieces():
    sentence = "The scan shows residue near the notch. "
    out = check(sentence * 60)
    assert all((sentence * 60)[:e].rstrip().endswith(".") for _, e, _ in out)
    check("漢字かな交じり" * 100)
    check("x" * 3000)
    check("abc🙂" * 400)
    check(("line one\n" * 7 + "\n") * 30)
    assert check("short") == [(0, 5, 1)]


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab 漢。.,\n🙂é\r\t"), min_size=100, max_size=900))
def test_random_pieces(text):
    check(text)


def test_pieces_beyond_the_cache(monkeypatch):
    bpe = tokenizer()
    texts = ["one two three four five six seven " * 40 + "x" * 3000 + " tail words here again", "plain other words stand here   \n " * 60]
    want = [check(t) for t in texts]
    monkeypatch.setattr("siftmill.llm.encode.CACHE_PIECES", 4)
    # Both texts belong to one step; a part of a word that is counted alone must not empty the cache between them.
    cuts = bpe.pieces(texts)
    assert [cut_text(bpe, t, c, 64, 8, 8) for t, c in zip(texts, cuts, strict=True)] == want
    # The next step starts afresh.
    bpe.pieces(["quite new"])
    assert len(bpe.cache) == 2


def test_pieces_operator(spark):
    long = "Word after word. " * 2000
    df = spark.createDataFrame([(1, long), (2, "short"), (3, None), (4, ""), (1, long)], "doc_id bigint, text string")
    got = split_texts(df, "doc_id", "text")
    assert {r.doc_id for r in got.where("piece_no = 1").collect()} == {1}
    one = got.where("doc_id = 1").orderBy("piece_no").dropDuplicates(["piece_no"]).collect()
    assert one[0].n_pieces == len(one) and all(r.n_tokens <= 2048 and long[r.start_char : r.end_char] == r.piece for r in one)
    assert got.where("doc_id in (3, 4)").count() == 0 and got.where("doc_id = 2").count() == 1
    assert split_texts(df.limit(0), "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        split_texts(df, "doc_id", "text", 100, 40, 40)


# --- mixing ------------------------------------------------------------------------------------------------------


def mixed(spark, rows, targets, total=None):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    m = mix_sources(df, t, "doc_id", "text", "source", total)
    return m.picked.collect(), {r.source: r for r in m.report.collect()}


def test_shares_and_repeats(spark):
    rows = [(i, "one two three four", "big") for i in range(400)] + [(1000 + i, "one two three four five", "small") for i in range(30)] + [(5000, None, "big"), (5001, "x y", None), (5002, "x y", "other")]
    picked, report = mixed(spark, rows, [("big", 0.6, 1), ("small", 0.3, 5), ("absent", 0.1, 2)])
    by = {s: sum(r.n_tokens * r.copies for r in picked if r.source == s) for s in ("big", "small")}
    total = sum(by.values())
    assert abs(by["big"] / total - 2 / 3) < 0.01 and abs(by["small"] / total - 1 / 3) < 0.01
    copies = [r.copies for r in picked if r.source == "small"]
    assert max(copies) <= 5 and max(copies) - min(copies) <= 1
    assert report["absent"].taken_tokens == 0 and report["other"].target_share == 0 and abs(report["big"].reached_share - by["big"] / total) < 1e-9
    assert not {r.doc_id for r in picked} & {5001, 5002}


def test_too_great_a_total(spark):
    rows = [(i, "one two", "a") for i in range(50)] + [(100 + i, "one two", "b") for i in range(50)]
    picked, report = mixed(spark, rows, [("a", 0.9, 2), ("b", 0.1, 1)], total=1000)
    assert report["a"].taken_tokens == 200 and report["a"].most_copies == 2 and report["b"].taken_tokens == 100
    assert sum(r.copies for r in picked) == 150


def test_one_huge_record_and_empty(spark):
    rows = [(1, "word " * 20_000, "a")] + [(i, "word", "b") for i in range(2, 40)]
    _, report = mixed(spark, rows, [("a", 0.5, 1), ("b", 0.5, 1)])
    assert report["b"].taken_tokens == 38
    picked, _ = mixed(spark, rows[:1], [("zzz", 1.0, 1)])
    assert picked == []
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mix_sources(df, t, "doc_id", "text", "source").picked.count() == 0


def test_counts_agree(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) if "\u0000" not in t], "k bigint, text string")
    pairs = token_counts(df, ["k"], "text").join(encode(df, ["k"], "text").select("k", F.size("ids").alias("n")), "k")
    assert pairs.where("n <> n_tokens").count() == 0

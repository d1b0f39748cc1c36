"""Queries of text search, facets and evidence, with the same said in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill import api
from siftmill.functions import tokens as K
from siftmill.functions.jsontext import clean_json
from siftmill.functions.vector import finite
from siftmill.operators import evidence as E
from siftmill.operators import facets as X
from siftmill.operators import records as R
from siftmill.operators import retrieval as S
from siftmill.plans.records import SQL_ID, quoted, sql_fold, sql_missing, sql_parsed, sql_present, sql_strip
from siftmill.plans.tables import table
from siftmill.session import materialise, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ASKED = "wafer scratch residue 划伤 残留 edge"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- tokens in SQL ------------------------------------------------------------------------------------------------

# Fixed values, written here again so that the SQL doesn't follow the library: words without meaning, and the words that
# phrases add.
_STOP = "'查询', '查找', '帮我', '请', '一下', '相关', '记录', '信息', '异常', '哪些', '所有', '有没有', '对应'"
_ADDED = (
    ("右下角", "bottom right"), ("右下", "bottom right"), ("左下角", "bottom left"), ("左下", "bottom left"), ("右上角", "top right"), ("右上", "top right"),
    ("左上角", "top left"), ("左上", "top left"), ("中心", "center"), ("中央", "center"), ("中间", "center"), ("随机分布", "random"), ("随机", "random"),
    ("残留", "residue"), ("残渣", "residue"), ("划伤", "scratch"), ("刮伤", "scratch"), ("颗粒", "particle"), ("粒子", "particle"), ("机台", "machine"),
    ("扫描机", "machine"), ("批次", "lotid"), ("批号", "lotid"),
)


def sql_sanitize(c: str) -> str:
    folded = sql_fold(f"coalesce({c}, '')")
    return f"trim(regexp_replace(regexp_replace({folded}, '[?!]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def sql_tokens(c: str, base: str, key: str, x: str = "") -> str:
    """CTEs ``tok(key, t)``: all tokens of ``base.c``; ``x`` ends the names."""
    added = " ".join(f"|| case when contains(n, '{k}') then ' {v}' else '' end" for k, v in _ADDED)
    return f"""norm{x} as (select {key} k, lower({sql_sanitize(c)}) n from {base}), ex{x} as (select k, n {added} e from norm{x}),
    runs{x} as (select k, unnest(regexp_extract_all(e, '([a-z0-9]+(?:[_.-][a-z0-9]+)*|[\\x{{4e00}}-\\x{{9fff}}]+)', 1)) r from ex{x}),
    cut{x} as (select k, unnest(case when regexp_matches(r, '^[a-z0-9]') then [r] else list_concat(string_split(r, ''), list_transform(range(1, length(r)), lambda i: substr(r, i::bigint, 2))) end) t from runs{x}),
    tok{x} as (select k, t from cut{x} where t <> '' and t not in ({_STOP}))"""


def sql_pairs(c: str, base: str, key: str) -> str:
    """CTE ``pr(k, t)``: all overlapping character pairs of ``base.c``."""
    return f"pr as (select k, unnest(list_transform(range(1, length(n)), lambda i: substr(n, i::bigint, 2))) t from (select {key} k, lower(coalesce({c}, '')) n from {base}) where length(n) > 1)"


@query(f"with {sql_tokens('text', 'documents', 'doc_id')} select t token, count(*) n, count(distinct k) df from tok group by 1")
def tokenize_counts(spark, d):
    """How often each token stands, and in how many texts: counted in each text before anything is moved."""
    cut = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.explode(K.tokens(F.col("text"))).alias("token"))
    return cut.groupBy("doc_id", "token").agg(F.count("*").alias("c")).groupBy("token").agg(F.sum("c").alias("n"), F.count("*").alias("df"))


@query(f"with {sql_pairs('text', 'documents', 'doc_id')} select t term, count(distinct k) df from pr group by 1")
def char_bigram_df(spark, d):
    return S.document_frequency(table(spark, d, "documents"), K.char_pairs(F.col("text")))


@query(f"select doc_id, {sql_sanitize('text')} clean from documents")
def sanitize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", K.sanitize(F.col("text")).alias("clean"))


def sql_bm25(base: str, key: str, text: str, asked: str) -> str:
    """CTEs up to ``bm(k, score)``."""
    return f"""{sql_tokens('s', '(select 0 id, ' + quoted(asked) + ' s)', 'id', 'q')}, qb as (select distinct t from tokq), {sql_tokens(text, base, key)},
 dl as (select {key} k, coalesce(n, 0) dl from {base} left join (select k, count(*) n from tok group by 1) c on {key} = c.k), st as (select count(*) n, avg(dl) a from dl),
 tf as (select k, t, count(*) tf from tok where t in (select t from qb) group by 1, 2), df as (select t, count(*) df from tf group by 1),
 bm as (select k, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(a, 1.0)))) score from tf join df using (t) join dl using (k), st group by 1)"""


def sql_tfidf(base: str, key: str, text: str, asked: str) -> str:
    """CTEs up to ``td(k, score)``."""
    pairs = f"(select unnest(list_transform(range(1, length({quoted(asked)})), lambda i: substr(lower({quoted(asked)}), i::bigint, 2))) t)"
    return f"""{sql_pairs(text, base, key)}, p as (select distinct k, t from pr), nd as (select count(*) n from {base}),
 idf as (select t, ln(n / (1 + count(*))) idf from p, nd group by t, n), q as (select t, count(*)::double c from {pairs} group by 1),
 qn as (select sqrt(sum(pow(c * idf, 2))) qn from idf join q using (t)), dn as (select k, sum(coalesce(c, 0) * idf * idf) d, sqrt(sum(idf * idf)) nn from p join idf using (t) left join q using (t) group by 1),
 td as (select k, d / (nn * qn) score from dn, qn where nn > 0 and qn > 0 and d / (nn * qn) > 0)"""


def sql_fused(channels: dict[str, str]) -> str:
    """CTE ``f(k, score, channels)`` of the first 50 of each channel, (k, s) each."""
    weights = {"dense": 0.45, "lexical": 0.30, "bigram": 0.15, "field": 0.10}
    union = " union all ".join(f"select '{c}' c, {weights[c]} w, k, round(s, 9) s from ({q})" for c, q in channels.items())
    return f"ch as ({union}), rk as (select *, row_number() over (partition by c order by s desc, k) r from ch), f as (select k, sum(w / (60 + r)) score, array_to_string(list(c order by c), ',') channels from rk where r <= 50 group by 1)"


@query(f"with {sql_bm25('documents', 'doc_id', 'text', ASKED)} select k doc_id, round(score, 6) score from bm where score > 0 order by score desc, k limit 50")
def bm25_topk(spark, d):
    hits = S.bm25(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", ASKED)
    return S.top(hits, "doc_id", 50).select("doc_id", F.round("score", 6).alias("score"))


@query(f"with {sql_tfidf('documents', 'doc_id', 'text', ASKED)} select k doc_id, round(score, 6) score from td order by score desc, k limit 50")
def tfidf_topk(spark, d):
    hits = S.tfidf(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", ASKED)
    return S.top(hits, "doc_id", 50).select("doc_id", F.round("score", 6).alias("score"))


@query(
    f"""with {sql_pairs('text', 'documents', 'doc_id')}, tf as (select k, t, count(*) tf from pr group by 1, 2), q as (select t, count(*)::double c from (select unnest(list_transform(range(1, length({quoted(ASKED)})), lambda i: substr({quoted(ASKED)}, i::bigint, 2))) t) group by 1),
    qn as (select sqrt(sum(c * c)) qn from q), d as (select k, sum(coalesce(c, 0) * tf) d, sqrt(sum(tf * tf)) nn from tf left join q using (t) group by 1)
    select doc_id, round(coalesce(case when nn > 0 then d / (nn * qn) end, 0), 6) score from documents left join d on doc_id = k, qn order by coalesce(d / (nn * qn), 0) desc, doc_id limit 50"""
)
def bigram_count_cosine_topk(spark, d):
    hits = S.pair_cosine(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", ASKED)
    return S.top(hits, "doc_id", 50).select("doc_id", F.round("score", 6).alias("score"))


_COS = "list_cosine_similarity(e.embedding::double[], q.embedding::double[])"


def _query_vector(spark, d):
    return table(spark, d, "embeddings").orderBy("vec_id").limit(1).first()["embedding"]


@query(f"with q as (select embedding from embeddings order by vec_id limit 1) select e.vec_id, round({_COS}, 6) score from embeddings e, q where {_COS} >= 0.2 order by {_COS} desc, e.vec_id limit 50")
def dense_topk_threshold(spark, d):
    hits = S.dense(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 0.2)
    return S.top(hits, "vec_id", 50).select("vec_id", F.round("score", 6).alias("score"))


@query(
    f"""with {sql_bm25('documents', 'doc_id', 'text', ASKED)}, {sql_tfidf('documents', 'doc_id', 'text', ASKED)}, qv as (select embedding qe from embeddings order by vec_id limit 1),
    """
    + sql_fused(
        {
            "dense": "select vec_id k, list_cosine_similarity(embedding::double[], qe::double[]) s from embeddings, qv where list_cosine_similarity(embedding::double[], qe::double[]) >= 0.2",
            "lexical": "select k, score s from bm where score > 0",
            "bigram": "select k, score s from td",
            "field": "select doc_id k, 1.0 s from documents where lot_id = 'MQ00017'",
        }
    )
    + " select k doc_id, round(score, 9) score, channels from f"
)
def rrf_fusion(spark, d):
    """All four channels over documents, those of one lot as the field channel."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lot_id")
    vec = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    channels = {
        "dense": S.dense(vec, "doc_id", "embedding", _query_vector(spark, d), 0.2),
        "lexical": S.bm25(docs, "doc_id", "text", ASKED),
        "bigram": S.tfidf(docs, "doc_id", "text", ASKED),
        "field": X.exact_or_squeezed(docs.select("doc_id", "lot_id"), {"lot_id": "MQ00017"}, "doc_id", "doc_id", 50).select("doc_id", F.lit(1.0).alias("score")),
    }
    return S.fuse_ranks(channels, "doc_id").select("doc_id", F.round("score", 9).alias("score"), F.array_join("channels", ",").alias("channels"))


#: A question that names one field (not one that answers it alone), a place and a defect; and what its phrases add to it.
QUESTION = "类型Class3 中心 划伤 scratch residue"
_WIDE = "类型class3 中心 划伤 scratch residue center scratch"
_SEM = "modality = 'sem' and len(vector) = 64 and len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0 and trim(coalesce(dn_no, '')) <> ''"


def _records(spark, d) -> DataFrame:
    merged = R.merge_points(table(spark, d, "payload_parser"), grains="grain_type")
    return merged.select(F.col("dn_no").alias("record_id"), "text_content", "class_type", "machine", "defect_type", "platform", "matched_grains")


def _record_vectors(spark, d) -> DataFrame:
    v = table(spark, d, "vectors").where((F.col("modality") == "sem") & (F.trim(F.coalesce("dn_no", F.lit(""))) != "") & finite(F.col("vector"), 64) & F.exists("vector", lambda x: x != 0))
    return v.groupBy(F.upper(F.trim("dn_no")).alias("record_id")).agg(F.min_by("vector", "vec_id").alias("vector"), F.min("vec_id").alias("vec_id"))


@query(
    f"""with pts as (select *, upper({SQL_ID}) k0 from payload_parser), rec as (select k0 rid, arg_max(text_content, (length(text_content), -ord)) filter (where {sql_present('text_content')} is not null) txt,
    arg_min(class_type, ord) filter (where {sql_present('class_type')} is not null) class_type, list(distinct grain_type) filter (where {sql_present('grain_type')} is not null) grains from pts where k0 <> '' group by 1),
    {sql_bm25('rec', 'rid', 'txt', _WIDE)}, {sql_tfidf('rec', 'rid', 'txt', _WIDE)}, rv as (select upper(trim(dn_no)) rid, arg_min(vector, vec_id) v, min(vec_id) vid from vectors where {_SEM} group by 1), q1 as (select v qv from rv order by vid limit 1),
    """
    + sql_fused(
        {
            "lexical": "select k, score s from bm where score > 0",
            "bigram": "select k, score s from td",
            "dense": "select rid k, list_cosine_similarity(v::double[], qv::double[]) s from rv, q1 where list_cosine_similarity(v::double[], qv::double[]) >= 0.5",
            "field": "select rid k, 1.0 s from rec where class_type = 'Class3'",
        }
    )
    + f""", {sql_tokens('s', '(select 0 id, ' + quoted(QUESTION) + ' s)', 'id', 'z')}, ov as (select k, count(distinct t) / (select count(distinct t) from tokz)::double o from tok where t in (select t from tokz) group by 1),
    j as (select rid, score, case when lower({sql_fold("coalesce(class_type, '')")}) = 'class3' then 1.0 when lower({sql_fold("coalesce(class_type, '')")}) <> '' and contains('class3', lower({sql_fold("coalesce(class_type, '')")})) then 0.7 else 0.0 end fs, coalesce(o, 0) o,
    coalesce(list_max(list_transform(grains, lambda g: case g when 'defect_focus' then 1.0 when 'machine_focus' then 0.9 when 'summary' then 0.8 when 'keywords' then 0.8 when 'natural_language' then 0.7 when 'full' then 0.6 else 0.5 end)), 0.0) gs
    from f join rec on f.k = rid left join ov on ov.k = rid), z as (select rid, 0.5 * score / max(score) over () + 0.35 * fs + 0.1 * o + 0.05 * gs final from j)
    select rid record_id, round(final, 6) final from z order by round(final, 9) desc, rid limit 20"""
)
def hybrid_search(spark, d):
    """The application's search: records of ``payload_parser`` by words, character pairs, vectors and fields, fused and reranked by
    fields, tokens and their points' grains."""
    corpus = materialise(_records(spark, d), "corpus")
    vectors = _record_vectors(spark, d)
    found = api.search(corpus, QUESTION, vectors, vectors.orderBy("vec_id").first()["vector"], limit=20)
    return found.rows.select("record_id", F.round("score", 6).alias("final"))


_IMPORTANCE = {"platform": 1.6, "defect_type": 1.8, "machine": 2.0}
_CONDS = {"platform": "QX040LP", "defect_type": "PitCluster_1", "machine": "VLSCA01"}


def _sq(c: str) -> str:
    return f"lower(regexp_replace({sql_fold(f'coalesce({c}, {chr(39)}{chr(39)})')}, '[\\s:=,。;()\\[\\]{{}}，；：（）]', '', 'g'))"


@query(
    "select ord, round(("
    + " + ".join(f"{_IMPORTANCE[f]} * case when {_sq(f)} = {_sq(quoted(v))} then 1.0 when {_sq(f)} <> '' and (contains({_sq(f)}, {_sq(quoted(v))}) or contains({_sq(quoted(v))}, {_sq(f)})) then 0.7 else 0.0 end" for f, v in _CONDS.items())
    + f") / {sum(_IMPORTANCE[f] for f in _CONDS)}, 6) field_score from payload_parser"
)
def field_scores(spark, d):
    return table(spark, d, "payload_parser").select("ord", F.round(S.field_score(_CONDS), 6).alias("field_score"))


@query(
    """with h as (select ord, class_type, coalesce(bad_wafers, 0)::double score from payload_parser order by coalesce(bad_wafers, 0) desc, ord limit 500)
    select ord, score from h where class_type in ('Class3', 'Class4') order by score desc, ord limit 10 offset 20"""
)
def paginate_postfilter(spark, d):
    hits = table(spark, d, "payload_parser").select("ord", "class_type", F.coalesce("bad_wafers", F.lit(0)).cast("double").alias("score"))
    return S.page_after(hits, "ord", F.col("class_type").isin("Class3", "Class4"), 20, 10).select("ord", "score")


# --- filters and facets -------------------------------------------------------------------------------------------


@query("select ord, dn_no from payload_parser where platform = 'QX040LP' and class_type = 'Class3' order by ord limit 100")
def exact_filter_conj(spark, d):
    return table(spark, d, "payload_parser").where(X.exactly({"platform": "QX040LP", "class_type": "Class3"})).orderBy("ord").limit(100).select("ord", "dn_no")


@query("select ord from payload_parser where lower(trim(coalesce(platform, ''))) in ('qx040lp', 'tr055bc') and lower(trim(coalesce(map_location, ''))) in ('edge', 'center')")
def facet_filter_or_and(spark, d):
    return table(spark, d, "payload_parser").where(X.any_of_each({"platform": ["qx040lp", "TR055BC "], "map_location": ["Edge", "CENTER"], "lot_id": []})).select("ord")


@query("select ord from payload_parser where lower(trim(machine)) = 'vlsca01' and lower(trim(platform)) = 'qx040lp'")
def facet_filter_casefold(spark, d):
    return table(spark, d, "payload_parser").where(X.equal_any_case({"machine": " vlsca01", "platform": "qx040LP"})).select("ord")


def _squeeze_sql(c: str) -> str:
    return f"lower(regexp_replace({sql_fold(f'coalesce({c}, {chr(39)}{chr(39)})')}, {quoted(X.IGNORED)}, '', 'g'))"


@query(f"select min(import_id) import_id, 'normalized' match_mode from ppt_import where {_squeeze_sql('lot_id')} = 'mq00017' and not exists (select 1 from ppt_import where lot_id = 'mq00017') group by record_id order by 1 limit 50")
def normalized_match_fallback(spark, d):
    rows = table(spark, d, "ppt_import").select("import_id", "record_id", "lot_id")
    return X.exact_or_squeezed(rows, {"lot_id": "mq00017"}, "record_id", "import_id", 50).select("import_id", "match_mode")


def _long_sql(tbl: str, fields, extra: str = "") -> str:
    return " union all ".join(f"select '{f}' field, {f}::varchar \"value\"{extra} from {tbl}" for f in fields)


@query(f"select field, \"value\", count(*) n from ({_long_sql('payload_parser', X.FILTER_FIELDS)}) where not {sql_missing(chr(34) + 'value' + chr(34))} group by 1, 2")
def facet_value_counts(spark, d):
    return X.facet_counts(table(spark, d, "payload_parser"), X.FILTER_FIELDS)


@query(f"select distinct field, \"value\" from ({_long_sql('ppt_import', X.FILTER_FIELDS)}) where not {sql_missing(chr(34) + 'value' + chr(34))}")
def facet_values(spark, d):
    return X.facet_values(table(spark, d, "ppt_import"), X.FILTER_FIELDS)


@query("select distinct machine \"value\" from payload_parser where contains(lower(machine), 'vlscb') order by 1 limit 50")
def facet_options(spark, d):
    return X.facet_options(table(spark, d, "payload_parser"), "machine", "VLSCB")


@query("select v.t typed, min(machine) \"value\" from payload_parser, (values ('vlsca01'), (' VLSCB02')) v(t) where lower(trim(machine)) = lower(trim(v.t)) group by 1")
def typed_values(spark, d):
    return X.canonical_value(table(spark, d, "payload_parser"), "machine", ["vlsca01", " VLSCB02", "nothing"])


@query(
    f"""with c as (select field, "value", count(*) n, min(ord) f from ({_long_sql('payload_parser', X.CHART_FIELDS, ', ord')}) where not {sql_missing(chr(34) + 'value' + chr(34))} group by 1, 2),
    r as (select field, "value", n, (row_number() over (partition by field order by n desc, f))::int place from c) select * from r where place <= 8"""
)
def top8_charts(spark, d):
    return X.top_values(table(spark, d, "payload_parser"), X.CHART_FIELDS, "ord", 8)


_RANKED = "select *, row_number() over (order by coalesce(bad_wafers, 0) desc, ord) rnk, coalesce(bad_wafers, 0) / 25.0 sim from payload_parser"


@query(
    f"""with r as (select * from ({_RANKED}) where rnk <= 20), c as (select field, "value", round(sum(greatest(sim, 0)), 9) w, count(*) n from ({_long_sql('r', X.ANALYSIS_FIELDS, ', sim')}) where not {sql_missing(chr(34) + 'value' + chr(34))} and "value" <> '0' group by 1, 2)
    select field, arg_max("value", (w, n, "value")) dominant_value from c group by 1"""
)
def dominant_value_weighted(spark, d):
    rows = table(spark, d, "payload_parser").withColumn("score", (F.coalesce("bad_wafers", F.lit(0)) / 25.0))
    first = S.ranked(S.top(rows, "ord", 20), "ord")
    return X.dominant_by_weight(first, X.ANALYSIS_FIELDS, "score", "rank")


@query(
    f"""with c as (select field, "value", count(*) n from ({_long_sql('payload_parser', X.ANALYSIS_FIELDS)}) where not {sql_missing(chr(34) + 'value' + chr(34))} group by 1, 2)
    select field, arg_min("value", (-n, "value")) dominant_value from c group by 1"""
)
def dominant_value_count(spark, d):
    return X.dominant_by_count(table(spark, d, "payload_parser"), X.ANALYSIS_FIELDS)


@query(
    """with src as (select platform, defect_type from ppt_import where import_id = 1), s as (select import_id, case when p.platform = src.platform and p.defect_type = src.defect_type then 1.0
    when starts_with(p.platform, left(src.platform, greatest(length(src.platform) - 2, 0))) then 0.8 end::double score from ppt_import p, src where import_id <> 1) select import_id, score from s where score is not null"""
)
def similar_records(spark, d):
    rows = table(spark, d, "ppt_import").select("import_id", "platform", "machine", "defect_type")
    return X.similar_records(rows, "import_id", 1)


@query(
    """select source_file from ppt_import where contains(lower(concat_ws(' ', coalesce(dn_no, ''), coalesce(machine, ''), coalesce(defect_type, ''))), 'pitcluster_1') group by 1
    union select distinct source_file from ppt_import where contains(lower(source_file), '_000012')"""
)
def library_keyword_semijoin(spark, d):
    rows = table(spark, d, "ppt_import").select("source_file", "dn_no", "machine", "defect_type")
    hit = rows.where(X.contains_keyword(["dn_no", "machine", "defect_type"], "PitCluster_1")).select("source_file").distinct()
    files = rows.select("source_file").distinct()
    named = files.where(F.lower("source_file").contains("_000012"))
    return files.join(hit, "source_file", "left_semi").union(named).distinct()


@query(
    "with l as ("
    + " union all ".join(f"select import_id, '{f}' field, {f}::varchar v from ppt_import where import_id in (1, 2, 3)" for f in ("dn_no", "platform", "machine", "edx_elements", "total_wafers"))
    + f") select field, {', '.join(f'coalesce(min(case when import_id = {i} then {sql_present(chr(118))} end), {quoted(chr(8212))}) r{i}' for i in (1, 2, 3))} from l group by 1"
)
def compare_records(spark, d):
    return X.compare_table(table(spark, d, "ppt_import"), "import_id", [1, 2, 3], ["dn_no", "platform", "machine", "edx_elements", "total_wafers"])


@query(f"select lower(trim(lot_id)) folded, arg_min(trim(lot_id), ord) lot_id from payload_parser where not {sql_missing('lot_id')} group by 1")
def first_spellings(spark, d):
    return X.first_spelling(table(spark, d, "payload_parser").select("ord", "lot_id"), "lot_id", "ord")


@query(
    f"""with l as ({_long_sql('ppt_import', X.FILTER_FIELDS, ', source_file, import_id')}), t as (select source_file, import_id, field, {sql_strip(chr(34) + 'value' + chr(34))} v from l where not {sql_missing(chr(34) + 'value' + chr(34))}), o as (select source_file, field, lower(v) k, min((import_id, v)) f from t where v <> '0' group by 1, 2, 3)
    select source_file, field, string_agg(f[2], '|' order by f) "values" from o group by 1, 2"""
)
def upload_candidates(spark, d):
    """Filters that the records of each uploaded file offer."""
    out = X.candidates(table(spark, d, "ppt_import"), "source_file", "import_id")
    return out.select("source_file", "field", F.array_join("values", "|").alias("values"))


@query("select c_nationkey, array_to_string(list(distinct c_mktsegment order by c_mktsegment), ',') merged from customer group by 1")
def filter_union(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.collect_set(F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))).alias("a"), F.collect_set(F.when(F.col("c_custkey") % 2 == 1, F.col("c_mktsegment"))).alias("b"))
    m = X.union_filters(F.create_map(F.lit("segment"), F.col("a")), F.create_map(F.lit("segment"), F.col("b")))
    return c.select("c_nationkey", F.array_join(F.array_sort(m["segment"]), ",").alias("merged"))


# --- evidence -----------------------------------------------------------------------------------------------------

_HITS = """select 'text' source, 0 source_ord, ord::bigint row_ord, dn_no record_id, coalesce(bad_wafers, 0)::double score, machine, defect_type from payload_parser
 union all select 'image', 1, import_id::bigint, dn_no, coalesce(bad_wafers, 0)::double, machine, defect_type from ppt_import"""


@query(
    f"""with h as ({_HITS}) select record_id, max(score) score, array_to_string(list(distinct source order by source desc), ',') sources, arg_min(machine, (source_ord, row_ord)) filter (where not {sql_missing('machine')}) machine,
    arg_min(defect_type, (source_ord, row_ord)) filter (where not {sql_missing('defect_type')}) defect_type from h where not {sql_missing('record_id')} group by 1 order by min((source_ord, row_ord)), 1 limit 20"""
)
def evidence_union_merge(spark, d):
    p = table(spark, d, "payload_parser").select(F.lit("text").alias("source"), F.lit(0).alias("source_ord"), F.col("ord").alias("row_ord"), F.col("dn_no").alias("record_id"), F.coalesce("bad_wafers", F.lit(0)).cast("double").alias("score"), "machine", "defect_type")
    i = table(spark, d, "ppt_import").select(F.lit("image").alias("source"), F.lit(1).alias("source_ord"), F.col("import_id").alias("row_ord"), F.col("dn_no").alias("record_id"), F.coalesce("bad_wafers", F.lit(0)).cast("double").alias("score"), "machine", "defect_type")
    m = E.merge_evidence(p.unionByName(i), ["machine", "defect_type"])
    return m.select("record_id", "score", F.array_join("sources", ",").alias("sources"), "machine", "defect_type")


@query(
    "select ord, "
    + ", ".join((f"{sql_present(f)} {f}" if f not in ("total_wafers", "bad_wafers") else f) for f in E.SHOWN)
    + ", substr(coalesce(text_content, ''), 1, 180) description from payload_parser order by ord limit 20"
)
def compact_projection(spark, d):
    return E.compact(table(spark, d, "payload_parser"), ["ord"])


@query(
    f"""with f as (select ord, concat_ws(' ', {', '.join(sql_present(c) for c in ('defect_type', 'platform', 'machine', 'map_location'))}) t from payload_parser order by ord limit 10)
    select substr('edge residue ' || 'report ' || string_agg(t, ' ' order by ord), 1, 2000) as "text" from f"""
)
def knowledge_query(spark, d):
    return E.knowledge_query(table(spark, d, "payload_parser"), "edge residue", "report", "ord", ["defect_type", "platform", "machine", "map_location"])


@query("select event_id, props clean from events")
def json_clean_extract(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("<think>{no}</think>```json\n"), "props", F.lit("\n```")))
    raw = raw.when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here it is: "), "props", F.lit(" as asked."))).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", clean_json(raw).alias("clean"))


@query("select doc_id, array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s，,。]+'), lambda w: w <> ''), '|') words from documents")
def keyword_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(K.keywords(F.col("text")), "|").alias("words"))


@query(
    """with b as (select import_id, coalesce(bad_wafers, 0) / 25.0 score from ppt_import order by score desc, import_id limit 200), l as (select import_id, scanned_wafers / 25.0 s from ppt_import where map_location = 'Edge')
    select import_id, round(coalesce(l.s, b.score), 6) score, l.s is not null has_regions, (row_number() over (order by coalesce(l.s, b.score) desc, import_id))::int as "rank" from b left join l using (import_id)"""
)
def baseline_with_regions(spark, d):
    p = table(spark, d, "ppt_import")
    base = S.top(p.select("import_id", (F.coalesce("bad_wafers", F.lit(0)) / 25.0).alias("score")), "import_id", 200)
    local = p.where("map_location = 'Edge'").select("import_id", (F.col("scanned_wafers") / 25.0).alias("final"))
    return S.ranked(S.replace_scores(base, local, "import_id"), "import_id").select("import_id", F.round("score", 6).alias("score"), "has_regions", "rank")


@query(
    "select import_id, coalesce(scanned_wafers, 0)::double metric, (row_number() over (order by coalesce(scanned_wafers, 0) desc, import_id))::int place from (select * from ppt_import order by coalesce(bad_wafers, 0) desc, import_id limit 100)"
)
def metric_rerank(spark, d):
    """A result list (the hundred records with most bad wafers) in the order of another measure."""
    hits = table(spark, d, "ppt_import").select("import_id", "scanned_wafers", F.coalesce("bad_wafers", F.lit(0)).cast("double").alias("score"))
    return S.by_metric(S.top(hits, "import_id", 100), "scanned_wafers", "import_id").select("import_id", "metric", "place")


# Questions as the SQL reads them: cut at the names of a field, the value is read where a part begins or ends.
_CODE = "[A-Za-z0-9][A-Za-z0-9_.-]*"
_LEADING = {
    "class_type": ("Class|类别|类型", r"Class\d+"), "lot_id": (r"Lot\s*ID|批次号|批次编号", "[A-Za-z0-9_.-]+"), "product_id": ("ProductID|产品编号|产品ID|产品", "[A-Za-z0-9_.-]+"), "platform": ("工艺平台|平台|Tech", "[A-Za-z0-9]+"),
    "station": ("工艺站点|站点|Station", "[A-Za-z0-9_]+"), "machine": ("扫描机器|机器|Machine", "[A-Za-z0-9]+"), "defect_type": ("缺陷类型|Defect|缺陷代码", "[A-Za-z0-9_]+"), "map_location": ("Map位置|Map分布", r"[A-Za-z\s]+"),
}
_OTHER = {"dn_no": "dn编号|dn号|dn", "lot_id": r"lotid|lot\s*id|lot|批次号|批次", "platform": "工艺平台|平台|tech", "station": "工艺站点|站点|station", "machine": "扫描机器|机器|机台|machine", "defect_type": "缺陷类型|缺陷|defect"}
_TRAILING = {"platform": "工艺平台|平台", "machine": "扫描机器|机器|机台", "defect_type": "缺陷类型|缺陷", "lot_id": "LotID|批次"}


def _asked_sql(f: str) -> str:
    parts = lambda cut: f"regexp_split_to_array(ft, '(?i)(?:{cut})')"
    first = lambda of, value: f"list_filter(list_transform({of}, lambda x: {value}), lambda x: x <> '')[1]"
    ways = ["nullif(regexp_extract(ft, '(?i)(?:^|[^\\p{L}\\p{N}_])(DN-[A-Za-z0-9-]+)(?:$|[^\\p{L}\\p{N}_-])', 1), '')"] if f == "dn_no" else []
    if f in _LEADING:
        cut, value = _LEADING[f]
        ways.append(first(f"{parts(cut)}[2:]", f"regexp_extract(x, '(?i)^\\s*[:{'=' if f == 'product_id' else ''}为是]?\\s*({value})', 1)"))
    if f in _OTHER:
        ways.append(first(f"{parts(_OTHER[f])}[2:]", f"case when regexp_matches(x, '^[A-Za-z]') then '' else regexp_extract(x, '^\\s*(?:为|是|叫|等于|=|:)?\\s*({_CODE})', 1) end"))
    if f in _TRAILING:
        ways.append(first(f"{parts(_TRAILING[f])}[1:-2]", f"regexp_extract(x, '({_CODE})\\s*$', 1)"))
    if f in ("defect_type", "platform"):
        ways.append(first(f"{parts('哪些')}[2:]", f"regexp_extract(x, '^\\s*({_CODE})\\s*发生在\\s*({_CODE})', {1 if f == 'defect_type' else 2})"))
    ways.append(sql_parsed(f))
    return "coalesce(" + ", ".join(f"nullif(trim({w}, ' ,。;:.' || chr(9) || chr(10) || chr(13)), '')" for w in ways) + ")"


_NAMED = ("class_type", "defect_type", "dn_no", "lot_id", "machine", "map_location", "platform", "product_id", "station")


@query(
    f"with f as (select ord, coalesce(text_content, '') q, {sql_strip(sql_fold("coalesce(text_content, '')"))} ft from payload_parser), c as (select ord, q, "
    + ", ".join(f"{_asked_sql(f)} as {f}" for f in _NAMED)
    + " from f) select ord, concat_ws(';', "
    + ", ".join(f"'{f}=' || {f}" for f in _NAMED)
    + """) conditions, case when coalesce(dn_no, lot_id, machine, platform, station, map_location) is not null or (defect_type is not null and (contains(q, '缺陷类型') or regexp_matches(defect_type, '^[A-Za-z][A-Za-z0-9.-]*_\\d+$')))
    or len(list_filter(["""
    + ", ".join(_NAMED)
    + "], lambda x: x is not null)) >= 2 then 'exact' else 'hybrid' end mode from c"
)
def routed_questions(spark, d):
    """Conditions and route of each note taken as a question."""
    told = S.route(table(spark, d, "payload_parser"), "ord", "text_content")
    pairs = F.transform(F.array_sort(F.map_entries("conditions")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return told.select("ord", F.array_join(pairs, ";").alias("conditions"), "mode")

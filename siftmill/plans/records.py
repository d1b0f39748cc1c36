"""Queries over records, with the same said in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftmill.functions import ids
from siftmill.functions.paths import EXTENSIONS, extension, file_name, image_role, resolve, role_order, safe_name
from siftmill.functions.text import INVISIBLE, OUTER_BLANKS, code_table, fold_code, present, strip
from siftmill.operators import evidence as E
from siftmill.operators import records as R
from siftmill.operators import tables as T
from siftmill.plans.tables import table
from siftmill.session import spread, table_path
from siftmill.sources.files import read_jsonl, read_texts
from siftmill.sources.labels import read_labels
from siftmill.sources.uploads import accept, sniff

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- SQL fragments -----------------------------------------------------------------------------------------------


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_fold(c: str) -> str:
    source, target = code_table()
    return f"translate({c}, {quoted(source + INVISIBLE)}, {quoted(target)})"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, {quoted(OUTER_BLANKS)}, '', 'g')"


def sql_missing(c: str) -> str:
    return f"(lower({sql_strip(f"coalesce({c}, '')")}) in ('', 'unknown', 'unknown_dn', '未知', 'nan', '—'))"


def sql_present(c: str) -> str:
    return f"(case when not {sql_missing(c)} then {c} end)"


def sql_given(c: str) -> str:
    return f"nullif({c}, 0)" if c.endswith("_wafers") else sql_present(c)


# Labels and values as the SQL knows them: texts are cut at the labels, and the value is read where a part begins.
_CODE, _PHRASE = "[A-Za-z0-9][A-Za-z0-9_.-]*", "[^,。;]+"
_TOLD = {
    "class_type": [("类型|类别", r"Class\s*\d+")],
    "lot_id": [(r"Lot\s*ID\s*(?:\([^)]*\))?", _CODE), ("批次编号|批次号|批号", _CODE)],
    "product_id": [("产品编号|产品ID|产品", _CODE)],
    "machine": [("扫描机器|扫描机|机器|机台", _CODE)],
    "total_wafers": [("Wafer总数", r"\d+")],
    "scanned_wafers": [("扫描过的Wafer数量", r"\d+")],
    "bad_wafers": [("坏的Wafer数量", r"\d+")],
    "defect_type": [("缺陷类型", _CODE)],
    "edx_elements": [("EDX检测到的元素", _PHRASE)],
    "edx_bg": [("EDX背景", _PHRASE)],
    "map_location": [("Map(?:上面)?分布的位置", _PHRASE)],
    "dft_location": [("DFT(?:上面)?分布的位置", _PHRASE)],
}


def sql_parsed(field: str, folded: str = "ft") -> str:
    first = lambda cut, part, value: f"list_filter(list_transform(regexp_split_to_array({folded}, '(?i)(?:{cut})'){part}, lambda x: regexp_extract(x, '(?i){value}', 1)), lambda x: x <> '')[1]"
    if field == "dn_no":
        # Cut where numbers begin: the part before must end in the label.
        parts = f"regexp_split_to_array({folded}, '(?i)DN-')"
        number = f"case when regexp_matches({parts}[i - 1], '(?i)DN\\s*(?:编号|号)?\\s*(?:为|是|:)?\\s*$') then nullif(regexp_extract({parts}[i], '^[A-Za-z0-9-]+'), '') end"
        return f"'DN-' || list_filter(list_transform(range(2, len({parts}) + 1), lambda i: {number}), lambda x: x is not null)[1]"
    if field == "platform":
        return first("平台", "[1:-2]", rf"({_CODE})\s*$")
    if field == "station":
        return first("平台", "[2:]", rf"^(?:的|下)?\s*({_CODE})\s*站点")
    if field == "scan_time":
        return first("于", "[2:]", r"^\s*(\d{4}[/-]\d{1,2}[/-]\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2})\s*完成(?:了)?扫描")
    found = "coalesce(" + ", ".join(first(cut, "[2:]", rf"^\s*(?:为|是|:)?\s*({value})") for cut, value in _TOLD[field]) + ", null)"
    return f"try_cast({found} as int)" if field.endswith("_wafers") else f"nullif(trim({found}, ' ,。;:()' || chr(9) || chr(10) || chr(13)), '')"


FOLDED = f"select *, {sql_fold(chr(34) + 'text_content' + chr(34))} ft from payload_parser"


@query("select 'documents' tbl, count(*) n from documents union all select 'embeddings', count(*) from embeddings union all select 'labels_example', count(*) from labels_example union all select 'payload_parser', count(*) from payload_parser union all select 'ppt_import', count(*) from ppt_import union all select 'vectors', count(*) from vectors")
def scan_count_probe(spark, d):
    out = None
    for name in ("documents", "embeddings", "labels_example", "payload_parser", "ppt_import", "vectors"):
        one = table(spark, d, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"select ord, {', '.join(sql_parsed(f) + ' as ' + f for f in R.FIELDS)} from ({FOLDED})")
def parse_fields_roundtrip(spark, d):
    return R.parse_records(spread(table(spark, d, "payload_parser").select("ord", "text_content")), "text_content").select("ord", *R.FIELDS)


_KEYS = "select * exclude (text_content, class_type), case when ord % 2 = 0 then class_type end class_type, case when ord % 3 = 0 then '未知' else text_content end text_content, case when ord % 3 = 0 then text_content when ord % 3 = 1 then 'DN编号:DN-20200101-01' end description from payload_parser"


@query(
    f"with k as ({_KEYS}), t as (select *, {sql_strip(f"coalesce({sql_present('text_content')}, {sql_present('description')})")} tx from k), p as (select *, {sql_fold('tx')} ft from t) select ord, coalesce({sql_given('dn_no')}, {sql_parsed('dn_no')}, {sql_present('record_id')}) record_id, tx text_content, "
    + ", ".join(f"coalesce({sql_given(f)}, {sql_parsed(f)}) as {f}" for f in R.FIELDS)
    + " from p"
)
def canonical_coalesce(spark, d):
    """Points repaired; of each three the text of one stands under another key, of each two one lacks its class."""
    rows = table(spark, d, "payload_parser").select("ord", "record_id", "text_content", *R.FIELDS)
    text, third = F.col("text_content"), F.col("ord") % 3
    rows = rows.withColumn("description", F.when(third == 0, text).when(third == 1, F.lit("DN编号:DN-20200101-01"))).withColumn("text_content", F.when(third == 0, F.lit("未知")).otherwise(text))
    rows = rows.withColumn("class_type", F.when(F.col("ord") % 2 == 0, F.col("class_type")))
    return R.canonicalise(spread(rows)).select("ord", "record_id", "text_content", *R.FIELDS)


_SAID = {
    "dn_no": "DN编号", "class_type": "类型", "lot_id": "LotID", "product_id": "产品", "platform": "平台", "station": "站点", "machine": "机器", "scan_time": "扫描时间", "total_wafers": "Wafer总数",
    "scanned_wafers": "已扫描Wafer", "bad_wafers": "坏Wafer", "defect_type": "缺陷类型", "edx_elements": "EDX元素", "edx_bg": "EDX背景", "map_location": "Map位置", "dft_location": "DFT位置",
}


@query(
    "with p as (select *, concat_ws('；', "
    + ", ".join(f"case when {sql_given(f)} is not null then {quoted(label + '为')} || {sql_strip(f + '::varchar')} end" for f, label in _SAID.items())
    + f") told from payload_parser) select ord, case when ord % 2 = 0 then {sql_present('text_content')} end own, coalesce(own, case when told <> '' then told || '。' else '原始记录未保存描述文本。' end) description from p"
)
def describe_record(spark, d):
    """Records told in words; every other one has no text of its own."""
    own = F.when(F.col("ord") % 2 == 0, present(F.col("text_content")))
    return R.describe(table(spark, d, "payload_parser").withColumn("text_content", own)).select("ord", F.col("text_content").alias("own"), "description")


SQL_ID = sql_strip(f"coalesce({sql_present('dn_no')}, {sql_present('record_id')}, {sql_present('point_id')}, '')")


@query(f"select ord, {SQL_ID} record_key from payload_parser")
def canonical_record_id(spark, d):
    return table(spark, d, "payload_parser").select("ord", R.record_id(F.col("dn_no"), F.col("record_id"), F.col("point_id")).alias("record_key"))


def _sql_told(fields) -> str:
    return "concat_ws('；', " + ", ".join(f"case when {sql_given(f)} is not null then {quoted(f + '=')} || {sql_strip(f + '::varchar')} end" for f in fields) + ")"


@query(
    f"""with p as (select ord, dn_no, list_filter([{_sql_told(R.FIELDS)}, {_sql_told(R.DEFECT_FIELDS)}, coalesce({sql_strip(sql_present('text_content'))}, '')], lambda x: x <> '') c from payload_parser),
    q as (select ord, dn_no, list_filter(c, lambda x, i: list_position(list_transform(c, lambda y: lower(y)), lower(x)) = i) c from p)
    select ord, len(case when len(c) > 0 then c else [coalesce(dn_no, '')] end)::int n_chunks, array_to_string(case when len(c) > 0 then c else [coalesce(dn_no, '')] end, '|') chunks from q"""
)
def text_chunks(spark, d):
    rows = table(spark, d, "payload_parser").withColumn("c", R.text_chunks(table(spark, d, "payload_parser")))
    return rows.select("ord", F.size("c").alias("n_chunks"), F.array_join("c", "|").alias("chunks"))


@query(
    f"""with p as (select *, upper({SQL_ID}) k from payload_parser) select k dn_no, {', '.join(f"arg_min({f}, ord) filter (where {sql_given(f)} is not null) as {f}" for f in R.FIELDS if f != 'dn_no')},
    arg_max(text_content, (length(text_content), -ord)) filter (where {sql_present('text_content')} is not null) text_content, count(*) n_points from p where k <> '' group by k"""
)
def merge_first_nonmissing_longest(spark, d):
    return R.merge_points(table(spark, d, "payload_parser"))


@query(
    f"""with p as (select *, upper({SQL_ID}) k from payload_parser where platform = 'QX040LP' and class_type = 'Class3') select k dn_no, {', '.join(f"arg_min({f}, ord) filter (where {sql_given(f)} is not null) as {f}" for f in ('lot_id', 'machine', 'defect_type'))},
    count(*) n_points, 1.0::double score from p where k <> '' group by k"""
)
def exact_hits_merge(spark, d):
    hits = table(spark, d, "payload_parser").where("platform = 'QX040LP' and class_type = 'Class3'")
    return R.merge_points(hits).select("dn_no", "lot_id", "machine", "defect_type", "n_points", F.lit(1.0).alias("score"))


@query("select md5(text) k, min(doc_id) doc_id from documents where text is not null group by 1")
def dedupe_first(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(F.col("text").cast("binary")).alias("k"))
    return R.first_rows(rows, ["k"], [F.col("doc_id")]).select("k", "doc_id")


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r = 1")
def dedupe_last(spark, d):
    return R.first_rows(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type", "value")


@query("select user_id, event_id, value from (select *, row_number() over (partition by user_id order by coalesce(value, 1.0) desc, event_id) r from events) where r = 1")
def dedupe_best(spark, d):
    return R.best_rows(table(spark, d, "events"), ["user_id"], "value", "event_id").select("user_id", "event_id", "value")


@query(
    f"""with p as (select upper({sql_strip('dn_no')}) k, ord, grain_type, coalesce(bad_wafers, 0)::double score from payload_parser where not {sql_missing('dn_no')})
    select k, max(score) score, arg_max(ord, (score, -ord)) as ord, array_to_string(coalesce(list(grain_type order by ord) filter (where not {sql_missing('grain_type')}), []), ',') grains from p group by k"""
)
def grain_merge_max(spark, d):
    rows = table(spark, d, "payload_parser").where(present(F.col("dn_no")).isNotNull())
    rows = rows.select(F.upper(strip(F.col("dn_no"))).alias("k"), "ord", "grain_type", F.coalesce("bad_wafers", F.lit(0)).cast("double").alias("score"))
    return R.merge_grains(rows, "k", "score", "grain_type", "ord").select("k", "score", "ord", F.array_join("matched_grains", ",").alias("grains"))


@query(
    """with n as (select c_custkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('record:' || upper(trim(c_name)))) h from customer)
    select c_custkey, substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||substr('89ab', (position(substr(h,17,1) in '0123456789abcdef')-1)%4+1, 1)||substr(h,18,3)||'-'||substr(h,21,12) uid from n"""
)
def uuid5_ids(spark, d):
    name = F.concat(F.lit("record:"), ids.normalize_dn(F.col("c_name")))
    return table(spark, d, "customer").select("c_custkey", ids.uuid5(name).alias("uid"))


@query(
    """select c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}') content_hash from customer"""
)
def content_hash(spark, d):
    return R.hashed(table(spark, d, "customer"), ["c_name", "c_custkey", "c_mktsegment"]).select("c_custkey", "content_hash")


_IMG = f"select upper({sql_strip('dn_no')}) dn_no, i.image_type, i.file_name from (select dn_no, unnest(images) i from ppt_import) where {sql_strip("coalesce(dn_no, '')")} <> ''"


@query(f"select dn_no, count(distinct (image_type, file_name)) image_count, min('images/' || dn_no || '/' || file_name) first_key from ({_IMG}) group by 1")
def image_manifest(spark, d):
    images = table(spark, d, "ppt_import").select("dn_no", F.explode("images").alias("i")).select("dn_no", "i.image_type", "i.file_name")
    m = R.image_manifest(images)
    return m.select("dn_no", "image_count", F.array_min(F.transform("images", lambda i: i["storage_key"])).alias("first_key"))


@query(
    f"""with r as (select distinct upper({sql_strip('dn_no')}) k from payload_parser where not {sql_missing('dn_no')}), i as (select distinct upper({sql_strip('dn_no')}) k from vectors where not {sql_missing('dn_no')})
    select 'missing_images' side, k from r where k not in (select k from i) union all select 'orphan_images', k from i where k not in (select k from r)"""
)
def missing_and_orphans(spark, d):
    key = F.upper(strip(F.col("dn_no"))).alias("k")
    r = table(spark, d, "payload_parser").where(present(F.col("dn_no")).isNotNull()).select(key)
    i = table(spark, d, "vectors").where(present(F.col("dn_no")).isNotNull()).select(key)
    a = R.only_in(r, i, "k").select(F.lit("missing_images").alias("side"), "k")
    return a.unionByName(R.only_in(i, r, "k").select(F.lit("orphan_images").alias("side"), "k"))


@query(
    f"""with r as (select distinct upper({SQL_ID}) dn_no from payload_parser where {SQL_ID} <> ''), i as (select dn_no, count(*) c from ({_IMG}) group by 1), b as (select r.dn_no r, i.dn_no i, c from r full join i using (dn_no))
    select 'dn_count' measure, count(r) n from b union all select 'image_count', coalesce(sum(c), 0)::bigint from b union all select 'missing_images', count(*) filter (where i is null) from b union all select 'orphan_image_dns', count(*) filter (where r is null) from b"""
)
def sync_report(spark, d):
    images = table(spark, d, "ppt_import").select("dn_no", F.explode("images").alias("i")).select(ids.normalize_dn(F.col("dn_no")).alias("dn_no"), "i.file_name").where("dn_no <> ''")
    return R.sync_report(R.merge_points(table(spark, d, "payload_parser")).select("dn_no"), images)


@query("select distinct sha256(text) k from documents where text is not null and sha256(text) not in (select sha256(text) from documents where text is not null and source = 'slide_import')")
def cache_miss_antijoin(spark, d):
    hashed = table(spark, d, "documents").where("text is not null").select("source", F.sha2(F.col("text").cast("binary"), 256).alias("k"))
    return R.only_in(hashed, hashed.where("source = 'slide_import'"), "k")


@query(
    f"""with r as (select upper({SQL_ID}) dn_no, count(*) n_points from payload_parser where {SQL_ID} <> '' group by 1), m as (select dn_no, count(distinct (image_type, file_name)) c from ({_IMG}) group by 1),
    v as (select upper({sql_strip('dn_no')}) dn_no, count(*) filter (where modality = 'binmap') b, count(*) filter (where modality = 'sem') s from vectors group by 1)
    select dn_no, n_points, coalesce(c, 0) image_count, coalesce(b, 0) binmap_vectors, coalesce(s, 0) sem_vectors from r left join m using (dn_no) left join v using (dn_no)"""
)
def entity_assembly(spark, d):
    images = table(spark, d, "ppt_import").select("dn_no", F.explode("images").alias("i")).select("dn_no", "i.image_type", "i.file_name")
    vectors = table(spark, d, "vectors").select(F.upper(strip(F.col("dn_no"))).alias("dn_no"), "modality")
    out = R.assemble(R.merge_points(table(spark, d, "payload_parser")).select("dn_no", "n_points"), R.image_manifest(images), vectors)
    return out.select("dn_no", "n_points", "image_count", "binmap_vectors", "sem_vectors")


@query(
    """with n as (select user_id, event_id, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events where event_type = (select min(event_type) from events)) where r = 1),
    o as (select user_id, min(event_id) event_id from events group by 1) select user_id, event_id, value from n union all
    select o.user_id, o.event_id, e.value from o join events e using (event_id) where o.user_id not in (select user_id from n)"""
)
def latest_upsert(spark, d):
    e = table(spark, d, "events")
    kind = e.agg(F.min("event_type").alias("event_type"))
    new = R.first_rows(e.join(F.broadcast(kind), "event_type", "left_semi"), ["user_id"], [F.desc("ts"), F.desc("event_id")])  # one row
    old = R.first_rows(e, ["user_id"], [F.col("event_id")])
    cols = ["user_id", "event_id", "value"]
    return R.upsert(old.select(*cols), new.select(*cols), ["user_id"])


@query(
    """with f as (select doc_id, source || '/' || lpad(doc_id::varchar, 9, '0') file_name, sha256(text) h from documents where text is not null and source is not null),
    led as (select distinct h from f where file_name like 'legacy_csv/%') select min(file_name) file_name, h sha256 from f where h not in (select h from led) group by h"""
)
def hash_idempotent_import(spark, d):
    f = table(spark, d, "documents").where("text is not null and source is not null")
    f = f.select(F.concat_ws("/", "source", F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("file_name"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return R.new_imports(f.where(F.col("file_name").startswith("legacy_csv/")), f, "sha256").select("file_name", "sha256")


@query(
    """with p as (select import_id, pos, case when image_type like 'DefectMap%' then 'binmap' else 'sem' end kind from (select import_id, generate_subscripts(images, 1) pos, unnest(images).image_type image_type from ppt_import)),
    r as (select *, row_number() over (partition by import_id, kind order by pos) n from p)
    select import_id, (pos - 1)::int pos, kind, n::int role_no, case when kind = 'binmap' then case when n = 1 then 'DefectMapPost' else 'ImportedBinMap' || n end when n <= 2 then 'TypicalDefectImage' || n else 'ImportedSEMImage' || n end as role from r"""
)
def role_ordinals(spark, d):
    p = table(spark, d, "ppt_import").select("import_id", F.posexplode("images").alias("pos", "i"))
    p = p.select("import_id", "pos", F.when(F.col("i.image_type").startswith("DefectMap"), "binmap").otherwise("sem").alias("kind"))
    return R.assign_roles(p, ["import_id"], "kind", ["pos"])


_HEADS = ("89504E470D0A1A0A", "FFD8FF", "424D", "504B0304", "524946460000000057454250", "25504446", "")


@query(
    """with u as (select source, doc_id, coalesce(strlen(text), 0) size, doc_id % 7 h from documents where source is not null),
    r as (select *, sum(size) over (partition by source order by doc_id) running, row_number() over (partition by source order by doc_id) nth from u)
    select source, doc_id, running::bigint running, case h when 0 then 'png' when 1 then 'jpeg' when 2 then 'bmp' when 3 then 'pptx' when 4 then 'webp' end kind, (running <= 20000 and nth <= 30) accepted from r"""
)
def running_upload_cap(spark, d):
    """Documents as uploads of their source behind the first bytes of a kind of file: what they are, and which are still taken."""
    head = F.element_at(F.array(*[F.unhex(F.lit(h)) for h in _HEADS]), (F.col("doc_id") % 7 + 1).cast("int"))
    u = table(spark, d, "documents").where("source is not null").select("source", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.concat(head, F.lit(b" ")).alias("content"))
    return accept(u, ["source"], "doc_id", "size", 20_000, 30).select("source", "doc_id", "running", sniff(F.col("content")).alias("kind"), "accepted")


@query()
def slide_record_parse(spark, d):
    rows = spread(table(spark, d, "ppt_import").select("import_id", "source_text", "source_file", "source_slide")).withColumn("l", F.split(fold_code(F.col("source_text")), "\n"))
    return rows.select("import_id", *[c.alias(f) for f, c in R.slide_record(F.col("l"), F.col("source_file"), F.col("source_slide")).items()])


_S = sql_fold("source_text")
ORACLES["slide_record_parse"] = f"""with l as (select import_id, source_file, source_slide, list_filter(list_transform(string_split({_S}, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '') ls from ppt_import),
 f as (select *, list_filter(ls, lambda x: regexp_matches(x, '(?i)(DN-[A-Za-z0-9-]+)'))[1] title, list_filter(ls, lambda x: regexp_matches(x, {quoted(R.SLIDE_TOTAL)}))[1] ident, list_filter(ls, lambda x: regexp_matches(x, {quoted(R.SLIDE_DEFECT)}))[1] defect,
 list_filter(ls, lambda x: regexp_matches(x, {quoted(R.SLIDE_PLACE)}))[1] place, list_filter(ls, lambda x: regexp_matches(x, {quoted(R.SLIDE_DATE)}))[1] dated,
 list_filter(ls, lambda x: regexp_matches(lower(x), '^(down|up)$'))[1] es, list_filter(ls, lambda x: regexp_matches(lower(x), '^(scrap|hold|release)'))[1] lst from l)
 select import_id, coalesce(nullif(regexp_extract(title, '(?i)(DN-[A-Za-z0-9-]+)', 1), ''), 'PPT-' || regexp_replace(source_file, '\\.[^.]*$', '') || '-' || lpad(source_slide::varchar, 3, '0')) dn_no,
 nullif(regexp_extract(title, '(?i)(?:^|[^A-Za-z0-9_])(Class\\s*\\d+)', 1), '') class_type, nullif(regexp_extract(title, '(?i)(?:^|[^A-Za-z0-9_])Class\\s*\\d+\\s+([A-Za-z0-9_.-]+)', 1), '') product_id,
 nullif(regexp_extract(title, '(?i)(?:^|[^A-Za-z0-9_])Class\\s*\\d+\\s+([A-Za-z0-9_.-]+)\\s+([A-Za-z0-9_.-]+)', 2), '') station, nullif(regexp_extract(ident, '(?:^|[^A-Za-z0-9_])([A-Z]{{2,}}\\d+[A-Z0-9]*)', 1), '') platform,
 nullif(trim(string_split(ident, '/')[2]), '') lot_id, try_cast(nullif(regexp_extract(ident, '(?i)(?:^|[^A-Za-z0-9_])NG\\s*(\\d+)', 1), '') as int) bad_wafers, try_cast(nullif(regexp_extract(ident, '(?i)AdhCANC\\s*(\\d+)', 1), '') as int) scanned_wafers,
 try_cast(nullif(regexp_extract(ident, {quoted(R.SLIDE_TOTAL)}, 1), '') as int) total_wafers, coalesce(nullif(regexp_extract(defect, {quoted(R.SLIDE_DEFECT)}, 1), ''), nullif(regexp_extract(title, '\\s([A-Za-z][A-Za-z0-9_-]+)\\s*$', 1), '')) defect_type,
 nullif(trim(string_split(place, '/')[-1]), '') map_location, nullif(regexp_extract(dated, '^([A-Za-z0-9_.-]+)', 1), '') machine, nullif(regexp_extract(dated, {quoted(R.SLIDE_TIME)}, 1), '') scan_time, es equipment_status, lst lot_status from f"""

# Fixed values, written here again so that the SQL doesn't follow the library.
_ALIASES = (
    ("addscandefectmapgallary1", "AddScanDefectMapGallary1"), ("addscandefectmapgallery1", "AddScanDefectMapGallary1"), ("addscandefectmapgallary", "AddScanDefectMapGallary"),
    ("addscandefectmapgallery", "AddScanDefectMapGallary"), ("typicaldefectimage1", "TypicalDefectImage1"), ("typeicaldefectimage1", "TypicalDefectImage1"),
    ("typicaldefectimage2", "TypicalDefectImage2"), ("typeicaldefectimage2", "TypicalDefectImage2"), ("defectparetochart", "DefectParetoChart"),
    ("defecttrendchart", "DefectTrendChart"), ("defectbarchart", "DefectBarChart"), ("defectmappost", "DefectMapPost"), ("defectmappre", "DefectMapPre"),
    ("edxdefectimage", "EDXDefectImage"), ("diestack", "DieStack"), ("moreimage", "MoreImage"), ("typicalmap2", "TypicalMap2"), ("typeicalmap2", "TypicalMap2"),
    ("typicalmap", "TypicalMap"), ("typeicalmap", "TypicalMap"),
)
_STEM = "regexp_extract(coalesce(image_path, ''), '([^/\\\\]*)$', 1)"


@query(
    f"""with p as (select label_id, image_path, {_STEM} fn from labels_example), q as (select *, case when regexp_matches(fn, '.\\.[^.]*$') then regexp_replace(fn, '\\.[^.]*$', '') else fn end st from p),
    r as (select *, regexp_replace(lower(st), '[^\\p{{L}}\\p{{Nd}}]', '', 'g') k from q)
    select label_id, fn file_name, case {' '.join(f"when contains(k, '{k}') then '{v}'" for k, v in _ALIASES)} when trim(st) <> '' then trim(st) else 'Image' end image_role, lower(regexp_extract(fn, '.\\.([^.]*)$', 1)) in ('jpg', 'jpeg', 'png', 'bmp', 'webp', 'tif', 'tiff') is_image from r"""
)
def path_classify(spark, d):
    p = F.col("image_path")
    return table(spark, d, "labels_example").select("label_id", file_name(p).alias("file_name"), image_role(p).alias("image_role"), extension(p).isin(*EXTENSIONS).alias("is_image"))


@query(
    """with p as (select label_id, regexp_replace(regexp_replace(coalesce(image_path, ''), '[^A-Za-z0-9._\\x{4e00}-\\x{9fff}-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') s from labels_example)
    select label_id, case when s <> '' then s else 'uploaded.pptx' end safe_name from p"""
)
def safe_names(spark, d):
    return table(spark, d, "labels_example").select("label_id", safe_name(F.col("image_path")).alias("safe_name"))


@query("select import_id, i.file_name file_name, 'ppt/media/' || i.file_name part from (select import_id, unnest(images) i from ppt_import) where i.file_name <> '' and not contains(i.file_name, '..')")
def part_paths(spark, d):
    """Parts that slides refer to from their own folder."""
    named = table(spark, d, "ppt_import").select("import_id", "source_slide", F.explode("images").alias("i")).select("import_id", "source_slide", "i.file_name").where((F.col("file_name") != "") & ~F.col("file_name").contains(".."))
    base = F.concat(F.lit("ppt/slides/slide"), F.col("source_slide").cast("string"), F.lit(".xml"))
    return named.select("import_id", "file_name", resolve(base, F.concat(F.lit("..\\media/./x/../"), "file_name")).alias("part"))


@query(
    """with k as (select distinct dn_no from vectors where dn_no is not null), f as (select dn_no, min(file_name) file_name from vectors where image_type = 'DefectMapPost' group by 1)
    select case when f.dn_no is null then 'skipped_missing_image' else 'included' end status, count(*) n from k left join f using (dn_no) group by 1"""
)
def training_manifest(spark, d):
    from siftmill.sources.labels import manifest

    v = table(spark, d, "vectors").where("dn_no is not null")
    return manifest(v.select("dn_no").distinct(), v.where("image_type = 'DefectMapPost'").select("dn_no", "file_name"), "dn_no", "file_name").groupBy("status").agg(F.count("*").alias("n"))


@query(
    """select import_id, image_type, file_name, (row_number() over (partition by import_id order by o, file_name, image_type))::int place from (select distinct import_id, i.image_type image_type, i.file_name file_name,
    case i.image_type when 'DefectMapPost' then 0 when 'TypicalDefectImage1' then 1 when 'TypicalDefectImage2' then 2 when 'AddScanDefectMapGallary' then 3 when 'AddScanDefectMapGallary1' then 4 when 'DefectBarChart' then 5 when 'DefectMapPre' then 6
    when 'DefectParetoChart' then 7 when 'DefectTrendChart' then 8 when 'DieStack' then 9 when 'EDXDefectImage' then 10 when 'MoreImage' then 11 when 'TypicalMap' then 12 when 'TypicalMap2' then 13 else 99 end o from (select import_id, unnest(images) i from ppt_import))"""
)
def display_order(spark, d):
    i = table(spark, d, "ppt_import").select("import_id", F.explode("images").alias("i")).select("import_id", "i.image_type", "i.file_name").distinct()
    return i.withColumn("place", F.row_number().over(W.partitionBy("import_id").orderBy(role_order(F.col("image_type")), "file_name", "image_type")))


@query("select label_id, '/' || url_encode(coalesce(image_path, '')) url from labels_example")
def quoted_urls(spark, d):
    """The URL of every label's path."""
    return table(spark, d, "labels_example").select("label_id", F.concat(F.lit("/"), ids.url_quote(F.coalesce("image_path", F.lit("")))).alias("url"))


@query(
    "select count(*) imports, count(distinct source_file) files, coalesce(sum(len(images)), 0)::bigint images, max(strftime(imported_at, '%Y-%m-%d %H:%M:%S')) latest from ppt_import"
)
def import_summary(spark, d):
    i = table(spark, d, "ppt_import")
    return i.agg(F.count("*").alias("imports"), F.count_distinct("source_file").alias("files"), F.coalesce(F.sum(F.size("images")), F.lit(0)).cast("bigint").alias("images"), F.substring(F.max("imported_at").cast("string"), 1, 19).alias("latest"))


_SHOWN = "case i.image_type when 'DefectMapPost' then 0 when 'TypicalDefectImage1' then 1 when 'TypicalDefectImage2' then 2 when 'AddScanDefectMapGallary' then 3 when 'AddScanDefectMapGallary1' then 4 when 'DefectBarChart' then 5 when 'DefectMapPre' then 6 when 'DefectParetoChart' then 7 when 'DefectTrendChart' then 8 when 'DieStack' then 9 when 'EDXDefectImage' then 10 when 'MoreImage' then 11 when 'TypicalMap' then 12 when 'TypicalMap2' then 13 else 99 end"


@query(
    f"""with i as (select distinct upper({sql_strip('dn_no')}) dn_no, i.image_type t, i.file_name n, {_SHOWN} o from (select dn_no, unnest(images) i from ppt_import) where {sql_strip("coalesce(dn_no, '')")} <> ''),
    p as (select *, upper({SQL_ID}) k from payload_parser), r as (select k dn_no, arg_min(machine, ord) filter (where {sql_present('machine')} is not null) machine from p where k <> '' group by 1)
    select i.dn_no, r.dn_no is not null has_record, any_value(machine) machine, string_agg(n, '|' order by o, n, t) images from i left join r using (dn_no) group by 1, 2"""
)
def record_details(spark, d):
    """Each record number with images: its record and its images in order of display."""
    images = table(spark, d, "ppt_import").select("dn_no", F.explode("images").alias("i")).select("dn_no", "i.image_type", "i.file_name")
    out = R.with_images(R.merge_points(table(spark, d, "payload_parser")).select("dn_no", "machine"), images)
    return out.select("dn_no", "has_record", "machine", F.array_join(F.transform("images", lambda i: i["file_name"]), "|").alias("images"))


@query(
    """with f as (select coalesce(site, '') site, source_file, count(*) slides, max(imported_at) latest from ppt_import group by 1, 2)
    select site, source_file, slides, strftime(latest, '%Y-%m-%d %H:%M:%S') latest, (row_number() over (partition by site order by latest desc, source_file))::int place from f"""
)
def import_history(spark, d):
    """Imported files of each site, the newest first."""
    files = table(spark, d, "ppt_import").groupBy(F.coalesce("site", F.lit("")).alias("site"), "source_file").agg(F.count("*").alias("slides"), F.max("imported_at").alias("latest"))
    place = F.row_number().over(W.partitionBy("site").orderBy(F.desc("latest"), "source_file"))
    return files.select("site", "source_file", "slides", F.substring(F.col("latest").cast("string"), 1, 19).alias("latest"), place.alias("place"))


@query(f"select ord, coalesce(nullif({SQL_ID}, ''), 'UNKNOWN') id, coalesce(bad_wafers, 0)::double score, coalesce(nullif(bad_wafers, 0), 1)::double old_score from payload_parser")
def served_hits(spark, d):
    hits = table(spark, d, "payload_parser").select("ord", R.record_id(F.col("dn_no"), F.col("record_id"), F.col("point_id")).alias("id"), F.col("bad_wafers").cast("double").alias("score"))
    return hits.select("ord", T.served_id(F.col("id")).alias("id"), T.served_score(F.col("score")).alias("score"), T.served_score(F.col("score"), compat=True).alias("old_score"))


@query(
    """select doc_id knowledge_id, coalesce(source, '') || chr(10) || coalesce(lang, '') || chr(10) || concat_ws(' ', lot_id, dn_no) || chr(10) || coalesce(text, '') || chr(10) || concat_ws('；', dn_no, lot_id) || chr(10) || '' document_text from documents"""
)
def note_texts(spark, d):
    """Documents as knowledge notes: the text that stands for each in a search."""
    n = table(spark, d, "documents").select(
        F.col("doc_id").alias("knowledge_id"), F.col("source").alias("title"), F.col("lang").alias("organization"), F.array("lot_id", "dn_no").alias("topics"), F.col("text").alias("summary_zh"),
        F.array("dn_no", "lot_id").alias("analysis_methods"), F.lit(None).cast("string").alias("limitations"),
    )
    return E.document_text(n)


@query(
    f"""with ids as (select distinct upper({sql_strip('dn_no')}) k from vectors where modality = 'binmap' and not {sql_missing('dn_no')}) select ord, upper({sql_strip('dn_no')}) dn_no from payload_parser where upper({sql_strip('dn_no')}) in (select k from ids)"""
)
def listed_ids(spark, d):
    """Points of the records on a list, here those with a map."""
    listed = table(spark, d, "vectors").where((F.col("modality") == "binmap") & present(F.col("dn_no")).isNotNull()).select(ids.normalize_dn(F.col("dn_no")).alias("dn_no"))
    return table(spark, d, "payload_parser").select("ord", ids.normalize_dn(F.col("dn_no")).alias("dn_no")).join(listed, "dn_no", "left_semi").select("ord", "dn_no")


@query(
    f"""with o as (select upper({sql_strip('dn_no')}) k, arg_min(machine, ord) machine from payload_parser where not {sql_missing('dn_no')} group by 1), n as (select upper({sql_strip('dn_no')}) k, arg_max(machine, import_id) machine from ppt_import where not {sql_missing('dn_no')} group by 1)
    select k, coalesce(n.machine, '?') machine, 'import' side from n union all select k, coalesce(machine, '?'), 'text' from o where k not in (select k from n)"""
)
def overlaid_records(spark, d):
    """Records of texts under those of imports: an import takes the place of the text's record."""
    key = ids.normalize_dn(F.col("dn_no")).alias("k")
    old = table(spark, d, "payload_parser").where(present(F.col("dn_no")).isNotNull()).groupBy(key).agg(F.min_by("machine", F.when(F.col("machine").isNotNull(), F.col("ord"))).alias("machine")).withColumn("side", F.lit("text"))
    new = table(spark, d, "ppt_import").where(present(F.col("dn_no")).isNotNull()).groupBy(key).agg(F.max_by("machine", F.when(F.col("machine").isNotNull(), F.col("import_id"))).alias("machine")).withColumn("side", F.lit("import"))
    return R.upsert(old, new, ["k"]).select("k", F.coalesce("machine", F.lit("?")).alias("machine"), "side")


@query(
    f"""with t as (select text_content x, ord, row_number() over (order by ord) - 1 pos from payload_parser where text_content is not null and text_content <> ''), f as (select *, {sql_fold('x')} ft from t),
    p as (select coalesce({sql_parsed('dn_no')}, 'local-' || pos) record_id, pos, {sql_parsed('machine')} machine from f), l as (select *, row_number() over (partition by record_id order by pos desc) r from p) select record_id, machine from l where r = 1"""
)
def csv_notes(spark, d):
    """Notes written to a CSV file and read back: records by the number a note states, else by its place in the file."""
    path = table_path(spark, "notes_csv")
    rows = table(spark, d, "payload_parser").where("text_content is not null and text_content <> ''").select("ord", "text_content").coalesce(1).sortWithinPartitions("ord")
    rows.select(F.col("text_content").alias("TEXT")).write.option("header", "true").option("escape", '"').option("quoteAll", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return read_texts(spark, path).select("record_id", "machine")


@query(f"select label_id::varchar label_id, image_path, trim(label) label from labels_example where not {sql_missing('image_path')} and not {sql_missing('label')}")
def labels_csv(spark, d):
    """Labelled images written to delimited files and read back, all as text; rows without an image or a label are left out."""
    path = table_path(spark, "labels_csv")
    rows = table(spark, d, "labels_example").select(F.col("label_id").cast("string").alias("label_id"), "image_path", "label")
    rows.write.csv(path, sep=";", header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return read_labels(spark, path).select("label_id", "image_path", "label")


@query("select import_id, lot_id, len(images)::int n_images, coalesce(list_min(list_transform(images, lambda i: i.file_name)), '') first_image from ppt_import where import_id % 5 > 1")
def broken_jsonl(spark, d):
    """Records written as JSON lines, of each five one cut off and one blank, and read back."""
    path = table_path(spark, "records_jsonl")
    whole = F.to_json(F.struct("import_id", "lot_id", "images"))
    line = F.when(F.col("import_id") % 5 == 0, F.substring(whole, 1, 20)).when(F.col("import_id") % 5 == 1, F.lit("  ")).otherwise(whole)
    table(spark, d, "ppt_import").select(line.alias("value")).write.text(path)
    back = read_jsonl(spark, path, "import_id bigint, lot_id string, images array<struct<image_type:string,file_name:string>>")
    first = F.coalesce(F.array_min(F.transform("images", lambda i: i["file_name"])), F.lit(""))
    return back.select("import_id", "lot_id", F.size("images").alias("n_images"), first.alias("first_image"))

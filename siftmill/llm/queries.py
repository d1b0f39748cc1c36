"""Queries of the training-data operators, over whole tables, and SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm import encode, mixing, neighbours, pieces, splits, survivor, unify_text
from siftmill.plans.records import sql_fold, sql_missing
from siftmill.plans.tables import table
from siftmill.session import materialise

#: Share of all leaves that a wide search opens.
WIDE_LEAVES = 0.3
TEXT_FIELDS = (("payload_parser", "text_content", "ord"), ("ppt_import", "source_text", "import_id"), ("ppt_import", "lot_id", "import_id"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for src, field, key in TEXT_FIELDS:
        one = unify_text.unify_text(table(spark, d, src), key, field, only_changed=True)
        one = one.select(F.lit(src).alias("src_table"), F.lit(field).alias("field_name"), F.col(key).cast("bigint").alias("row_key"))
        out = one if out is None else out.unionByName(one)
    return out


def p1_unified(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for src, field, key in TEXT_FIELDS:
        one = unify_text.unify_text(table(spark, d, src), key, field, strip=field == "lot_id")
        one = one.select(F.lit(src).alias("src_table"), F.lit(field).alias("field_name"), F.col(key).alias("row_key"), "text", "changes")
        out = one if out is None else out.unionByName(one)
    return out


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = splits.conflicts(table(spark, d, "labels_example"), "label_id", "image_path", "image_sha", "split")
    return found.select(F.col("first_id").alias("first_label_id"), F.col("other_id").alias("label_id"))


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    groups = materialise(splits.related_groups(table(spark, d, "labels_example"), "label_id", "image_path", "image_sha"), "groups")
    sizes = materialise(groups.groupBy("group_id").agg(F.count("*").alias("n_rows")), "group_sizes")
    given = materialise(splits.assign_splits(sizes, table(spark, d, "split_targets")), "given")
    return splits.lookup(groups, given, ["group_id"], "n_rows", F.col("label_id")).select("label_id", "group_id", "split")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.near_pairs(neighbours.nearest(table(spark, d, "vectors"), "vec_id", "vector", "modality", k=10, min_cosine=0.92))


def p4_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The ten best of every vector whose id is divisible by 100, against all vectors. Most have no near ones, and in 64
    dimensions only a wide search finds the ten best of those: all regions are asked."""
    near = neighbours.nearest(table(spark, d, "vectors"), "vec_id", "vector", "modality", k=10, reach=float("inf"), visits=1 << 13, leaves=WIDE_LEAVES, every=100)
    return near.withColumn("cosine", F.round("cosine", 6))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(table(spark, d, "payload_parser"), table(spark, d, "origin_trust"))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    return survivor.surviving_records(table(spark, d, "payload_parser"), table(spark, d, "origin_trust"))


def p5_fused(spark: SparkSession, d: str) -> DataFrame:
    return survivor.fuse(table(spark, d, "payload_parser"), table(spark, d, "origin_trust")).values


def p5_fused_records(spark: SparkSession, d: str) -> DataFrame:
    return survivor.fuse(table(spark, d, "payload_parser"), table(spark, d, "origin_trust")).records()


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"), ["doc_id"], "text")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "source_targets"), "doc_id", "text", "source").picked


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "source_targets"), "doc_id", "text", "source").report


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    cut = pieces.split_texts(table(spark, d, "documents"), "doc_id", "text", with_text=False)
    # The second piece of a text stands for it: a text within the limit has none.
    return cut.where("piece_no = 1").select("doc_id")


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_texts(table(spark, d, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_unified, p3_found, p3_splits, p4_found, p4_nearest, p5_found, p5_records, p5_fused, p5_fused_records, p7_ids, p8_mix, p8_shares, p9_found, p9_pieces)
}


# --- SQL of what SQL can say; no look-around, so stated values are taken out and judged -------------------------------

_DN = r"'(?i)DN[-_\s]*(\d{8})[-_\s]+(\d{2,})'"
_IS = r"\s*(?:为|是|:)?\s*"
_HOLD = "('unknown', 'unknown_dn', '未知', 'nan', '—', '')"


def _sql_dn(folded: str) -> str:
    return f"(case when regexp_matches({folded}, {_DN}) then 'DN-' || regexp_extract({folded}, {_DN}, 1) || '-' || regexp_extract({folded}, {_DN}, 2) end)"


def _told(label: str, value: str = r"[^,。;\s]*", need: str = "") -> str:
    test = f" and regexp_matches(v, '(?i){need}')" if need else ""
    return f"(len(list_filter(regexp_extract_all(ft, '(?i){label}({value})', 1), lambda v: lower(v) not in {_HOLD}{test})) > 0)::int"


_STATES = (
    _told(r"DN\s*(?:编号|号)" + _IS, need="^DN-[a-z0-9]"),
    _told(r"(?:^|[^陷])(?:类型|类别)" + _IS, r"[^,。;]*", r"^Class\s*\d"),
    _told(r"(?:Lot\s*ID\s*(?:\([^)]*\))?|批次编号|批次号|批号)" + _IS, need="^[a-z0-9]"),
    _told(r"产品(?:编号|ID)?" + _IS, need="^[a-z0-9]"),
    _told(r"(?:^|[^A-Za-z0-9_.-])", r"[A-Za-z0-9][A-Za-z0-9_.-]*\s*平台"),
    _told(r"平台(?:的|下)?\s*", r"[A-Za-z0-9][A-Za-z0-9_.-]*\s*站点"),
    _told(r"(?:扫描机器|扫描机|机器|机台)" + _IS, r"[^,。;\s于]*", "^[a-z0-9]"),
    _told("于", r"\s*\d{4}[/-]\d{1,2}[/-]\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}\s*完成(?:了)?扫描"),
    *[_told(x + _IS, r"\d*", r"\d") for x in ("Wafer总数", "扫描过的Wafer数量", "坏的Wafer数量")],
    _told("缺陷类型" + _IS, need="^[a-z0-9]"),
    *[_told(x + _IS) for x in ("EDX检测到的元素", "EDX背景", "Map(?:上面)?分布的位置", "DFT(?:上面)?分布的位置")],
)


def _p5_sql() -> str:
    own = r"'(?i)DN\s*(?:编号|号)" + _IS + r"(DN[-_\s]*\d{8}[-_\s]+\d{2,})'"
    has = {f: f"not {sql_missing(f)}" for f in survivor.FIELDS if f != "total_wafers"} | {"total_wafers": "coalesce(total_wafers, 0) <> 0"}
    rank = "coalesce(trust_rank, 2147483647), coalesce(-epoch_us(updated_at), 9223372036854775807), ord"
    parts = [
        f"select dn dn_no, '{f}' field_name, ord from (select dn, ord, row_number() over (partition by dn order by {'-stated, ' if f == 'text_content' else ''}{rank}) r from n where {has[f]}) where r = 1"
        for f in survivor.FIELDS
    ]
    return f"""with f as (select *, {sql_fold('text_content')} ft from payload_parser), g as (select *, coalesce({_sql_dn(sql_fold('dn_no'))}, {_sql_dn(sql_fold('record_id'))}, {_sql_dn(f"regexp_extract(ft, {own}, 1)")}) dn, {' + '.join(_STATES)} stated from f),
    t as (select origin, min(trust_rank) trust_rank from origin_trust group by 1), n as (select g.*, trust_rank from g left join t using (origin) where dn is not null and dn in (select dn from g group by 1 having count(*) >= 2)) {' union all '.join(parts)}"""


_PATH = f"regexp_replace(regexp_replace(trim(regexp_replace({sql_fold('url_decode(image_path)')}, '[\\\\/]+', '/', 'g')), '^(\\./)+', ''), '^$', '')"

ORACLES: dict[str, str] = {
    "p5_found": _p5_sql(),
    "p3_found": f"""with recursive l as (select label_id, {_PATH} p, nullif(lower(trim(image_sha)), '') sha, lower(trim(coalesce(split, ''))) s, {sql_missing('image_path')} nopath from labels_example),
    k as (select label_id, s, case when nopath then null else coalesce({_sql_dn('p')}, 'p:' || p) end a, sha from l),
    e as (select 'a' || a x, label_id from k where a is not null union all select 's' || sha, label_id from k where sha is not null), m as (select x, min(label_id) lo from e group by 1),
    ed as (select distinct label_id u, lo v from e join m using (x) where lo <> label_id), both_ as (select u, v from ed union select v, u from ed),
    reach(u, v) as (select label_id, label_id from k union select r.u, b.v from reach r join both_ b on r.v = b.u), c as (select u, min(v) g from reach group by 1),
    n as (select g, u, case when s in ('train', 'training') then 'train' when s in ('val', 'valid', 'validation') then 'val' when s in ('test', 'testing') then 'test' end sp from c join k on u = label_id)
    select g first_label_id, u label_id from n where u <> g and g in (select g from n group by 1 having count(distinct sp) > 1)""",
}

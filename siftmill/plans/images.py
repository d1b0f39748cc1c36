"""Queries over vectors, regions and pixel rows, with the same said in SQL.

In ``embeddings`` the label stands for the record and the parity of the id for the kind of image; the three vectors of
least id are the query images. Rows of ``lineitem`` stand for pixels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.functions import box
from siftmill.functions.paths import ROLES
from siftmill.functions.vector import norm, normalise, visual_score
from siftmill.operators import images as I
from siftmill.operators import rasters as Z
from siftmill.operators import records as R
from siftmill.plans.tables import table
from siftmill.session import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


_SIMS = """with qv as (select vec_id qid, embedding qe from embeddings order by vec_id limit 3), s as (select label dn, vec_id, vec_id % 2 kind, qid, list_dot_product(embedding::double[], qe::double[]) sim from embeddings, qv)"""


def _sims(spark, d, n: int = 3) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.orderBy("vec_id").limit(n).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qe"))
    cols = e.select(F.col("label").alias("dn"), "vec_id", (F.col("vec_id") % 2).alias("kind"), "embedding")
    return I.similarities(cols, q, "embedding", "qe").select("dn", "vec_id", "kind", "qid", "sim")


@query(
    f"""{_SIMS}, o as (select * from s where qid = (select min(qid) from qv)) select dn, round(avg(round(sim, 6)), 6) average_similarity, arg_max(vec_id, (round(sim, 6), -vec_id)) best_image, count(*) n_images,
    round(least(greatest((avg(round(sim, 6)) + 1) / 2, 0), 1), 4) visual from o group by 1"""
)
def image_mean_per_entity(spark, d):
    m = I.mean_per_entity(_sims(spark, d, 1), "dn", "vec_id")
    return m.withColumn("visual", F.round(visual_score(F.col("average_similarity")), 4))


@query(f"{_SIMS}, b as (select dn, qid, max(sim) m from s group by 1, 2) select dn, round(avg(m), 6) score from b group by 1 having count(*) = 3")
def multi_query_max_mean(spark, d):
    return I.max_then_mean(_sims(spark, d), "dn", "qid", 3).select("dn", F.round("score", 6).alias("score"))


@query(f"{_SIMS}, b as (select dn, kind, qid, max(sim) m from s group by 1, 2, 3), k as (select dn, kind, sum(m) / 3 s from b group by 1, 2) select dn, round(max(s), 6) score from k group by 1")
def maxsim_modalities(spark, d):
    return I.max_sim(_sims(spark, d), "dn", "kind", "qid", 3).select("dn", F.round("score", 6).alias("score"))


@query(
    f"""{_SIMS}, c as (select *, row_number() over (partition by kind order by sim desc, vec_id, qid) r from s) select dn, round(max(sim), 6) score, (row_number() over (order by round(max(sim), 6) desc, dn))::int as "rank" from c where r <= 100 group by dn"""
)
def over_fetched_candidates(spark, d):
    from siftmill.operators.mlops import top_per_group

    some = top_per_group(_sims(spark, d), ["kind"], [F.desc("sim"), F.col("vec_id"), F.col("qid")], I.over_fetch(20))
    best = some.groupBy("dn").agg(F.round(F.max("sim"), 6).alias("score"))
    return I.numbered(best, "score", "dn").select("dn", "score", "rank")


_BLOCKS = f"""{_SIMS}, t as (select qid, dn, vec_id // 4 block, vec_id % 4 rot, max(round(sim, 9)) sim from s group by 1, 2, 3, 4), bt as (select qid, dn, block, max(sim) sim, arg_min(rot, (-sim, rot)) rot from t group by 1, 2, 3),
 best as (select qid, dn, arg_min(block, (-sim, block)) block, arg_min(rot, (-sim, block)) rot, max(sim) sim from bt group by 1, 2)"""


def _best(spark, d) -> DataFrame:
    t = _sims(spark, d).groupBy("qid", "dn", F.floor(F.col("vec_id") / 4).alias("block"), (F.col("vec_id") % 4).alias("rot")).agg(F.max(F.round("sim", 9)).alias("sim"))
    return I.best_rotation(t, "qid", "dn", "block", "rot")


@query(f"{_BLOCKS} select qid, dn, block, rot, sim from best")
def rotation_argmax(spark, d):
    return _best(spark, d)


@query(
    f"""{_BLOCKS}, r as (select dn, max(sim) peak, list_avg(list_slice(list_sort(list(sim), 'DESC'), 1, 3)) top3, count(*) filter (where sim >= 0.84) / 3.0 coverage from best group by 1),
    l as (select *, greatest(0.94 * peak, 0.72 * top3 + 0.28 * coverage) "local", least(0.12, 0.12 * coverage) w from r)
    select dn, round(peak, 6) peak, round(top3, 6) top3, round(coverage, 6) coverage, round("local", 6) "local", round((0.22 - w / 2) * 0.5 + (0.70 + w / 2) * "local" + 0.08 * 0.25, 6) final from l"""
)
def local_score_blend(spark, d):
    return I.local_scores(_best(spark, d), "dn", 3, F.lit(0.5), F.lit(0.25))


# Rows of lineitem as the defect pixels of pictures of 51 by 128.
_PIX = "select l_suppkey img, l_quantity::double x, floor(l_extendedprice / 1000)::double y from lineitem"
WIDTH, HEIGHT = 51, 128


def _pixels(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("img"), F.col("l_quantity").cast("double").alias("x"), F.floor(F.col("l_extendedprice") / 1000).cast("double").alias("y"))


@query(
    f"""with p as ({_PIX}), f as (select img, sqrt((x - 25) ** 2 + (y - 63.5) ** 2) / sqrt(25.0 ** 2 + 63.5 ** 2) r from p), b as (select img, case when r = 1 then 7 else floor(r * 8)::int end bin from f where r <= 1)
    select img, bin, round(count(*) / sum(count(*)) over (partition by img)::double, 9) share from b group by 1, 2"""
)
def pixel_histogram(spark, d):
    return I.radial_histogram(_pixels(spark, d), "img", "x", "y", F.lit(WIDTH), F.lit(HEIGHT))


_RINGS = f"""with p as ({_PIX}), f as (select img, sqrt((x - 25) ** 2 + (y - 63.5) ** 2) / sqrt(25.0 ** 2 + 63.5 ** 2) r from p), b as (select img, case when r = 1 then 7 else floor(r * 8)::int end bin from f where r <= 1),
 h as (select img, bin, round(count(*) / sum(count(*)) over (partition by img)::double, 9) share from b group by 1, 2), n as (select img, count(*) / 6528.0 ratio from p group by 1),
 v as (select img, ratio, list_transform(range(8), lambda i: coalesce(list_sum(list_transform(list_filter(hs, lambda x: x.bin = i), lambda x: x.share)), 0.0)) q from n join (select img, list({{'bin': bin, 'share': share}}) hs from h group by 1) using (img))"""


@query(
    f"""{_RINGS}, a as (select img qi, q aq, ratio ar from v order by img limit 3), s as (select img % 50 record, qi, max(0.75 * list_cosine_similarity(q, aq) + 0.25 * exp(-abs(ln(greatest(ratio, 1e-8) / greatest(ar, 1e-8))))) b from v, a group by 1, 2)
    select record, round(avg(greatest(b, 0.0)), 6) geometry from s group by 1"""
)
def geometry_similarity(spark, d):
    """Shape likeness of records with several maps each to the three query maps."""
    p = _pixels(spark, d)
    rings = I.ring_vectors(I.radial_histogram(p, "img", "x", "y", F.lit(WIDTH), F.lit(HEIGHT)), "img")
    maps = rings.join(p.groupBy("img").agg((F.count("*") / (WIDTH * HEIGHT)).alias("ratio")), "img")
    maps = materialise(maps, "maps").withColumn("record", F.col("img") % 50)
    out = I.geometry_scores(maps, maps.orderBy("img").limit(3), "record", "img")
    return out.select("record", F.round("geometry", 6).alias("geometry"))


_DRAWN = f"""with p as (select distinct l_suppkey % 20 img, l_quantity::int x, floor(l_extendedprice / 1000)::int y from lineitem where l_quantity <= 50 and floor(l_extendedprice / 1000) < 128),
 n as (select img, count(*) n from p group by 1), r as (select img, least(floor(sqrt((x - 25) ** 2 + (y - 63.5) ** 2) / sqrt(25.0 ** 2 + 63.5 ** 2) * 8), 7)::int bin, count(*) c from p group by 1, 2)"""


def _drawn(spark, d) -> DataFrame:
    points = _pixels(spark, d).withColumn("img", F.col("img") % 20)
    return Z.drawn(points, "img", "x", "y", WIDTH, HEIGHT)


@query(f"{_DRAWN} select img::varchar img_id, round(n / 6528.0, 4) ratio, round(coalesce(sum(c) filter (where bin < 4), 0) / n::double, 4) inner_half from r join n using (img) group by img, n")
def drawn_geometry(spark, d):
    """Shape of drawn maps, told from their pixels: the share of defects, and of those in the inner half."""
    g = Z.map_geometry(_drawn(spark, d))
    inner = F.aggregate(F.slice("geometry", 1, 4), F.lit(0.0), lambda s, x: s + x)
    return g.select("img_id", F.round(F.col("geometry")[8].cast("double"), 4).alias("ratio"), F.round(inner, 4).alias("inner_half"))


@query()
def drawn_regions(spark, d):
    """Kind, connected parts and best regions of drawn maps."""
    maps = materialise(_drawn(spark, d), "drawn")
    parts = Z.map_components(maps).select("img_id", F.size("components").alias("n_components"))
    return Z.map_regions(maps).join(parts, "img_id").join(Z.map_kinds(maps), "img_id").select("img_id", "modality", "n_components", F.size("regions").alias("n_regions"), F.col("regions")[0]["score"].alias("best_score"))


@query("select user_id, event_type, event_id, (row_number() over (partition by user_id order by event_type, event_id))::int display_id from events")
def request_blocks(spark, d):
    """Events of a user as the regions of a request, their types as its query images."""
    return I.request_blocks(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_type", "event_id")


@query(
    f"""with p as ({_PIX}), sp as (select img, quantile_cont(x, 0.05) x0, quantile_cont(x, 0.95) x1, quantile_cont(y, 0.05) y0, quantile_cont(y, 0.95) y1, count(*) n from p group by 1),
    c as (select img, least(2, x::int * 3 // 51) gx, least(2, y::int * 3 // 128) gy, count(*) k from p group by 1, 2, 3),
    o as (select img, count(*) filter (where k >= 4 and k >= ceil(0.06 * n))::int active_cells, -sum(k / n::double * ln(k / n::double)) / ln(9.0) d, max((x1 - x0 + 1) / 51) xs, max((y1 - y0 + 1) / 128) ys from c join sp using (img) group by 1)
    select img, round(xs, 6) x_span, round(ys, 6) y_span, active_cells, round(d, 6) dispersion, active_cells = 9 and d >= 0.93 spread_all_over from o"""
)
def grid_entropy(spark, d):
    return I.grid_dispersion(_pixels(spark, d), "img", "x", "y", F.lit(WIDTH), F.lit(HEIGHT))


@query(f"with p as ({_PIX}) select img, round(quantile_cont(x, 0.05), 6) low, round(quantile_cont(x, 0.95), 6) high from p group by 1")
def percentile_span(spark, d):
    p = _pixels(spark, d).groupBy("img")
    return p.agg(F.round(F.percentile("x", 0.05), 6).alias("low"), F.round(F.percentile("x", 0.95), 6).alias("high"))


@query(
    """with p as (select l_orderkey, l_linenumber, (l_quantity * 5)::int r, (l_extendedprice::int % 256) g, (l_partkey % 256)::int b from lineitem)
    select l_orderkey, l_linenumber, ((r >= 125 and r >= g + 25 and r >= b + 25) or (r >= 75 and r >= g + 10 and r >= b + 8 and g <= 0.93 * r)) defect from p"""
)
def mask_predicate(spark, d):
    p = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 5).cast("int").alias("r"), (F.round("l_extendedprice", 0).cast("int") % 256).alias("g"), (F.col("l_partkey") % 256).cast("int").alias("b"))
    return p.select("l_orderkey", "l_linenumber", I.defect_pixel(F.col("r"), F.col("g"), F.col("b")).alias("defect"))


ORACLES["mask_predicate"] = ORACLES["mask_predicate"].replace("(l_extendedprice::int % 256)", "(round(l_extendedprice, 0)::int % 256)")


@query(
    f"""with p as ({_PIX}), b as (select img, min(x) l, min(y) t, avg(x) r, max(y) + 1 bo from p where img % 3 <> 0 group by 1)
    select p.img, round(avg(case when b.img is not null and x >= l and x < r and y >= t and y < bo then 1.0 else 0.0 end), 6) coverage from p left join b using (img) group by 1"""
)
def box_coverage(spark, d):
    p = _pixels(spark, d)
    b = p.where("img % 3 <> 0").groupBy("img").agg(F.min("x").alias("left"), F.min("y").alias("top"), F.avg("x").alias("right"), (F.max("y") + 1).alias("bottom"))
    return I.box_coverage(p, b, "img", "x", "y")


@query(
    """with b as (select o_orderkey, o_custkey % 100 l, o_orderkey % 100 t, o_custkey % 100 + 10 + o_orderkey % 7 r, o_orderkey % 100 + 12 bo from orders)
    select o_orderkey, ((r - l) * (bo - t))::bigint area, round(greatest(least(r, 60) - greatest(l, 20), 0) * greatest(least(bo, 60) - greatest(t, 20), 0) / greatest(least((r - l) * (bo - t), 1600), 1)::double, 6) overlap from b"""
)
def box_algebra(spark, d):
    o = table(spark, d, "orders")
    left, top = F.col("o_custkey") % 100, F.col("o_orderkey") % 100
    own = F.struct(left.alias("left"), top.alias("top"), (left + 10 + F.col("o_orderkey") % 7).alias("right"), (top + 12).alias("bottom"))
    fixed = F.struct(F.lit(20).alias("left"), F.lit(20).alias("top"), F.lit(60).alias("right"), F.lit(60).alias("bottom"))
    return o.select("o_orderkey", box.area(own).cast("bigint").alias("area"), F.round(box.overlap(own, fixed), 6).alias("overlap"))


@query("select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) length, round(embedding[1]::double / sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) first from embeddings")
def vector_norms(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.round(norm(F.col("embedding")), 6).alias("length"), F.round(normalise(F.col("embedding"))[0], 6).alias("first"))


@query(
    """with i as (select upper(trim(dn_no)) dn_no, count(*) n_images from vectors where dn_no is not null group by 1), r as (select upper(trim(dn_no)) dn_no, min(platform) platform from ppt_import group by 1)
    select i.dn_no, n_images, coalesce(platform, '—') platform, r.dn_no is not null has_record from i left join r using (dn_no)"""
)
def entity_left_join_stub(spark, d):
    i = table(spark, d, "vectors").where("dn_no is not null").groupBy(F.upper(F.trim("dn_no")).alias("dn_no")).agg(F.count("*").alias("n_images"))
    r = table(spark, d, "ppt_import").groupBy(F.upper(F.trim("dn_no")).alias("dn_no")).agg(F.min("platform").alias("platform"), F.lit(True).alias("known"))
    return i.join(r, "dn_no", "left").select("dn_no", "n_images", F.coalesce("platform", F.lit("—")).alias("platform"), F.coalesce("known", F.lit(False)).alias("has_record"))


@query("select distinct platform from ppt_import where upper(trim(dn_no)) in (select upper(trim(dn_no)) from vectors) and platform is not null")
def facets_semi_join(spark, d):
    i = table(spark, d, "vectors").select(F.upper(F.trim("dn_no")).alias("k"))
    r = table(spark, d, "ppt_import").where("platform is not null").withColumn("k", F.upper(F.trim("dn_no")))
    return r.join(i, "k", "left_semi").select("platform").distinct()


@query(
    "select 'records' measure, count(distinct dn_no) n from vectors"
    + "".join(f" union all select '{r}', count(*) from vectors where image_type = '{r}'" for r in ROLES)
)
def catalog_status(spark, d):
    return I.catalogue_status(table(spark, d, "vectors"), ROLES)


@query(
    """with i as (select unnest(images).image_type t from ppt_import) select modality, count(*) n from (select case when t = 'DefectMapPost' then 'binmap' when t in ('TypicalDefectImage1', 'TypicalDefectImage2') then 'sem' end modality from i)
    where modality is not null group by 1"""
)
def modality_eligible(spark, d):
    i = table(spark, d, "ppt_import").select(F.explode("images").alias("i")).select("i.image_type")
    return R.searchable(i).groupBy("modality").agg(F.count("*").alias("n"))

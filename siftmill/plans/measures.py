"""Queries of labels, splits, model measures and event windows, with the same said in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.operators import mlops as M
from siftmill.plans.records import sql_missing
from siftmill.plans.tables import table
from siftmill.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


_LAB = f"select *, trim(label) lab from labels_example where not {sql_missing('label')}"
_PAIRS = "select o_orderkey % 7 truth, case when o_custkey % 4 = 0 then (o_orderkey + 1) % 6 else o_orderkey % 7 end pred from orders"


def _pairs(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select((F.col("o_orderkey") % 7).alias("truth"), F.when(F.col("o_custkey") % 4 == 0, (F.col("o_orderkey") + 1) % 6).otherwise(F.col("o_orderkey") % 7).alias("pred"))


@query(f"select lab label, (row_number() over (order by try_cast(lab as double) nulls last, lab) - 1)::int target from (select distinct lab from ({_LAB}))")
def label_index(spark, d):
    return M.label_index(table(spark, d, "labels_example"), "label")


@query(
    """with c as (select o_orderpriority, count(*) n from orders group by 1), s as (select *, greatest(1, round_even(n * 0.1, 0)::bigint) v from c)
    select o_orderpriority, n - 2 * v train, v val, v test from s"""
)
def stratified_split_counts(spark, d):
    s = M.stratified_split(table(spark, d, "orders"), "o_orderkey", "o_orderpriority")
    return M.split_distribution(s, "o_orderpriority", "split").withColumnRenamed("label", "o_orderpriority")


@query(
    f"""with l as (select lab label, case when lower(trim(coalesce(split, ''))) in ('train', 'val', 'test') then lower(trim(split)) end s from ({_LAB}))
    select label, array_to_string(list_filter(['train', 'val', 'test'], lambda x: not list_contains(coalesce(list(distinct s) filter (where s is not null), []), x)), ',') missing_splits, count(*) filter (where s is null) unknown_values from l group by 1"""
)
def split_audit(spark, d):
    return M.split_audit(table(spark, d, "labels_example"), "label", "split")


@query(f"select lab label, {', '.join(f'''count(*) filter (where lower(trim(split)) = '{s}') {s}''' for s in M.SPLITS)} from ({_LAB}) group by 1")
def split_distribution(spark, d):
    return M.split_distribution(table(spark, d, "labels_example"), "label", "split")


@query(f"select lab label, count(*) n, round(pow(count(*)::double, -0.5), 9) weight from ({_LAB}) group by 1")
def class_weights(spark, d):
    return M.class_weights(table(spark, d, "labels_example"), "label")


@query(f"with c as (select truth, pred, count(*) n from ({_PAIRS}) group by 1, 2) select *, round(n / sum(n) over (partition by truth)::double, 9) share from c")
def confusion_norm(spark, d):
    return M.confusion(_pairs(spark, d), "truth", "pred")


_REPORT = f"""with p as ({_PAIRS}), k as (select truth c from p union select pred from p), r as (select c, (select count(*) from p where truth = c) s, (select count(*) from p where pred = c) q, (select count(*) from p where truth = c and pred = c) h from k),
 f as (select *, case when q > 0 then h / q::double else 0 end pr, case when s > 0 then h / s::double else 0 end rc from r), g as (select *, case when pr + rc > 0 then 2 * pr * rc / (pr + rc) else 0 end f1 from f)"""


@query(f"{_REPORT} select round(sum(h) / sum(s)::double, 9) accuracy, round(avg(rc) filter (where s > 0), 9) balanced_accuracy, round(avg(f1), 9) macro_f1, round(sum(f1 * s) / sum(s), 9) weighted_f1 from g")
def classification_metrics(spark, d):
    return M.metrics(_pairs(spark, d), "truth", "pred")


@query(f"{_REPORT} select c::bigint \"class\", s support, q predicted, round(pr, 9) \"precision\", round(rc, 9) recall, round(f1, 9) f1 from g")
def class_report(spark, d):
    r = M.class_report(_pairs(spark, d), "truth", "pred")
    return r.select("class", "support", "predicted", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(
    """with z as (select l_orderkey k, l_linenumber c, round(avg(l_quantity / 10), 9) z from lineitem group by 1, 2), e as (select *, exp(z - max(z) over (partition by k)) e from z),
    p as (select k, c, round(e / sum(e) over (partition by k), 9) probability, (row_number() over (partition by k order by z desc, c))::int place from e) select k l_orderkey, c "class", probability, place from p where place <= 3"""
)
def softmax_topk(spark, d):
    logits = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10).alias("z"))
    return M.softmax_top(logits, "l_orderkey", "l_linenumber", "z")


@query(
    """with u as (select label, unnest(range(64)) pos, unnest(list_transform(embedding, lambda x: x::double / sqrt(list_dot_product(embedding::double[], embedding::double[])))) v from embeddings), m as (select label, pos, avg(v) m from u group by 1, 2)
    select label, pos::int pos, round(m / greatest(sqrt(sum(m * m) over (partition by label)), 1e-12), 6) "value" from m"""
)
def embedding_view_mean(spark, d):
    return M.view_mean(table(spark, d, "embeddings"), "label", "embedding")


@query(
    """with e as (select vec_id // 8 b, vec_id % 8 i, embedding::double[] v from embeddings), p as (select a.b, a.i q, c.i it, round(list_dot_product(a.v, list_concat(c.v[2:], c.v[:1])), 9) sim from e a join e c on a.b = c.b),
    t as (select b, q, arg_min(it, (-sim, it)) w from p group by 1, 2) select p.b batch, round(avg(sim) filter (where p.q = it), 6) mean_same, round(avg(sim) filter (where p.q <> it), 6) mean_other, (select round(avg(case when w = t.q then 1.0 else 0.0 end), 9) from t where t.b = p.b) top1 from p group by p.b"""
)
def retrieval_gap(spark, d):
    from siftmill.functions.vector import dot

    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("batch"), (F.col("vec_id") % 8).alias("i"), "embedding")
    o = e.select("batch", F.col("i").alias("item"), F.concat(F.slice("embedding", 2, 63), F.slice("embedding", 1, 1)).alias("v"))  # eight a batch
    p = e.join(o, "batch").select("batch", F.col("i").alias("q"), "item", F.round(dot(F.col("embedding"), F.col("v")), 9).alias("sim"))
    return M.retrieval_gap(p, "batch", "q", "item", "sim")


_HIST = "select c_nationkey run, row_number() over (partition by c_nationkey order by c_custkey) epoch, c_acctbal v from customer"


@query(
    f"""with h as ({_HIST}), a as (select *, max(v) over w b, coalesce(v > max(v) over (partition by run order by epoch rows between unbounded preceding and 1 preceding), true) imp from h window w as (partition by run order by epoch rows unbounded preceding)),
    s as (select *, epoch - max(case when imp then epoch end) over (partition by run order by epoch rows unbounded preceding) stale from a)
    select run, epoch::int epoch, b best_so_far, imp improved, stale::int stale, max(stale) over (partition by run order by epoch rows unbounded preceding) >= 12 stopped from s"""
)
def early_stop_best(spark, d):
    from pyspark.sql import Window as W

    h = table(spark, d, "customer").select(F.col("c_nationkey").alias("run"), F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")).alias("epoch"), F.col("c_acctbal").alias("v"))
    return M.early_stop(h, "run", "epoch", "v", 12)


@query("select e::int epoch, round(case when e < 2 then (e + 1) / 2.0 else 0.5 * (1 + cos(pi() * least(1.0, (e - 2) / 58.0))) end, 9) factor from range(60) t(e)")
def lr_schedule(spark, d):
    return spark.range(60).select(F.col("id").cast("int").alias("epoch"), F.round(M.learning_rate(F.col("id"), 60), 9).alias("factor"))


@query(
    """with c as (select c_mktsegment, count(*) n from customer group by 1), s as (select *, sum(n) over (order by n desc, c_mktsegment rows unbounded preceding) e, sum(n) over () t from c)
    select c_mktsegment, n, round(e / t::double, 9) share_end, round(e / t::double - n / t::double, 9) share_start from s"""
)
def cumulative_share(spark, d):
    c = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return M.cumulative_share(c, "n", [F.desc("n"), F.col("c_mktsegment")])


@query("select l_suppkey, l_orderkey, l_linenumber, place from (select *, (row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber))::int place from lineitem) where place <= 2")
def top_n_per_group(spark, d):
    t = M.top_per_group(table(spark, d, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 2)
    return t.select("l_suppkey", "l_orderkey", "l_linenumber", "place")


# --- event windows: beyond the retrieval application, in batch form of the streaming plans ----------------------------


@query(
    """select strftime(time_bucket(interval 5 minute, ts), '%Y-%m-%d %H:%M:%S') start, event_type, count(*) n, round(avg(value), 6) mean from events group by 1, 2"""
)
def events_tumbling(spark, d):
    w = windows.tumbling(table(spark, d, "events"), "ts", "5 minutes", ["event_type"], "value")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


@query(
    """with e as (select event_id, time_bucket(interval 30 minute, ts) - unnest([interval 0 minute, interval 30 minute]) s, value from events)
    select strftime(s, '%Y-%m-%d %H:%M:%S') start, count(*) n, round(avg(value), 6) mean from e group by 1"""
)
def events_sliding(spark, d):
    w = windows.sliding(table(spark, d, "events"), "ts", "1 hour", "30 minutes", [], "value")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("mean", 6).alias("mean"))


@query(
    """with g as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 30 minute or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end b from events),
    s as (select user_id, ts, sum(b) over (partition by user_id order by ts rows unbounded preceding) k from g) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') start, count(*) n from s group by user_id, k"""
)
def events_session(spark, d):
    w = windows.sessions(table(spark, d, "events"), "ts", "30 minutes", ["user_id"])
    return w.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")

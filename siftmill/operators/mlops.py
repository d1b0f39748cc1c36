"""Labels, splits and measures of classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftmill.functions.text import is_missing
from siftmill.session import numbered

SPLITS = ("train", "val", "test")


def label_index(rows: DataFrame, label: str) -> DataFrame:
    """``(label, target)``: distinct labels from 0, numbers by value before texts."""
    names = rows.where(~is_missing(F.col(label))).select(F.trim(F.col(label)).alias("label")).distinct()
    number = F.col("label").try_cast("double")
    return numbered(names.orderBy(F.asc_nulls_last(number), "label"), "target").select("label", F.col("target").cast("int").alias("target"))


def stratified_split(rows: DataFrame, key: str, target: str, val: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """``(key, target, split)``: in each class, by hash order, round(n * val) and round(n * test) rows (half to even), one of each at
    least, fewer while no row is left to train. Classes of fewer than three rows are called ``too_few``.

    Ranks within a class come from counts by hash bucket, so that a class of any size is never ranked in one task.
    """
    tagged = rows.select(key, F.col(target).alias(target), F.xxhash64(F.col(key), F.lit(seed)).alias("__h")).withColumn("__b", F.shiftrightunsigned("__h", 52))
    counts = tagged.groupBy(target, "__b").agg(F.count("*").alias("n"))
    before = counts.select(target, "__b", (F.sum("n").over(W.partitionBy(target).orderBy("__b")) - F.col("n")).alias("__s"), F.sum("n").over(W.partitionBy(target)).alias("__n"))
    nth = F.row_number().over(W.partitionBy(target, "__b").orderBy("__h", key))
    ranked = tagged.withColumn("__i", nth).join(before, [target, "__b"]).withColumn("__at", F.col("__s") + F.col("__i"))
    n_val, n_test = split_sizes(F.col("__n"), val, test)
    split = F.when(F.col("__n") < 3, "too_few").when(F.col("__at") <= n_val, "val").when(F.col("__at") <= n_val + n_test, "test").otherwise("train")
    return ranked.select(key, target, split.alias("split"))


def split_sizes(n: Column, val: float, test: float) -> tuple[Column, Column]:
    """Rows of validation and test: rounded half to even, at least one, shrunk so that a row is left to train."""
    half_even = lambda share: F.greatest(F.lit(1), F.bround(n * F.lit(share), 0).cast("bigint"))
    v, t = half_even(val), half_even(test)
    over = F.greatest(F.lit(0), v + t - (n - 1))
    # The larger one gives first, the test part of equals.
    from_t = F.least(t - 1, F.ceil((over + F.greatest(F.lit(0), t - v)) / 2))
    from_t = F.when(over > 0, F.greatest(F.lit(0), from_t)).otherwise(F.lit(0))
    return F.greatest(F.lit(1), v - (over - from_t)), F.greatest(F.lit(1), t - from_t)


def split_audit(rows: DataFrame, label: str, split: str) -> DataFrame:
    """``(label, missing_splits, unknown_values)``: splits a class lacks, and rows of it whose split is none of the three."""
    value = F.lower(F.trim(F.coalesce(F.col(split), F.lit(""))))
    known = F.when(value.isin(*SPLITS), value)
    sets = rows.where(~is_missing(F.col(label))).groupBy(F.trim(F.col(label)).alias("label")).agg(F.collect_set(known).alias("have"), F.count_if(known.isNull()).alias("unknown_values"))
    lacks = F.array_join(F.filter(F.array(*[F.lit(s) for s in SPLITS]), lambda s: ~F.array_contains("have", s)), ",")
    return sets.select("label", lacks.alias("missing_splits"), "unknown_values")


def split_distribution(rows: DataFrame, label: str, split: str) -> DataFrame:
    """``(label, train, val, test)``: counts, zeros included."""
    value = F.lower(F.trim(F.col(split)))
    return rows.where(~is_missing(F.col(label))).groupBy(F.trim(F.col(label)).alias("label")).agg(*[F.count_if(value == s).alias(s) for s in SPLITS])


def class_weights(rows: DataFrame, label: str, power: float = 0.5) -> DataFrame:
    """``(label, n, weight)``: count to the power of -power; 1 if power is 0 or less."""
    counts = rows.where(~is_missing(F.col(label))).groupBy(F.trim(F.col(label)).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("weight", F.round(F.pow(F.col("n").cast("double"), F.lit(-power)), 9) if power > 0 else F.lit(1.0))


def confusion(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    """``(truth, pred, n, share)``: share of the truth's row."""
    cells = rows.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return cells.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("truth")), 9))


def class_report(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    """``(class, support, predicted, precision, recall, f1)``: 0 where nothing divides."""
    cells = rows.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    sides = F.explode(F.array(F.struct(F.col("t").alias("class"), F.col("n").alias("s"), F.lit(0).cast("bigint").alias("q")), F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("s"), F.col("n").alias("q"))))
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    per = cells.select(sides.alias("x"), hit.alias("h")).groupBy("x.class").agg(F.sum("x.s").alias("support"), F.sum("x.q").alias("predicted"), (F.sum("h") / 2).alias("hit"))
    div = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    per = per.withColumn("precision", div(F.col("hit"), F.col("predicted"))).withColumn("recall", div(F.col("hit"), F.col("support")))
    return per.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))


def metrics(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: accuracy, balanced accuracy (mean recall of classes in the truth), macro and weighted F1."""
    per = class_report(rows, truth, pred)
    return per.agg(
        F.round(F.sum("hit") / F.sum("support"), 9).alias("accuracy"),
        F.round(F.avg(F.when(F.col("support") > 0, F.col("recall"))), 9).alias("balanced_accuracy"),
        F.round(F.avg("f1"), 9).alias("macro_f1"),
        F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 9).alias("weighted_f1"),
    )


def softmax_top(logits: DataFrame, key: str, cls: str, logit: str, k: int = 3) -> DataFrame:
    """``(key, class, probability, place)``: logits averaged over views, softmax, the k most likely classes."""
    mean = logits.groupBy(key, cls).agg(F.round(F.avg(logit), 9).alias("z"))
    whole = W.partitionBy(key)
    shifted = mean.withColumn("e", F.exp(F.col("z") - F.max("z").over(whole)))
    prob = shifted.withColumn("probability", F.round(F.col("e") / F.sum("e").over(whole), 9))
    placed = prob.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.desc("z"), cls)))
    return placed.where(F.col("place") <= k).select(key, F.col(cls).alias("class"), "probability", "place")


def view_mean(views: DataFrame, key: str, vector: str) -> DataFrame:
    """``(key, pos, value)``: mean of the views' unit vectors, made a unit vector again, one row a position."""
    from siftmill.functions.vector import normalise

    cells = views.select(key, F.posexplode(normalise(F.col(vector))).alias("pos", "v")).groupBy(key, "pos").agg(F.avg("v").alias("m"))
    length = F.greatest(F.sqrt(F.sum(F.col("m") * F.col("m")).over(W.partitionBy(key))), F.lit(1e-12))
    return cells.select(key, "pos", F.round(F.col("m") / length, 6).alias("value"))


def retrieval_gap(pairs: DataFrame, batch: str, query: str, item: str, sim: str) -> DataFrame:
    """``(batch, mean_same, mean_other, top1)``: of each batch's similarity matrix the diagonal's mean, the others' mean, and the
    share of queries whose best item is their own."""
    best = pairs.groupBy(batch, query).agg(F.max_by(item, F.struct(sim, -F.col(item))).alias("b"))
    hit = best.groupBy(batch).agg(F.round(F.avg((F.col("b") == F.col(query)).cast("double")), 9).alias("top1"))
    same = F.col(query) == F.col(item)
    mean = pairs.groupBy(batch).agg(F.round(F.avg(F.when(same, F.col(sim))), 6).alias("mean_same"), F.round(F.avg(F.when(~same, F.col(sim))), 6).alias("mean_other"))
    return mean.join(hit, batch)


def early_stop(history: DataFrame, run: str, epoch: str, value: str, patience: int) -> DataFrame:
    """``(run, epoch, best_so_far, improved, stale, stopped)``: an epoch improves on all before it strictly; training stops once
    ``patience`` epochs in a row didn't."""
    past = W.partitionBy(run).orderBy(epoch).rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(run).orderBy(epoch).rowsBetween(W.unboundedPreceding, 0)
    better = F.coalesce(F.col(value) > F.max(value).over(past), F.lit(True))
    rows = history.withColumn("improved", better).withColumn("best_so_far", F.max(value).over(upto)).withColumn("__n", F.row_number().over(W.partitionBy(run).orderBy(epoch)))
    rows = rows.withColumn("stale", F.col("__n") - F.max(F.when(F.col("improved"), F.col("__n"))).over(upto))
    return rows.select(run, epoch, "best_so_far", "improved", "stale", (F.max("stale").over(upto) >= patience).alias("stopped"))


def learning_rate(epoch: Column, epochs: int, warm: int = 2) -> Column:
    """Factor of the base rate: linear warm-up, then half a cosine."""
    progress = (epoch - warm) / max(1, epochs - warm)
    return F.when(epoch < warm, (epoch + 1) / max(1, warm)).otherwise(0.5 * (1 + F.cos(F.lit(3.141592653589793) * F.least(F.lit(1.0), progress))))


def cumulative_share(rows: DataFrame, value: str, order: list) -> DataFrame:
    """``rows`` with the share of the total where each begins and ends; for charts of a few rows."""
    upto = W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    total = F.nullif(F.sum(value).over(W.partitionBy()).cast("double"), F.lit(0.0))
    end = F.sum(value).over(upto) / total
    return rows.withColumn("share_end", F.round(end, 9)).withColumn("share_start", F.round(end - F.col(value) / total, 9))


def top_per_group(rows: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("place") <= n)

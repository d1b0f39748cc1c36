"""Similarity of images and records by their vectors, catalogues, and what can be told from pixel rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftmill.functions.vector import dot
from siftmill.session import is_small

#: Query images of one request.
MAX_QUERIES = 100
# Fixed values of the scores.
STRONG = 0.84


def similarities(images: DataFrame, queries: DataFrame, vector: str, query_vector: str) -> DataFrame:
    """Each image with each query image and their dot product ``sim``. ``queries`` are the few images of one request (more
    than ``MAX_QUERIES`` are refused) and are broadcast; images are scanned once."""
    if not is_small(queries, MAX_QUERIES):
        raise ValueError("too many query images")
    return images.crossJoin(F.broadcast(queries)).withColumn("sim", dot(F.col(vector), F.col(query_vector)))


def mean_per_entity(sims: DataFrame, entity: str, image: str) -> DataFrame:
    """One query image: ``(entity, average_similarity, best_image, n_images)``; similarities are rounded to six places
    before they are averaged."""
    s = F.round("sim", 6)
    return sims.groupBy(entity).agg(F.round(F.avg(s), 6).alias("average_similarity"), F.max_by(image, F.struct(s, -F.col(image))).alias("best_image"), F.count("*").alias("n_images"))


def max_then_mean(sims: DataFrame, entity: str, query: str, n_queries: int) -> DataFrame:
    """Several query images: mean over queries of the best similarity of any image; records must have one for every
    query."""
    best = sims.groupBy(entity, query).agg(F.max("sim").alias("m"))
    return best.groupBy(entity).agg(F.avg("m").alias("score"), F.count("*").alias("n")).where(F.col("n") == n_queries).drop("n")


def max_sim(sims: DataFrame, entity: str, kind: str, query: str, n_queries: int) -> DataFrame:
    """Multivector score: for each kind of image the mean over queries of the best similarity; of the kinds the best."""
    best = sims.groupBy(entity, kind, query).agg(F.max("sim").alias("m"))
    per_kind = best.groupBy(entity, kind).agg((F.sum("m") / n_queries).alias("s"))
    return per_kind.groupBy(entity).agg(F.max("s").alias("score"))


def over_fetch(limit: int) -> int:
    """Candidates fetched for each kind before they are grouped."""
    return min(max(4 * limit, 100), 1000)


def numbered(hits: DataFrame, score: str, key: str) -> DataFrame:
    """Rank by score, then key. For lists already cut to size."""
    return hits.withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), key)))


def best_rotation(sims: DataFrame, query_block: str, record: str, block: str, rotation: str) -> DataFrame:
    """Of each query region and record region the best of the rotations; then of each query region and record the best
    region: ``(query_block, record, block, rotation, sim)``. Ties go to the lesser rotation and region."""
    turned = sims.groupBy(query_block, record, block).agg(F.max(F.struct(F.col("sim"), -F.col(rotation))).alias("x"))
    turned = turned.select(query_block, record, block, F.col("x.sim").alias("sim"), (-F.col("x.col2")).alias(rotation))
    best = turned.groupBy(query_block, record).agg(F.max(F.struct(F.col("sim"), -F.col(block), -F.col(rotation))).alias("x"))
    return best.select(query_block, record, (-F.col("x.col2")).alias(block), (-F.col("x.col3")).alias(rotation), F.col("x.sim").alias("sim"))


def local_scores(best: DataFrame, record: str, n_blocks: int, base: Column | None = None, geometry: Column | None = None, manual: bool = False) -> DataFrame:
    """``(record, peak, top3, coverage, local, final)`` from the best similarity of each query region.

    ``base`` and ``geometry`` are the record's whole-image and shape scores, columns of ``best`` that are equal
    throughout a record.
    """
    sims = F.sort_array(F.collect_list("sim"), asc=False)  # as many as query regions, three at most by request
    rows = best.groupBy(record).agg(
        F.max("sim").alias("peak"),
        F.slice(sims, 1, 3).alias("__s"),
        (F.count_if(F.col("sim") >= STRONG) / n_blocks).alias("coverage"),
        F.max(base if base is not None else F.lit(0.0)).alias("__b"),
        F.max(geometry if geometry is not None else F.lit(0.0)).alias("__g"),
    )
    top3 = F.aggregate("__s", F.lit(0.0), lambda s, x: s + x) / F.size("__s")
    rows = rows.withColumn("top3", top3)
    rows = rows.withColumn("local", F.greatest(0.94 * F.col("peak"), 0.72 * F.col("top3") + 0.28 * F.col("coverage")))
    w = F.least(F.lit(0.12), 0.12 * F.col("coverage"))
    auto = (0.22 - w / 2) * F.col("__b") + (0.70 + w / 2) * F.col("local") + 0.08 * F.col("__g")
    final = 0.10 * F.col("__b") + 0.85 * F.col("local") + 0.05 * F.col("__g") if manual else auto
    six = lambda c: F.round(c, 6)
    return rows.select(record, six("peak").alias("peak"), six("top3").alias("top3"), six("coverage").alias("coverage"), six("local").alias("local"), six(final).alias("final"))


def geometry_similarity(hist_a: Column, hist_b: Column, ratio_a: Column, ratio_b: Column) -> Column:
    """Shape likeness: cosine of radial histograms and closeness of defect ratios, floored at 1e-8."""
    norm = lambda h: F.greatest(F.sqrt(dot(h, h)), F.lit(1e-12))
    gap = F.abs(F.ln(F.greatest(ratio_a, F.lit(1e-8)) / F.greatest(ratio_b, F.lit(1e-8))))
    return 0.75 * dot(hist_a, hist_b) / (norm(hist_a) * norm(hist_b)) + 0.25 * F.exp(-gap)


def ring_vectors(rings: DataFrame, image: str, bins: int = 8) -> DataFrame:
    """``(image, rings)``: the shares of ``radial_histogram`` as one array, 0 for rings without defects."""
    some = rings.groupBy(image).agg(F.map_from_entries(F.collect_list(F.struct("bin", "share"))).alias("__m"))  # as many as rings
    return some.select(image, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("__m", i), F.lit(0.0))).alias("rings"))


def geometry_scores(maps: DataFrame, queries: DataFrame, record: str, query: str) -> DataFrame:
    """``(record, geometry)``: for each query map the likest of the record's maps in shape, 0 at least; of the queries the mean.

    ``maps(record, rings, ratio)``, ``queries(query, rings, ratio)``; queries are those of one request (more than
    ``MAX_QUERIES`` are refused) and are broadcast.
    """
    if not is_small(queries, MAX_QUERIES):
        raise ValueError("too many query maps")
    asked = queries.select(F.col(query).alias("__q"), F.col("rings").alias("__rings"), F.col("ratio").alias("__ratio"))
    like = geometry_similarity(F.col("rings"), F.col("__rings"), F.col("ratio"), F.col("__ratio"))
    best = maps.crossJoin(F.broadcast(asked)).groupBy(record, "__q").agg(F.greatest(F.max(like), F.lit(0.0)).alias("b"))
    return best.groupBy(record).agg(F.avg("b").alias("geometry"))


def request_blocks(blocks: DataFrame, request: list[str], query: str, block: str) -> DataFrame:
    """``blocks`` with ``display_id``, one number for each region of a request, from 1, by query image and region. A request's
    regions are few."""
    return blocks.withColumn("display_id", F.row_number().over(W.partitionBy(*request).orderBy(query, block)))


def defect_pixel(r: Column, g: Column, b: Column) -> Column:
    """Whether a pixel is of the red that marks defects: vivid, or muted. Fixed values."""
    vivid = (r >= 125) & (r >= g + 25) & (r >= b + 25)
    muted = (r >= 75) & (r >= g + 10) & (r >= b + 8) & (g <= 0.93 * r)
    return vivid | muted


def radial_histogram(pixels: DataFrame, image: str, x: str, y: str, width: Column, height: Column, bins: int = 8) -> DataFrame:
    """``(image, bin, share)``: shares of defect pixels in equal rings around the picture's middle, out to its corners; the
    last ring is closed.

    ``pixels`` are the defect pixels with their picture's ``width`` and ``height``. One aggregation over pictures and rings.
    """
    cx, cy = (width - 1) / 2, (height - 1) / 2
    radius = F.sqrt(F.pow(F.col(x) - cx, 2) + F.pow(F.col(y) - cy, 2)) / F.greatest(F.sqrt(cx * cx + cy * cy), F.lit(1.0))
    ring = F.when(radius <= 1, F.least(F.floor(radius * bins), F.lit(bins - 1))).cast("int")
    rings = pixels.select(image, ring.alias("bin")).where("bin is not null").groupBy(image, "bin").agg(F.count("*").alias("n"))
    return rings.select(image, "bin", F.round(F.col("n") / F.sum("n").over(W.partitionBy(image)), 9).alias("share"))


def grid_dispersion(pixels: DataFrame, image: str, x: str, y: str, width: Column, height: Column) -> DataFrame:
    """``(image, x_span, y_span, active_cells, dispersion, spread_all_over)``: a 3x3 grid over the picture; a cell is active
    with six per cent of the defect pixels (four at least); dispersion is the entropy over ln 9. The spans are those of the
    5th to 95th percentile, as shares of the picture's sides. One aggregation: nine counts a picture, and the coordinates'
    own counts, which are no more than a picture's side."""
    size = {x: F.greatest(width, F.lit(1)), y: F.greatest(height, F.lit(1))}
    cell = {c: F.least(F.lit(2), F.floor(F.col(c) * 3 / n)).cast("int") for c, n in size.items()}
    placed = pixels.select(image, x, y, size[x].alias("__w"), size[y].alias("__h"), (3 * cell[y] + cell[x]).alias("__cell"))
    spans = [F.percentile(c, q).alias(f"{n}{i}") for c, n in ((x, "x"), (y, "y")) for i, q in ((0, 0.05), (1, 0.95))]
    one = placed.groupBy(image).agg(F.count("*").alias("n"), F.max("__w").alias("w"), F.max("__h").alias("h"), *spans, *[F.count_if(F.col("__cell") == i).alias(f"k{i}") for i in range(9)])
    counts = F.array(*[F.col(f"k{i}") for i in range(9)])
    share = lambda k: k / F.col("n")
    entropy = F.aggregate(counts, F.lit(0.0), lambda s, k: s - F.when(k > 0, share(k) * F.ln(share(k))).otherwise(0.0))
    active = F.size(F.filter(counts, lambda k: k >= F.greatest(F.lit(4), F.ceil(F.col("n") * 0.06))))
    told = one.select(image, ((F.col("x1") - F.col("x0") + 1) / F.col("w")).alias("x_span"), ((F.col("y1") - F.col("y0") + 1) / F.col("h")).alias("y_span"), active.alias("active_cells"), (entropy / F.ln(F.lit(9.0))).alias("d"))
    six = lambda c: F.round(c, 6)
    return told.select(image, six("x_span").alias("x_span"), six("y_span").alias("y_span"), "active_cells", six("d").alias("dispersion"), ((F.col("active_cells") == 9) & (F.col("d") >= 0.93)).alias("spread_all_over"))


def box_coverage(pixels: DataFrame, boxes: DataFrame, image: str, x: str, y: str) -> DataFrame:
    """``(image, coverage)``: share of the defect pixels that lie in any box. ``boxes(image, left, top, right, bottom)`` has three a
    picture at most, kept as an array beside each pixel row."""
    own = boxes.groupBy(image).agg(F.collect_list(F.struct("left", "top", "right", "bottom")).alias("__b"))
    inside = F.exists("__b", lambda b: (F.col(x) >= b["left"]) & (F.col(x) < b["right"]) & (F.col(y) >= b["top"]) & (F.col(y) < b["bottom"]))
    return pixels.join(own, image, "left").groupBy(image).agg(F.round(F.avg(F.coalesce(inside, F.lit(False)).cast("double")), 6).alias("coverage"))


def catalogue_status(images: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """``(measure, n)``: records with images, and images of each role, zeros included."""
    aggs = [F.count_distinct("dn_no").alias("records"), *[F.count_if(F.col("image_type") == r).alias(r) for r in roles]]
    wide = images.agg(*aggs)
    names = ("records", *roles)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("n")) for n in names])).alias("x")).select("x.measure", "x.n")

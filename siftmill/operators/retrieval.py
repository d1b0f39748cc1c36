"""Text search: term statistics, BM25, character-pair cosine, dense scores, rank fusion and reranking.

The query side is always a handful of rows built on the driver; the texts of the corpus are cut once for each channel and
the corpus is never joined with itself.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftmill.functions.asked import conditions, is_exact
from siftmill.functions.bind import let
from siftmill.functions.text import fold_code
from siftmill.functions.tokens import char_pairs, expand, sanitize, tokens
from siftmill.functions.vector import cosine, literal
from siftmill.operators.facets import exact_or_squeezed
from siftmill.operators.skew import lookup
from siftmill.session import broadcast_if_small, materialise, spread

# Fixed values of the ranking.
K1, B = 1.5, 0.75
RRF_K = 60
CHANNELS = {"dense": 0.45, "lexical": 0.30, "bigram": 0.15, "field": 0.10}
RECALL_K, MAX_RECALL = 50, 5_000
MIN_DENSE = 0.5
BLEND = {"base": 0.50, "field": 0.35, "overlap": 0.10, "grain": 0.05}
FIELD_WEIGHTS = {"dn_no": 3.0, "lot_id": 2.5, "machine": 2.0, "product_id": 1.8, "platform": 1.6, "station": 1.5, "defect_type": 1.8, "map_location": 1.3, "dft_location": 1.3}
GRAIN_WEIGHTS = {"defect_focus": 1.0, "machine_focus": 0.9, "summary": 0.8, "keywords": 0.8, "natural_language": 0.7, "full": 0.6}
UNKNOWN_GRAIN = 0.5


def split_query(spark: SparkSession, query: str, terms: Column) -> list[str]:
    """The terms of one query, by the same expression as the corpus'; one row goes to the driver."""
    return spark.range(1).select(F.lit(query).alias("q")).select(terms.alias("t")).first()["t"]


def document_frequency(corpus: DataFrame, terms: Column) -> DataFrame:
    """``(term, df)``: repeated terms of one document count once, before they are exploded."""
    return spread(corpus).select(F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _is(word: str) -> Callable[[Column], Column]:
    return lambda x: x == word


def bm25(corpus: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """``(key, score)`` of documents that hold a term of the query; each distinct term counts once.

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)); the mean length is 1 at least. NULL texts are empty documents and count.
    Texts are cut once; the statistics are one aggregation over numbers, of which one row goes to the driver.
    """
    wanted = list(dict.fromkeys(split_query(corpus.sparkSession, query, tokens(F.col("q")))))
    if not wanted:
        return corpus.select(key, F.lit(0.0).alias("score")).limit(0)
    counts = let(tokens(F.col(text)), lambda t: F.struct(F.size(t).alias("dl"), F.array(*[F.size(F.filter(t, _is(w))) for w in wanted]).alias("tf")))
    counted = materialise(spread(corpus.select(key, text)).select(key, counts.alias("c")).select(key, "c.dl", "c.tf"), "counted")
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("a"), *[F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(wanted))]).first()
    length = F.lit(1.0) - B + F.lit(B) * F.col("dl") / max(stats["a"] or 0.0, 1.0)
    score = F.lit(0.0)
    for i in range(len(wanted)):
        df, tf = stats[f"df{i}"], F.col("tf")[i]
        score = score + F.ln(F.lit(1 + (stats["n"] - df + 0.5) / (df + 0.5))) * tf * (K1 + 1) / (tf + K1 * length)
    return counted.where(F.exists("tf", lambda n: n > 0)).select(key, score.alias("score")).where("score > 0")


@dataclass
class PairIndex:
    """What a corpus' character pairs weigh, for any number of queries: ``idf(term, n, idf)``, ``norms(key, norm)``, ``pairs(key, terms)``."""

    idf: DataFrame
    norms: DataFrame
    pairs: DataFrame


def pair_index(corpus: DataFrame, key: str, text: str) -> PairIndex:
    """idf = ln(N / (1 + df)), which may be negative, and the length of each document's vector, in which each of its pairs
    stands once. Texts are cut once; pairs that stand in very many documents meet their idf by broadcast, so that no task gets
    all documents of a pair."""
    pairs = materialise(spread(corpus.select(key, text)).select(key, F.array_distinct(char_pairs(F.col(text))).alias("terms")), "pairs")
    total = pairs.count()
    terms = pairs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    idf = materialise(terms.select("term", "n", F.ln(F.lit(float(total)) / (1 + F.col("n"))).alias("idf")), "idf")
    each = pairs.select(key, F.explode("terms").alias("term"))
    small = broadcast_if_small(idf)
    weighed = each.join(small.drop("n"), "term") if small is not idf else lookup(each, idf, ["term"], "n", F.col(key))
    norms = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    return PairIndex(idf, materialise(norms, "norms"), pairs)


def tfidf(corpus: DataFrame, key: str, text: str, query: str, index: PairIndex | None = None) -> DataFrame:
    """``(key, score)``: cosine over character pairs, weighted by ``pair_index`` (built here if none is given).

    A document holds each of its pairs once, the query as often as it stands there. Only documents of positive
    score are returned.
    """
    asked: dict[str, int] = {}
    for pair in split_query(corpus.sparkSession, query, char_pairs(F.col("q"))):
        asked[pair] = asked.get(pair, 0) + 1
    index = index or pair_index(corpus, key, text)
    known = {r.term: r.idf for r in index.idf.where(F.col("term").isin(*asked)).collect()} if asked else {}  # as many as the query has pairs
    length = sum((asked[t] * w) ** 2 for t, w in known.items()) ** 0.5
    if not length:
        return corpus.select(key, F.lit(0.0).alias("score")).limit(0)
    weights = F.create_map(*[x for t, w in known.items() for x in (F.lit(t), F.lit(asked[t] * w * w))])
    met = F.array_intersect("terms", F.array(*[F.lit(t) for t in known]))
    dot = F.aggregate(met, F.lit(0.0), lambda s, t: s + F.try_element_at(weights, t))
    hits = index.pairs.select(key, dot.alias("dot")).where("dot > 0")
    return hits.join(index.norms, key).where("norm > 0").select(key, (F.col("dot") / (F.col("norm") * length)).alias("score")).where("score > 0")


def pair_cosine(corpus: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """``(key, score)`` of every document: cosine of raw pair counts, 0 where nothing is shared; no threshold."""
    spark = corpus.sparkSession
    asked: dict[str, int] = {}
    for pair in split_query(spark, query, char_pairs(F.col("q"))):
        asked[pair] = asked.get(pair, 0) + 1
    qnorm = sum(c * c for c in asked.values()) ** 0.5
    # A document without pairs keeps one row without a term.
    tf = spread(corpus.select(key, text)).select(key, F.explode_outer(char_pairs(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("term").alias("tf"))
    weight = F.coalesce(*[F.when(F.col("term") == t, F.lit(float(c))) for t, c in asked.items()], F.lit(0.0))
    dots = tf.groupBy(key).agg(F.sum(weight * F.col("tf")).alias("d"), F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("n"))
    score = F.when((F.col("n") > 0) & F.lit(qnorm > 0), F.col("d") / (F.col("n") * F.lit(qnorm or 1.0))).otherwise(0.0)
    return dots.select(key, F.coalesce(score, F.lit(0.0)).alias("score"))


def dense(vectors: DataFrame, key: str, vector: str, query: Sequence[float], least: float = MIN_DENSE) -> DataFrame:
    """``(key, score)``: cosine with one query vector, ``least`` or more."""
    return vectors.select(key, cosine(F.col(vector), literal(query)).alias("score")).where(F.col("score") >= least)


def top(hits: DataFrame, key: str, k: int) -> DataFrame:
    return hits.orderBy(F.desc("score"), key).limit(k)


def ranked(hits: DataFrame, key: str) -> DataFrame:
    """``hits`` with 1-based ranks by score and key. Meant for lists already cut to their first k."""
    return hits.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), key)))


def fuse_ranks(channels: Mapping[str, DataFrame], key: str, weights: Mapping[str, float] = CHANNELS, k: int = RECALL_K) -> DataFrame:
    """``(key, score, channels)``: weighted reciprocal-rank sum over the first ``k`` of each channel. Scores are compared to
    nine places, so that the order in which parts were added decides nothing."""
    union = None
    for name, hits in channels.items():
        one = ranked(top(hits.withColumn("score", F.round("score", 9)), key, k), key).select(key, F.lit(name).alias("channel"), F.lit(weights[name]).alias("w"), "rank")
        union = one if union is None else union.unionByName(one)
    return union.groupBy(key).agg(F.sum(F.col("w") / (RRF_K + F.col("rank"))).alias("score"), F.array_sort(F.collect_list("channel")).alias("channels"))


def field_score(conditions: Mapping[str, str], compat: bool = False) -> Column:
    """Weighted share of conditions a record meets: full for equality, 0.7 if either value holds the other. A missing
    value earns nothing, unless ``compat``."""
    squeeze = lambda c: F.lower(F.regexp_replace(fold_code(F.coalesce(c, F.lit(""))), r"[\s:=,。;()\[\]{}，；：（）]", ""))
    total = sum(FIELD_WEIGHTS.get(f, 1.0) for f in conditions)
    score = F.lit(0.0)
    for f, v in conditions.items():
        mine, asked = squeeze(F.col(f)), squeeze(F.lit(v))
        inside = (mine.contains(asked) | asked.contains(mine)) & (F.lit(compat) | (mine != ""))
        score = score + F.when(mine == asked, 1.0).when(inside, 0.7).otherwise(0.0) * FIELD_WEIGHTS.get(f, 1.0)
    return score / max(total, 1.0)


def overlap_score(text: Column, query_tokens: Sequence[str]) -> Column:
    """Share of the query's distinct tokens that a text has."""
    asked = sorted(set(query_tokens))
    if not asked:
        return F.lit(0.0)
    return F.size(F.array_intersect(F.array(*[F.lit(t) for t in asked]), tokens(text))) / len(asked)


def grain_score(grains: Column) -> Column:
    """Highest weight of a record's grains; a grain without a weight has 0.5, no grain 0."""
    table = F.create_map(*[F.lit(x) for kv in GRAIN_WEIGHTS.items() for x in kv])
    weights = F.transform(grains, lambda g: F.coalesce(F.try_element_at(table, g), F.lit(UNKNOWN_GRAIN)))
    return F.coalesce(F.array_max(weights), F.lit(0.0))


def rerank(hits: DataFrame, field: Column, overlap: Column, grain: Column) -> DataFrame:
    """``hits`` with ``final``: base score over the highest one (0 if that is 0), blended with three features."""
    best = F.max("score").over(W.partitionBy())
    base = F.coalesce(F.col("score") / F.nullif(best, F.lit(0.0)), F.lit(0.0))
    final = BLEND["base"] * base + BLEND["field"] * field + BLEND["overlap"] * overlap + BLEND["grain"] * grain
    return hits.withColumn("final", final)


def page_after(hits: DataFrame, key: str, predicate: Column, offset: int, limit: int) -> DataFrame:
    """A page of those of the best max(offset + limit, 500) hits that meet the predicate: fewer may be left."""
    kept = top(hits, key, max(offset + limit, 500)).where(predicate)
    return kept.orderBy(F.desc("score"), key).offset(offset).limit(limit)


def replace_scores(hits: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """``hits`` whose score is the local one where there is one; others keep theirs. No hit is added."""
    return hits.join(local.select(key, "final"), key, "left").select(key, F.coalesce("final", "score").alias("score"), F.col("final").isNotNull().alias("has_regions"))


def by_metric(hits: DataFrame, metric: str, key: str) -> DataFrame:
    """A list of results put in order of a chosen metric; a missing one is 0."""
    some = hits.withColumn("metric", F.coalesce(F.col(metric), F.lit(0)).cast("double"))
    return some.withColumn("place", F.row_number().over(W.orderBy(F.desc("metric"), key)))


def route(questions: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, conditions, mode)`` of a log of questions: the field values each names and how it would be answered."""
    told = spread(questions.select(F.col(key), F.col(text).alias("__text"))).withColumn("conditions", conditions(F.col("__text")))
    return told.select(key, "conditions", F.when(is_exact(F.col("__text"), F.col("conditions")), "exact").otherwise("hybrid").alias("mode"))


def hybrid(
    corpus: DataFrame,
    query: str,
    asked: Mapping[str, str],
    vectors: DataFrame | None = None,
    query_vector: Sequence[float] | None = None,
    k: int = RECALL_K,
    index: PairIndex | None = None,
) -> DataFrame:
    """``(record_id, score, channels, final)``, unordered: the first ``k`` of each channel fused by rank and reranked.

    ``corpus(record_id, text_content, matched_grains?, fields)`` has one row a record. Channels are words, character pairs of
    the question with the words of its phrases, vectors (where they are given) and the records that meet the conditions
    ``asked``, exactly or else squeezed. Reranking goes by fused score, conditions, shared tokens and grains.
    """
    spark = corpus.sparkSession
    wide = spark.range(1).select(F.lit(query).alias("q")).select(expand(F.col("q")).alias("e")).first()["e"]
    channels = {"lexical": bm25(corpus, "record_id", "text_content", wide), "bigram": tfidf(corpus, "record_id", "text_content", wide, index)}
    if vectors is not None and query_vector is not None:
        channels["dense"] = dense(vectors, "record_id", "vector", query_vector)
    if asked:
        named = corpus.select("record_id", *asked)
        channels["field"] = exact_or_squeezed(named, asked, "record_id", "record_id", k).select("record_id", F.lit(1.0).alias("score"))
    fused = materialise(fuse_ranks(channels, "record_id", k=k), "fused")
    rows = corpus.join(F.broadcast(fused), "record_id")  # at most k rows a channel, k at most MAX_RECALL
    grain = grain_score(F.col("matched_grains")) if "matched_grains" in corpus.columns else F.lit(0.0)
    field = field_score(asked) if asked else F.lit(0.0)
    return rerank(rows, field, overlap_score(F.col("text_content"), split_query(spark, query, tokens(F.col("q")))), grain)


def asked_for(spark: SparkSession, query: str) -> str:
    """A question as it is searched for: folded, without question and exclamation marks, case kept."""
    return spark.range(1).select(F.lit(query).alias("q")).select(sanitize(F.col("q")).alias("s")).first()["s"]

"""Ranking metrics per query, their means and regressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def evaluate(rankings: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Per query of qrels: n_relevant, recall, precision (denominator k), reciprocal rank, average precision, nDCG, hit, missed, noise.

    rankings (query_id, id, rank): of an id that comes twice the first place counts. qrels (query_id, id, gain), gain > 0.
    """
    judged = qrels.where("gain > 0").groupBy("query_id", "id").agg(F.max("gain").cast("double").alias("gain"))
    ideal_place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("gain").desc(), "id"))
    ideal = judged.withColumn("place", ideal_place).groupBy("query_id").agg(F.count("*").alias("n_relevant"), F.sum(F.when(F.col("place") <= k, F.col("gain") / F.log2(F.col("place") + 1))).alias("ideal"))
    joined = _cut(rankings, k).join(judged.hint("merge"), ["query_id", "id"], "full")
    ids = lambda test: F.array_join(F.array_sort(F.collect_list(F.when(test, F.col("id")))).cast("array<string>"), ",")
    is_hit = F.col("gain").isNotNull() & F.col("rank").isNotNull()
    sums = _sums(joined, ids(is_hit).alias("hit"), ids(F.col("rank").isNull()).alias("missed"), ids(F.col("gain").isNull()).alias("noise"))
    return _values(ideal.join(sums.hint("merge"), "query_id"), k, "hit", "missed", "noise")


def evaluate_counted(rankings: DataFrame, found: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """`evaluate` without the lists, where all gains are 1 and the number of relevant ids of a query is known.

    found (query_id, id): the ranked ids that are relevant; relevant (query_id, n_relevant), n_relevant > 0, names all judged
    queries. So nothing is made of what is relevant and not ranked.
    """
    sums = _sums(_cut(rankings, k).join(found.select("query_id", "id", F.lit(1.0).alias("gain")).distinct().hint("merge"), ["query_id", "id"], "left"))
    best = F.array(*(F.lit(sum(1 / math.log2(i + 1) for i in range(1, n + 1))) for n in range(1, k + 1)))
    ideal = relevant.withColumn("ideal", F.get(best, F.least(F.col("n_relevant"), F.lit(k)).cast("int") - 1))
    return _values(ideal.join(sums.hint("merge"), "query_id", "left"), k)


def _cut(rankings: DataFrame, k: int) -> DataFrame:
    first = rankings.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id"))
    return first.withColumn("rank", place).where(F.col("rank") <= k)


def _sums(joined: DataFrame, *more: Column) -> DataFrame:
    """Per query of (query_id, id, rank, gain)."""
    hits = F.sum(F.when(F.col("gain").isNotNull() & F.col("rank").isNotNull(), 1).otherwise(0)).over(Window.partitionBy("query_id").orderBy(F.col("rank").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    marked = joined.withColumn("running", hits).withColumn("is_hit", F.col("gain").isNotNull() & F.col("rank").isNotNull())
    return marked.groupBy("query_id").agg(
        F.count_if("is_hit").alias("hits"), F.min(F.when(F.col("is_hit"), F.col("rank"))).alias("first_hit"),
        F.sum(F.when(F.col("is_hit"), F.col("running") / F.col("rank"))).alias("precisions"), F.sum(F.when(F.col("is_hit"), F.col("gain") / F.log2(F.col("rank") + 1))).alias("dcg"), *more,
    )


def _values(out: DataFrame, k: int, *more: str) -> DataFrame:
    value = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return out.select(
        "query_id", "n_relevant", value(F.col("hits") / F.col("n_relevant")).alias("recall"), value(F.col("hits") / F.lit(max(k, 1))).alias("precision"),
        value(1 / F.col("first_hit")).alias("mrr"), value(F.col("precisions") / F.col("n_relevant")).alias("map"), value(F.col("dcg") / F.col("ideal")).alias("ndcg"), *more,
    )


def means(per_query: DataFrame, queries: DataFrame, by: list[str] = ()) -> DataFrame:
    """Means over the queries with labels; the others are counted as skipped."""
    joined = queries.join(per_query.hint("merge"), "query_id", "left")
    values = [F.round(F.avg(c), 6).alias(c) for c in ("recall", "precision", "mrr", "map", "ndcg")]
    return joined.groupBy(*by).agg(F.count("recall").alias("evaluated"), F.count_if(F.col("recall").isNull()).alias("skipped"), *values)


def deltas(by_config: DataFrame, baseline: str = "bm25-only") -> DataFrame:
    """Each configuration minus the baseline; one row a configuration, so the window is that small."""
    own = Window.partitionBy()
    base = lambda c: F.max(F.when(F.col("config") == baseline, F.col(c))).over(own)
    return by_config.select("config", *[F.round(F.col(c) - base(c), 6).alias(f"d_{c}") for c in ("recall", "ndcg", "mrr")])


def regressions(by_config: DataFrame, floors: dict[str, float]) -> DataFrame:
    """(config, metric, value, floor) of the metrics below their floors."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(f).alias("floor")) for m, f in floors.items()])
    return by_config.select("config", F.inline(pairs)).where(F.col("value") < F.col("floor"))


def failures(per_query: DataFrame) -> DataFrame:
    """Queries that missed something, worst first."""
    return per_query.where("recall < 1").orderBy("recall", "mrr", "query_id")

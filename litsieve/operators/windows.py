"""Ranking, retention and budget operators written as windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(scored: DataFrame, by: list[str], order: list, name: str = "rank") -> DataFrame:
    return scored.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top(scored: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return ranked(scored, by, order).where(F.col("rank") <= k)


def renumber(entries: DataFrame, most: int) -> DataFrame:
    """The best `most` entries of each run by combined score, numbered in their original order."""
    best = top(entries, ["run_id"], [F.col("combined").desc(), "idx"], most).drop("rank")
    return ranked(best, ["run_id"], ["idx"], "number")


def keep_recent(logs: DataFrame, cutoff, keep: int) -> DataFrame:
    """Logs not older than cutoff and among the newest `keep`; what is kept is bounded, so the rank runs over it alone."""
    newest = logs.where(F.col("created_at") >= F.lit(cutoff).cast("timestamp"))
    return newest.orderBy(F.col("id").desc()).limit(keep)


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row of each key: the last by the order columns."""
    rest = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return last.select(key, "x.*")


def phases_of(steps: DataFrame, order: list[str]) -> DataFrame:
    """Per run its distinct phases in pipeline order; unknown ones last."""
    place = F.coalesce(*[F.when(F.col("phase") == p, F.lit(i)) for i, p in enumerate(order)], F.lit(len(order)))
    held = F.array_sort(F.collect_set(F.struct(place.alias("place"), "phase")))
    return steps.groupBy("run_id").agg(F.transform(held, lambda x: x["phase"]).alias("phases"))


def key_suffix(keys: DataFrame, key: str, order: str) -> DataFrame:
    """A letter a..j for the first ten of several entries with one key; none where the key is alone."""
    own = Window.partitionBy(key)
    number, many = F.row_number().over(own.orderBy(order)), F.count("*").over(own)
    return keys.withColumns({"_n": number, "_m": many}).withColumn("suffix", F.when(F.col("_m") > 1, F.substr(F.lit("abcdefghij"), F.col("_n"), F.lit(1))).otherwise("")).drop("_n", "_m")


def fit_digest(papers: DataFrame, budget: int, ladder: list[tuple[int, int]]) -> DataFrame:
    """Per run the first (papers, characters) step of the ladder whose texts fit the token budget, else the last.

    papers (run_id, rank, text). Tokens are estimated as characters / 3.5 + 1.
    """
    sums = [F.sum(F.when(F.col("rank") <= n, F.floor(F.least(F.char_length("text"), F.lit(c)) / 3.5) + 1)).alias(f"t{i}") for i, (n, c) in enumerate(ladder)]
    step = F.coalesce(*[F.when(F.col(f"t{i}") <= budget, F.lit(i)) for i in range(len(ladder))], F.lit(len(ladder) - 1))
    made = papers.groupBy("run_id").agg(*sums).withColumn("step", step)
    tokens = F.coalesce(*[F.when(F.col("step") == i, F.col(f"t{i}")) for i in range(len(ladder))])
    return made.select("run_id", "step", tokens.alias("tokens"))

"""Judged papers: clean-up of a judge's table, its fusion with rule scores, look-ups, means by source, author names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.functions.text import has_cjk

# Words that accept a paper; the score where none can be read; particles that begin a family name.
ACCEPTS, MIDDLE = ["是", "yes", "true", "y", "1"], 5.0
FAMILY_PARTICLES = "van von de del della der den la le du di da dos bin ibn ter ten op st mac mc".split()


def score(raw: Column) -> Column:
    """A number held within 0 to 10; MIDDLE where there is none."""
    value = raw.try_cast("double")
    return F.when(value.isNull() | F.isnan(value), F.lit(MIDDLE)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(10.0), value)))


def judged(rows: DataFrame) -> DataFrame:
    """A judge's table (paper_id, relevance, quality, evidence_level, key_finding, limitation, use_in_review, all texts) with clean values; a missing use_in_review accepts."""
    use = F.when(F.col("use_in_review").isNull(), True).otherwise(F.trim("use_in_review").isin(ACCEPTS))
    level = F.coalesce(F.nullif(F.col("evidence_level"), F.lit("")), F.lit("其他"))
    return rows.select("paper_id", score(F.col("relevance")).alias("relevance"), score(F.col("quality")).alias("quality"), level.alias("evidence_level"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("key_finding", "limitation")), use.alias("use_in_review"))


def fused(rules: DataFrame, judge: DataFrame) -> DataFrame:
    """Rule scores with a judge's: means of both, texts of the judge before those of the rules, accepted if both accept; rows without a judge stay."""
    both = rules.alias("r").join(judge.alias("j"), "paper_id", "left")
    there = F.col("j.use_in_review").isNotNull()
    mean = lambda c: F.when(there, F.round((F.col(f"j.{c}") + F.col(f"r.{c}")) / 2, 1)).otherwise(F.col(f"r.{c}")).alias(c)
    said = lambda c: F.coalesce(F.nullif(F.col(f"j.{c}"), F.lit("")), F.col(f"r.{c}")).alias(c)
    use = (F.coalesce("j.use_in_review", F.lit(True)) & F.col("r.use_in_review")).alias("use_in_review")
    return both.select("paper_id", mean("relevance"), mean("quality"), *map(said, ("evidence_level", "key_finding", "limitation")), use, F.when(there, "both").otherwise("rules").alias("source"))


def with_quality(papers: DataFrame, assessments: DataFrame) -> DataFrame:
    """papers (paper_id, index) with the quality of the assessment of that paper_id, else of that index, else MIDDLE."""
    own = assessments.where("paper_id is not null").groupBy("paper_id").agg(F.max("quality").alias("_own"))
    placed = assessments.where("index is not null").groupBy("index").agg(F.max("quality").alias("_placed"))
    return papers.join(own, "paper_id", "left").join(placed, "index", "left").withColumn("quality", F.coalesce("_own", "_placed", F.lit(MIDDLE))).drop("_own", "_placed")


def means_by_source(per_query: DataFrame, metrics: list[str]) -> DataFrame:
    """Queries and means of the metrics by where the queries come from."""
    source = F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("(未标注来源)"))
    return per_query.groupBy(source.alias("source")).agg(F.count("*").alias("queries"), *(F.round(F.avg(m), 6).alias(m) for m in metrics))


def negative_controls(per_query: DataFrame) -> DataFrame:
    """One row: queries that should find nothing, and how many results they got on average and at most."""
    return per_query.where("expect_no_relevant").agg(F.count("*").alias("cases"), F.round(F.avg("returned"), 6).alias("avg_returned"), F.max("returned").alias("max_returned"))


def split_author(name: Column) -> Column:
    """struct<family, given> of 'Family Given'; a name in Chinese characters, or of one word, is all family."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"^\s+|\s+$", ""), "^[.,;]+|[.,;]+$", "")
    tokens = F.filter(F.split(clean, r"\s+"), lambda x: x != "")
    n = F.size(tokens)
    particle = F.lower(F.get(tokens, F.lit(0))).isin(FAMILY_PARTICLES) & (n >= 3)
    joined = lambda first, count: F.array_join(F.slice(tokens, first, F.greatest(count, F.lit(0))), " ")
    family = F.when(has_cjk(clean), clean).when(particle, joined(F.lit(1), n - 1)).otherwise(joined(F.lit(1), F.lit(1)))
    given = F.when(has_cjk(clean), F.lit("")).when(particle, joined(n, F.lit(1))).otherwise(joined(F.lit(2), n - 1))
    return F.struct(family.alias("family"), given.alias("given"))


def initials(given: Column, mark: str = ". ", join: str = "") -> Column:
    parts = F.filter(F.split(F.coalesce(given, F.lit("")), r"[\s\-]+"), lambda x: x != "")
    return F.trim(F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lit(mark))), join))


def bibliography(papers: DataFrame, by: str) -> DataFrame:
    """papers in the order of a bibliography: cited (its number), author (first author, year) or year (newest first)."""
    first = F.lower(F.coalesce(F.get("authors", F.lit(0)), F.lit("")))
    year = F.coalesce("pub_year", F.lit(0))
    orders = {"cited": [F.col("number")], "author": [first, year, F.col("number")], "year": [year.desc(), first, F.col("number")]}
    return papers.orderBy(*orders[by])

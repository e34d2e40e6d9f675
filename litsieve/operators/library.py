"""Joins, lists and snapshots of the paper library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litsieve.store import written


def references(citations: DataFrame, papers: DataFrame) -> DataFrame:
    """Each reference with its local paper, if it has one."""
    return citations.join(papers.select(F.col("paper_id").alias("cited_paper_id"), "title", "pub_year"), "cited_paper_id", "left")


def citing_papers(citations: DataFrame, papers: DataFrame) -> DataFrame:
    edges = citations.where("cited_paper_id is not null").select("cited_paper_id", "citing_paper_id").distinct()
    return edges.join(papers.select(F.col("paper_id").alias("citing_paper_id"), "title", "pub_year"), "citing_paper_id")


def resolve_references(refs: DataFrame, papers: DataFrame) -> DataFrame:
    """refs (citing_paper_id, doi, pmid, title, source) as edges: local paper by DOI, then PMID; null-safe distinct."""
    by_doi = papers.where("doi is not null").groupBy("doi").agg(F.min("paper_id").alias("_by_doi"))
    by_pmid = papers.where("pmid is not null").groupBy("pmid").agg(F.min("paper_id").alias("_by_pmid"))
    joined = refs.join(by_doi, "doi", "left").join(by_pmid, "pmid", "left")
    external = F.coalesce("doi", "pmid", F.substring("title", 1, 400))
    return joined.select("citing_paper_id", F.coalesce("_by_doi", "_by_pmid").alias("cited_paper_id"), external.alias("cited_external_id"), "source").distinct()


def project_members(papers: DataFrame, members: DataFrame) -> DataFrame:
    return members.distinct().join(papers, "paper_id")


def missing(papers: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Papers without a row in `done` (for example without an embedding), lowest ids first."""
    left = papers.join(done.select("paper_id").distinct(), "paper_id", "left_anti").orderBy("paper_id")
    return left if limit is None else left.limit(limit)


def fulltext_candidates(papers: DataFrame, fulltext: DataFrame, failed: DataFrame, limit: int) -> DataFrame:
    """Open or with a PMCID, no text yet, no permanent failure; PMCID first, then by citations and id."""
    open_ = papers.where("is_open_access or pmcid is not null")
    left = open_.join(fulltext.select("paper_id"), "paper_id", "left_anti").join(failed.where("permanent").select("paper_id"), "paper_id", "left_anti")
    return left.orderBy(F.when(F.col("pmcid").isNotNull(), 0).otherwise(1), F.col("cited_by_count").desc(), "paper_id").limit(limit)


def find_ids(incoming: DataFrame, library: DataFrame) -> DataFrame:
    """incoming with paper_id of its match in the library: by DOI, then PMID, then title key."""

    def by(key: str) -> DataFrame:
        return library.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.min("paper_id").alias(f"_{key}"))

    out = incoming
    for key in ("doi", "pmid", "title_key"):
        out = out.join(by(key), key, "left")
    return out.withColumn("paper_id", F.coalesce("_doi", "_pmid", "_title_key")).drop("_doi", "_pmid", "_title_key")


def with_counts(parents: DataFrame, children: DataFrame, key: str, foreign: str, name: str) -> DataFrame:
    counts = children.groupBy(F.col(foreign).alias(key)).agg(F.count("*").alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def runs_with_artifacts(runs: DataFrame, artifacts: DataFrame, limit: int) -> DataFrame:
    """The latest runs with their artifacts. The runs are cut first, as a left join drops none, so runs without an artifact
    don't meet in one task; their few ids go to the artifacts by broadcast."""
    latest = [F.col("created_at").desc(), F.col("run_id").desc()]
    top = written(runs.orderBy(*latest).limit(limit), "runs")
    held = artifacts.join(top.select("artifact_id").distinct().hint("broadcast"), "artifact_id", "left_semi")
    return top.join(held.hint("merge"), "artifact_id", "left").orderBy(*latest).limit(limit)


def list_papers(papers: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of the list, with has_more."""
    page = papers.orderBy(*order).offset(offset).limit(limit + 1)
    numbered = page.withColumn("_n", F.row_number().over(Window.orderBy(*order)))  # limit + 1 rows at most
    return numbered.withColumn("has_more", F.max("_n").over(Window.partitionBy()) > limit).where(F.col("_n") <= limit).drop("_n")


def unpaywall_location(papers: DataFrame, dump: DataFrame) -> DataFrame:
    """papers with best_url: the best location if it has a link, else the first that has; PDF before landing page."""
    link = lambda x: F.coalesce(x["url_for_pdf"], x["url"])
    first = F.get(F.filter(F.transform("oa_locations", link), lambda u: u.isNotNull()), F.lit(0))
    urls = dump.select("doi", F.coalesce(link(F.col("best_oa_location")), first).alias("best_url"))
    return papers.join(urls, "doi", "left")


def merge_runs(stored: DataFrame, live: DataFrame, phases: DataFrame, terminal: list[str]) -> DataFrame:
    """Stored and live runs, live ones winning, with their phases; resumable ones first, then the newest."""
    both = stored.withColumn("_rank", F.lit(1)).unionByName(live.withColumn("_rank", F.lit(0)), allowMissingColumns=True)
    first = both.withColumn("_n", F.row_number().over(Window.partitionBy("run_id").orderBy("_rank"))).where("_n = 1").drop("_n", "_rank")
    joined = first.join(phases, "run_id", "left")
    resumable = ~F.col("status").isin(terminal) & (F.size(F.coalesce("phases", F.array().cast("array<string>"))) > 0)
    return joined.withColumn("resumable", resumable).orderBy(F.col("resumable").desc(), F.col("created_at").desc())

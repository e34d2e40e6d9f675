"""Entity resolution: dedupe keys, merged records, batch upserts and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litsieve.functions.text import title_fingerprint, title_key
from litsieve.operators.library import find_ids
from litsieve.store import written

FIRSTS = ["pmid", "pmcid", "doi", "journal", "source", "language"]


def dedup_key(df: DataFrame) -> Column:
    """DOI, else PMID, else title fingerprint, else source with the title's head."""
    filled = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    print_ = title_fingerprint(F.col("title"))
    return F.coalesce(F.concat(F.lit("doi:"), filled("doi")), F.concat(F.lit("pmid:"), filled("pmid")), F.concat(F.lit("title:"), F.when(print_ != "", print_)), F.concat_ws(":", "source", F.substring("title", 1, 40)))


def merge_papers(papers: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One record per dedup key (within each value of `by`), in order of first_seq.

    The longest title and abstract win (ties: the first), the year is the richest record's, citations the largest, open
    access if any is; other fields take the first non-empty value by ingest_seq; found_in is the ordered union of sources.
    """
    df = papers.withColumn("dedup_key", dedup_key(papers))
    seq = F.col("ingest_seq")
    longest = lambda c: F.max_by(c, F.struct(F.char_length(F.coalesce(F.col(c), F.lit(""))), -seq))
    richness = F.struct(F.char_length(F.coalesce("abstract", F.lit(""))), F.coalesce("cited_by_count", F.lit(0)), -seq)
    firsts = [F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", seq)).alias(c) for c in FIRSTS if c in df.columns]
    union = F.transform(F.array_sort(F.collect_list(F.struct("ingest_seq", "source"))), lambda x: x["source"])
    from litsieve.functions.text import distinct_ignoring_case

    return df.groupBy(*by, "dedup_key").agg(
        F.min("ingest_seq").alias("first_seq"), F.count("*").alias("merged"), longest("title").alias("title"), longest("abstract").alias("abstract"),
        F.coalesce(F.max_by("pub_year", richness), F.min("pub_year")).alias("pub_year"), F.max("cited_by_count").alias("cited_by_count"), F.bool_or("is_open_access").alias("is_open_access"),
        distinct_ignoring_case(union).alias("found_in"), *firsts,
    )


def upsert(library: DataFrame, incoming: DataFrame, highest: int | None = None) -> DataFrame:
    """The library's next snapshot: matched records enriched, new ones added with the next ids; action tells which.

    Incoming records are merged among themselves first. A library value that is there wins, longer titles and abstracts
    win, citations take the larger, open access if either. New ids follow `highest`, by default the library's largest.
    """
    fresh = merge_papers(incoming).drop("found_in", "merged", "dedup_key").withColumn("title_key", title_key(F.col("title")))
    keyed = library.withColumn("title_key", title_key(F.col("title")))
    matched = find_ids(fresh, keyed).drop("title_key")
    own = matched.where("paper_id is not null")
    once = own.withColumn("_n", F.row_number().over(Window.partitionBy("paper_id").orderBy("first_seq"))).where("_n = 1").drop("_n")
    new = {c: f"_{c}" for c in once.columns if c != "paper_id"}
    joined = library.join(once.withColumnsRenamed(new), "paper_id", "left")
    filled = lambda c: F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c)), F.col(f"_{c}"))
    longer = lambda c: F.when(F.char_length(F.coalesce(F.col(f"_{c}"), F.lit(""))) > F.char_length(F.coalesce(F.col(c), F.lit(""))), F.col(f"_{c}")).otherwise(F.col(c))
    rule = {"title": longer("title"), "abstract": longer("abstract"), "cited_by_count": F.greatest("cited_by_count", "_cited_by_count"), "is_open_access": F.col("is_open_access") | F.coalesce("_is_open_access", F.lit(False))}
    kept = ["paper_id", "title", "abstract", "pub_year", "cited_by_count", "is_open_access", *[c for c in FIRSTS if c in library.columns]]
    old = joined.select(*[(rule.get(c) if c in rule else F.col(c) if c == "paper_id" else filled(c)).alias(c) for c in kept], F.when(F.col("_first_seq").isNull(), "kept").otherwise("updated").alias("action"))
    if highest is None:
        highest = library.agg(F.coalesce(F.max("paper_id"), F.lit(0)).alias("m")).first()["m"]
    added = numbered(matched.where("paper_id is null").drop("paper_id"), "first_seq", highest)
    return old.unionByName(added.select(*kept, F.lit("new").alias("action")))


def numbered(df: DataFrame, order: str, after: int) -> DataFrame:
    """df with paper_id = after + 1, ... in the order's sequence, without one task for all: range parts, counts, then ranks."""
    spark = df.sparkSession
    parts = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).withColumn("_p", F.spark_partition_id())
    parts = written(parts, "numbered")  # one dealing for the counts and the rows
    counts = parts.groupBy("_p").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    place = F.row_number().over(Window.partitionBy("_p").orderBy(order))
    return parts.join(counts.select("_p", before.alias("_before")), "_p").withColumn("paper_id", (F.lit(after) + F.col("_before") + place).cast("long")).drop("_p", "_before")


def merge_unique(primary: DataFrame, extra: DataFrame) -> DataFrame:
    """primary, then those of extra whose DOI (else lower-cased title) is new."""
    key = F.coalesce(F.when(F.col("doi") != "", F.col("doi")), F.lower("title"))
    both = primary.withColumn("_set", F.lit(0)).unionByName(extra.withColumn("_set", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(key).orderBy("_set", "ingest_seq"))
    return both.withColumn("_n", place).where("_n = 1").drop("_n", "_set")


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of incoming that are new by their keys (nulls equal), each once."""
    new = incoming.dropDuplicates(keys)
    had = existing.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = [new[k].eqNullSafe(had[f"_{k}"]) for k in keys]
    return new.join(had, same, "left_anti")


def latest_state(events: DataFrame, key: str, order: list[str], keep_last: list[str] = ()) -> DataFrame:
    """Last row by key; columns in keep_last hold their last non-null value; attempts counts the events."""
    rest = [c for c in events.columns if c != key and c not in keep_last]
    stamp = F.struct(*order)
    kept = [F.max_by(c, F.when(F.col(c).isNotNull(), stamp)).alias(c) for c in keep_last]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), stamp).alias("x"), F.count("*").alias("attempts"), *kept).select(key, "x.*", "attempts", *keep_last)


def delete_papers(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of these paper ids."""
    return {name: t.join(ids.select("paper_id"), "paper_id", "left_anti") for name, t in tables.items()}

"""The corpus pipeline: toxicity, exact dedup, near dedup, decontamination, packing, each over all that the one before kept.

Stages other than the last return rows of documents with all their columns. Defined cases: rows with a null text are
empty documents; rows that repeat another in doc_id and text are equal texts, of which exact dedup keeps one; null ids
take part in every stage, where near dedup keeps them only if all of a component are null (then the least text mark),
and decontamination treats them as one id; columns of documents may have any names; an empty table runs
through to no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.llm import decontaminate, exact_dedup, jaccard_join, packing, toxicity
from litsieve.llm.common import table, text_or_empty, written
from litsieve.llm.queries import tokenizer_path

TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.scores(docs, table(spark, sf_dir, "labels"), threshold=TOXIC)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays. The join is on digest and id, so a hot text is spread."""
    live = exact_dedup.classes(docs).where("kept").select(F.col("text_sha256").alias("_live"), F.col("doc_id").alias("_of")).distinct()
    packed = docs.select(F.struct("*").alias("_row"), F.sha2(text_or_empty().cast("binary"), 256).alias("_digest"), F.col("doc_id").cast("long").alias("_id"))
    same = packed["_id"].eqNullSafe(live["_of"]) & (packed["_digest"] == live["_live"])
    return packed.join(live.hint("merge"), same, "left_semi").dropDuplicates(["_digest", "_id"]).select("_row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a component of documents with Jaccard >= 0.8 over five-word shingles, the one with the smallest doc_id stays.

    Rows are told apart by doc_id and text, so another text under the same doc_id has its own component.
    """
    found = jaccard_join.classes(docs, k=5, num=80, den=100).where("component is not null")
    found = written(found.select("doc_id", "mark", "component").distinct(), "classes")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    stay = found.groupBy("component").agg(F.min(first).alias("stay"), F.count("*").alias("rows")).where("rows > 1")
    gone = found.join(stay.hint("merge"), "component").where(~first.eqNullSafe(F.col("stay"))).select(F.col("doc_id").alias("_gone"), F.col("mark").alias("_mark"))
    packed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), jaccard_join.text_mark("text").alias("_text"))
    same = packed["_id"].eqNullSafe(gone["_gone"]) & (packed["_text"] == gone["_mark"])
    return packed.join(gone.hint("merge"), same, "left_anti").select("_row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose doc_id holds a benchmark item go."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    leaks = written(found.select(F.col("doc_id").alias("_gone")).distinct(), "leaks")
    packed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"))
    return packed.join(leaks.hint("merge"), packed["_id"].eqNullSafe(leaks["_gone"]), "left_anti").select("_row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize_pieces(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=2048)
    return packing.pack(pieces.select("row_id", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity=2048).drop("row_id")


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", drop_leaks), ("best-fit packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs

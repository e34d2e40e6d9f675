"""Incremental embedding: papers without a vector go through a provider in batches; failed batches are left for the next run."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Provider = Callable[[list[str]], Sequence[Sequence[float]]]
RESULT = "paper_id long, status string, model string, dim int, vector array<float>, text string, error string"
_ARROW = pa.schema([("paper_id", pa.int64()), ("status", pa.string()), ("model", pa.string()), ("dim", pa.int32()), ("vector", pa.list_(pa.float32())), ("text", pa.string()), ("error", pa.string())])
EMBEDDED, SKIPPED, FAILED = "embedded", "skipped", "failed"


def embed_text(papers: DataFrame) -> Column:
    """Title, first twelve headings and abstract, those that are there, a line each."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in papers.columns else F.lit("")
    parts = [text("title"), text("abstract")]
    if "mesh_terms" in papers.columns:
        terms = F.array_join(F.slice("mesh_terms", 1, 12), "; ")
        parts.insert(1, F.when(terms != "", F.concat(F.lit("MeSH: "), terms)).otherwise(""))
    return F.trim(F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n"))


def _embed(batches: Iterator[pa.RecordBatch], provider: Provider, model: str, batch_size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, batch_size):
            ids, texts = (batch.slice(at, batch_size).column(c).to_pylist() for c in ("paper_id", "text"))
            row = lambda i, status, vector=None, text=None, error=None: (i, status, model, None if vector is None else len(vector), vector, text, error)
            out = [row(i, SKIPPED) for i, t in zip(ids, texts, strict=True) if not t]
            asked = [(i, t) for i, t in zip(ids, texts, strict=True) if t]
            try:
                vectors = [np.asarray(v, dtype=np.float64) for v in provider([t for _, t in asked])] if asked else []
                if len(vectors) != len(asked):
                    raise ValueError(f"{len(asked)} texts, {len(vectors)} vectors")
                lengths = [float(np.sqrt((v * v).sum())) for v in vectors]
                out += [row(i, EMBEDDED, (v / n if n > 1e-12 else v).astype(np.float32)) for (i, _), v, n in zip(asked, vectors, lengths, strict=True)]
            except Exception as e:  # a provider's failure is a result; its papers are asked for again in the next run
                out += [row(i, FAILED, text=t, error=f"{type(e).__name__}: {e}") for i, t in asked]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)


def results(spark: SparkSession, target: str, below: int | None = None) -> DataFrame:
    """What earlier runs wrote under target, as far as folder `below`."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], RESULT + ", batch long")
    rows = spark.read.schema(RESULT + ", batch long").parquet(target)
    return rows if below is None else rows.where(F.col("batch") < below)


def embed(papers: DataFrame, before: DataFrame, provider: Provider, model: str, batch_size: int = 16) -> DataFrame:
    """A result per paper that has no vector of this model in `before`, those that failed there included (by their text).

    The provider is called in the tasks, with batch_size texts at a time, and must be pickled; write the result once, as
    each reading of it calls the provider again. Repeated papers are embedded once.
    """
    own = before.where(F.col("model") == model)
    done = own.where(F.col("status") == EMBEDDED).select("paper_id")
    again = own.where(F.col("status") == FAILED).select("paper_id", "text")
    rows = papers.select("paper_id", embed_text(papers).alias("text")).unionByName(again)
    rows = rows.groupBy("paper_id").agg(F.min("text").alias("text")).join(done.hint("merge"), "paper_id", "left_anti")
    return rows.mapInArrow(partial(_embed, provider=provider, model=model, batch_size=batch_size), RESULT)


def vectors(found: DataFrame) -> DataFrame:
    return found.where(F.col("status") == EMBEDDED).select("paper_id", "model", "dim", "vector")


def report(found: DataFrame) -> DataFrame:
    """One row a model: requested, embedded, skipped, failed, and up to ten of the errors."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in (EMBEDDED, SKIPPED, FAILED)]
    return found.groupBy("model").agg(F.count("*").alias("requested"), *counts, F.slice(F.array_sort(F.collect_set("error")), 1, 10).alias("errors"))

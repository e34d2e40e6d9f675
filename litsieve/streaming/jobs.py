"""Structured Streaming forms of incremental loads, log aggregates, run states and retention."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from litsieve.operators import embedding
from litsieve.operators.resolve import merge_papers, upsert
from litsieve.operators.snapshots import Library

# The states of a run that has not ended, and the state of one that went silent.
OPEN, SILENT = ["running", "awaiting_approval"], "interrupted"


def ingest(papers: DataFrame, target: str, checkpoint: str, after: list[Callable[[DataFrame], None]] = ()) -> StreamingQuery:
    """Merges each micro-batch by dedup key and writes it as one version under target; the checkpoint makes it resumable."""

    def write(batch: DataFrame, epoch: int) -> None:
        made = merge_papers(batch)
        made.write.mode("overwrite").parquet(f"{target}/batch={epoch}")  # the same epoch again writes the same place
        for hook in after:
            hook(made)

    return papers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_into(papers: DataFrame, library: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Merges each micro-batch into the library and writes its next snapshot under target/version=<batch>.

    The first batch starts from `library`, later ones from the snapshot before, so a paper that comes again in a later
    batch is merged with its row; a batch that is run again writes the same snapshot.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        held = library if epoch == 0 else batch.sparkSession.read.schema(library.schema).parquet(f"{target}/version={epoch - 1}")
        made = upsert(held, batch).drop("action")
        made.select(*library.columns).write.mode("overwrite").parquet(f"{target}/version={epoch}")

    return papers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_keyed(papers: DataFrame, library: Library, checkpoint: str, first_version: int = 0) -> StreamingQuery:
    """Merges each micro-batch into a keyed library as version first_version + batch, which rewrites only the buckets it
    touches; a batch that is run again finds its version there."""
    write = lambda batch, epoch: library.apply(batch, first_version + epoch)
    return papers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_windows(logs: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Per window and source: results, new ones, failures, searches."""
    held = logs.withWatermark("created_at", late).groupBy(F.window("created_at", size).alias("w"), "source")
    made = held.agg(F.sum("result_count").alias("results"), F.sum("new_count").alias("new_results"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count("*").alias("searches"))
    return made.select(F.col("w.start").alias("start"), "source", "results", "new_results", "failed", "searches")


def recent_only(logs: DataFrame, now, days: int) -> DataFrame:
    """The age bound of retention; the bound by count stays a batch job (windows.keep_recent)."""
    return logs.where(F.col("created_at") >= F.lit(now).cast("timestamp") - F.expr(f"interval {int(days)} days"))


def latest_runs(events: DataFrame) -> DataFrame:
    """Last status of each run by (created_at, status), kept as streaming state; use output mode complete or update."""
    return events.groupBy("run_id").agg(F.max_by("status", F.struct("created_at", "status")).alias("status"), F.count("*").alias("events"))


class RunStates(StatefulProcessor):
    """Last status of each run; a run that is open and silent for `silence` in event time turns to interrupted.

    Every run has one timer, at its last event plus `silence`. When it fires, the run's state goes, so the state holds the
    runs of the last `silence` only. A later event of such a run begins it anew.
    """

    def __init__(self, silence: timedelta):
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, micros long, events long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        status, at, events = held if held else (None, None, 0)
        for part in rows:
            events += len(part)
            newest = part.sort_values(["micros", "status"]).iloc[-1]
            if at is None or (newest.micros, newest.status) > (at, status):
                status, at = newest.status, int(newest.micros)
        self.last.update((status, at, events))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(-(-at // 1000) + int(self.silence.total_seconds() * 1000))
        yield pd.DataFrame({"run_id": [key[0]], "status": [status], "micros": [at], "events": [events]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, at, events = self.last.get()
        self.last.clear()
        if status in OPEN:
            yield pd.DataFrame({"run_id": [key[0]], "status": [SILENT], "micros": [at], "events": [events]})

    def close(self) -> None:
        pass


def run_states(events: DataFrame, silence: timedelta = timedelta(hours=1), late: str = "10 minutes") -> DataFrame:
    """Changes (run_id, status, created_at, events) of a stream of (run_id, status, created_at). Needs the RocksDB state
    store (see RUN_STATE_SETTINGS) and output mode update."""
    held = events.select(F.col("run_id").cast("string").alias("run_id"), "status", F.col("created_at").cast("timestamp").alias("created_at"))
    held = held.withColumn("micros", F.unix_micros("created_at")).withWatermark("created_at", late)
    made = held.groupBy("run_id").transformWithStateInPandas(RunStates(silence), "run_id string, status string, micros long, events long", "Update", "EventTime")
    return made.select("run_id", "status", F.timestamp_micros("micros").alias("created_at"), "events")


RUN_STATE_SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def run_states_at(events: DataFrame, now: Column, silence: timedelta = timedelta(hours=1)) -> DataFrame:
    """The batch form: last status of each run, open runs without an event since `now` - silence interrupted."""
    last = events.groupBy(F.col("run_id").cast("string").alias("run_id")).agg(F.max(F.struct("created_at", "status")).alias("x"), F.count("*").alias("events"))
    gone = F.col("x.status").isin(OPEN) & (F.col("x.created_at") + F.lit(silence) <= now)
    return last.select("run_id", F.when(gone, SILENT).otherwise(F.col("x.status")).alias("status"), F.col("x.created_at").alias("created_at"), "events")


def embed_arrivals(papers: DataFrame, target: str, provider: embedding.Provider, model: str, checkpoint: str, batch_size: int = 16) -> StreamingQuery:
    """Embeds the papers of a stream, and again those whose batch failed before. Each micro-batch writes its results as one
    folder under target; a micro-batch that is run again writes the same folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = embedding.results(spark, target, below=epoch)
        embedding.embed(batch, before, provider, model, batch_size).write.mode("overwrite").parquet(f"{target}/batch={epoch}")

    return papers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(df: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a streaming plan over what is there and returns the memory table: for tests and small backfills."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)

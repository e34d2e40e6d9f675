"""Streams give what the batch operators give on the same input."""

from pyspark.sql import functions as F

from litsieve.operators.resolve import merge_papers
from litsieve.streaming import jobs


def test_log_windows_match_batch(spark, tmp_path):
    rows = spark.range(200).select(F.col("id"), (F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 97)).alias("created_at"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), (F.col("id") % 7).alias("result_count"), (F.col("id") % 2).alias("new_count"), F.when(F.col("id") % 10 == 0, "HTTP 500").alias("error"))
    rows.write.parquet(f"{tmp_path}/logs")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/logs")
    made = jobs.run_to_end(jobs.log_windows(stream), "log_windows", "complete")
    want = jobs.log_windows(rows)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect()))
    runs = rows.select(F.col("source").alias("run_id"), F.when(F.col("error").isNull(), "done").otherwise("error").alias("status"), "created_at")
    runs.write.parquet(f"{tmp_path}/runs")
    state = jobs.run_to_end(jobs.latest_runs(spark.readStream.schema(runs.schema).parquet(f"{tmp_path}/runs")), "runs_state", "complete")
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, jobs.latest_runs(runs).collect()))


def test_ingest_matches_merge(spark, tmp_path):
    rows = [(i, f"10.1/{i % 4}", None, f"Title {i}", "a", "J", "s", "en", 2000 + i, i, False) for i in range(12)]
    papers = spark.createDataFrame(rows, "ingest_seq long, doi string, pmid string, title string, abstract string, journal string, source string, language string, pub_year int, cited_by_count int, is_open_access boolean")
    papers.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(papers.schema).parquet(f"{tmp_path}/in")
    seen = []
    jobs.ingest(stream, f"{tmp_path}/out", f"{tmp_path}/state", [lambda df: seen.append(df.count())]).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == merge_papers(papers).count() == 4 and seen == [4]


def test_ingest_into_merges_across_batches(spark, tmp_path):
    kinds = "ingest_seq long, doi string, pmid string, title string, abstract string, journal string, source string, language string, pub_year int, cited_by_count int, is_open_access boolean"
    row = lambda seq, doi, title, abstract: (seq, doi, None, title, abstract, "J", "s", "en", 2000, seq, False)
    for i, rows in enumerate([[row(1, "10.1/a", "T one", "short")], [row(2, "10.1/a", "T one longer", "a longer one"), row(3, "10.1/b", "T two", "x")]]):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        library = spark.createDataFrame([], "paper_id long, " + kinds.split(", ", 1)[1]).drop("source")
        stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        jobs.ingest_into(stream, library, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/version=1").orderBy("paper_id").collect()
    assert [(r["paper_id"], r["title"], r["cited_by_count"]) for r in got] == [(1, "T one longer", 2), (2, "T two", 3)]


def test_run_states_turn_silent_runs_to_interrupted(spark, tmp_path):
    """Timers give what the batch form gives, over a restart too, and the state is dropped."""
    from datetime import datetime, timedelta

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.RUN_STATE_SETTINGS["spark.sql.streaming.stateStore.providerClass"])
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    first = [("a", "running", at(0)), ("b", "running", at(1)), ("b", "done", at(5)), ("c", "awaiting_approval", at(2)), ("d", "running", at(50)), ("e", "error", at(3))]
    second = [("d", "running", at(100)), ("f", "running", at(190)), ("g", "done", at(200))]
    kinds, shown = "run_id string, status string, created_at timestamp", []
    for part in (first, second):
        spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.run_states(spark.readStream.schema(kinds).parquet(f"{tmp_path}/in"), timedelta(hours=1))
        keep = lambda df, epoch: shown.extend(df.collect())
        stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    last = {}
    for r in shown:
        last[r.run_id] = (r.status, r.created_at, r.events)
    want = jobs.run_states_at(spark.createDataFrame(first + second, kinds), F.lit(at(190)).cast("timestamp"), timedelta(hours=1)).collect()
    assert last == {r.run_id: (r.status, r.created_at, r.events) for r in want}
    assert {k: v[0] for k, v in last.items()} == {"a": "interrupted", "b": "done", "c": "interrupted", "d": "interrupted", "e": "error", "f": "running", "g": "done"} and last["d"][2] == 2


def test_embedding_loses_nothing_to_a_failing_provider(spark, tmp_path):
    from litsieve.operators import embedding

    def provider(texts, fails=True):
        if fails and any("bad" in t for t in texts):
            raise RuntimeError("no answer")
        return [[len(t), t.count("a") + 1.0] for t in texts][: len(texts) - (texts == ["short"])]

    kinds = "paper_id long, title string, abstract string, mesh_terms array<string>"
    rows = [(1, "alpha", "text", ["k", "l"]), (2, "bad one", None, None), (3, " ", "", []), (4, None, None, None), (5, "short", "", None), (6, "omega", "x", [])]
    target = f"{tmp_path}/vectors"
    for i, part in enumerate((rows[:4], rows[4:] + rows[:1])):
        spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(kinds).parquet(f"{tmp_path}/in")
        healthy = lambda texts, fails=not i: provider(texts, fails)
        jobs.embed_arrivals(stream, target, healthy, "m", f"{tmp_path}/state", batch_size=1).awaitTermination()
    found = embedding.results(spark, target)
    assert sorted((r.batch, r.paper_id, r.status) for r in found.collect()) == [(0, 1, "embedded"), (0, 2, "failed"), (0, 3, "skipped"), (0, 4, "skipped"), (1, 2, "embedded"), (1, 5, "failed"), (1, 6, "embedded")]
    first = embedding.report(found.where("batch = 0")).first()
    assert (first.requested, first.embedded, first.skipped, first.failed, first.errors) == (4, 1, 2, 1, ["RuntimeError: no answer"])
    v = {r.paper_id: r.vector for r in embedding.vectors(found).collect()}
    text = "alpha\nMeSH: k; l\ntext"
    assert sorted(v) == [1, 2, 6] and abs(v[1][0] - len(text) / (len(text) ** 2 + (text.count("a") + 1) ** 2) ** 0.5) < 1e-6
    assert embedding.embed(spark.createDataFrame(rows[:1], kinds), found, provider, "other", 4).first().status == "embedded"

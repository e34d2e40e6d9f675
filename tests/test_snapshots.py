"""Versions of a keyed library equal whole rewrites, and write what the batch touches."""

import random

from pyspark.sql import functions as F

from litsieve.operators.resolve import upsert
from litsieve.operators.snapshots import Library
from litsieve.streaming import jobs

KINDS = "ingest_seq long, doi string, pmid string, title string, abstract string, journal string, source string, language string, pub_year int, cited_by_count int, is_open_access boolean"
SCHEMA = "paper_id long, title string, abstract string, pub_year int, cited_by_count int, is_open_access boolean, pmid string, doi string, journal string, language string"


def paper(rng, seq, n):
    i = rng.randrange(n)
    return (seq, f"10.1/{i}" if rng.random() < 0.7 else None, f"{i}" if rng.random() < 0.5 else None, f"Title {i}" + " long" * rng.randrange(2), "a" * rng.randrange(5), rng.choice(["J", ""]), "s", "en", 2000 + i % 20, rng.randrange(50), rng.random() < 0.3)


def test_versions_equal_whole_upserts(spark, tmp_path):
    rng = random.Random(2)
    library = Library(spark, f"{tmp_path}/lib", SCHEMA, bucket_rows=20, key_buckets=8)
    whole = spark.createDataFrame([], SCHEMA)
    for size, n in ((60, 200), (5, 200), (30, 400), (1, 3)):
        batch = spark.createDataFrame([paper(rng, s, n) for s in range(size)], KINDS)
        after = upsert(whole, batch)
        changes = library.apply(batch)
        assert sorted(map(tuple, changes.collect())) == sorted((r.paper_id, r.action) for r in after.where("action <> 'kept'").collect())
        whole = spark.createDataFrame(after.select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect(), SCHEMA)
        assert sorted(map(str, library.read().select(*whole.columns).collect())) == sorted(map(str, whole.collect()))
    assert library.versions() == [0, 1, 2, 3] and library.read(0).count() < library.read(3).count()
    assert library.bytes_of(3) < library.bytes_of(0)
    held = {(k, b): v for k, b, v, _ in library.manifest(3) if k == "papers"}
    assert 0 < sum(v == 3 for v in held.values()) < len(held)  # other buckets stay where they were
    before = sorted(map(str, library.read().collect()))
    library.apply(spark.createDataFrame([paper(rng, 1, 9)], KINDS), 3)  # a version that is there is left alone
    assert sorted(map(str, library.read().collect())) == before


def test_stream_into_keyed_library(spark, tmp_path):
    rng = random.Random(3)
    library = Library(spark, f"{tmp_path}/lib", SCHEMA, bucket_rows=50, key_buckets=4)
    whole = spark.createDataFrame([], SCHEMA)
    for i in range(2):
        batch = spark.createDataFrame([paper(rng, s, 60) for s in range(40)], KINDS).coalesce(1)
        batch.write.mode("append").parquet(f"{tmp_path}/in")
        jobs.ingest_keyed(spark.readStream.schema(KINDS).parquet(f"{tmp_path}/in"), library, f"{tmp_path}/state").awaitTermination()
        whole = spark.createDataFrame(upsert(whole, batch).select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect(), SCHEMA)
    assert sorted(map(str, library.read().select(*whole.columns).collect())) == sorted(map(str, whole.collect())) and library.versions() == [0, 1]
    assert library.read().where(F.col("paper_id") > 0).count() == whole.count()

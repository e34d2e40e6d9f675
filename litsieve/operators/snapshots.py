"""A library of papers in versions, of which a batch rewrites only the parts it touches.

Papers lie in buckets of consecutive ids, a folder each; the keys by which papers are found (DOI, PMID, title key) lie in
buckets by hash and are only appended to. A manifest per version names the folder of every bucket. A batch reads the key
buckets of its own keys, then the paper buckets those name and the last one, where new papers go, and writes these anew.
So what is read and written follows the batch; a version is there once its manifest is, and a run that is broken off and
started again writes the same folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.functions.text import title_key
from litsieve.operators.resolve import merge_papers, upsert

MANIFEST = "kind string, bucket long, version long, highest long"
PAPERS, KEYS = "papers", "keys"


class Library:
    """Versions under `path`. bucket_rows: ids in a bucket of papers; key_buckets: number of buckets of keys."""

    def __init__(self, spark: SparkSession, path: str, schema: str, bucket_rows: int = 100_000, key_buckets: int = 256):
        self.spark, self.path, self.schema, self.bucket_rows, self.key_buckets = spark, path.rstrip("/"), schema, bucket_rows, key_buckets

    # versions
    def versions(self) -> list[int]:
        """Versions whose manifest is complete, in order."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        root = fs_path(f"{self.path}/manifest")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        names = [s.getPath() for s in files.listStatus(root)]
        return sorted(int(p.getName()[2:]) for p in names if files.exists(fs_path(p, "_SUCCESS")))

    def manifest(self, version: int) -> list[tuple[str, int, int, int]]:
        """(kind, bucket, version of its folder, highest id): a row for each folder, so bounded by the number of buckets and versions."""
        return [tuple(r) for r in self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v={version}").collect()]

    def read(self, version: int | None = None) -> DataFrame:
        """The papers of a version, the last if none is given."""
        held = self.versions()
        version = held[-1] if version is None and held else version
        return self._load(PAPERS, self.manifest(version) if held else [], self.schema)

    def _load(self, kind: str, rows: list[tuple[str, int, int, int]], schema: str, only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{kind}/v={v}/bucket={b}" for k, b, v, _ in rows if k == kind and (only is None or b in only)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # keys
    def keys(self, papers: DataFrame) -> DataFrame:
        """(key, bucket, ...) of papers: 'doi:', 'pmid:' and 'title:' keys, those that are there."""

        def key(kind: str, value: Column) -> Column:
            return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(kind), value))

        found = F.array_compact(F.array(key("doi:", F.col("doi")), key("pmid:", F.col("pmid")), key("title:", title_key(F.col("title")))))
        kept = [c for c in papers.columns if c == "paper_id"]
        rows = papers.select(F.explode(found).alias("key"), *kept)
        return rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.key_buckets)))

    # writing
    def apply(self, incoming: DataFrame, version: int | None = None) -> DataFrame:
        """Merges incoming papers as the next version (or as `version`, which is left alone if it is there).

        -> (paper_id, action) of the papers that are new or updated."""
        held = self.versions()
        version = (held[-1] + 1 if held else 0) if version is None else version
        if version not in held:
            self._write(incoming, version, [v for v in held if v < version])
        return self.changes(version)

    def changes(self, version: int) -> DataFrame:
        return self.spark.read.schema("paper_id long, action string").parquet(f"{self.path}/changes/v={version}")

    def _write(self, incoming: DataFrame, version: int, held: list[int]) -> None:
        rows = self.manifest(held[-1]) if held else []
        highest = max((h for *_, h in rows), default=0)
        asked = self.keys(merge_papers(incoming))
        wanted = {r["bucket"] for r in asked.select("bucket").distinct().collect()}  # key_buckets at most
        met = self._load(KEYS, rows, "key string, paper_id long", wanted).join(asked.select("key").distinct().hint("merge"), "key", "left_semi")
        bucket = F.floor(F.col("paper_id") / self.bucket_rows)
        touched = {r["b"] for r in met.select(bucket.alias("b")).distinct().collect()} | {(highest + 1) // self.bucket_rows}
        made = upsert(self._load(PAPERS, rows, self.schema, touched), incoming, highest).withColumn("bucket", bucket)
        made.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{PAPERS}/v={version}")
        done = self.spark.read.schema(f"{self.schema}, action string, bucket long").parquet(f"{self.path}/{PAPERS}/v={version}")
        changed = done.where(F.col("action") != "kept")
        changed.select("paper_id", "action").write.mode("overwrite").parquet(f"{self.path}/changes/v={version}")
        self.keys(changed).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{KEYS}/v={version}")
        top = max(done.agg(F.max("paper_id")).first()[0] or 0, highest)
        anew = [(PAPERS, r["bucket"], version, top) for r in done.select("bucket").distinct().collect()]
        more = [(KEYS, r["bucket"], version, top) for r in self.spark.read.schema("key string, paper_id long, bucket long").parquet(f"{self.path}/{KEYS}/v={version}").select("bucket").distinct().collect()]
        written = {b for _, b, _, _ in anew}
        kept = [r for r in rows if r[0] == KEYS or r[1] not in written]
        self.spark.createDataFrame(kept + anew + more, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={version}")

    def bytes_of(self, version: int) -> int:
        """Size of what a version wrote of papers and keys."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        paths = [jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/v={version}") for kind in (PAPERS, KEYS)]
        return sum(p.getFileSystem(conf).getContentSummary(p).getLength() for p in paths if p.getFileSystem(conf).exists(p))

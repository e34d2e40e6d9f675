"""Helpers shared by the operators: the shared folder, written tables, Arrow slices."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session may do without and gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="spark-litsieve-")
    return _OWN_DIRS[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/litsieve/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lets no Arrow batch grow far beyond BATCH_BYTES, whatever the length of its texts. A session's lower bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(key, str(1 << 26)))) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def dropped(*frames: DataFrame) -> None:
    """Removes the files of written tables that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        for name in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(name).getParent()
            if "/litsieve/" in path.toString():
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Hands memory that is free to the system: Python workers live on from task to task and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries have no such call
        pass


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows whose texts have about `most` bytes (one row at least), then gives back what is free."""
    texts, start, size = batch.column(column), 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if size and size + (n or 0) > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)
    give_back()


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


LEAST_BITS, MOST_BITS, BITS_BLOCK = 1 << 17, 1 << 27, 1 << 17


def _bits(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    mask = np.zeros(BITS_BLOCK, dtype=bool)
    mask[rows.slot.to_numpy() % BITS_BLOCK] = True
    return pd.DataFrame({"block": [int(key[0])], "bits": [np.packbits(mask).tobytes()]})


def _unmarked(batches: Iterator[pa.RecordBatch], bits) -> Iterator[pa.RecordBatch]:
    mask = np.unpackbits(np.frombuffer(bits.value, dtype=np.uint8))
    for batch in batches:
        held = batch.filter(pa.array(mask[batch.column("_slot").to_numpy()].astype(bool)))
        if held.num_rows:
            yield held.drop_columns(["_slot"])


def only_ids(rows: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows whose `column` (a long) is among ids' (null counts as a value), perhaps with a few others.

    A bit map of hashed ids, 16 places an id up to MOST_BITS (16 MB), leaves the others out without a shuffle of the
    texts. Beyond MOST_BITS / 4 ids the map would let too many through, and the rows are joined with the ids instead.
    """
    ids = ids.select(F.col(column).cast("long").alias("_id")).distinct()
    n = ids.count()
    if n > MOST_BITS // 4:
        spread = rows.withColumn("_salt", F.pmod(F.xxhash64(F.struct("*")), F.lit(16)).cast("int"))
        every = ids.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        same = spread[column].eqNullSafe(every["_id"]) & (spread["_salt"] == every["_salt"])
        return spread.join(every.hint("merge"), same, "left_semi").drop("_salt")
    size = min(max(LEAST_BITS, 1 << (16 * n).bit_length()), MOST_BITS)
    slots = ids.select(F.pmod(F.xxhash64("_id"), F.lit(size)).cast("int").alias("slot")).distinct()
    packed = slots.withColumn("block", F.floor(F.col("slot") / BITS_BLOCK).cast("int")).groupBy("block").applyInPandas(_bits, "block int, bits binary")
    found = {r["block"]: bytes(r["bits"]) for r in packed.collect()}
    bits = rows.sparkSession.sparkContext.broadcast(b"".join(found.get(b, bytes(BITS_BLOCK // 8)) for b in range(size // BITS_BLOCK)))
    marked = rows.withColumn("_slot", F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(size)).cast("int"))
    return marked.mapInArrow(partial(_unmarked, bits=bits), rows.schema)

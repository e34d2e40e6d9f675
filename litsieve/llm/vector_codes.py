"""Vector code compression: product codebooks trained by member-resident Lloyd rounds.

Every vector is cut into equal parts, one codebook of `entries` entries a position. The rows of a round are the parts,
laid out as a table bucketed by their owner (position, entry, salt). A round reads the residents where they lie, lets
the parts that changed entry in the round before move in by the only shuffle of rows, sums the members of each owner
(partial sums, so what travels is a row an owner and task), and replaces the entries. Codebooks are positions x entries
small rows, whatever the input, and travel with the tasks.

Salts: an owner holds about `owner_rows` parts even if all vectors are copies of one, as the number of salts follows the
number of rows. All arithmetic is on integers, so the result does not depend on the layout.

Defined cases: vectors that are null or hold null or non-finite components are left out; components beyond +-2^24
(after scaling) are held at that bound, so that distances fit a long; vectors of other lengths are padded with zeros to
the longest, rounded up to a multiple of `parts`; every row counts, also rows that share an id or repeat another; of
rows that share an id the least vector, by components, is the seed; a null id is one id, after all others; fewer ids
than entries give shorter codebooks; an empty table gives no rows. Other columns, of any name, are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, shuffles, written

OWNER = ["pos", "home", "salt"]
BOUND = 1 << 24
MOST_LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, vector: str = "embedding", scale: int = 4096) -> DataFrame:
    """(row, vec_id, label, v): the kept rows with integer components, written once."""
    held = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col(vector).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * F.lit(float(scale)), F.lit(float(BOUND))), F.lit(float(-BOUND)))).cast("int"))
    kept = held.where(F.col("v").isNotNull() & ~odd).select("vec_id", "label", whole.alias("v"))
    return written(kept.select(F.monotonically_increasing_id().alias("row"), "*"), "vectors")


def seeds(kept: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    """The first codebooks, as an array (position, entry, place in the part): the vectors of the smallest ids."""
    first = [r["vec_id"] for r in kept.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()]
    ids = F.col("vec_id").isin([i for i in first if i is not None])
    chosen = kept.where(ids | F.col("vec_id").isNull() if None in first else ids)
    rows = chosen.groupBy("vec_id").agg(F.min("v").alias("v")).orderBy(F.col("vec_id").asc_nulls_last()).collect()
    vectors = np.array([r["v"] for r in rows], dtype=np.int64).reshape(len(rows), parts, width)
    return np.ascontiguousarray(vectors.transpose(1, 0, 2))


def nearest(pos: np.ndarray, part: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each part; of equal distances the lower index."""
    entry, best = np.zeros(len(pos), dtype=np.int32), np.full(len(pos), MOST_LONG)
    for e in range(books.shape[1]):
        apart = part - books[pos, e]
        far = np.einsum("ij,ij->i", apart, apart)
        near = far < best
        entry[near], best[near] = e, far[near]
    return entry, best


def _assign(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adds or replaces entry and error."""
    for batch in batches:
        flat = pa.array(batch.column("part")).flatten().to_numpy(zero_copy_only=False)
        part = flat.reshape(batch.num_rows, books.shape[2]).astype(np.int64)
        entry, error = nearest(batch.column("pos").to_numpy(), part, books)
        batch = batch.drop_columns([c for c in ("entry", "error") if c in batch.schema.names])
        yield batch.append_column("entry", pa.array(entry)).append_column("error", pa.array(error))


def assigned(parts: DataFrame, books: np.ndarray) -> DataFrame:
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields if f.name not in ("entry", "error"))
    return parts.mapInArrow(partial(_assign, books=books), f"{kept}, entry int, error long")


class Residents:
    """The parts as a table bucketed by owner; `entry` is where a part belongs, `home` where it lies."""

    def __init__(self, spark: SparkSession):
        self.spark, self.buckets, self.name = spark, shuffles(spark), ""

    def keep(self, rows: DataFrame) -> None:
        """Writes the next state of the parts beside the last, without moving a row, then drops the last."""
        last, self.name = self.name, f"litsieve_parts_{uuid.uuid4().hex}"
        rows.write.format("parquet").option("compression", "zstd").bucketBy(self.buckets, *OWNER).saveAsTable(self.name)
        self.drop(last)

    def drop(self, name: str | None = None) -> None:
        name = self.name if name is None else name
        if name:
            self.spark.sql(f"drop table {name}")

    def settled(self) -> DataFrame:
        """Residents stay in their files; only parts whose entry changed are shuffled to their new owner."""
        rows = self.spark.table(self.name)
        moved = rows.where("entry <> home").withColumn("home", F.col("entry")).repartition(self.buckets, *OWNER)
        return rows.where("entry = home").unionByName(moved)

    def updated(self, books: np.ndarray) -> np.ndarray:
        """floor(sum / count) of the members of each entry, owner by owner; entries without members stay."""
        rows, width = self.spark.table(self.name), books.shape[2]
        sums = [F.sum(F.col("part")[i].cast("long")).alias(f"s{i}") for i in range(width)]
        owners = rows.groupBy("pos", "entry", "salt").agg(F.count("*").alias("n"), *sums)
        total = owners.groupBy("pos", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col(f"s{i}").cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)))
        books = books.copy()
        for r in total.collect():  # positions x entries rows at most
            books[r["pos"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
        return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def train(vectors: DataFrame, vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, owner_rows: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """-> (row, vec_id, label, pos, entry, error) of every part under the final codebooks, and the codebooks."""
    spark = vectors.sparkSession
    kept = quantised(vectors, vector)
    size = kept.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("longest")).first()
    width = -(-size["longest"] // parts)
    padded = kept.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), F.lit(width * parts) - F.size("v"))))
    books = seeds(padded, parts, entries, width) if size["n"] else np.zeros((parts, 1, width), dtype=np.int64)
    salts = max(1, -(-size["n"] // owner_rows))
    cut = padded.select("row", "vec_id", "label", F.pmod(F.xxhash64("row"), F.lit(salts)).alias("salt"), "v", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("pos"))
    cut = cut.select("row", "vec_id", "label", "salt", "pos", F.slice("v", F.col("pos") * width + 1, F.lit(width)).alias("part"))
    state = Residents(spark)
    state.keep(assigned(cut, books).withColumn("home", F.col("entry")).repartition(state.buckets, *OWNER))
    dropped(kept)
    for r in range(rounds):
        books = state.updated(books)
        if r < rounds - 1:
            state.keep(assigned(state.settled(), books))
    final = written(assigned(spark.table(state.name).drop("entry", "home", "salt"), books).drop("part"), "codes")
    state.drop()
    return final, books


def codes(vectors: DataFrame, vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """-> (vec_id, code, error, label_error, codebooks_sha256), one row a kept row of vectors.

    code has two hex digits a part; label_error sums error over equal labels (nulls together) and ends at the largest
    long. Label sums come back by a join on label and salt, so a label with most of the rows is spread.
    """
    found, books = train(vectors, vector, parts, entries, rounds)
    cells = F.array_sort(F.collect_list(F.struct("pos", F.lower(F.lpad(F.hex("entry"), 2, "0")).alias("hex"))))
    rows = found.groupBy("row", "vec_id", "label").agg(F.array_join(F.transform(cells, lambda x: x["hex"]), "").alias("code"), F.sum("error").alias("error"))
    labels = found.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    labels = labels.select(F.col("label").alias("_label"), F.least("total", F.lit(MOST_LONG).cast("decimal(38,0)")).cast("long").alias("label_error"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_salt"))
    spread = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(64)).cast("int"))
    same = spread["label"].eqNullSafe(labels["_label"]) & (spread["salt"] == labels["_salt"])
    return spread.join(labels.hint("merge"), same).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))

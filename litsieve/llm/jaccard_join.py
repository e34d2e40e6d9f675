"""N-gram Jaccard self-join with a token-group matrix.

Documents become sets of hashed k-word shingles. A sketch counts in how many documents each shingle occurs, in a fixed
number of counters, so that every document can order its tokens from rare to frequent (ties by hash: one order for
all). Two sets with Jaccard >= num/den must share l of their first n - ceil(n * num/den) + l tokens in any such order,
for l up to the overlap they need; with l = NEED these are the candidate keys. Equal sets are put into one class first and represented by one document, so large
groups of copies cost nothing more. linking.link() then finds the components exactly: groups of similar documents,
each group's token union, a bound on the query-group overlap, and only qualifying groups opened.

Hash collisions aside (64 bits; a false link needs several within one pair), the result is exact.

Defined cases: a null or blank text has an empty set and is linked with nothing; texts with fewer than k words have
their whole word sequence as one token; a text of any length is one set; equal sets, so repeated rows too, are one
class. Rows are the documents: rows that share a doc_id but not a text are separate, and each gets the smallest doc_id
of the rows that its own links reach. A null doc_id takes part, but is no component's smallest id unless all are null;
empty sets keep their own. Ties of frequency are ordered by hash; an empty table gives no rows; extra columns of any
name are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only_ids, slices, small_batches, written
from .linking import link
from .shingles import shingles, word_hashes

COUNTERS, BLOCKS, NEED = 1 << 20, 64, 6
SETS = "doc_id long, mark long, place long, n long, node long, keys array<long>"


def _sets(part: pa.RecordBatch, k: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the texts in a batch and the bounds of each text's run."""
    texts = part.column("text").to_pylist()
    hashes, text, _, _ = word_hashes(texts, lower)
    tokens, of = shingles(hashes, text, len(texts), k)
    return tokens, np.searchsorted(of, np.arange(len(texts) + 1))


def _slot(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(44)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch], k: int, lower: bool) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COUNTERS, dtype=np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            tokens, _ = _sets(part, k, lower)
            counts += np.bincount(_slot(tokens), minlength=COUNTERS)
    if counts.any():
        rows = counts.astype("<u4").reshape(BLOCKS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([zlib.compress(r.tobytes(), 1) for r in rows], pa.binary())], ["block", "counts"])


def _sum(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(c), "<u4").astype(np.int64) for c in rows.counts)
    level = np.round(4 * np.log2(1 + total)).astype("u1")
    return pd.DataFrame({"block": rows.block.iloc[:1], "counts": [level.tobytes()]})


def frequency_levels(docs: DataFrame, k: int, lower: bool) -> bytes:
    """One byte per counter: the logarithm of its count over all documents. COUNTERS bytes, whatever the input."""
    counted = docs.select("text").mapInArrow(partial(_count, k=k, lower=lower), "block int, counts binary")
    summed = counted.groupBy("block").applyInPandas(_sum, "block int, counts binary").collect()
    by_block = {r["block"]: bytes(r["counts"]) for r in summed}
    return b"".join(by_block.get(b, bytes(COUNTERS // BLOCKS)) for b in range(BLOCKS))


def _node(own: np.ndarray) -> int:
    """The number of a set, the same for equal sets only (64 bits)."""
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def _describe(batches: Iterator[pa.RecordBatch], k: int, lower: bool, num: int, den: int, levels) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    level = np.frombuffer(levels.value, dtype=np.uint8)
    task, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        for part in slices(batch, "text"):
            tokens, bounds = _sets(part, k, lower)
            rank = level[_slot(tokens)]
            n_keys, nodes, keys = [], [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                n = b - a
                overlap = -(-n * num // den)
                first = n - overlap + min(NEED, overlap)
                own = tokens[a:b]
                keys.append(own[np.argsort(rank[a:b], kind="stable")[:first]].astype(np.int64) if n else own.astype(np.int64))
                n_keys.append(first)
                nodes.append(_node(own) if n else None)
            ends = np.concatenate([[0], np.cumsum(n_keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            place = (seen + np.arange(len(n_keys))) | task << 33
            seen += len(n_keys)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(place), pa.array(np.diff(bounds), pa.int64()), pa.array(nodes, pa.int64()), lists], ["doc_id", "mark", "place", "n", "node", "keys"])


def _tokens(batches: Iterator[pa.RecordBatch], k: int, lower: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            tokens, bounds = _sets(part, k, lower)
            filled = np.flatnonzero(np.diff(bounds))
            ids = [_node(tokens[bounds[i] : bounds[i + 1]]) for i in filled.tolist()]
            lists = pa.ListArray.from_arrays(pa.array(np.append(bounds[filled], bounds[-1]).astype(np.int32)), pa.array(tokens.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], ["id", "set"])


def text_mark(column: str):
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def classes(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, lower: bool = True) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id of its component), and, to tell
    rows of one doc_id apart, mark (text_mark) and component (a number of the component, null for empty sets)."""
    spark = docs.sparkSession
    small_batches(spark)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    levels = spark.sparkContext.broadcast(frequency_levels(read, k, lower))
    made = written(read.withColumn("mark", text_mark("text")).mapInArrow(partial(_describe, k=k, lower=lower, num=num, den=den, levels=levels), SETS), "described")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place"))
    equal = made.where("node is not null").groupBy("node").agg(first.alias("first"))
    equal = written(equal.select("node", "first.doc_id", F.col("first.place").alias("place")), "equal")
    firsts = made.join(equal.select("node", "place").hint("merge"), ["node", "place"], "left_semi")
    need = F.least(F.lit(NEED), F.ceil(F.col("n") * num / den)).cast("int")
    keys = firsts.select(F.explode("keys").alias("key"), F.col("node").alias("id"), "n", need.alias("need"))

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = equal.join(ids.select(F.col("id").alias("node")).hint("merge"), "node", "left_semi")
        sets = only_ids(read, wanted).mapInArrow(partial(_tokens, k=k, lower=lower), "id long, set array<long>")
        return sets.join(ids.hint("merge"), "id", "left_semi").dropDuplicates(["id"])

    found = link(keys, sets_of, num, den, prefixes=True).withColumnRenamed("id", "node")
    reached = equal.select("node", "doc_id").join(found.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = reached.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = written(reached.select("node", "component").join(least.hint("merge"), "component").select("node", "component", "component_id"), "named")
    joined = made.select("doc_id", "mark", "n", "node").join(named.hint("merge"), "node", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "mark", "component")

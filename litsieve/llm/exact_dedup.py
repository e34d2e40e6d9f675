"""Exact deduplication over a cuckoo-filter index of live digests.

The index is a pair of tables dealt into buckets by digest: `filters` (bucket, slots) holds one cuckoo filter per
bucket, `keys` (bucket, digest, keep_id, group_size) the stored live digests. Inserting and deleting go bucket by
bucket: a filter miss proves a digest new; a hit is verified against the bucket's stored keys; a full filter is
rebuilt at twice the size from the stored keys. A bucket's size is bounded by the number of *distinct* digests,
because equal texts are summed up before they are dealt; `salts` splits a hot digest during that sum.

Texts that make up more than a share of 1 / HOT_SHARE of the rows, fewer than HOT_SHARE then, meet their rows without a
shuffle; all others are joined by digest.

Defined cases: a null text counts as empty; a null id never wins over a number, and where all ids of a text are null
every row of it carries kept = true; repeated rows are rows of their group; a text of any length is one digest; empty
input gives empty output; extra columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffles, text_or_empty, written

SLOTS, KICKS, HOT_SHARE = 4, 200, 1000
INDEX = "bucket int, digest string, keep_id long, group_size long, slots binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class CuckooFilter:
    """16-bit fingerprints in rows of four slots; a fingerprint lives in one of two rows (partial-key hashing)."""

    def __init__(self, rows: int):
        self.rows = 1 << max(3, int(rows - 1).bit_length())
        self.table = np.zeros((self.rows, SLOTS), dtype=np.uint16)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(int(keys / SLOTS / 0.8) + 1)

    @classmethod
    def loads(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, dtype="<u2").reshape(-1, SLOTS).copy()
        made = cls(len(table))
        made.table = table
        return made

    def dumps(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mixed = _mix(keys)
        mark = (mixed >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (mixed & np.uint64(self.rows - 1)).astype(np.int64)
        return mark, first, first ^ self._jump(mark)

    def _jump(self, mark: np.ndarray) -> np.ndarray:
        return (_mix(mark) & np.uint64(self.rows - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(keys)
        return ((self.table[a] == mark[:, None]) | (self.table[b] == mark[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if a key found no place; the filter is then to be rebuilt larger."""
        mark, a, b = self._places(keys)
        return all(self._put(m, i, j) for m, i, j in zip(mark, a.tolist(), b.tolist(), strict=True))

    def _put(self, mark: np.uint16, i: int, j: int) -> bool:
        for at in (i, j):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        at = j
        for kick in range(KICKS):
            slot = kick % SLOTS
            self.table[at, slot], mark = mark, self.table[at, slot]
            at ^= int(self._jump(np.array([mark]))[0])
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Takes one copy of each key's fingerprint out; the keys must be live (verified by the caller)."""
        mark, a, b = self._places(keys)
        for m, i, j in zip(mark, a.tolist(), b.tolist(), strict=True):
            for at in (i, j):
                found = np.flatnonzero(self.table[at] == m)
                if len(found):
                    self.table[at, found[0]] = 0
                    break


def _words(digests) -> np.ndarray:
    """The 64 bits of a hex digest that follow those which chose the bucket."""
    return np.array([int(d[8:24], 16) for d in digests], dtype=np.uint64)


def _rebuilt(digests: pd.Series, least: int) -> CuckooFilter:
    filled = CuckooFilter.sized(max(least, len(digests)))
    while not filled.insert(_words(digests)):
        filled = CuckooFilter(filled.rows * 2)
    return filled


def _state(stored: pd.DataFrame) -> tuple[CuckooFilter, pd.DataFrame]:
    kept = stored[stored.digest.notna()]
    marks = stored[stored.slots.notna()].slots
    return (CuckooFilter.loads(marks.iloc[0]) if len(marks) else CuckooFilter.sized(max(16, len(kept)))), kept


def _returned(bucket: int, filled: CuckooFilter, keys: pd.DataFrame) -> pd.DataFrame:
    rows = keys[["digest", "keep_id", "group_size"]].assign(bucket=bucket, slots=None)
    return pd.concat([rows, pd.DataFrame({"bucket": [bucket], "slots": [filled.dumps()]})])[["bucket", "digest", "keep_id", "group_size", "slots"]].astype({"keep_id": "Int64", "group_size": "Int64"})


class Bucket:
    """The live digests of one bucket behind their filter. `verified` counts the lookups of stored content."""

    def __init__(self, stored: pd.DataFrame):
        self.filled, kept = _state(stored)
        self.live = {d: (i, n) for d, i, n in zip(kept.digest, kept.keep_id, kept.group_size, strict=True)}
        self.verified = 0

    def insert(self, more: pd.DataFrame) -> None:
        """more: digest, keep_id, group_size. A miss is new and goes in without a lookup; only a hit is verified."""
        words = _words(more.digest)
        rows = list(zip(more.digest, more.keep_id, more.group_size, strict=True))
        for at in range(0, len(rows), 4096):
            waiting: dict[str, tuple] = {}
            for hit, (digest, keep, size) in zip(self.filled.contains(words[at : at + 4096]), rows[at : at + 4096], strict=True):
                known = waiting.get(digest)  # of this batch, not in the filter yet
                if known is None and hit:
                    self.verified += 1
                    known = self.live.get(digest)
                    if known is not None:
                        self.live[digest] = _joined(known, keep, size)
                        continue
                waiting[digest] = (keep, size) if known is None else _joined(known, keep, size)
            self.live.update(waiting)
            if waiting and not self.filled.insert(_words(list(waiting))):
                self.filled = _rebuilt(pd.Series(list(self.live)), 2 * len(self.live))

    def rows(self, bucket: int) -> pd.DataFrame:
        digests, values = list(self.live), list(self.live.values())
        keys = pd.DataFrame({"digest": digests, "keep_id": pd.array([v[0] for v in values], dtype="Int64"), "group_size": [v[1] for v in values]})
        return _returned(bucket, self.filled, keys)


def _joined(known: tuple, keep: int | None, size: int) -> tuple:
    """The larger id stays live; a missing one never does beside a number."""
    ids = [i for i in (known[0], keep) if not pd.isna(i)]
    return (max(ids) if ids else None, known[1] + size)


def _insert_bucket(bucket: int, stored: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
    held = Bucket(stored)
    held.insert(more)
    return held.rows(bucket)


def _delete_bucket(bucket: int, stored: pd.DataFrame, gone: pd.DataFrame) -> pd.DataFrame:
    filled, keys = _state(stored)
    asked = gone.digest.drop_duplicates()
    asked = asked[filled.contains(_words(asked))]
    live = asked[asked.isin(set(keys.digest))]  # a false positive must not take another key's fingerprint
    filled.delete(_words(live))
    return _returned(bucket, filled, keys[~keys.digest.isin(set(live))])


def _bucket(buckets: int):
    return F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def _cogrouped(index: DataFrame, more: DataFrame, buckets: int, apply) -> DataFrame:
    def run(key: tuple, stored: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        return apply(int(key[0]), stored, rows)

    return index.groupBy("bucket").cogroup(more.withColumn("bucket", _bucket(buckets)).groupBy("bucket")).applyInPandas(run, INDEX)


def empty_index(spark) -> DataFrame:
    return spark.createDataFrame([], INDEX)


def insert(index: DataFrame, keys: DataFrame, buckets: int) -> DataFrame:
    """index with keys (digest, keep_id, group_size) put in; `buckets` must be that of the index."""
    return _cogrouped(index, keys.select("digest", "keep_id", "group_size"), buckets, _insert_bucket)


def delete(index: DataFrame, keys: DataFrame, buckets: int) -> DataFrame:
    """index without the digests of keys; digests that are not live change nothing."""
    return _cogrouped(index, keys.select("digest"), buckets, _delete_bucket)


def lookup(index: DataFrame, digests: DataFrame, buckets: int) -> DataFrame:
    """(digest, hit, live) of distinct digests: the filter's answer, and the answer after verification."""

    def run(key: tuple, stored: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        filled, keys = _state(stored)
        asked = rows.digest.drop_duplicates().reset_index(drop=True)
        hits = filled.contains(_words(asked))
        return pd.DataFrame({"digest": asked, "hit": hits, "live": hits & asked.isin(set(keys.digest)).to_numpy()})

    return index.groupBy("bucket").cogroup(digests.select("digest").withColumn("bucket", _bucket(buckets)).groupBy("bucket")).applyInPandas(run, "digest string, hit boolean, live boolean")


def fresh_index(keys: DataFrame, buckets: int) -> DataFrame:
    """insert() into an empty index, without a cogroup."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"digest": pd.Series(dtype=object), "keep_id": pd.Series(dtype="int64"), "group_size": pd.Series(dtype="int64"), "slots": pd.Series(dtype=object)})
        return _insert_bucket(int(key[0]), empty, rows)

    return keys.select("digest", "keep_id", "group_size").withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInPandas(run, INDEX)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 50_000, salts: int = 8) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the largest id stays.

    Rows that repeat an id with the same text share its fate: all of them carry kept = true if that id stays.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text_or_empty(text_col).cast("binary"), 256).alias("digest"))
    rows = written(rows, "digests")
    buckets = max(shuffles(spark), rows.count() // bucket_rows + 1)
    salted = rows.groupBy("digest", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    index = written(fresh_index(salted, buckets), "cuckoo")
    live = index.where("digest is not null").select("digest", "keep_id", "group_size")
    hot = F.broadcast(live.where(F.col("group_size") * HOT_SHARE > rows.count()))  # fewer than HOT_SHARE rows, whatever the input
    rest = rows.join(hot.select("digest"), "digest", "left_anti").join(live.hint("merge"), "digest")
    joined = rows.join(hot, "digest").unionByName(rest)
    return joined.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), F.col("digest").alias("text_sha256"))

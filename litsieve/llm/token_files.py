"""Token-ID files in Simple-8b word-aligned coding.

A file holds consecutive documents in ascending doc_id order. Its ids are cut into blocks of BLOCK ids; a block is a run
of 64-bit little-endian words, each with a selector in the upper four bits that says how many ids of how many bits fill
the lower sixty, followed by the block's escapes. An id wider than the block's chosen width is coded as 0 and given as
an escape (place, value), so that a rare large id does not widen its neighbours. The footer holds each block's byte
offset, counts and the table of documents, so a reader decodes any block alone and all words of one selector at once.

    b"S8B1" | block* | footer | footer offset u64 | b"S8B1"
    block:  words u64[n_words], escape places u32[n_escapes], escape values u64[n_escapes]
    footer: n_blocks u32, n_docs u32, then per block offset u64, n_ids u32, n_words u32, n_escapes u32,
            then doc_id i64[n_docs], has_id u8[n_docs], n_tokens u64[n_docs]

Files are written by the tasks to a folder all executors share; a manifest, written by Spark's own commit, names those
of the attempts that succeeded. Only these are read.

Defined cases: a null text is empty and has the end id alone; a null doc_id comes first; rows that share a doc_id, or
have none, go by the crc32 of their text, then its length; repeated rows are repeated documents; a text of any length
is encoded whole and spans as many blocks as it needs; an empty table gives no files and no rows; extra columns of any
name are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, shuffles, slices, small_batches, written
from .tokens import encode_column

MAGIC, BLOCK, FILE_IDS = b"S8B1", 1 << 16, 1 << 25
# Fixed values of the coding: ids to a word and bits to an id, by selector from 1 up.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
MANIFEST = "part int, seq int, path string, n_docs long, n_ids long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def encode_block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, escape places and escape values of up to BLOCK unsigned ids."""
    n, ids = len(ids), ids.astype(np.uint64)
    width = np.zeros(n, dtype=np.int64)
    for b in BITS[1:]:
        width += ids >> np.uint64(b) > 0
    width = np.append(BITS, 64)[1:][width]  # the least selector width that holds each id
    cost = [(n * b / 60 + 1.5 * np.count_nonzero(width > b), b) for b in BITS[1:]]
    limit = min(cost)[1]
    places = np.flatnonzero(width > limit)
    values = ids[places]
    if len(places):
        ids, width = ids.copy(), width.copy()
        ids[places], width[places] = 0, 1
    step, chosen = np.ones(n, dtype=np.int64), np.full(n, len(BITS) - 1, dtype=np.int64)
    left = np.arange(n)
    for selector in range(len(BITS) - 2, 0, -1):  # from few wide ids to many narrow ones: where one doesn't fit, no narrower does
        bad = np.append(np.flatnonzero(width > BITS[selector]), n)
        if len(left) > n // 8:
            ahead = np.full(n + 1, n)
            ahead[bad] = bad
            run = np.minimum.accumulate(ahead[::-1])[::-1][left] - left
        else:
            run = bad[np.searchsorted(bad, left)] - left
        left = left[run >= np.minimum(COUNTS[selector], n - left)]
        if not len(left):
            break
        step[left], chosen[left] = COUNTS[selector], selector
    starts, at, jump = [], 0, step.tolist()
    while at < n:
        starts.append(at)
        at += jump[at]
    first = np.array(starts, dtype=np.int64)
    words = chosen[first].astype(np.uint64) << np.uint64(60)
    padded = np.append(ids, np.zeros(60, dtype=np.uint64))
    for selector in np.unique(chosen[first]):
        of = np.flatnonzero(chosen[first] == selector)
        packed = np.zeros(len(of), dtype=np.uint64)
        for k in range(COUNTS[selector]):
            at_k = first[of] + k
            packed |= np.where(at_k < n, padded[at_k], 0).astype(np.uint64) << np.uint64(k * BITS[selector])
        words[of] |= packed
    return words, places.astype(np.uint32), values


def decode_block(words: np.ndarray, n: int, places: np.ndarray, values: np.ndarray) -> np.ndarray:
    selectors = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[selectors])
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    for selector in np.unique(selectors):
        of = np.flatnonzero(selectors == selector)
        begin = ends[of] - COUNTS[selector]
        mask = np.uint64((1 << int(BITS[selector])) - 1)
        for k in range(COUNTS[selector]):
            out[begin + k] = (words[of] >> np.uint64(k * BITS[selector])) & mask
    out = out[:n]
    out[places] = values
    return out


class Writer:
    def __init__(self, uri: str):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.out, self.at, self.blocks = uri, store.open_output_stream(path), 0, []
        self.waiting, self.n_waiting, self.n_ids = [], 0, 0
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _block(self, ids: np.ndarray) -> None:
        words, places, values = encode_block(ids)
        self.blocks.append((self.at, len(ids), len(words), len(places)))
        self._put(words.astype("<u8").tobytes() + places.astype("<u4").tobytes() + values.astype("<u8").tobytes())

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.sizes.append(len(ids))
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, dtype=np.uint32)
        upto = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, upto, BLOCK):
            self._block(ids[i : min(i + BLOCK, upto)])
        self.waiting, self.n_waiting = [ids[upto:]], len(ids) - upto

    def close(self) -> tuple[str, int, int]:
        self._flush(True)
        at = self.at
        self._put(struct.pack("<II", len(self.blocks), len(self.doc_ids)))
        self._put(b"".join(struct.pack("<QIII", *b) for b in self.blocks))
        self._put(np.array([d or 0 for d in self.doc_ids], dtype="<i8").tobytes())
        self._put(np.array([d is not None for d in self.doc_ids], dtype="u1").tobytes())
        self._put(np.array(self.sizes, dtype="<u8").tobytes())
        self._put(struct.pack("<Q", at) + MAGIC)
        self.out.close()
        return self.uri, len(self.doc_ids), self.n_ids


class Reader:
    """Reads the footer, then blocks one at a time."""

    def __init__(self, uri: str):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)
        end = self.file.size()
        at, magic = struct.unpack("<Q4s", self.file.read_at(12, end - 12))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        foot = self.file.read_at(end - 12 - at, at)
        n_blocks, n_docs = struct.unpack_from("<II", foot)
        self.blocks = [struct.unpack_from("<QIII", foot, 8 + 20 * i) for i in range(n_blocks)]
        rest = 8 + 20 * n_blocks
        ids = np.frombuffer(foot, "<i8", n_docs, rest)
        has = np.frombuffer(foot, "u1", n_docs, rest + 8 * n_docs)
        self.doc_ids = [int(d) if h else None for d, h in zip(ids, has, strict=True)]
        self.sizes = np.frombuffer(foot, "<u8", n_docs, rest + 9 * n_docs).astype(np.int64)

    def block(self, k: int) -> np.ndarray:
        offset, n, n_words, n_escapes = self.blocks[k]
        data = self.file.read_at(8 * n_words + 12 * n_escapes, offset)
        places = np.frombuffer(data, "<u4", n_escapes, 8 * n_words)
        return decode_block(np.frombuffer(data, "<u8", n_words), n, places, np.frombuffer(data, "<u8", n_escapes, 8 * n_words + 4 * n_escapes))

    def documents(self) -> Iterator[tuple[int | None, int, int, list[np.ndarray]]]:
        """doc_id, start in the file, size and the ids in parts."""
        k, left, start = 0, np.zeros(0, dtype=np.uint64), 0
        for doc_id, size in zip(self.doc_ids, self.sizes.tolist(), strict=True):
            parts, wanted = [], size
            while wanted:
                if not len(left):
                    left, k = self.block(k), k + 1
                parts.append(left[:wanted])
                left = left[wanted:]
                wanted -= len(parts[-1])
            yield doc_id, start, size, parts
            start += size


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int, file_ids: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task = TaskContext.get()
    part, rows, out = task.partitionId(), [], None
    end = np.array([end_id], dtype=np.uint32)
    for batch in batches:
        for some in slices(batch, "text", 2 << 20):
            for doc_id, ids in zip(some.column("doc_id").to_pylist(), encode_column(path, some.column("text")), strict=True):
                if out is None:
                    out = Writer(f"{folder}/part-{part:06d}-{len(rows):04d}-{task.taskAttemptId()}.s8b")
                out.add(doc_id, np.append(np.frombuffer(ids, "<u4"), end))
                if out.n_ids >= file_ids:
                    rows.append((part, len(rows), *out.close()))
                    out = None
    if out is not None:
        rows.append((part, len(rows), *out.close()))
    if rows:
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "seq", "path", "n_docs", "n_ids"])


def write_token_files(docs: DataFrame, path: str, end_id: int = 2, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes docs (doc_id, text) as token files in ascending doc_id order; returns the manifest in that order's keys."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = new_path(spark, "tokens")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["doc_id", "crc", "size"]  # so that rows of one id, or of none, are split too
    read = read.withColumns({"crc": F.crc32(F.col("text").cast("binary")), "size": F.char_length("text")})
    ordered = read.repartitionByRange(shuffles(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    return written(ordered.mapInArrow(partial(_write, folder=folder, path=path, end_id=end_id, file_ids=file_ids), MANIFEST), "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
            rows: list[tuple] = []
            for doc_id, start, size, parts in Reader(path).documents():
                crc = 0
                for p in parts:
                    crc = zlib.crc32(p.astype("<u4").tobytes(), crc)
                rows.append((doc_id, base + start, size, crc))
                if len(rows) == 10_000:
                    yield _row_batch(rows)
                    rows = []
            if rows:
                yield _row_batch(rows)


def _row_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The running sum runs over files, each of some 10^7 ids, not over documents.
    """
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return files.repartition(shuffles(manifest.sparkSession)).mapInArrow(_read, READ)

"""Substring deduplication by MinHash banding of paragraphs.

Paragraphs are lines of at least `line_words` words; a line of more than `long_words` is cut at anchors chosen by its own
words, the least run of ANCHOR words in reach of `line_words` on either side, so that the same words are cut alike in
whatever line they stand. Paragraphs with equal sets of k-word shingles are one node. MinHash signatures are cut into
bands, tuned so that two paragraphs at the threshold collide with the wanted probability; all that collide are decided by
exact Jaccard and clustered into components by linking.link(), which loses no colliding pair.

Repeats inside lines, or across them, are found as passages: each window of RUN words picks one run of `passage_words`
words inside it by its least run of a few words (a mod-minimizer), so the same window picks the same passage in whatever
text it stands, and a repeated run of RUN words or more holds an equal passage in every copy, with or without sentence
ends or line ends in it. Equal passages are one class; those that overlap in a text, and repeat the same text, are
joined into one span.

In each component the first paragraph by (doc_id, start) stays; the others are removals. Words and passages are
compared by 64-bit hashes of lower-cased words.

Defined cases: a null text has no paragraphs; lines shorter than `line_words` and texts of fewer than RUN words hold no
paragraph or passage; a text of any length is read whole; repeated rows repeat their paragraphs; ties of (doc_id, start),
as of rows that share an id, go by the rows' places in the input; null ids come last; an empty table, or one without
repeats, gives no rows; extra columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only_ids, slices, small_batches, written
from .linking import link
from .shingles import mix, runs, shingles, word_hashes

RUN, ANCHOR = 51, 3
PARAGRAPHS = "row long, doc_id long, line int, at int, start int, stop int, n_words int, n long, node long, keys array<long>"
NAMES = [x.split()[0] for x in PARAGRAPHS.split(", ")]


def tune_bands(threshold: float, recall: float = 0.9998, most: int = 36) -> tuple[int, int]:
    """(bands, rows): the longest rows for which pairs at the threshold collide with probability `recall`."""
    fit = [r for r in range(1, most + 1) if 1 - (1 - threshold**r) ** (most // r) >= recall]
    rows = max(fit, default=1)
    return most // rows, rows


def anchors(hashes: np.ndarray, reach: int) -> np.ndarray:
    """Words at which a line is cut: the least run of ANCHOR words in reach on both sides, so cuts are more than reach apart."""
    grams = runs(hashes, ANCHOR)
    if len(grams) <= 2 * reach:
        return np.zeros(0, dtype=np.int64)
    around = np.lib.stride_tricks.sliding_window_view(grams, 2 * reach + 1)
    return np.flatnonzero((around.argmin(axis=1) == reach)) + reach


def _lines(texts: list[str | None], line_words: int, long_words: int) -> tuple[list[str], list[int], list[int], list[int]]:
    """Paragraphs: text, number of the document, number of the line, start."""
    lines, of, number, begin = [], [], [], []
    for d, text in enumerate(texts):
        at = 0
        for k, line in enumerate((text or "").split("\n")):
            if len(line) >= 2 * line_words - 1 and (n := len(line.split())) >= line_words:
                cuts = [0, *(_cuts(line, line_words) if n > long_words else ()), len(line)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    lines.append(line[a:b])
                    of.append(d)
                    number.append(k)
                    begin.append(at + a)
            at += len(line) + 1
    return lines, of, number, begin


def _cuts(line: str, reach: int) -> list[int]:
    hashes, _, first_byte, _ = word_hashes([line])
    data = line.encode("utf-8", "surrogatepass")
    return [len(data[:b].decode("utf-8", "surrogatepass")) for b in first_byte[anchors(hashes, reach)].tolist()]


def _node(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def _seeds(rows: int, band: int) -> np.ndarray:
    return mix(np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(band)) | np.uint64(1)


def _fold(mins: list[np.ndarray], band: int) -> np.ndarray:
    key = np.full(len(mins[0]), band + 1, dtype=np.uint64)
    for least in mins:
        key = mix(key * np.uint64(0xA0761D6478BD642F) + least)
    return key


def _value(tokens: np.ndarray, seed: np.uint64) -> np.ndarray:
    return (tokens * seed) >> np.uint64(20)


def line_keys(tokens: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[sets, bands] of 64-bit band keys; no set may be empty."""
    each = [_fold([np.minimum.reduceat(_value(tokens, s), bounds[:-1]) for s in _seeds(rows, b)], b) for b in range(1, bands + 1)]
    return np.stack(each, axis=1)


def passage_starts(hashes: np.ndarray, text: np.ndarray, passage_words: int, run: int) -> np.ndarray:
    """First words of the passages: every `run` words of a text hold a whole one, chosen by these words alone."""
    choices = run - passage_words + 1
    gram = min(choices + passage_words % choices, passage_words)
    windows, wide = len(hashes) - run + 1, run - gram + 1
    if windows <= 0:
        return np.zeros(0, dtype=np.int64)
    grams = runs(hashes, gram)
    least, have = (grams & ~np.uint64(0xFFFFFFFF)) | np.arange(len(grams), dtype=np.uint64), 1  # of equal ones the first
    while 2 * have <= wide:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    least = np.minimum(least[:windows], least[wide - have : wide - have + windows])
    first = np.arange(windows)
    start = first + ((least & np.uint64(0xFFFFFFFF)).astype(np.int64) - first) % choices
    return np.unique(start[text[:windows] == text[run - 1 :]])


def passage_keys(hashes: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of `length` words that begins at `first`."""
    value = np.zeros(len(first), dtype=np.uint64)
    for j, f in enumerate(_seeds(length, 0)):
        value += hashes[first + j] * f
    return mix(value)


def _line_sets(texts: list[str | None], k: int, line_words: int, long_words: int) -> tuple:
    lines, of, number, begin = _lines(texts, line_words, long_words)
    hashes, text, _, _ = word_hashes(lines)
    tokens, owner = shingles(hashes, text, len(lines), k)
    return lines, of, number, begin, np.bincount(text, minlength=len(lines)), tokens, np.searchsorted(owner, np.arange(len(lines) + 1))


def _line_batch(rows: np.ndarray, ids: pa.Array, texts: list[str | None], k: int, line_words: int, long_words: int, bands: int, width: int) -> pa.RecordBatch | None:
    lines, of, number, begin, words, tokens, bounds = _line_sets(texts, k, line_words, long_words)
    if not lines:
        return None
    keys = line_keys(tokens, bounds, bands, width).astype(np.int64)
    nodes = [_node(tokens[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    begin, size = np.array(begin), np.array([len(x) for x in lines])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(lines) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
    columns = [pa.array(rows[of]), ids.take(pa.array(of)), pa.array(number, pa.int32()), pa.nulls(len(lines), pa.int32()), pa.array(begin, pa.int32()), pa.array(begin + size, pa.int32())]
    columns += [pa.array(words, pa.int32()), pa.array(np.diff(bounds)), pa.array(nodes, pa.int64()), lists]
    return pa.RecordBatch.from_arrays(columns, NAMES)


def _passage_batch(rows: np.ndarray, ids: pa.Array, texts: list[str | None], passage_words: int) -> pa.RecordBatch | None:
    hashes, text, first_byte, last_byte = word_hashes(texts)
    w0 = passage_starts(hashes, text, passage_words, max(RUN, passage_words))
    if not len(w0):
        return None
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"".join(data), dtype=np.uint8)
    base = np.cumsum([0] + [len(d) for d in data])[:-1]
    last = w0 + passage_words - 1
    point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
    of = text[last]
    key = passage_keys(hashes, w0, passage_words).astype(np.int64)
    start = point[base[of] + first_byte[w0]] - point[base[of]]
    stop = point[base[of] + last_byte[last]] - point[base[of]]
    at = w0 - np.searchsorted(text, of)
    none = lambda kind: pa.nulls(len(w0), kind)
    columns = [pa.array(rows[of]), ids.take(pa.array(of)), none(pa.int32()), pa.array(at, pa.int32()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())]
    columns += [none(pa.int32()), none(pa.int64()), pa.array(key), none(pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, NAMES)


def _describe(batches: Iterator[pa.RecordBatch], k: int, line_words: int, long_words: int, passage_words: int, bands: int, width: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        for part in slices(batch, "text"):
            ids, texts = part.column("doc_id"), part.column("text").to_pylist()
            rows = (seen + np.arange(len(texts))) | task << 33
            seen += len(texts)
            made = (_line_batch(rows, ids, texts, k, line_words, long_words, bands, width), _passage_batch(rows, ids, texts, passage_words))
            yield from (x for x in made if x is not None)


def _tokens(batches: Iterator[pa.RecordBatch], k: int, line_words: int, long_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            *_, tokens, bounds = _line_sets(part.column("text").to_pylist(), k, line_words, long_words)
            ids = [_node(tokens[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(tokens.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], ["id", "set"])


ORDER = "struct(doc_id is null as none, doc_id, start, row) as place"


def repeated_paragraphs(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, line_words: int = 50, long_words: int = 300, passage_words: int = 45, recall: float = 0.9998) -> DataFrame:
    """Paragraphs of docs (doc_id, text) that repeat: doc_id, line, start, stop (code points), n_words, kind, component,
    members, keep_doc_id, keep_start, removed. line is null for passages, which can cross lines."""
    small_batches(docs.sparkSession)
    bands, width = tune_bands(num / den, recall)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    describe = partial(_describe, k=k, line_words=line_words, long_words=long_words, passage_words=passage_words, bands=bands, width=width)
    made = written(read.mapInArrow(describe, PARAGRAPHS), "paragraphs")
    lines, passages = made.where("line is not null"), made.where("line is null").select("row", "doc_id", "at", "start", "stop", F.col("node").alias("key"))
    return _alike_lines(read, lines, k, num, den, line_words, long_words).unionByName(_equal_passages(passages, passage_words))


def _alike_lines(read: DataFrame, lines: DataFrame, k: int, num: int, den: int, line_words: int, long_words: int) -> DataFrame:
    equal = written(lines.selectExpr("node", ORDER).groupBy("node").agg(F.min("place").alias("first"), F.count("*").alias("copies")), "equal")
    firsts = lines.join(equal.select("node", "first.row", "first.start").hint("merge"), ["node", "row", "start"], "left_semi")
    keys = firsts.select(F.explode("keys").alias("key"), F.col("node").alias("id"), "n", F.lit(1).alias("need"))

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = equal.join(ids.select(F.col("id").alias("node")).hint("merge"), "node", "left_semi").select("first.doc_id")
        sets = only_ids(read, wanted).mapInArrow(partial(_tokens, k=k, line_words=line_words, long_words=long_words), "id long, set array<long>")
        return only_ids(sets, ids, "id").join(ids.hint("merge"), "id", "left_semi").dropDuplicates(["id"])

    linked = link(keys, sets_of, num, den, prefixes=False).select(F.col("id").alias("node"), "component")
    reached = equal.join(linked.hint("merge"), "node", "left").where("copies > 1 or component is not null")
    reached = written(reached.withColumn("component", F.coalesce("component", "node")), "reached")
    keep = reached.groupBy("component").agg(F.min("first").alias("keep"), F.sum("copies").alias("members"))
    named = reached.select("node", "component").join(keep.hint("merge"), "component")
    out = lines.drop("keys").join(named.hint("merge"), "node")
    kept = (F.col("row") == F.col("keep.row")) & (F.col("start") == F.col("keep.start"))
    return out.select("doc_id", "line", "start", "stop", "n_words", F.lit("line").alias("kind"), "component", "members", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.start").alias("keep_start"), (~kept).alias("removed"))


def _equal_passages(passages: DataFrame, passage_words: int) -> DataFrame:
    met = written(passages.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "met")
    again = written(only_ids(passages, met.select("key"), "key"), "again")
    keep = again.selectExpr("key", ORDER).groupBy("key").agg(F.min("place").alias("keep"), F.count("*").alias("members")).where("members > 1")
    held = again.join(keep.hint("merge"), "key")
    held = held.withColumn("removed", (F.col("row") != F.col("keep.row")) | (F.col("start") != F.col("keep.start")))
    # the windows of one text, of which there are as many as its length allows, become spans
    own = Window.partitionBy("row").orderBy("start")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    other = (F.col("start") > F.coalesce(F.max("stop").over(before), F.lit(-1))) | ~F.lag("removed").over(own).eqNullSafe(F.col("removed")) | ~F.lag("keep.row").over(own).eqNullSafe(F.col("keep.row"))
    spans = held.withColumn("begins", other.cast("int")).withColumn("span", F.sum("begins").over(own)).groupBy("row", "span")
    spans = spans.agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("stop").alias("stop"), (F.max("at") - F.min("at") + passage_words).alias("n_words"),
        F.min(F.struct("start", "key")).alias("first"), F.max("members").alias("members"), F.min("keep").alias("keep"), F.first("removed").alias("removed"),
    )
    return spans.select("doc_id", F.lit(None).cast("int").alias("line"), "start", "stop", "n_words", F.lit("passage").alias("kind"), F.col("first.key").alias("component"), "members", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.start").alias("keep_start"), "removed")


def without_repeats(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """docs with the removed runs cut out of their texts; other columns stay as they are. Rows that share a doc_id share its runs."""
    gone = repeated.where("removed").groupBy(F.col("doc_id").alias("_of")).agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("_gone"))
    packed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    cut = packed.join(gone.hint("merge"), F.col("_id").eqNullSafe(F.col("_of")), "left")
    blank = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))

    def step(acc, x):
        gap = F.greatest(x["start"] - acc["at"], F.lit(0))
        kept = F.concat(acc["kept"], F.substr(F.col("text"), acc["at"] + 1, gap))
        return F.struct(kept.alias("kept"), F.greatest(acc["at"], x["stop"]).alias("at"))

    walked = F.aggregate("_gone", blank, step, lambda acc: F.concat(acc["kept"], F.substr(F.col("text"), acc["at"] + 1)))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(walked)
    return cut.select(*(text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns))

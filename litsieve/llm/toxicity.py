"""Toxicity scores from class-conditional Kneser-Ney models over word pieces.

A word (a run of letters, lower-cased) is two symbols: its stem, the first STEM letters, and its ending. For each class
the model is

    P_c(stem)          = (max(n_c(stem) - D, 0) + D * S_c * P(stem)) / n_c
    P_c(ending | stem) = (max(n_c(stem, ending) - D, 0) + D * S_c(stem) * P(ending)) / n_c(stem)

with absolute discount D, S the number of distinct symbols seen, and shared backoff counts: P(stem) from all documents,
P(ending) from the number of distinct stems it follows. n counts documents, so a word that one text repeats counts
once. A rare expression so falls back on what both classes share; what its few counts still say is weighted by c / (c + RARE),
c its count in the toxic class or the count due to it there. Texts are scored
by their length-normalised log-likelihood under the toxic and the ordinary model; a logistic curve turns this into a
score. It is fitted on at most `fit_rows` labelled rows, each scored by a model that has not counted it.

Shared counts come from all documents, class counts from all labelled training rows. Labels are
learnt from rows whose crc32(doc_id as text) modulo 3 is not 1. The model that goes to the tasks holds every
labelled word and every stem under its 64-bit hash, so it grows with the vocabulary and no word gets another's ratio.

Defined cases: null and blank texts are empty, get the score of no evidence; repeated rows count and are scored each;
empty tables, or labels of one class only, give no evidence: every score is then the share of toxic labels (0 if there
are none); several labels of a document count as toxic if one is; null labels are left out; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import only_ids, slices, small_batches, written
from .shingles import mix

STEM, DISCOUNT, RARE, BLOCK = 5, 0.75, 4.0, 1 << 14
# Classes of a labelled row: ordinary and toxic of either half.
KINDS = 4
_U = np.uint64
_BASE, _INVERSE = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    if "letters" not in _tables:
        _tables["letters"] = np.array([chr(c).isalpha() for c in range(1 << 16)] + [True])
    return _tables["letters"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, dtype=_U)
            x[0] = 1
            _tables[name] = np.multiply.accumulate(x)
    return _tables["up"][:n], _tables["down"][:n]


def word_pieces(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words: hash of the word, of its stem, of its ending, and number of the text."""
    lower = [(t or "").lower() for t in texts]
    size = np.array([len(t) + 1 for t in lower], dtype=np.int64)
    joined = "\n".join(lower) + "\n"
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[np.minimum(c, 1 << 16)]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], letter])))
    start, stop = edge[::2], edge[1::2]
    up, down = _powers(len(c))
    sums = np.concatenate([np.zeros(1, dtype=_U), np.cumsum(mix(c.astype(_U) + _U(1)) * up)])
    cut = np.minimum(start + STEM, stop)
    word = mix((sums[stop] - sums[start]) * down[start])
    stem = mix((sums[cut] - sums[start]) * down[start] + _U(1))
    ending = mix((sums[stop] - sums[cut]) * down[np.minimum(cut, len(c) - 1)] + _U(2))
    return word, stem, ending, np.searchsorted(np.cumsum(size), start, side="right")


def _documents_of_words(part: pa.RecordBatch) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of all words, then of each distinct (word, text) an index in order of words, its text, and where a word begins."""
    word, stem, ending, text = word_pieces(part.column("text").to_pylist())
    order = np.lexsort((text, word))
    w, t = word[order], text[order]
    new = np.ones(len(w), dtype=bool)
    new[1:] = (w[1:] != w[:-1]) | (t[1:] != t[:-1])
    order = order[new]
    w = word[order]
    begin = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, np.int64)
    return (word, stem, ending), order, text[order], begin


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            pieces, order, text, begin = _documents_of_words(part)
            if len(begin):
                counts = np.diff(np.append(begin, len(text))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(pa.array(x[order[begin]].astype(np.int64)) for x in pieces), pa.array(counts)], ["w", "s", "e", "n"])


def _count_kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            kinds = np.asarray(part.column("kind").to_numpy(zero_copy_only=False), dtype=np.int64)
            pieces, order, text, begin = _documents_of_words(part)
            if len(begin):
                counts = [np.add.reduceat((kinds[text] == k).astype(np.int64), begin).astype(np.int32) for k in range(KINDS)]
                yield pa.RecordBatch.from_arrays([pa.array(pieces[0][order[begin]].astype(np.int64)), *map(pa.array, counts)], ["w", *(f"n{k}" for k in range(KINDS))])


def _piece_tables(counts: DataFrame) -> tuple[DataFrame, DataFrame, dict]:
    """Per word and per stem the log-likelihood ratios of three models: first half, second half, both."""
    halves = {"a": ("n0", "n1"), "b": ("n2", "n3"), "c": ("n0 + n2", "n1 + n3")}
    sums = {f"{m}{c}": F.expr(f"cast({x} as double)") for m, xs in halves.items() for c, x in zip("ot", xs, strict=True)}
    words = counts.select("w", "s", "e", *(v.alias(k) for k, v in sums.items()), F.col("n").cast("double").alias("all"))
    names = list(sums)
    stems = words.groupBy("s").agg(*(F.sum(k).alias(f"s_{k}") for k in names), *(F.sum((F.col(k) > 0).cast("double")).alias(f"d_{k}") for k in names), F.sum("all").alias("s_all"))
    stems = written(stems, "stems")
    totals = stems.agg(*(F.coalesce(F.sum(f"s_{k}"), F.lit(0.0)).alias(f"t_{k}") for k in names), *(F.sum((F.col(f"s_{k}") > 0).cast("double")).alias(f"k_{k}") for k in names), F.sum("s_all").alias("t_all"), F.count("*").alias("stems")).first().asDict()
    endings = written(words.groupBy("e").agg(F.count("*").cast("double").alias("follows")), "endings")
    follows = endings.agg(F.sum("follows").alias("n")).first()["n"] or 1.0
    shared_stem = F.col("s_all") / F.lit(totals["t_all"] or 1.0)

    def stem_p(k: str) -> Column:
        return (F.greatest(F.col(f"s_{k}") - DISCOUNT, F.lit(0.0)) + DISCOUNT * (totals[f"k_{k}"] or 1.0) * shared_stem) / F.lit(totals[f"t_{k}"] or 1.0)

    def rest(k: str) -> Column:
        return F.when(F.col(f"s_{k}") > 0, DISCOUNT * F.col(f"d_{k}") / F.col(f"s_{k}")).otherwise(1.0)

    def ending_p(k: str) -> Column:
        seen = F.when(F.col(f"s_{k}") > 0, F.greatest(F.col(k) - DISCOUNT, F.lit(0.0)) / F.col(f"s_{k}")).otherwise(0.0)
        return seen + rest(k) * F.col("follows") / F.lit(follows)

    def weight(seen: str, every: str, m: str) -> Column:
        """Near 0 for expressions too rare to tell the classes apart, near 1 for frequent ones."""
        due = F.greatest(F.col(seen), F.col(every) * F.lit((totals[f"t_{m}t"] or 0.0) / (totals["t_all"] or 1.0)))
        return due / (due + RARE)

    def stem_ratio(m: str) -> Column:
        return F.log(stem_p(f"{m}t") / stem_p(f"{m}o")) * weight(f"s_{m}t", "s_all", m)

    def ending_ratio(m: str) -> Column:
        return F.log(ending_p(f"{m}t") / ending_p(f"{m}o")) * weight(f"{m}t", "all", m)

    unseen = stems.select("s", "s_all", *(stem_ratio(m).alias(m) for m in halves))
    known = words.where("ao + at + bo + bt > 0").join(stems.hint("merge"), "s").join(endings.hint("merge"), "e")
    known = known.select("w", "all", *((stem_ratio(m) + ending_ratio(m)).alias(m) for m in halves))
    return known, unseen, totals


def _pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    keys = rows.key.to_numpy().view(_U)
    order = np.argsort(keys)
    ratios = rows[["a", "b", "c"]].to_numpy()[order].astype("<f2")
    return pd.DataFrame({"block": [int(key[0])], "keys": [keys[order].astype("<u8").tobytes()], "ratios": [ratios.tobytes()]})


def _table(rows: DataFrame, key: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes, where those with each first bits begin, and [3, hashes] of ratios; nothing is left out."""
    rows = written(rows.select(F.col(key).alias("key"), "a", "b", "c"), "ratios")
    n = rows.count()
    bits = (n // BLOCK).bit_length() + 1
    packed = rows.withColumn("block", F.shiftrightunsigned("key", 64 - bits)).groupBy("block").applyInPandas(_pack, "block long, keys binary, ratios binary")
    blocks = sorted((r["block"], bytes(r["keys"]), bytes(r["ratios"])) for r in packed.toLocalIterator())
    keys = np.frombuffer(b"".join(b[1] for b in blocks), "<u8")
    ratios = np.ascontiguousarray(np.frombuffer(b"".join(b[2] for b in blocks), "<f2").reshape(-1, 3).T)
    near = max(n.bit_length(), 1)
    first = np.append(0, np.cumsum(np.bincount((keys >> _U(64 - near)).astype(np.int64), minlength=1 << near))).astype(np.int32)
    return keys, first, ratios


def _ratios(table: tuple[np.ndarray, np.ndarray, np.ndarray], m: int, hashes: np.ndarray) -> np.ndarray:
    """Ratios of model m, NaN for hashes that are not in the table."""
    keys, first, ratios = table
    out = np.full(len(hashes), np.nan, dtype=np.float16)
    top = (hashes >> _U(64 - (len(first) - 1).bit_length() + 1)).astype(np.int64)
    at, end = first[top], first[top + 1]
    left = np.flatnonzero(at < end)
    while len(left):
        hit = keys[at[left]] == hashes[left]
        out[left[hit]] = ratios[m, at[left[hit]]]
        left = left[~hit]
        at[left] += 1
        left = left[at[left] < end[left]]
    return out


def text_features(texts: list[str | None], words: tuple, stems: tuple, m: int) -> np.ndarray:
    """Per text by model m: mean log-likelihood ratio, mean of its strong part, share of strong words, log of the length."""
    word, stem, _, text = word_pieces(texts)
    ratio = _ratios(words, m, word)
    ratio = np.where(np.isnan(ratio), _ratios(stems, m, stem), ratio)
    ratio = np.clip(np.nan_to_num(ratio.astype(np.float64)), -6, 6)
    n = np.bincount(text, minlength=len(texts))
    mean = lambda x: np.bincount(text, weights=x, minlength=len(texts)) / np.maximum(n, 1)
    return np.stack([mean(ratio), mean(np.maximum(ratio - 2, 0)), np.sqrt(mean(ratio > 2)), np.log1p(n) / 10], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of the columns, then the constant; scaled ridge Newton steps."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return np.append(np.zeros(x.shape[1]), np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    mid, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mid) / scale, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge * len(y) ** 0.5), 0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (y - p) - penalty * w
        hess = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    out = w[:-1] / scale
    return np.append(out, w[-1] - (out * mid).sum())


def _features(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    words, stems = model.value
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            texts, kinds = part.column("text").to_pylist(), part.column("kind").to_numpy(zero_copy_only=False)
            first, second = (text_features(texts, words, stems, m) for m in (0, 1))
            x = np.where((kinds >= 2)[:, None], first, second)  # the half that hasn't counted the row
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array((kinds % 2).astype(np.int32)), lists], ["y", "x"])


def _score(batches: Iterator[pa.RecordBatch], model, weights: list[float]) -> Iterator[pa.RecordBatch]:
    words, stems = model.value
    w = np.array(weights)
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            x = text_features(part.column("text").to_pylist(), words, stems, 2)
            p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            rest = [part.column(c) for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(np.round(p, 6))], [c for c in part.schema.names if c != "text"] + ["score"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)), F.lit(0)) == 1


def scores(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, threshold: float | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, score. labels: (doc_id, toxic).

    With a threshold: the rows of docs with a score below it instead, with all their columns.
    """
    spark = docs.sparkSession
    small_batches(spark)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    taught = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    taught = taught.where(~held_out(F.col("doc_id")))
    half = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)).cast("int")  # 0 or 2
    known = written(taught.select("doc_id", (half + F.col("toxic")).alias("kind")), "taught")
    marked = only_ids(read.where("doc_id is not null"), known)  # so that only texts with labels are shuffled
    labelled = written(marked.join(known.hint("merge"), "doc_id").select("doc_id", "kind", "text"), "labelled")
    every = read.select("text").mapInArrow(_count, "w long, s long, e long, n int").groupBy("w").agg(F.min("s").alias("s"), F.min("e").alias("e"), F.sum("n").alias("n"))
    kinds = [f"n{k}" for k in range(KINDS)]
    own = labelled.select("kind", "text").mapInArrow(_count_kinds, "w long, " + ", ".join(f"{k} int" for k in kinds)).groupBy("w").agg(*(F.sum(k).alias(k) for k in kinds))
    counts = written(every.join(own.hint("merge"), "w", "left").select("w", "s", "e", "n", *(F.coalesce(k, F.lit(0)).alias(k) for k in kinds)), "counts")
    words, stems, totals = _piece_tables(counts)
    model = spark.sparkContext.broadcast((_table(words, "w"), _table(stems, "s")))
    share = min(1.0, fit_rows / max(known.count(), 1))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * share)).select("kind", "text")
    fitted = sample.mapInArrow(partial(_features, model=model), "y int, x array<double>").limit(2 * fit_rows).toPandas()
    x = np.array(fitted.x.tolist(), dtype=float).reshape(-1, 4)
    weights = fit_logistic(x, fitted.y.to_numpy(dtype=float)) if totals["t_co"] and totals["t_ct"] else fit_logistic(np.zeros((len(fitted), 4)), fitted.y.to_numpy(dtype=float))
    if threshold is not None:
        packed = docs.select(F.col("text").cast("string").alias("text"), F.struct("*").alias("row"))
        scored = packed.mapInArrow(partial(_score, model=model, weights=weights.tolist()), StructType([packed.schema["row"], StructField("score", DoubleType())]))
        return scored.where(F.col("score") < threshold).select("row.*")
    out = read.withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "text")
    return out.mapInArrow(partial(_score, model=model, weights=weights.tolist()), "doc_id long, held_out boolean, score double")

"""Spelling variant grouping: words one edit apart by PartEnum signatures of their letter multisets.

A word's letters, each numbered among its equals, are the ones of a binary vector: a replaced letter makes a Hamming
distance of two at most, an inserted or deleted one a distance of one. PartEnum deals the dimensions to n parts and takes
as signatures all choices of n - k parts: vectors at distance k or less agree on one of them at least. Words of one
length meet with k = 2, words whose lengths differ by one with k = 1; and as a single edit leaves one half of the word
as it is, a signature also holds that half (first or last letters), so anagram-rich vocabularies don't all meet. The
signatures are exact filters: no pair is lost. They are joined by equality, and the join itself verifies the edit
distance, so no unverified pair leaves it.

Forms: each word points to its most frequent near word if that is `ratio` times as frequent. As counts double along the
way, paths are at most 63 long, and pointer doubling finds their ends in six rounds.

Defined cases: null texts have no words; a null doc_id is written as the empty text before the colon; rows that share an
id or repeat another each count; × and ÷ are in the class of letters, as the pattern says; an empty table gives no rows.
A text is split in one row of memory, some ten times its size. Other columns, of any name, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, text_or_empty, written
from .shingles import mix

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
SAME, SHORTER, LONGER = 0, 1, 2
_U = np.uint64


def occurrences(docs: DataFrame, least_chars: int = 5, every: int = 97) -> DataFrame:
    """(word) per run of letters; of runs whose crc32 `every` divides, one code point is deleted."""
    lower = F.translate(text_or_empty(), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.char_length("run") >= least_chars).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    size = F.char_length("run")
    at = (F.col("h") % size).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, size))
    return runs.select(F.when(F.col("h") % every == 0, less).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= least_chars)


def vocabulary(docs: DataFrame, least_chars: int = 5, least_n: int = 3) -> DataFrame:
    """(word, n) of all words with at least `least_n` occurrences; counted in each task before the shuffle."""
    return occurrences(docs, least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def part_sums(words: list[str], n: int) -> np.ndarray:
    """Per word and part a 64-bit sum over the elements (letter, number among its equals) dealt to that part."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    text = np.repeat(np.arange(len(words)), sizes)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    order = np.lexsort((letters, text))
    text, letters = text[order], letters[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (letters[1:] != letters[:-1])
    first = np.flatnonzero(new)
    nth = np.arange(len(text)) - np.repeat(first, np.diff(np.append(first, len(text))))
    element = mix(letters.astype(_U) * _U(0x9E3779B97F4A7C15) + nth.astype(_U) + _U(1))
    out = np.zeros((len(words), n), dtype=_U)
    np.add.at(out, (text, ((element >> _U(33)) % _U(n)).astype(np.int64)), mix(element))
    return out


def enumerated(words: list[str], k: int, n: int) -> list[np.ndarray]:
    """PartEnum with one first-level part: a hash per choice of n - k of n parts."""
    sums, out = part_sums(words, n), []
    for number, chosen in enumerate(combinations(range(n), n - k)):
        value = np.full(len(words), 1 + number + (k << 8) + (n << 16), dtype=_U)
        for p in chosen:
            value = mix(value + sums[:, p])
        out.append(value)
    return out


def _half_hashes(words: list[str], half: list[int], last: bool) -> np.ndarray:
    """Hash of the first or last `half` letters, as a polynomial in the letters."""
    cut = [w[len(w) - h :] if last else w[:h] for w, h in zip(words, half, strict=True)]
    sizes = np.array(half, dtype=np.int64)
    ends = np.cumsum(sizes)
    letters = np.frombuffer("".join(cut).encode("utf-32-le"), dtype="<u4").astype(_U)
    place = np.arange(len(letters)) - np.repeat(ends - sizes, sizes)
    sums = np.concatenate([[_U(0)], np.cumsum(mix(letters * _U(0xD1B54A32D192ED03) + place.astype(_U)), dtype=_U)])
    return mix(sums[ends] - sums[ends - sizes] + _U(2 + last))


def _signatures(batches: Iterator[pa.RecordBatch], same_parts: int, other_parts: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1 << 15):
            batch = whole.slice(at, 1 << 15)
            words = batch.column("word").to_pylist()
            size = np.array([len(w) for w in words], dtype=np.int64)
            same, other = enumerated(words, 2, same_parts), enumerated(words, 1, other_parts)
            for role, values, shorter in ((SAME, same, size), (SHORTER, other, size), (LONGER, other, size - 1)):
                tag = mix(shorter.astype(_U) * _U(2) + _U(role != SAME))
                for last in (False, True):
                    key = mix(tag + _half_hashes(words, (shorter // 2).tolist(), last))
                    for value in values:
                        rows = [pa.array(mix(key + value).view(np.int64)), pa.array(np.full(len(words), role, dtype=np.int8))]
                        yield pa.record_batch([*rows, batch.column("word"), batch.column("n")], names=["sig", "role", "word", "n"])


def near_pairs(words: DataFrame, same_parts: int = 3, other_parts: int = 2) -> DataFrame:
    """words (word, n) -> (a, n_a, b, n_b), once a pair of words exactly one edit apart."""
    signed = written(words.mapInArrow(partial(_signatures, same_parts=same_parts, other_parts=other_parts), "sig long, role byte, word string, n long"), "signatures")
    left = signed.where(F.col("role") != LONGER).select("sig", "role", F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = signed.where(F.col("role") != SHORTER).select("sig", F.col("role").alias("other"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    meet = (left["sig"] == right["sig"]) & (F.char_length("a") + F.when(F.col("role") == SAME, 0).otherwise(1) == F.char_length("b"))
    fits = ((F.col("role") == SAME) & (F.col("other") == SAME) & (F.col("a") < F.col("b"))) | ((F.col("role") == SHORTER) & (F.col("other") == LONGER))
    return left.join(right.hint("merge"), meet & fits & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form) -> (word, root): from word, follow forms to the last, by pointer doubling."""
    paths = written(forms.select("word", F.col("form").alias("root")), "paths")
    for _ in range(6):  # paths of 63 steps at most, as counts double
        ahead = paths.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        last, paths = paths, written(paths.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("went")), "paths")
        dropped(last)
        if not paths.where("went").head(1):
            break
        paths = paths.drop("went")
    return paths.select("word", "root")


def groups(docs: DataFrame, least_chars: int = 5, least_n: int = 3, ratio: int = 2) -> DataFrame:
    """-> (word, form, root, n, n_near, form_n), one row a word."""
    words = written(vocabulary(docs, least_chars, least_n), "vocabulary")
    pairs = written(near_pairs(words), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("n_b").alias("m"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("n_a").alias("m"), F.col("a").alias("near")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best"))
    held = words.join(near.hint("merge"), "word", "left")
    far = F.col("best.less") * -1 >= F.col("n") * ratio
    held = written(held.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("best.near")).alias("form"), F.when(far, -F.col("best.less")).alias("form_n")), "near")
    ends = roots(held.where("form is not null").select("word", "form"))
    return held.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are lower-cased and their white space is normalised. An item of L code points with at most e
edits in a text shares at least L - q + 1 - q * e of its q-grams with it, and these lie on at most e + 1 neighbouring
diagonals (place in the text minus place in the item). So shared q-grams are counted in bands of 2 * (e + 1) diagonals
that overlap by half; only regions that meet the bound stay and are verified by banded alignment.

An item of L code points may have floor(share * L) edits, or floor((L - q) / q) where that is less, so that the lemma
leaves q-grams to count: none below 2 q. Items shorter than q hold no q-gram; they are searched without edits, as whole
words, by an automaton.

The benchmark is the stated query set: it is sent to the tasks in blocks of at most BLOCK_CHARS code points, each block
against all documents.

Defined cases: null texts and null items hold nothing, nor do items without text; equal items are all reported; repeated
rows are searched each, null ids reported as they are; of overlapping runs of an item the one with the fewest edits stays, of ties
the first; texts of any length are read whole; empty tables give no rows; extra columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches
from .shingles import mix

BLOCK_CHARS, BITS = 8 << 20, 22
HITS = "doc_id long, item_id long, start int, stop int, edits int"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def grams(c: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams of a code array."""
    out = np.zeros(max(0, len(c) - q + 1), dtype=np.uint64)
    for j in range(q):
        out = out * np.uint64(0x9E3779B97F4A7C15) + c[j : j + len(out)] + np.uint64(1)
    return mix(out)


def edit_budget(length: int, q: int, share: float) -> int:
    """share of the length, or less where the lemma would leave no q-gram to count."""
    return max(0, min(int(length * share), (length - q) // q))


@dataclass
class Items:
    """A block of benchmark items with the index of its q-grams."""

    q: int
    share: float
    ids: list[int] = field(default_factory=list)
    texts: list[np.ndarray] = field(default_factory=list)
    edits: list[int] = field(default_factory=list)
    short: dict[str, list[int]] = field(default_factory=dict)

    def add(self, item_id: int, text: str) -> None:
        text = normal(text)
        c = codes(text)
        if len(c) >= self.q:
            self.ids.append(item_id)
            self.texts.append(c)
            self.edits.append(edit_budget(len(c), self.q, self.share))
        elif text:
            self.short.setdefault(text, []).append(item_id)

    def index(self) -> None:
        self.automaton = None
        if self.short:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for text, ids in self.short.items():
                self.automaton.add_word(text, (len(text), ids))
            self.automaton.make_automaton()
        own = [grams(c, self.q) for c in self.texts]
        item = np.repeat(np.arange(len(own)), [len(g) for g in own])
        place = np.concatenate([np.arange(len(g)) for g in own]) if own else np.zeros(0, np.int64)
        all_grams = np.concatenate(own) if own else np.zeros(0, np.uint64)
        order = np.argsort(all_grams, kind="stable")
        self.item, self.place = item[order].astype(np.int64), place[order].astype(np.int64)
        self.gram, self.first, self.count = np.unique(all_grams[order], return_index=True, return_counts=True)
        self.bits = np.zeros(1 << BITS, dtype=bool)
        self.bits[(self.gram >> np.uint64(64 - BITS)).astype(np.int64)] = True
        self.length = np.array([len(c) for c in self.texts], dtype=np.int64)
        self.edit = np.array(self.edits, dtype=np.int64)
        self.least = self.length - self.q + 1 - self.q * self.edit

    def regions(self, c: np.ndarray) -> list[tuple[int, int]]:
        """(item, first diagonal of the band) of the bands that hold enough shared q-grams."""
        g = grams(c, self.q)
        at = np.flatnonzero(self.bits[(g >> np.uint64(64 - BITS)).astype(np.int64)])
        i = np.searchsorted(self.gram, g[at])
        i[i == len(self.gram)] = 0
        good = self.gram[i] == g[at] if len(self.gram) else np.zeros(0, bool)
        at, i = at[good], i[good]
        times = self.count[i]
        offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        posting = np.repeat(self.first[i], times) + offset
        item, diagonal = self.item[posting], np.repeat(at, times) - self.place[posting]
        width = self.edit[item] + 1
        band = (diagonal + (1 << 38)) // width  # stride e + 1; each diagonal is in this band and the one before
        key = np.concatenate([item << 40 | band, item << 40 | (band - 1)])
        key, n = np.unique(key, return_counts=True)
        item = key >> 40
        enough = n >= self.least[item]
        item, band = item[enough], (key & ((1 << 40) - 1))[enough]
        return list(zip(item.tolist(), (band * (self.edit[item] + 1) - (1 << 38)).tolist(), strict=True))


def align(item: np.ndarray, window: np.ndarray, most: int, low: int | None = None, high: int | None = None) -> tuple[int, int, int] | None:
    """Least edits between item and any run of the window, with the run; None above `most`.

    Banded: of each row only the places on the diagonals low to high (place in the window minus place in the item).
    """
    n, m, far = len(window), len(item), 1 << 40
    low, high = -m if low is None else low, n if high is None else high
    whole = window.tobytes().find(item.tobytes())
    if whole >= 0 and whole % item.itemsize == 0 and low <= whole // item.itemsize <= high:
        return 0, whole // item.itemsize, whole // item.itemsize + m
    diagonal = np.arange(low, high + 1)
    step, wide = np.arange(len(diagonal)), len(diagonal)
    before, after = max(0, -low), max(0, high + m - n)
    # outside the window nothing matches; what runs past its end is left out at last, and nothing begins before it
    none = np.full(before + after + 1, 1 << 60, dtype=np.uint64)
    padded = np.concatenate([none[:before], window, none[:after]])
    cost, origin = np.where((diagonal >= 0) & (diagonal <= n), 0, far), diagonal.copy()
    for r in range(m):
        begin = low + r + before
        diag = cost + (padded[begin : begin + wide] != item[r])
        up = cost[1:] + 1
        shorter = up < diag[:-1]
        begun = origin.copy()
        np.copyto(begun[:-1], origin[1:], where=shorter)
        np.minimum(diag[:-1], up, out=diag[:-1])
        slid = diag - step
        lead = np.minimum.accumulate(slid)
        source = np.maximum.accumulate(np.where(slid == lead, step, 0))
        cost, origin = lead + step, begun[source]
        if r % 8 == 7 and cost.min() > most:
            return None
    cost[diagonal + m > n] = far
    best = int(np.argmin(cost))
    if cost[best] > most:
        return None
    return int(cost[best]), int(origin[best]), int(diagonal[best]) + m


def _found(items: Items, doc: np.ndarray, part: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(item, start, stop, edits) in one document; of overlapping runs of an item the closest stays."""
    best: list[tuple[int, int, int, int]] = []
    for item, diagonal in part:
        e, length = items.edits[item], len(items.texts[item])
        lo = max(0, diagonal - e)
        window = doc[lo : max(0, diagonal + 2 * (e + 1) + length + e)]
        run = align(items.texts[item], window, e, diagonal - e - lo, diagonal + 3 * e + 2 - lo)
        if run:
            best.append((item, lo + run[1], lo + run[2], run[0]))
    kept: list[tuple[int, int, int, int]] = []
    for x in sorted(best, key=lambda x: (x[0], x[3], x[1])):
        if not any(x[0] == y[0] and x[1] < y[2] and y[1] < x[2] for y in kept):
            kept.append(x)
    return kept


def short_runs(automaton, text: str) -> list[tuple[int, int, int]]:
    """(place among the items, start, stop) of the short items that stand in a normalised text as whole words."""
    found = []
    for last, (size, items) in automaton.iter(text):
        start, stop = last - size + 1, last + 1
        if not (start and text[start - 1].isalnum() and text[start].isalnum()) and not (stop < len(text) and text[stop].isalnum() and text[last].isalnum()):
            found += [(i, start, stop) for i in items]
    return found


def original_places(text: str, places: list[int]) -> list[int]:
    """Places in normal(text) as places in text."""
    lower = text.lower()
    if len(lower) != len(text):  # a letter that has no one-letter lower case: map by words of the lowered text
        text = lower
    out, at, word_at = {}, 0, 0
    marks = sorted(set(places))
    for word in text.split():
        word_at = text.index(word, word_at)
        while marks and marks[0] <= at + len(word):
            out[marks[0]] = word_at + marks[0] - at
            marks.pop(0)
        at, word_at = at + len(word) + 1, word_at + len(word)
    for m in marks:
        out[m] = len(text)
    return [out[p] for p in places]


def _search(batches: Iterator[pa.RecordBatch], block) -> Iterator[pa.RecordBatch]:
    items: Items = block.value
    if not hasattr(items, "gram"):
        items.index()
    gap = np.zeros(1, dtype=np.uint64)
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
            docs = [codes(normal(t)) for t in texts]
            begin = np.cumsum([0] + [len(d) + 1 for d in docs])
            by_doc: dict[int, list[tuple[int, int]]] = {}
            for item, diagonal in items.regions(np.concatenate([x for d in docs for x in (d, gap)]) if docs else gap):
                for d in {int(np.searchsorted(begin, min(max(p, 0), begin[-1] - 1), side="right")) - 1 for p in (diagonal, diagonal + items.edits[item] + 1 + len(items.texts[item]) // 2)}:
                    by_doc.setdefault(d, []).append((item, diagonal - int(begin[d])))
            rows = []
            for d in sorted(by_doc):
                runs = _found(items, docs[d], by_doc[d])
                places = original_places(texts[d], [p for r in runs for p in (r[1], r[2])]) if runs else []
                rows += [(ids[d], items.ids[r[0]], a, b, r[3]) for r, a, b in zip(runs, places[::2], places[1::2], strict=True)]
            if items.automaton:
                for d, text in enumerate(texts):
                    runs = short_runs(items.automaton, normal(text))
                    places = original_places(text, [p for r in runs for p in r[1:]]) if runs else []
                    rows += [(ids[d], r[0], a, b, 0) for r, a, b in zip(runs, places[::2], places[1::2], strict=True)]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "item_id", "start", "stop", "edits"])


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = 10, share: float = 0.08) -> DataFrame:
    """Runs of docs (doc_id, text) that hold an item of benchmark (item_id, text) with at most share * length edits:
    doc_id, item_id, start, stop (code points of the text), edits."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    chars = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = chars // BLOCK_CHARS + 1
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = []
    for b in range(blocks):
        held = Items(q, share)
        for row in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").toLocalIterator():
            held.add(row["item_id"], row["text"])
        found.append(read.mapInArrow(partial(_search, block=spark.sparkContext.broadcast(held)), HITS))
    return reduce(DataFrame.unionByName, found)

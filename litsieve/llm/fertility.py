"""Quality rules by tokeniser fertility: public vocabularies measure a document, and bands per language or script judge it.

Measures, over the words of a document, each encoded as it stands after a space:
- chars_per_token: characters a token of the piece vocabulary, and chars_per_token_multi of a byte vocabulary for many
  languages: both fall where text is not what vocabularies are made of (symbols, capitals, codes, encoded data);
- byte_share: share of the piece vocabulary's tokens that are single bytes, as its pieces know no such character;
- token_entropy: entropy (bits) of the tokens in stretches of 128, averaged over the whole text, so that it does not
  depend on the length: it falls where few tokens recur.

Bands are learned over all documents that the base rules pass: median and median absolute deviation per language, or
per script where a row has no language, from exact histograms. A document is rejected whose measure lies outside
median +- scale * (a + b / sqrt(stretches)); short texts vary more, so b widens their bands. Groups of fewer than
`least_rows` documents are judged by the bands over all documents.

Defined cases: null texts have no words; fewer than 50 words fail the base rules and have no part in the bands; rows that
share an id or repeat another are judged each by itself; a null id stays null; a table without `lang` is grouped by
script; other columns, of any name, are not read; an empty table gives no rows. Long texts are read whole; memory in a
task is bounded by a batch of some 4 MB, or by some twenty times the longest text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, small_batches, text_or_empty, written
from .shingles import runs, word_hashes
from .tokens import _Chunks

STRETCH = 128
LEAST_WORDS = 50
SYMBOLS = "#*$%&|<>"
# Allowed deviations (a, b) below and above the median, and the least scale, of each measure.
BANDS = {
    "chars_per_token": ((7.0, 6.0), (12.0, 12.0), 0.02),
    "chars_per_token_multi": ((7.0, 6.0), (12.0, 12.0), 0.02),
    "byte_share": ((7.0, 6.0), (7.0, 6.0), 0.02),
    "token_entropy": ((3.5, 2.0), (12.0, 12.0), 0.02),
}
# First and last code points of scripts.
SCRIPTS = [
    ("latin", "[A-Za-z\\u00C0-\\u024F]"), ("greek", "[\\u0370-\\u03FF]"), ("cyrillic", "[\\u0400-\\u052F]"), ("hebrew", "[\\u0590-\\u05FF]"),
    ("arabic", "[\\u0600-\\u06FF]"), ("devanagari", "[\\u0900-\\u097F]"), ("thai", "[\\u0E00-\\u0E7F]"), ("kana", "[\\u3040-\\u30FF]"),
    ("han", "[\\u4E00-\\u9FFF]"), ("hangul", "[\\uAC00-\\uD7AF]"),
]
MEASURED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, stretches long, chars_per_token double, chars_per_token_multi double, byte_share double, token_entropy double"
_LOADED: dict[tuple, Lexicon] = {}


class Lexicon:
    """Token ids of words through a cache of a worker, of bounded size."""

    MOST_WORDS = 1_000_000

    def __init__(self, encode):
        self.encode, self.cache, self.recent = encode, _Chunks(), _Chunks()

    def find(self, keys: np.ndarray, word) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place and number of the ids of each key in a pool; word(i) gives the text of keys[i]."""
        offset, size = np.zeros(len(keys), dtype=np.int64), np.full(len(keys), -1, dtype=np.int64)
        pools, shift = [], 0
        for tier in (self.cache, self.recent):
            at = tier.find(keys)
            hit = np.flatnonzero(at >= 0)
            offset[hit], size[hit] = tier.offset[at[hit]] + shift, tier.size[at[hit]]
            pools.append(tier.pool)
            shift += len(tier.pool)
        new = np.flatnonzero(size < 0)
        if len(new):
            made = _Chunks.of(keys[new], [np.array(ids, dtype="<u4").tobytes() for ids in self.encode([word(i) for i in new.tolist()])])
            offset[new], size[new] = made.offset + shift, made.size
            pools.append(made.pool)
            if len(self.cache) + len(self.recent) + len(made) <= self.MOST_WORDS:
                self.recent = self.recent.with_(made)
                if 8 * len(self.recent) > len(self.cache):
                    self.cache, self.recent = self.cache.with_(self.recent), _Chunks()
        return offset, size, np.concatenate(pools)


def piece_lexicon(path: str) -> tuple[Lexicon, np.ndarray]:
    """Of a sentencepiece model; and which of its ids are bytes."""
    if ("piece", path) not in _LOADED:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        own = Lexicon(lambda words: model.encode(words, num_threads=1))
        own.is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
        _LOADED["piece", path] = own
    own = _LOADED["piece", path]
    return own, own.is_byte


def rank_lexicon(path: str, pattern: str) -> Lexicon:
    """Of a file of ranks, one token in base64 and its rank a line."""
    if ("ranks", path) not in _LOADED:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        coding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _LOADED["ranks", path] = Lexicon(lambda words: [coding.encode_ordinary(" " + w) for w in words])
    return _LOADED["ranks", path]


def gathered(place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of all members of runs that begin at `place` and have `size` members."""
    ends = np.cumsum(size)
    return np.repeat(place - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def stretch_entropy(ids: np.ndarray, n_tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the mean entropy of its stretches of 128 tokens, the last of which ends with the text, and their number.

    A shorter text is one stretch, whose entropy is scaled to that length.
    """
    count = np.maximum(1, -(-n_tokens // STRETCH)) * (n_tokens > 0)
    text = np.repeat(np.arange(len(n_tokens)), count)
    begins = np.cumsum(n_tokens) - n_tokens
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    inside = np.minimum(nth * STRETCH, np.maximum(n_tokens[text] - STRETCH, 0))
    size = np.minimum(n_tokens[text], STRETCH)
    token = ids[gathered(begins[text] + inside, size)].astype(np.int64)
    keys, times = np.unique((np.repeat(np.arange(len(text)), size) << 32) | token, return_counts=True)
    of = keys >> 32
    share = times / size[of]
    bits = np.bincount(of, weights=-share * np.log2(share), minlength=len(text))
    bits = np.where(size < STRETCH, bits * np.log2(STRETCH) / np.log2(np.maximum(size, 2)), bits)
    return np.bincount(text, weights=bits, minlength=len(n_tokens)) / np.maximum(count, 1), count


def repeated_words(hashes: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """Words inside 3-word windows that their text holds twice or more."""
    covered = np.zeros(len(hashes) + 2, dtype=bool)
    if len(hashes) >= 3:
        at = np.flatnonzero(text[:-2] == text[2:])
        window = runs(hashes, 3)[at]
        order = np.lexsort((window, text[at]))
        at, window = at[order], window[order]
        same = (window[1:] == window[:-1]) & (text[at[1:]] == text[at[:-1]])
        twice = np.zeros(len(at), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        for k in range(3):
            covered[at[twice] + k] = True
    return np.bincount(text[covered[: len(hashes)]], minlength=n_texts)


def dup_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def measured(texts: list[str], pieces: str, ranks: str, pattern: str) -> list[np.ndarray]:
    n = len(texts)
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(d) for d in data], dtype=np.int64)
    raw = np.frombuffer(b"".join(data), dtype=np.uint8)
    of = np.repeat(np.arange(n), sizes)
    space = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    chars = np.bincount(of[~space & ((raw & 0xC0) != 0x80)], minlength=n)
    symbols = np.bincount(of[np.isin(raw, np.frombuffer(SYMBOLS.encode(), dtype=np.uint8))], minlength=n)
    hashes, text, start, stop = word_hashes(texts, lower=False)
    words = np.bincount(text, minlength=n)
    lines = np.array([dup_lines(t) for t in texts], dtype=np.int64)
    keys, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    word = lambda i: data[text[first[i]]][start[first[i]] : stop[first[i]]].decode("utf-8", "replace")
    own, is_byte = piece_lexicon(pieces)
    place, size, pool = own.find(keys, word)
    multi = np.bincount(text, weights=rank_lexicon(ranks, pattern).find(keys, word)[1][number], minlength=n)
    tokens = np.bincount(text, weights=size[number], minlength=n).astype(np.int64)
    ids = pool[gathered(place[number], size[number])]
    entropy, stretches = stretch_entropy(ids, tokens)
    n_bytes = np.bincount(np.repeat(np.arange(n), tokens)[is_byte[ids]], minlength=n)
    some = np.maximum(tokens, 1)
    return [words, chars, symbols, lines, repeated_words(hashes, text, n), stretches, chars / some, chars / np.maximum(multi, 1), n_bytes / some, entropy]


def _measure(batches: Iterator[pa.RecordBatch], names: list[str], **vocabularies: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            found = measured(part.column("text").to_pylist(), **vocabularies)
            kept = part.drop_columns(["text"])
            yield pa.record_batch([*kept.columns, *(pa.array(x) for x in found)], names=[*kept.schema.names, *names])


def group_of(docs: DataFrame) -> Column:
    """The language, or the script most of whose letters a text holds (of equals, the first in the list)."""
    counts = [F.struct(F.char_length(text_or_empty()) - F.char_length(F.regexp_replace(text_or_empty(), pattern, "")), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, pattern) in enumerate(SCRIPTS)]
    script = F.concat(F.lit("script "), F.greatest(*counts)["name"])
    if "lang" not in docs.columns:
        return script
    lang = F.col("lang").cast("string")
    return F.when(F.coalesce(F.trim(lang), F.lit("")) != "", F.concat(F.lit("lang "), lang)).otherwise(script)


def measures(docs: DataFrame, pieces: str, ranks: str, pattern: str) -> DataFrame:
    """-> (doc_id, group, base columns, measures, base_failed), one row a row of docs, written once."""
    small_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id"), group_of(docs).alias("group"), text_or_empty().alias("text"))
    names = [x.split()[0] for x in MEASURED.split(", ")]
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = read.mapInArrow(partial(_measure, names=names, pieces=pieces, ranks=ranks, pattern=pattern), f"doc_id {kind}, group string, {MEASURED}")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return written(found.withColumn("base_failed", failed), "measures")


def _median(bins: DataFrame, value: str, name: str) -> DataFrame:
    """The lower median of `value` per (group, measure), exact, from bins with a count."""
    upto = F.sum("n").over(Window.partitionBy("group", "measure").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy("group", "measure"))
    ranked = bins.select("group", "measure", value, upto.alias("upto"), total.alias("total"))
    return ranked.where("2 * upto >= total").groupBy("group", "measure").agg(F.min(value).alias(name), F.max("total").alias("total"))


def bands(scored: DataFrame) -> DataFrame:
    """(group, measure, middle, scale, total) in thousandths, per group and under '' over all documents.

    Rows become counts of (group, measure, value in thousandths) before any shuffle; a measure has at most some ten
    thousand values, so the rest of the work is on small tables.
    """
    each = F.array(*(F.struct(F.lit(m).alias("measure"), F.round(F.col(m) * 1000).cast("long").alias("q")) for m in BANDS))
    counts = scored.where(~F.col("base_failed")).select("group", F.explode(each).alias("x")).groupBy("group", "x.measure", "x.q").agg(F.count("*").alias("n"))
    counts = written(counts, "counts")
    every = counts.groupBy("measure", "q").agg(F.sum("n").alias("n")).select(F.lit("").alias("group"), "measure", "q", "n")
    bins = counts.unionByName(every)
    middle = written(_median(bins, "q", "middle"), "middle")
    apart = bins.join(middle.select("group", "measure", "middle").hint("merge"), ["group", "measure"]).withColumn("apart", F.abs(F.col("q") - F.col("middle")))
    apart = apart.groupBy("group", "measure", "apart").agg(F.sum("n").alias("n"))
    return middle.join(_median(apart, "apart", "away").drop("total").hint("merge"), ["group", "measure"]).withColumn("scale", F.col("away") * 1.4826).drop("away")


def judged(docs: DataFrame, pieces: str, ranks: str, pattern: str, least_rows: int = 30) -> DataFrame:
    """-> (doc_id, base columns, measures, group, base_failed, kept, reason), one row a row of docs.

    The bands come back by a join on group and a salt, so a language with most of the rows is spread.
    """
    scored = measures(docs, pieces, ranks, pattern)
    found = bands(scored)
    cell = F.map_from_entries(F.collect_list(F.struct("measure", F.struct("middle", "scale"))))
    wide = written(found.groupBy("group").agg(cell.alias("own"), F.max("total").alias("total")).where((F.col("total") >= least_rows) | (F.col("group") == "")), "bands")
    first = wide.where("group = ''").select("own").head()
    everywhere = first["own"] if first else {}
    salted = wide.where("group <> ''").select("group", "own", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("salt"))
    rows = scored.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars", "token_entropy"), F.lit(32)).cast("int"))
    rows = rows.join(salted.hint("merge"), ["group", "salt"], "left")
    outside = []
    for m, (below, above, least) in BANDS.items():
        spare = everywhere.get(m)
        middle = F.coalesce(F.col("own")[m]["middle"], F.lit(spare["middle"] if spare else None).cast("long")) / 1000
        scale = F.greatest(F.coalesce(F.col("own")[m]["scale"], F.lit(spare["scale"] if spare else None).cast("double")) / 1000, F.lit(least))
        wider = F.sqrt(F.greatest(F.col("stretches"), F.lit(1)))
        low, high = middle - scale * (below[0] + below[1] / wider), middle + scale * (above[0] + above[1] / wider)
        outside.append(F.when((F.col(m) < low) | (F.col(m) > high), F.lit(m)))
    reason = F.when(F.col("base_failed"), F.lit("base")).otherwise(F.coalesce(*outside))
    names = [x.split()[0] for x in MEASURED.split(", ")]
    return rows.select("doc_id", "group", *names, "base_failed", reason.isNull().alias("kept"), reason.alias("reason"))

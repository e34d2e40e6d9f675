"""Best-fit packing with swap-based local search.

Documents are tokenised into pieces of at most `capacity` ids, written once with their ids. Pieces are dealt into groups
of bounded size; each group is packed best-fit decreasing, then its underfull bins are improved by local search: move a
piece, exchange one for one, or two for one, from the emptiest bin into fuller ones. Every step raises the sum of the
squared fills, so the search ends; bins that come out empty are gone. The underfull bins that are left go whole into
groups of the same size, so into fewer as they get fewer, until one group of at most four times that size holds them or
a round no longer lessens them.

Defined cases: a null text is empty and gives one piece with the end id alone; a null doc_id is kept as it is; repeated
rows are packed each; pieces of equal length are packed in the order of their rows; a text of any length is tokenised
whole and cut into full pieces after a first that takes the rest; an empty table gives no rows; of documents only id and
text are read; pack() carries columns of any name, but replaces sequence_id and offset.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, written
from .tokens import encode_column

LAST = 4
PIECES = "doc_id long, piece int, start long, length long, ids binary"


def piece_lengths(total: int, capacity: int) -> list[int]:
    """One piece, or full ones after a first that takes the rest."""
    if total <= capacity:
        return [total]
    return [total % capacity or capacity] + [capacity] * ((total - 1) // capacity)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    end = end_id.to_bytes(4, "little")
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            rows: list[tuple] = []
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode_column(path, part.column("text")), strict=True):
                ids += end
                start = 0
                for k, n in enumerate(piece_lengths(len(ids) // 4, capacity)):
                    rows.append((doc_id, k, start, n, ids[4 * start : 4 * (start + n)]))
                    start += n
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])


def tokenize_pieces(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids, row_id), written to the shared folder; ids are little-endian uint32."""
    small_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = read.mapInArrow(partial(_pieces, path=path, end_id=end_id, capacity=capacity), PIECES)
    return written(made.withColumn("row_id", F.monotonically_increasing_id()), "pieces")


class _Bins:
    """Bins of (length, item) with a bit set of the gaps, for best fit in a few integer steps."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.fill = capacity, [], []
        self.by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.gaps = 0

    def file(self, b: int) -> None:
        gap = self.capacity - self.fill[b]
        self.by_gap[gap].append(b)
        self.gaps |= 1 << gap

    def take(self, size: int) -> int | None:
        """The fullest bin with room for size, taken out of the index."""
        fit = self.gaps >> size
        if not fit:
            return None
        gap = size + (fit & -fit).bit_length() - 1
        b = self.by_gap[gap].pop()
        if not self.by_gap[gap]:
            self.gaps ^= 1 << gap
        return b

    def add(self, size: int, item: int) -> None:
        b = self.take(size)
        if b is None:
            b = len(self.bins)
            self.bins.append([])
            self.fill.append(0)
        self.bins[b].append((size, item))
        self.fill[b] += size
        self.file(b)


def best_fit(lengths: list[int], capacity: int) -> list[list[tuple[int, int]]]:
    packed = _Bins(capacity)
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        packed.add(lengths[item], item)
    return packed.bins


def _swap(donor: list[tuple[int, int]], target: list[tuple[int, int]], gap: int) -> bool:
    """One exchange between donor and target that raises target's fill by 1..gap; the largest such raise."""
    best, choice = 0, None
    sizes = sorted(target)
    for i, (b, _) in enumerate(donor):
        for a in sizes:
            if best < b - a[0] <= gap:
                best, choice = b - a[0], ([i], [a])
        for j in range(i):
            two = b + donor[j][0]
            for a in sizes:
                if best < two - a[0] <= gap:
                    best, choice = two - a[0], ([i, j], [a])
        for k, a in enumerate(sizes):
            for c in sizes[:k]:
                if best < b - a[0] - c[0] <= gap:
                    best, choice = b - a[0] - c[0], ([i], [a, c])
        if best == gap:
            break
    if choice is None:
        return False
    out, back = [donor[i] for i in choice[0]], choice[1]
    for x in out:
        donor.remove(x)
    for x in back:
        target.remove(x)
    donor += back
    target += out
    return True


def improve(bins: list[list[tuple[int, int]]], capacity: int, reach: int = 48, wide: int = 64) -> list[list[tuple[int, int]]]:
    """Local search over the underfull bins. reach: targets tried for each donor; wide: pieces of a bin it exchanges."""
    size = lambda b: sum(x[0] for x in b)
    full = [b for b in bins if size(b) == capacity]
    under = sorted((b for b in bins if b and size(b) < capacity), key=size)
    fills = [size(b) for b in under]
    done = [False] * len(under)
    at = 0
    while at < len(under):
        donor, moved = under[at], True
        while moved and donor:
            moved = False
            near = sorted((t for t in range(at + 1, min(len(under), at + 1 + 4 * reach)) if not done[t] and fills[t] < capacity), key=lambda t: -fills[t])[:reach]
            near += [t for t in range(max(at + 1, len(under) - reach), len(under)) if fills[t] < capacity and t not in near]
            for t in near:
                gap = capacity - fills[t]
                fit = max((x for x in donor if x[0] <= gap), default=None)
                if fit and fills[t] + fit[0] > fills[at]:
                    donor.remove(fit)
                    under[t].append(fit)
                elif len(donor) > wide or len(under[t]) > wide or fills[t] < fills[at] or not _swap(donor, under[t], gap):
                    continue
                fills[t], fills[at], moved = size(under[t]), size(donor), True
                if not donor:
                    break
        done[at] = True
        at += 1
    return full + [b for b in under if b]


def _pack_group(key: tuple, rows: pd.DataFrame, capacity: int, level: int) -> pd.DataFrame:
    rows = rows.drop(columns="g")
    lengths = rows.length.tolist()
    bins = best_fit(lengths, capacity)
    if level:
        had: dict[int, list[tuple[int, int]]] = {}
        for i, (s, n) in enumerate(zip(rows.sequence_id.tolist(), lengths, strict=True)):
            had.setdefault(s, []).append((n, i))
        bins = min(bins, list(had.values()), key=len)
    bins = improve([list(b) for b in bins], capacity)
    base = (level << 58) | (int(key[0]) << 20)
    number, offset, fill = [0] * len(lengths), [0] * len(lengths), [0] * len(lengths)
    for k, b in enumerate(bins):
        at = 0
        for n, i in sorted(b, key=lambda x: x[1]):
            number[i], offset[i] = base | k, at
            at += n
        for _, i in b:
            fill[i] = at
    return rows.assign(sequence_id=number, offset=offset, fill=fill)


def pack(items: DataFrame, capacity: int = 2048, group_items: int = 20_000) -> DataFrame:
    """items (row_id, length, any more columns) with sequence_id and offset added. No length may exceed capacity."""
    more = [c for c in items.columns if c not in ("row_id", "length", "sequence_id", "offset")]
    items = items.select("row_id", "length", *(F.col(f"`{c.replace('`', '``')}`").alias(f"more{i}") for i, c in enumerate(more)))
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in items.schema)}, sequence_id long, offset long, fill long"
    blank = {"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "fill": F.lit(capacity).cast("long")}
    full = items.where(F.col("length") == capacity).withColumns(blank).withColumn("sequence_id", F.lit(1 << 62).bitwiseOR(F.col("row_id")))
    left = items.where(F.col("length") < capacity).withColumns(blank)
    count = left.count()
    out, level, groups = [full], 0, count // group_items + 1
    while True:
        dealt = left.withColumn("g", F.pmod(F.xxhash64("row_id" if level == 0 else "sequence_id"), F.lit(groups)))
        packed = written(dealt.groupBy("g").applyInPandas(partial(_pack_group, capacity=capacity, level=level), schema), f"packed{level}")
        under = 0 if groups == 1 else packed.where(F.col("fill") < capacity).count()
        if groups == 1 or under > LAST * group_items and (4 * under > 3 * count or level == 14):  # lengths that do not add up stay in several groups
            out.append(packed)
            break
        out.append(packed.where(F.col("fill") == capacity))
        left, level, count = packed.where(F.col("fill") < capacity), level + 1, under
        groups = 1 if count <= LAST * group_items else count // group_items + 1
    total = out[0]
    for x in out[1:]:
        total = total.unionByName(x)
    return total.select("row_id", "length", *(F.col(f"more{i}").alias(c) for i, c in enumerate(more)), "sequence_id", "offset")


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, as little-endian uint32."""
    joined = pieces.select("row_id", "ids").join(placed.select("row_id", "sequence_id", "offset").hint("merge"), "row_id")
    ordered = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return joined.groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(ordered, lambda x: x["ids"]), "")).alias("ids"))

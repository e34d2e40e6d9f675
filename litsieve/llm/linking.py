"""Exact components of a set-similarity graph, without all pairs: star links, then a token-group matrix.

Input are candidate keys: rows (key, id, n, need), one or more a set, such that two sets of the wanted similarity share
at least least(need, need) keys, where n is the size of the set; and a function that gives the sets of chosen ids. Where
the keys are the first n - ceil(t * n) + need tokens of each set in one order (`prefixes`), sharing c of them leaves at
most n - prefix + c tokens in common, so for sizes n and m the pair must share as many more keys as t * (n + m) / (1 + t)
exceeds the larger of t * n and t * m. The steps:

1. Keys held by one id only are dropped, then ids that hold too few of the others; once more, where a key counts only if
   two ids of near sizes hold it.
2. A star round. In each key every id meets one chosen id of the key, the one that shares most keys with others (an
   original does so more than its edited copies); pairs that meet in enough keys are decided by exact overlap. So m ids
   of a key cost m - 1 comparisons; ids linked with the same star are known to be connected.
3. Token-group matrix. All ids are dealt into groups of similar sets: the same most-held key and a close size, or, where
   more than GROUP are connected already, those together; groups hold GROUP sets or TOKENS tokens about. Each group has
   the union of its keys and the range of its sizes. Two groups meet if their unions share as many keys as the least of
   their pairs need, and their sizes are near. Only then sets are read, and both groups opened in one task, which bounds
   the overlap of each set with the other group's token union, and compares those that reach it by a matrix of shared
   tokens. A task returns links that span what it found, not all pairs.

So m unlinked sets that share a key make (m / GROUP)^2 / 2 meetings of groups, not m^2 / 2 pairs. No link between
different components is lost: each pair of ids is connected by step 2, or excluded by a bound, or compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written
from .components import components

GROUP, TOKENS, WIDE = 128, 1 << 18, 1 << 13


def _near(n: str, m: str, num: int, den: int) -> Column:
    return (F.least(n, m) * den) >= (F.greatest(n, m) * num)


def _band(n: str, num: int, den: int) -> Column:
    """Sets of near sizes are in one band or in two that follow each other."""
    return F.floor(F.log(F.greatest(F.col(n), F.lit(1)).cast("double")) / F.lit(1.0001 * math.log(den / num)))


def _around() -> Window:
    """Rows of a key in the bands next to a row's own. Where (key, band) are rows, a key has only as many as there are bands."""
    return Window.partitionBy("key").orderBy("band").rangeBetween(-1, 1)


def _more(n: Column, m: Column, num: int, den: int) -> Column:
    """How many more prefix keys than `need` sets of these sizes share, if they are alike."""
    both = F.ceil((n + m) * num / (num + den))
    return F.greatest(both - F.greatest(F.ceil(n * num / den), F.ceil(m * num / den)), F.lit(0))


def link(keys: DataFrame, sets_of: Callable[[DataFrame], DataFrame], num: int, den: int, prefixes: bool) -> DataFrame:
    """(id, component) of the ids that are linked with another. sets_of(ids) gives (id, set) of these ids, once each."""
    held = keys.select("key", "id", F.col("n").cast("long").alias("n"), "need")
    for by in (["key"], ["key", "band"], ["key", "band"]):  # the ids that go leave keys that only one holds
        if len(by) > 1:
            held = held.withColumn("band", _band("n", num, den))
        met = held.groupBy(by).agg(F.count("*").alias("held"))
        met = (met if len(by) == 1 else met.withColumn("held", F.sum("held").over(_around()))).where("held > 1")
        shared = written(held.join(met.hint("merge"), by).select("key", "id", "n", "need", "held"), "shared")
        enough = shared.groupBy("id").agg(F.count("*").alias("degree"), F.max("need").alias("least"), F.max(F.struct("held", "key")).alias("most"))
        enough = enough.where("degree >= least").select("id", "degree", F.col("most.key").alias("most"))
        held = written(shared.join(enough.hint("merge"), "id").select("key", "id", "n", "need", "degree", "most"), "held")
        dropped(shared)
    stars = _star_links(held, sets_of, num, den, prefixes)
    out = components(stars.unionByName(_group_links(held, sets_of, stars, num, den, prefixes)))
    dropped(held)
    return out


def _star_links(held: DataFrame, sets_of: Callable[[DataFrame], DataFrame], num: int, den: int, prefixes: bool) -> DataFrame:
    """Links (a, b) of ids a with the stars b of their keys."""
    pick = F.min(F.struct((-F.col("degree")).alias("d"), F.xxhash64("id").alias("h"), "id", "n", "need")).alias("star")
    star = held.groupBy("key").agg(pick, F.count("*").alias("ids")).where("ids > 1").select("key", "star")
    pairs = held.join(star.hint("merge"), "key").where("id <> star.id").where(_near("n", "star.n", num, den))
    need = F.least("need", "star.need") + (_more(F.col("n"), F.col("star.n"), num, den) if prefixes else F.lit(0))
    pairs = pairs.select(F.col("id").alias("a"), F.col("star.id").alias("b"), need.alias("need")).groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("need").alias("need"))
    pairs = written(pairs.where("shared >= need").select("a", "b"), "pairs")
    sets = written(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "sets")
    left, right = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    alike = both * den >= (F.size("set_a") + F.size("set_b") - both) * num
    return written(pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(alike).select("a", "b"), "stars")


def _labels(held: DataFrame, stars: DataFrame) -> DataFrame:
    """(id, n, need, most, label, members): ids with one label are connected by star links."""
    ids = held.groupBy("id").agg(F.first("n").alias("n"), F.first("need").alias("need"), F.first("most").alias("most"))
    up = written(stars.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("up")), "up")
    top = up.select(F.col("id").alias("up"), F.col("up").alias("top"))
    named = up.join(top.hint("merge"), "up", "left").select("id", F.least("up", "top").alias("label"))
    named = written(ids.join(named.hint("merge"), "id", "left").withColumn("label", F.coalesce("label", "id")), "named")
    sizes = named.groupBy("label").agg(F.count("*").alias("members"))
    return named.join(sizes.hint("merge"), "label")


def _dealt(labels: DataFrame, num: int, den: int) -> DataFrame:
    """labels with band (of near sizes) and group g."""
    band = _band("n", num, den)
    large = F.col("members") > GROUP
    base = F.when(large, F.xxhash64("label", F.lit(1))).otherwise(F.xxhash64("most", F.lit(2)))
    rows = labels.withColumns({"base": base, "band": band})
    rows = written(rows, "based")
    sizes = rows.groupBy("base", "band").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n") / TOKENS)).alias("parts"))
    part = F.pmod(F.xxhash64(F.when(large, F.col("id")).otherwise(F.col("label"))), F.col("parts"))
    return rows.join(sizes.hint("merge"), ["base", "band"]).select("id", "n", "need", "label", "band", F.xxhash64("base", "band", part).alias("g"))


def meetings(held: DataFrame, dealt: DataFrame, num: int, den: int, prefixes: bool) -> DataFrame:
    """(x, y, x_size, y_size): the groups whose members can be alike and are not all connected. dealt: (id, n, need, label, band, g)."""
    groups = dealt.groupBy("g").agg(
        F.count("*").alias("size"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("need").alias("need"),
        F.when(F.min("label") == F.max("label"), F.min("label")).alias("own"),
    )
    groups = written(groups, "groups")
    unions = written(held.select("key", "id").join(dealt.select("id", "band", "g").hint("merge"), "id").select("key", "band", "g").distinct(), "unions")
    ends = unions.groupBy("key", "band").agg(F.min("g").alias("lo"), F.max("g").alias("hi"))
    shared = ends.select("key", "band", F.min("lo").over(_around()).alias("lo"), F.max("hi").over(_around()).alias("hi")).where("lo <> hi").select("key", "band")
    unions = unions.join(shared.hint("merge"), ["key", "band"])
    left = unions.select("key", "band", F.col("g").alias("x"))
    right = unions.select("key", F.col("band").alias("low"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), F.col("g").alias("y"))
    pairs = left.join(right.hint("merge"), ["key", "band"]).where("low < band or x < y").groupBy("x", "y").agg(F.countDistinct("key").alias("shared"))
    side = lambda s: groups.select(*(F.col(c).alias(c if c == s else f"{s}_{c}") for c in ("size", "least", "most", "need", "own")), F.col("g").alias(s))
    pairs = pairs.join(side("x").hint("merge"), "x").join(side("y").hint("merge"), "y")
    apart = F.col("x_own").isNull() | F.col("y_own").isNull() | (F.col("x_own") != F.col("y_own"))
    near = (F.col("x_least") * num <= F.col("y_most") * den) & (F.col("y_least") * num <= F.col("x_most") * den)
    need = F.least("x_need", "y_need")
    if prefixes:  # least at the ends of the size ranges, less one for the two ceilings between
        ends = F.least(_more(F.col("x_least"), F.col("y_most"), num, den), _more(F.col("y_least"), F.col("x_most"), num, den))
        need = need + F.greatest(ends - 1, F.lit(0))
    across = pairs.where(apart & near & (F.col("shared") >= need)).select("x", "y", "x_size", "y_size")
    within = groups.where("own is null and size > 1").select(F.col("g").alias("x"), F.col("g").alias("y"), F.col("size").alias("x_size"), F.col("size").alias("y_size"))
    return across.unionByName(within)


def _sharing(held: DataFrame, dealt: DataFrame) -> DataFrame:
    """(g, id, label) of the ids that share enough keys with others of their own group."""
    keyed = held.select("key", "id").join(dealt.select("id", "g", "need", "label").hint("merge"), "id")
    common = keyed.groupBy("g", "key").agg(F.count("*").alias("ids"), F.min("need").alias("least")).where("ids > 1").select("g", "key", "least")
    own = keyed.join(common.hint("merge"), ["g", "key"]).groupBy("g", "id", "label").agg(F.count("*").alias("n"), F.min("least").alias("least"))
    return own.where("n >= least").select("g", "id", "label")


def _group_links(held: DataFrame, sets_of: Callable[[DataFrame], DataFrame], stars: DataFrame, num: int, den: int, prefixes: bool) -> DataFrame:
    dealt = written(_dealt(_labels(held, stars), num, den), "dealt")
    pairs = written(meetings(held, dealt, num, den, prefixes), "meetings")
    larger = F.struct("x_size", "x") >= F.struct(F.col("y_size").alias("x_size"), F.col("y").alias("x"))
    met = pairs.where("x <> y").select(F.when(larger, F.col("x")).otherwise(F.col("y")).alias("x"), F.when(larger, F.col("y")).otherwise(F.col("x")).alias("g"), F.least("x_size", "y_size").alias("size"))
    blocks = met.groupBy("x").agg(F.ceil(F.sum("size") / GROUP).alias("blocks"))  # small groups meet a larger one together
    met = written(met.join(blocks.hint("merge"), "x").select("x", F.pmod(F.xxhash64("g"), "blocks").alias("y"), "g"), "met")
    across = met.unionByName(met.select("x", "y", F.col("x").alias("g")).distinct()).join(dealt.select("g", "id", "label").hint("merge"), "g")
    within = pairs.where("x = y").select("x", F.lit(-1).cast("long").alias("y"), F.col("x").alias("g")).join(_sharing(held, dealt).hint("merge"), "g")
    asked = written(across.unionByName(within), "asked")
    sets = sets_of(asked.select("id").distinct())
    opened = asked.join(sets.hint("merge"), "id").repartition("x", "y").sortWithinPartitions("x", "y", "g", "id")
    found = opened.select("x", "y", "g", "id", "label", "set").mapInArrow(partial(_open, num=num, den=den), "a long, b long")
    return written(found, "links")


def _open(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows of a group x and a block y of groups that meet it (-1: itself), in a run -> links that span what is alike in them."""
    at, group, others = None, [], []
    for batch in batches:
        found: list[tuple[int, int]] = []
        values, bounds = batch.column("set").values.to_numpy(), batch.column("set").offsets.to_numpy()
        columns = [batch.column(c).to_pylist() for c in ("x", "y", "g", "id", "label")]
        for i, (x, y, g, one, label) in enumerate(zip(*columns, strict=True)):
            if (x, y) != at:
                found += _matched(group, others if at and at[1] >= 0 else None, num, den)
                at, group, others = (x, y), [], []
            (group if g == x else others).append((one, label, values[bounds[i] : bounds[i + 1]]))
        if found:
            yield _rows(found)
    if found := _matched(group, others if at and at[1] >= 0 else None, num, den):
        yield _rows(found)


def _rows(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])


def _matched(left: list, right: list | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links among left (id, label, set) where right is None, else between the two."""
    if right is None:
        right = left
    else:
        left, right = _bounded(left, right, num, den), _bounded(right, left, num, den)
    if not left or not right:
        return []
    shared = _overlaps([s for _, _, s in left], [s for _, _, s in right])
    n, m = (np.array([len(s) for _, _, s in z], dtype=np.int64) for z in (left, right))
    alike = shared * den >= (n[:, None] + m[None, :] - shared) * num
    one, other = np.nonzero(alike)
    label = {i: k for i, k, _ in [*left, *right]}
    top = {k: k for k in label.values()}

    def root(k: int) -> int:
        while top[k] != k:
            top[k] = top[top[k]]
            k = top[k]
        return k

    found = []
    for i, j in zip(one.tolist(), other.tolist(), strict=True):
        a, b = left[i][0], right[j][0]
        p, q = root(label[a]), root(label[b])
        if p != q:
            top[q] = p
            found.append((a, b))
    return found


def _bounded(queries: list, group: list, num: int, den: int) -> list:
    """The queries whose overlap with the group's token union lets them be alike to a member."""
    if not group:
        return []
    union = group[0][2] if len(group) == 1 else np.unique(np.concatenate([s for _, _, s in group]))
    return [q for q in queries if np.isin(q[2], union).sum() * den >= len(q[2]) * num]


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """[left, right] of the numbers of tokens in common, from a matrix of sets by shared tokens, WIDE tokens at a time."""
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), dtype=np.int64)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        tokens = np.concatenate(sets)
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        hit = common[at] == tokens
        return of[hit], at[hit]

    if not len(common):
        return out
    (row, at), (col, to) = places(left), places(right)
    for begin in range(0, len(common), WIDE):
        wide = min(WIDE, len(common) - begin)
        a, b = np.zeros((len(left), wide), dtype=np.float32), np.zeros((len(right), wide), dtype=np.float32)
        here = (at >= begin) & (at < begin + wide)
        a[row[here], at[here] - begin] = 1
        here = (to >= begin) & (to < begin + wide)
        b[col[here], to[here] - begin] = 1
        out += (a @ b.T).astype(np.int64)
    return out

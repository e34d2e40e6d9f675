"""Main text of web pages by consensus host paths.

Every page's containers are scored by the text they hold outside links; each page casts one vote, shared out by score
over the generalised tag-class paths of its containers (a path is a running hash, so deep nesting costs no long names).
Spark sums the votes by host and path; the winning path of a host is then used to extract each of its pages again. A page
that has no container of its host's path is extracted by its own best one.

What is inside the winning path and not the article is left to the host as well. A path whose text repeats over the
host's pages is left out, where the winner's own text does not repeat. A class, id or role that names such things
(PARTS) only makes a path suspect: each page votes to leave it out if it holds less than a share of the page's text
(MOST_WHOLE for a name that is such a word, MOST_PART for one that has it as a part), and the host's majority decides.
So an article in `main has-sidebar` stays, and `ad` goes. A form is suspect as well: one that holds most of the page wraps
it and stays, without its controls. Only what HTML itself declares is left out by its tag or attribute: navigation,
footers, asides, form controls and their labels, scripts, styles, `hidden` and its like.

Reader comments are found by structure, whatever their names: siblings of one path after the article, two or more, most
of them of several blocks without a heading, the first or last of which is short and holds a name and a date. A host
leaves out such a path where a third of its pages that have the path show it so, and thereby single comments too.

A link counts as one from an `a` with an address to its end tag; the text after one that is never closed is no link. A
page whose text is all links votes by plain length.

The decisions are one row per host. Up to `most_hosts` of them, with as many paths each as `most_paths` allows in all, go
to the tasks as a table; beyond that the pages are joined with them, with hosts salted, as one host can hold a third of
all pages.

Defined cases: a null or empty html, or one without text, gives an empty text; a null url has the empty host; repeated
rows vote and are extracted each; of paths with equal votes the deeper wins, then the one of the larger hash; pages of
any length and any nesting are read whole, in one pass; an empty table gives no rows; extra columns of any name are
ignored.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, written
from .url_filter import host

# Element kinds, and words in class, id or role that mark what isn't the article.
CONTAINERS = frozenset("body main article section div td".split())
BLOCKS = CONTAINERS | frozenset("address blockquote br caption center dd dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr li ol p pre table tbody tfoot th thead tr ul nav footer aside form details summary".split())
LISTS = frozenset("ul ol li".split())
DROPPED = frozenset("head nav footer aside button select label legend datalist menu dialog iframe object".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 dt dd".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
PARTS = (
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments respond disqus share sharing social related recommended newsletter subscribe widget pagination pager"
).split()
MOST_WHOLE, MOST_PART = 0.85, 0.5
REPEATED = 3  # pages to each text of a path that repeats
TALKS = 3  # pages that have a path to each that shows it as comments, at most
BYLINE, LEAST_ARTICLE = 80, 200  # the longest line with a name and a date; the least text before comments
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>", re.I | re.S).finditer
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I).findall
_NAMED = frozenset(PARTS)
_STYLED = re.compile(r"display\s*:\s*none", re.I).search
_ATTRIBUTES = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""").findall
_HREF = re.compile(r"(?:^|[\s\"'])href\s*=", re.I).search
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
_DATE = re.compile(rf"\d{{4}}[-/.]\d\d?[-/.]\d\d?|\d\d?[-/.]\d\d?[-/.]\d{{2,4}}|\d\d?(?:st|nd|rd|th)?\.? {_MONTH},? \d{{4}}|{_MONTH} \d\d?(?:st|nd|rd|th)?,? \d{{4}}|(?:\d+|an?) (?:second|minute|hour|day|week|month|year)s? ago", re.I)
_NAME = re.compile(r"[^\W\d_]{2}").search
_DIGITS = re.compile(r"\d+").sub
_WORDS = re.compile(r"[a-z]+").findall


def _hidden(attributes: str) -> bool:
    for name, value in _ATTRIBUTES(attributes):
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value.strip("\"'").lower() == "true" or name == "style" and _STYLED(value):
            return True
    return False


def suspicion(names: str) -> float:
    """The share of a page below which an element of these names is not its article; 0 if they say nothing."""
    most = 0.0
    for name in names.split():
        if name in _NAMED:
            return MOST_WHOLE
        if not most and not _NAMED.isdisjoint(_WORDS(name)):
            most = MOST_PART
    return most


class Node:
    """A container, a list or its item, or an element of suspect names, with the text that stands in it directly.

    score counts text outside links, plain all of it; chars is the text with that of the nodes inside. first and last
    number its blocks. heads: it holds a heading. talk: it is a reader comment, or holds nothing but comments.
    """

    __slots__ = ("parent", "path", "depth", "most", "listed", "score", "plain", "chars", "digest", "first", "last", "heads", "talk")

    def __init__(self, parent: int, path: int, depth: int, most: float, listed: bool = False, first: int = 0):
        self.parent, self.path, self.depth, self.most, self.listed = parent, path, depth, most, listed
        self.score, self.plain, self.chars, self.digest = 0.0, 0, 0, 0
        self.first, self.last, self.heads, self.talk = first, first, False, False


class _Open:
    """An open element that matters: one that is a node, or whose content is left out."""

    __slots__ = ("tag", "node", "drop", "headings")

    def __init__(self, tag: str, node: int | None, drop: bool = False, headings: bool = False):
        self.tag, self.node, self.drop, self.headings = tag, node, drop, headings


def _clean(parts: list[str]) -> str:
    return " ".join(html_lib.unescape("".join(parts)).split())


def _step(path: int, name: str) -> int:
    """The running hash of a path, in 62 bits."""
    return (path * 0x9E3779B97F4A7C15 + zlib.crc32(name.encode()) * 0xD1B54A32D192ED03 + 1 & 0xFFFFFFFFFFFFFFFF) >> 2


def read_page(page: str | None) -> tuple[list[Node], list[tuple[int, str]]]:
    """The nodes, parents first, and the blocks of text with the number of the node each stands in."""
    page = page or ""
    nodes, stack = [Node(-1, 0, 0, 0.0)], [_Open("", 0)]
    open_nodes, open_tags = [0], {"": 1}
    blocks: list[tuple[int, str]] = []
    parts: list[str] = []
    links = link_chars = heading = at = 0
    linked: list[tuple[int, int]] = []  # what the blocks of the open link would count if it is never closed
    drops = plain_drops = 0  # open elements whose content is left out; those that let no heading through

    def flush() -> None:
        nonlocal parts, link_chars
        if parts:
            if text := _clean(parts):
                blocks.append((open_nodes[-1], text))
                worth = max(0, len(text) - 2 * link_chars)
                nodes[open_nodes[-1]].score += worth
                nodes[open_nodes[-1]].plain += len(text)
                if links:
                    linked.append((open_nodes[-1], len(text) - worth))
            parts, link_chars = [], 0

    def never_closed() -> None:
        for i, more in linked:
            nodes[i].score += more
        linked.clear()

    def close(upto: int) -> None:
        nonlocal drops, plain_drops
        while len(stack) > upto:
            done = stack.pop()
            open_tags[done.tag] -= 1
            if done.node is not None:
                open_nodes.pop()
                nodes[done.node].last = len(blocks)
            drops -= done.drop
            plain_drops -= done.drop and not done.headings

    def take(text: str) -> None:
        nonlocal link_chars
        if text and not plain_drops and (not drops or heading):
            parts.append(text)
            if links:
                link_chars += len(text)

    for m in _TOKEN(page):
        take(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if m[2]:
            if tag in BLOCKS or open_tags.get(tag):
                flush()
            if tag == "a":
                links = 0
                linked.clear()
            if tag in HEADINGS:
                heading = 0
            if open_tags.get(tag):
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if tag in BLOCKS or tag in DROPPED:
            flush()
            while len(stack) > 1 and stack[-1].tag in CLOSED_BY_BLOCK:
                close(len(stack) - 1)
        if tag == "body" and open_tags.get("head"):
            close(next(i for i, x in enumerate(stack) if x.tag == "head"))
        if tag == "li" and open_tags.get("li"):
            above = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in LISTS)
            if stack[above].tag == "li":
                close(above)
        if tag == "a":
            never_closed()
            links = 1 if _HREF(m[4]) else 0
        if tag in HEADINGS:
            heading = 1
            nodes[open_nodes[-1]].heads = True
        if tag in VOID or m[4].endswith("/") and tag not in CONTAINERS:
            continue
        names = {k.lower(): v.strip("\"'").lower() for k, v in _NAMES(m[4])} if m[4] else {}
        most = 0.0 if tag in ("body", "html", "article", "main") or not names else suspicion(" ".join(names.values()))
        if tag == "form":
            most = most or MOST_PART
        drop = tag in DROPPED or tag == "header" or bool(m[4]) and _hidden(m[4])
        node = None
        if tag in CONTAINERS or tag in LISTS or most:
            if tag not in CONTAINERS:
                flush()
            named = _DIGITS("", (names.get("class") or "").split(" ")[0] or names.get("id") or "")
            above = nodes[open_nodes[-1]]
            node = len(nodes)
            nodes.append(Node(open_nodes[-1], _step(above.path, f"{tag}.{named}"), above.depth + 1, most, tag in LISTS, len(blocks)))
            open_nodes.append(node)
        if node is not None or drop:
            stack.append(_Open(tag, node, drop, drop and tag == "header" and not _hidden(m[4])))
            open_tags[tag] = open_tags.get(tag, 0) + 1
            drops += drop
            plain_drops += drop and not stack[-1].headings
    take(page[at:])
    flush()
    never_closed()
    close(1)
    nodes[0].last = len(blocks)
    for i, text in blocks:
        nodes[i].chars += len(text)
        nodes[i].digest = nodes[i].digest * 31 + zlib.crc32(text.encode("utf-8", "surrogatepass")) & 0x7FFFFFFFFFFFFFFF
    for node in reversed(nodes[1:]):
        above = nodes[node.parent]
        above.chars += node.chars
        above.heads |= node.heads
        above.digest = above.digest + node.digest * 0x9E3779B1 & 0x7FFFFFFFFFFFFFFF
    _mark_talk(nodes, blocks)
    return nodes, blocks


def _signed(node: Node, blocks: list[tuple[int, str]]) -> bool:
    """Whether a node of several blocks begins or ends with a line of a name and a date."""
    if node.last - node.first < 2 or node.heads:
        return False
    for _, line in (blocks[node.first], blocks[node.last - 1]):
        if len(line) <= BYLINE and _DATE.search(line) and _NAME(_DATE.sub("", line)):
            return True
    return False


def _mark_talk(nodes: list[Node], blocks: list[tuple[int, str]]) -> None:
    """Marks the comments, and the node they stand in if it holds little else."""
    alike: dict[tuple[int, int], list[Node]] = {}
    for n in nodes[1:]:
        if n.last - n.first >= 2 and not n.heads:
            alike.setdefault((n.parent, n.path), []).append(n)
    before = None
    for (parent, _), group in alike.items():
        if len(group) < 2 or 2 * sum(_signed(n, blocks) for n in group) < max(4, len(group)):
            continue
        before = before or [0, *accumulate(len(text) for _, text in blocks)]
        held, above = sum(n.chars for n in group), nodes[parent]
        if before[group[0].first] < max(LEAST_ARTICLE, held / len(group)):
            continue
        for n in group:
            n.talk = True
        if parent and before[above.first] >= LEAST_ARTICLE and 4 * (above.chars - held) < held:
            above.talk = True


def _left_out(nodes: list[Node], drops: frozenset, keeps: frozenset) -> list[bool]:
    """Which nodes are left out, by the host's decisions, or by the page's own where it has none."""
    out = [False] * len(nodes)
    for i, n in enumerate(nodes):
        if n.path in drops:
            out[i] = True
        elif n.path not in keeps:
            out[i] = n.talk or n.most > 0 and n.chars < n.most * nodes[0].chars
        out[i] |= i > 0 and out[n.parent]
    return out


def votes(nodes: list[Node], out: list[bool]) -> dict[int, float]:
    """Shares of one vote by path; a container counts its own text and its lists', and half of what its containers count."""
    score = [0.0 if o else n.score for n, o in zip(nodes, out, strict=True)]
    if not any(score):
        score = [0.0 if o else float(n.plain) for n, o in zip(nodes, out, strict=True)]
    for i in range(len(nodes) - 1, 0, -1):
        score[nodes[i].parent] += score[i] if nodes[i].listed else score[i] / 2
    by_path: dict[int, float] = {}
    for n, x in zip(nodes, score, strict=True):
        if x > 0 and not n.listed:
            by_path[n.path] = max(by_path.get(n.path, 0.0), x)
    total = sum(by_path.values())
    return {p: x / total for p, x in by_path.items()}


def extract(page: str | None, path: int | None = None, drops: frozenset = frozenset(), keeps: frozenset = frozenset()) -> str:
    nodes, blocks = read_page(page)
    out = _left_out(nodes, drops, keeps)

    def inside(path: int) -> list[str]:
        held = [False] * len(nodes)
        for i, n in enumerate(nodes):
            held[i] = n.path == path or i > 0 and held[n.parent]
        return [text for i, text in blocks if held[i] and not out[i]]

    found = inside(path) if path is not None else []
    if not found and (own := votes(nodes, out)):
        depth = {n.path: n.depth for n in nodes}
        found = inside(max(own, key=lambda p: (own[p], depth[p], p)))
    return " ".join(found)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = frozenset()
    for batch in batches:
        summed: dict[tuple, list] = {}
        for part in slices(batch, "html"):
            for h, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                nodes, _ = read_page(page)
                out = _left_out(nodes, none, none)
                shares = votes(nodes, out)
                seen: dict[int, list] = {}
                for n, o in zip(nodes, out, strict=True):
                    if n.chars:
                        x = seen.setdefault(n.path, [n.depth, 0, 0, 0])
                        x[3] |= n.talk
                        x[1] = x[1] + n.digest & 0x7FFFFFFFFFFFFFFF
                        if n.most:
                            x[2] += 1 if n.chars < n.most * nodes[0].chars else -1
                for path, (depth, digest, doubt, talk) in seen.items():
                    x = summed.setdefault((h, path, depth, digest), [0, 0.0, 0, 0])
                    x[0], x[1], x[2], x[3] = x[0] + 1, x[1] + shares.get(path, 0.0), x[2] + (doubt > 0) - (doubt < 0), x[3] + talk
        if summed:
            keys, values = zip(*summed), zip(*summed.values())
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in keys), *(pa.array(c) for c in values)], VOTES)


def _extract(batches: Iterator[pa.RecordBatch], paths) -> Iterator[pa.RecordBatch]:
    none = (None, [], [])
    for batch in batches:
        for part in slices(batch, "html"):
            pages = part.column("html").to_pylist()
            if paths:
                best = [paths.value.get(h, none) for h in part.column("host").to_pylist()]
            else:
                best = list(zip(*(part.column(c).to_pylist() for c in ("path", "drops", "keeps")), strict=True))
            texts = [extract(p, path, frozenset(drops or ()), frozenset(keeps or ())) for p, (path, drops, keeps) in zip(pages, best, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


VOTES = ["host", "path", "depth", "digest", "n", "share", "doubt", "talk"]


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path, votes, drops, keeps): the winning path of each host, and the suspect or repeated ones with its decision. pages: (host, html)."""
    cast = pages.select("host", "html").mapInArrow(_vote, "host string, path long, depth long, digest long, n long, share double, doubt long, talk long")
    texts = cast.groupBy("host", "path", "digest").agg(F.max("depth").alias("depth"), F.sum("n").alias("n"), F.sum("share").alias("share"), F.sum("doubt").alias("doubt"), F.sum("talk").alias("talk"))
    paths = texts.groupBy("host", "path").agg(F.max("depth").alias("depth"), F.sum("n").alias("n"), F.count("*").alias("texts"), F.round(F.sum("share"), 6).alias("votes"), F.sum("doubt").alias("doubt"), F.sum("talk").alias("talk"))
    repeats = F.col("texts") * REPEATED <= F.col("n")
    best = F.max(F.struct("votes", "depth", "path", repeats.alias("repeats"))).alias("best")
    talks = (F.col("talk") > 0) & (F.col("talk") * TALKS >= F.col("n"))
    doubtful = (F.col("doubt") != 0) | (F.col("talk") > 0) | repeats
    seen = F.collect_list(F.when(doubtful, F.struct("path", "doubt", "talk", (talks | (F.col("doubt") > 0)).alias("out"), repeats.alias("repeats")))).alias("seen")
    hosts = paths.groupBy("host").agg(best, seen)
    gone = lambda x: x["out"] | (x["repeats"] & ~F.col("best.repeats"))
    of = lambda keep: F.array_sort(F.transform(F.filter("seen", lambda x: ~gone(x) & ((x["doubt"] < 0) | (x["talk"] > 0)) if keep else gone(x)), lambda x: x["path"]))
    return hosts.select("host", "best.path", "best.votes", of(False).alias("drops"), of(True).alias("keeps"))


def main_text(pages: DataFrame, most_hosts: int = 100_000, most_paths: int = 1_000_000, salts: int = 16) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text."""
    spark = pages.sparkSession
    small_batches(spark)
    read = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host(F.col("url")))
    winners = written(host_paths(read), "host_paths")
    schema = f"page_id {read.schema['page_id'].dataType.simpleString()}, url string, text string"
    size = winners.agg(F.count("*").alias("hosts"), F.coalesce(F.sum(F.size("drops") + F.size("keeps")), F.lit(0)).alias("paths")).first()
    if size["hosts"] <= most_hosts and size["paths"] <= most_paths:
        table = spark.sparkContext.broadcast({r["host"]: (r["path"], r["drops"], r["keeps"]) for r in winners.toLocalIterator()})
        return read.mapInArrow(partial(_extract, paths=table), schema)
    spread = winners.select("host", "path", "drops", "keeps", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = read.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    joined = salted.join(spread.hint("merge"), ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "path", "drops", "keeps").mapInArrow(partial(_extract, paths=None), schema)

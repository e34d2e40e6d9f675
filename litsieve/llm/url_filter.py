"""URL filtering by pattern rules indexed by their rarest literal token, with DataFrame functions only.

Every rule is a regular expression over host + path and the literal tokens that any url it fits must hold. A count of
those tokens over all urls names each rule's rarest one; the rule is filed under it. A url's tokens fetch the rules
filed under them, and only those run their expression. The rule list is a parameter. Up to `inline` rules travel inside
the plan as a literal map, so no url is shuffled; longer lists become a table by token, which the urls' tokens are joined
with on salted keys, as some tokens stand in most urls. Both ways give the same rows.

Of the host and path rules that fit, the longest wins (ties: the first by name). Where none fits, the method's own
patterns decide: block if one of them fits, else allow.

Defined cases: a null url, or one without `://`, has empty host and path, and so is allowed; repeated rows are judged
each, null page_ids too; a url of any length is read whole; an empty table gives no rows; extra columns of any name are
ignored.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

INLINE_RULES, SALTS = 500, 8
HOST, PATH = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"
RULE = "struct<verdict:string,name:string,regex:string,site:boolean,size:int>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    name: str
    regex: str
    tokens: tuple[str, ...]
    site: bool  # a host and path rule; else one of the method's patterns


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits host and its subdomains if the url's path starts with path."""
    whole = re.findall(r"[a-z0-9]+", host.lower()) + re.findall(r"[a-z0-9]+(?=[^a-z0-9])", path.lower())
    return Rule(verdict, host + path, rf"^(?:[^/]*\.)?{re.escape(host.lower())}{re.escape(path)}", tuple(whole), True)


def word_rule(verdict: str, *words: str) -> Rule:
    """Fits a host that holds the words in a row, divided by dots or hyphens."""
    return Rule(verdict, "-".join(words), rf"^(?:[^/]*[.-])?{'[.-]'.join(map(re.escape, words))}(?:[.-][^/]*)?(?:/|$)", words, False)


# The rules of the production query, and host words of gambling, pill, adult and advert sites.
SITE_RULES = [
    site_rule("allow", "org", "/"),
    site_rule("block", "example.org", "/es/"),
    site_rule("block", "example.org", "/en/1"),
    site_rule("allow", "com", "/fr/"),
    site_rule("block", "com", "/de/"),
]
WORD_RULES = [word_rule("block", *words.split()) for words in ("casino", "bets", "poker", "pills", "viagra", "porn", "xxx", "adserver", "ads track", "payday loans")]


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def _tokens(place: Column) -> Column:
    return F.array_distinct(F.split(F.translate(place, UPPER, LOWER), "[^a-z0-9]+"))


def token_counts(urls: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """How many rows hold each token of the rules; at most one entry per token of the rules comes back."""
    wanted = sorted({(t,) for r in rules for t in r.tokens})
    place = F.concat(host(F.col("url")), path(F.col("url")))
    if len(wanted) <= INLINE_RULES:
        named = F.array(*(F.lit(t) for (t,) in wanted)) if wanted else F.array().cast("array<string>")
        held = urls.select(F.explode(F.array_intersect(_tokens(place), named)).alias("token"))
        return {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}
    held = urls.select(F.explode(_tokens(place)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    named = urls.sparkSession.createDataFrame(wanted, "token string")
    return {r["token"]: r["n"] for r in held.join(named.hint("merge"), "token").collect()}


def _filed(rules: list[Rule], counts: dict[str, int]) -> list[tuple[str, dict]]:
    """Each rule with its rarest token; those without tokens are filed under the empty one, which every url gets."""
    rarest = [min(r.tokens, key=lambda t: (counts.get(t, 0), t), default="") for r in rules]
    return [(t, {"verdict": r.verdict, "name": r.name, "regex": r.regex, "site": r.site, "size": len(r.name)}) for t, r in zip(rarest, rules, strict=True)]


def rule_index(rules: list[Rule], counts: dict[str, int]) -> Column:
    """map<token, array<rule>>"""
    filed: dict[str, list[dict]] = {"": []}
    for token, rule in _filed(rules, counts):
        filed.setdefault(token, []).append(rule)
    return F.from_json(F.lit(json.dumps(filed)), f"map<string,array<{RULE}>>")


def fits_by_table(urls: DataFrame, rules: list[Rule], counts: dict[str, int]) -> DataFrame:
    """urls (n, place) with fit, the rules that fit each, by a join of tokens with the table of rules."""
    spark = urls.sparkSession
    table = spark.createDataFrame([(t, tuple(r.values())) for t, r in _filed(rules, counts)], f"token string, rule {RULE}").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("n"), F.lit(SALTS)).cast("int")
    asked = urls.select("n", "place", salt.alias("salt"), F.explode(F.array_distinct(F.concat(_tokens(F.col("place")), F.array(F.lit(""))))).alias("token"))
    found = asked.join(table.hint("merge"), ["token", "salt"]).where(F.regexp(F.col("place"), F.col("rule.regex")))
    fit = found.groupBy("n").agg(F.collect_list("rule").alias("fit"))
    return urls.join(fit.hint("merge"), "n", "left").withColumn("fit", F.coalesce("fit", F.array().cast(f"array<{RULE}>")))


def judge(pages: DataFrame, rules: list[Rule] | None = None, inline: int = INLINE_RULES) -> DataFrame:
    """Per row of pages (page_id, url): page_id, host, path, rule, verdict, pattern."""
    rules = SITE_RULES + WORD_RULES if rules is None else rules
    urls = pages.select("page_id", "url")
    counts = token_counts(urls, rules)
    judged = urls.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    judged = judged.withColumn("place", F.concat("host", "path"))
    if len(rules) > inline:
        judged = fits_by_table(written(judged.withColumn("n", F.monotonically_increasing_id()), "urls"), rules, counts)
    else:
        index = rule_index(rules, counts)
        tokens = F.array_distinct(F.concat(_tokens(F.col("place")), F.array(F.lit(""))))
        candidates = F.flatten(F.filter(F.transform(tokens, lambda t: index[t]), lambda r: r.isNotNull()))
        judged = judged.withColumn("fit", F.filter(candidates, lambda r: F.regexp(F.col("place"), r["regex"])))
    site = F.get(F.array_sort(F.transform(F.filter("fit", lambda r: r["site"]), lambda r: F.struct((-r["size"]).alias("order"), r["name"].alias("name"), r["verdict"].alias("verdict")))), 0)
    pattern = F.array_sort(F.transform(F.filter("fit", lambda r: ~r["site"]), lambda r: F.struct(r["name"].alias("name"), r["verdict"].alias("verdict"))))
    judged = judged.withColumns({"best": site, "own": pattern})
    blocked = F.exists("own", lambda r: r["verdict"] == "block")
    return judged.select(
        "page_id", "host", "path", F.col("best.name").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.when(F.col("best").isNull() & (F.size("own") > 0), F.col("own")[0]["name"]).alias("pattern"),
    )

"""Finished drafts: citation marks in other styles, and a check of citations and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.functions.text import CJK
from litsieve.operators.claims import CITATION, citation_check

# Styles whose marks are numbers, words that begin a family name, the sign of an unknown author.
NUMERIC = ["vancouver", "gb7714", "bibtex", "ris"]
PARTICLES = ["van", "von", "de", "del", "della", "der", "den", "la", "le", "du", "di", "da", "dos", "bin", "ibn", "ter", "ten", "op", "st", "mac", "mc"]
NOBODY = "佚名"
SHORT_SECTION = 60


def name_parts(name: Column) -> tuple[Column, Column]:
    """A name without outer points and commas, and its words."""
    clean = F.btrim(F.trim(F.coalesce(name, F.lit(""))), F.lit(".,;"))
    return clean, F.filter(F.split(clean, "\\s+"), lambda w: w != "")


def family(name: Column) -> Column:
    """The family name of 'Family Given'; with a particle all but the last word; a name in Chinese characters whole."""
    return family_of(*name_parts(name))


def family_of(clean: Column, words: Column) -> Column:
    own = F.when(F.lower(F.get(words, F.lit(0))).isin(PARTICLES) & (F.size(words) >= 3), F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " "))
    return F.when(F.rlike(clean, F.lit(f"[{CJK}]")), clean).otherwise(F.coalesce(own, F.get(words, F.lit(0)), F.lit("")))


def author_year(authors: Column, year: Column) -> Column:
    """'Family, 2020', 'A & B, 2020' or 'A et al., 2020'."""
    first, second, n = family(F.get(authors, F.lit(0))), family(F.get(authors, F.lit(1))), F.coalesce(F.size(authors), F.lit(0))
    names = F.when(n >= 3, F.concat(first, F.lit(" et al."))).when(n == 2, F.concat(first, F.lit(" & "), second)).when(n == 1, first).otherwise(NOBODY)
    dated = F.when(F.coalesce(year, F.lit(0)) != 0, year.cast("string")).otherwise("n.d.")
    return F.concat(names, F.lit(", "), dated)


def restyle_inline(drafts: DataFrame, entries: DataFrame, style: str = "apa") -> DataFrame:
    """drafts (draft_id, draft) with their marks as (Family, year) by entries (draft_id, number, authors, pub_year).

    Styles of numbers keep the draft. Of a mark, single numbers that the list has are written, in order, the others not;
    a mark without any goes. The list of a draft becomes one lookup table beside it; the text is cut at its marks and put
    together again in order. Of several entries under one number the last by label stands.
    """
    if style in NUMERIC:
        return drafts
    labels = entries.select("draft_id", F.col("number").cast("string").alias("number"), author_year(F.col("authors"), F.col("pub_year")).alias("label"))
    labels = labels.groupBy("draft_id", "number").agg(F.max("label").alias("label"))
    lists = labels.groupBy("draft_id").agg(F.map_from_entries(F.collect_list(F.struct("number", "label"))).alias("_labels"))
    body = F.coalesce("draft", F.lit(""))

    def mark(group: Column) -> Column:
        numbers = F.filter(F.transform(F.split(group, "[,，]"), lambda t: F.trim(t)), lambda t: F.rlike(t, F.lit("^[0-9]+$")))
        known = F.filter(F.transform(numbers, lambda t: F.element_at("_labels", t.cast("int").cast("string"))), lambda x: x.isNotNull())
        return F.when(F.size(known) > 0, F.concat(F.lit("("), F.array_join(known, "; "), F.lit(")"))).otherwise("")

    marks = F.transform(F.regexp_extract_all(body, F.lit(CITATION), 1), mark)
    text = F.array_join(F.zip_with(F.split(body, CITATION, -1), marks, lambda piece, m: F.concat(piece, F.coalesce(m, F.lit("")))), "")
    return drafts.join(lists.hint("merge"), "draft_id", "left").withColumn("draft", text).select(*drafts.columns)


def sections(draft: Column) -> Column:
    """(head, body) of each part that a line '## head' begins, with what stands before the first; lines '# ...' left out."""
    lines = F.filter(F.split(F.coalesce(draft, F.lit("")), "\r?\n"), lambda x: ~F.startswith(x, F.lit("# ")))
    whole = F.regexp_replace(F.array_join(lines, "\n"), "\n$", "")
    parts = F.split(whole, "(?m)(?=^## )")
    heads = F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, "^## ([^\n]*)", 1)).alias("head"), F.trim(F.regexp_replace(p, "^## [^\n]*\n?", "")).alias("body"), F.startswith(p, F.lit("## ")).alias("headed")))
    return F.filter(heads, lambda s: s["headed"] | (s["body"] != ""))


def selfcheck(drafts: DataFrame) -> DataFrame:
    """drafts (draft_id, draft, valid array<int>) -> missing and never cited numbers, empty and short sections, verdict, characters."""
    cited = citation_check(drafts.withColumn("draft", F.coalesce("draft", F.lit("")))).select("draft_id", "missing", "never_cited", "ok")
    clean = lambda s: F.regexp_replace(s["body"], "^\\s+|\\s+$", "")
    made = drafts.select("draft_id", sections(F.col("draft")).alias("s"), F.char_length(F.coalesce("draft", F.lit(""))).cast("long").alias("char_count"))
    empty = F.transform(F.filter("s", lambda s: clean(s) == ""), lambda s: s["head"])
    short = F.transform(F.filter("s", lambda s: (clean(s) != "") & (F.char_length(clean(s)) < SHORT_SECTION) & (s["head"] != "")), lambda s: s["head"])
    verdict = F.when(F.col("ok"), "pass").otherwise("revise")
    return cited.join(made.hint("merge"), "draft_id").select("draft_id", "missing", "never_cited", empty.alias("empty_sections"), short.alias("short_sections"), verdict.alias("verdict"), "char_count")

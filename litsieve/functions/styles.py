"""Bibliographies in six styles, as column expressions over papers (authors in the form 'Family Given')."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litsieve.functions.text import CJK, let
from litsieve.operators.formatting import NOBODY, family, family_of, name_parts

# The most authors a style shows, words a key leaves out, marks of publication types, the longest abstract of an export.
MOST = {"gb7714": 3, "vancouver": 6, "apa7": 20, "chicago": 20}
KEY_STOPS = ["a", "an", "the", "of", "for", "and", "or", "in", "on", "to", "with", "by", "study", "trial", "analysis", "effect", "effects", "review"]
MARKS = [("dissertation|thesis", "[D]"), ("proceedings|conference", "[C]"), ("book|monograph", "[M]"), ("preprint", "[EB/OL]")]
NO_JOURNAL, ABSTRACT_MOST = "（期刊信息缺失）", 4000
LATEX = [("&", "\\&"), ("%", "\\%"), ("$", "\\$"), ("#", "\\#"), ("_", "\\_")]


def text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def initialled(names: Column, dot: str) -> Column:
    """array<struct<family, initials>> of names. What follows the family name is given; a name in Chinese characters has no initials."""
    parts = F.transform(names, lambda a: F.struct(*(c.alias(n) for c, n in zip(name_parts(a), ("clean", "words"), strict=True))))
    cut = F.transform(parts, lambda x: F.struct(x["clean"].alias("clean"), family_of(x["clean"], x["words"]).alias("family")))

    def initials(x: Column) -> Column:
        given = F.when(F.rlike(x["clean"], F.lit(f"[{CJK}]")), "").otherwise(F.trim(F.substr(x["clean"], F.char_length(x["family"]) + 1)))
        words = F.filter(F.split(given, "[\\s\\-]+"), lambda p: p != "")
        return F.trim(F.array_join(F.transform(words, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lit(dot))), ""))

    return F.transform(cut, lambda x: F.struct(x["family"].alias("family"), initials(x).alias("initials")))


def authors(style: str) -> Column:
    names = F.filter(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.trim(F.coalesce(a, F.lit(""))) != "")
    return let(names, lambda own: _authors(own, style))


def _authors(names: Column, style: str) -> Column:
    most, n = MOST[style], F.size(names)
    shown = F.slice(names, 1, most)
    nobody = F.when(F.startswith(text("language"), F.lit("zh")) | F.lit(style == "gb7714"), NOBODY).otherwise("Anonymous")
    if style == "gb7714":
        named = F.concat(F.array_join(F.transform(shown, lambda a: F.trim(a)), ", "), F.when(n > most, ", 等").otherwise(""))
    elif style == "vancouver":
        each = F.transform(initialled(shown, ""), lambda x: F.trim(F.concat_ws(" ", x["family"], x["initials"])))
        named = F.concat(F.array_join(each, ", "), F.when(n > most, ", et al.").otherwise(""))
    else:
        each = F.transform(initialled(shown, ". "), lambda x: F.when(x["initials"] == "", x["family"]).otherwise(F.concat(x["family"], F.lit(", "), x["initials"])))
        each = let(each, lambda e: F.when(n > most, F.concat(F.slice(e, 1, most - 1), F.array(F.lit("…")), F.slice(e, -1, 1))).otherwise(e))
        joined = lambda e: F.concat(F.array_join(F.slice(e, F.lit(1), F.greatest(F.size(e) - 1, F.lit(0))), ", "), F.lit(", & "), F.get(F.slice(e, -1, 1), F.lit(0)))
        named = let(each, lambda e: F.when(F.size(e) == 1, F.get(e, F.lit(0))).otherwise(joined(e)))
    return F.when(n == 0, nobody).otherwise(named)


def listed(style: str, number: Column | None = None) -> Column:
    """One entry of a list in apa7, vancouver, gb7714 or chicago; numbered where the style is and a number is given."""
    year = F.when(F.coalesce("pub_year", F.lit(0)) != 0, text("pub_year")).otherwise("n.d.")
    title, journal = F.regexp_replace(F.trim(text("title")), "\\.+$", ""), F.coalesce(F.nullif(F.trim(text("journal")), F.lit("")), F.lit(NO_JOURNAL))
    pages, doi = F.trim(text("pages")), text("doi")
    some = lambda sign, value: F.when(value != "", F.concat(F.lit(sign), value)).otherwise("")
    issue = F.when(text("issue") != "", F.concat(F.lit("("), text("issue"), F.lit(")"))).otherwise("")
    volume = lambda sign: F.when(text("volume") != "", F.concat(F.lit(sign), text("volume"), issue)).otherwise("")
    numbered = lambda left, right: F.lit("") if number is None else F.concat(F.lit(left), number.cast("string"), F.lit(right))
    link = some(" https://doi.org/", doi)
    if style == "apa7":
        return F.concat(authors(style), F.lit(" ("), year, F.lit("). "), title, F.lit(". "), journal, volume(", "), some(", ", pages), F.lit("."), link)
    if style == "vancouver":
        who = let(authors(style), lambda a: F.concat(a, F.when(F.endswith(a, F.lit(".")), "").otherwise(".")))
        return F.concat(numbered("", ". "), who, F.lit(" "), title, F.lit(". "), journal, F.lit(". "), year, volume(";"), some(":", pages), F.lit("."), some(" doi:", doi))
    if style == "chicago":
        who = F.regexp_replace(authors(style), "\\.+$", "")
        return F.concat(who, F.lit(". "), year, F.lit(". “"), title, F.lit(".” "), journal, volume(" "), some(": ", pages), F.lit("."), link)
    kind = F.lower(text("publication_type"))
    mark = F.coalesce(*(F.when(F.rlike(kind, F.lit(words)), F.lit(sign)) for words, sign in MARKS), F.lit("[J]"))
    tail = F.when(doi != "", F.concat(F.lit(" DOI: "), doi, F.lit("."))).otherwise("")
    return F.concat(numbered("[", "] "), authors(style), F.lit(". "), title, mark, F.lit(". "), journal, F.lit(", "), year, volume(", "), some(": ", pages), F.lit("."), tail)


def genre(conference: str, thesis: str, other: str) -> Column:
    kind = F.lower(text("publication_type"))
    return F.when(F.rlike(kind, F.lit("conference|proceedings")), conference).when(F.rlike(kind, F.lit("dissertation|thesis")), thesis).otherwise(other)


def key_base() -> Column:
    """Family, year and first word of the title that counts."""
    who = F.coalesce(F.nullif(F.lower(F.regexp_replace(family(F.get("authors", F.lit(0))), "[^a-zA-Z0-9]", "")), F.lit("")), F.lit("anon"))
    words = F.filter(F.split(F.regexp_replace(text("title"), "[^a-zA-Z0-9]", " "), "\\s+"), lambda w: (w != "") & ~F.lower(w).isin(KEY_STOPS))
    year = F.when(F.coalesce("pub_year", F.lit(0)) != 0, text("pub_year")).otherwise("nd")
    return F.concat(who, year, F.substring(F.coalesce(F.lower(F.get(words, F.lit(0))), F.lit("paper")), 1, 12))


def escaped(value: Column) -> Column:
    out = F.replace(value, F.lit("\\"), F.lit("\\textbackslash{}"))
    for sign, code in LATEX:
        out = F.replace(out, F.lit(sign), F.lit(code))
    out = F.replace(F.replace(out, F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))
    return F.replace(F.replace(out, F.lit("~"), F.lit("\\textasciitilde{}")), F.lit("^"), F.lit("\\textasciicircum{}"))


def fields_of(pairs: list[tuple[Column, Column]]) -> Column:
    """The (name, value) pairs that have a value."""
    return F.filter(F.array(*(F.struct(n.alias("name"), v.alias("value")) for n, v in pairs)), lambda x: x["value"] != "")


def bibtex(key: Column) -> Column:
    year = F.when(F.coalesce("pub_year", F.lit(0)) != 0, text("pub_year")).otherwise("")
    rows = [
        (F.lit("author"), escaped(F.array_join("authors", " and "))), (F.lit("title"), escaped(text("title"))), (genre("booktitle", "booktitle", "journal"), escaped(text("journal"))), (F.lit("year"), year),
        (F.lit("volume"), escaped(text("volume"))), (F.lit("number"), escaped(text("issue"))), (F.lit("pages"), escaped(F.replace(text("pages"), F.lit("-"), F.lit("--")))), (F.lit("doi"), text("doi")),
        (F.lit("url"), text("url")), (F.lit("keywords"), escaped(F.array_join("keywords", ", "))),
    ]
    def lines(held: Column) -> Column:
        width = F.coalesce(F.array_max(F.transform(held, lambda x: F.char_length(x["name"]))), F.lit(4))
        line = lambda w: F.transform(held, lambda x: F.concat(F.lit("  "), F.rpad(x["name"], w, F.lit(" ")), F.lit(" = {"), x["value"], F.lit("}")))
        return F.array_join(let(width, line), ",\n")

    body = let(fields_of(rows), lines)
    return F.concat(F.lit("@"), genre("inproceedings", "phdthesis", "article"), F.lit("{"), key, F.lit(",\n"), body, F.lit("\n}"))


def ris() -> Column:
    year = F.when(F.coalesce("pub_year", F.lit(0)) != 0, text("pub_year")).otherwise("")
    each = lambda name, items: F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda v: F.concat(F.lit(f"{name}  - "), v))
    one = lambda *pairs: F.transform(fields_of([(F.lit(n), v) for n, v in pairs]), lambda x: F.concat(x["name"], F.lit("  - "), x["value"]))
    first, last = F.trim(F.substring_index(text("pages"), "-", 1)), F.when(F.contains(text("pages"), F.lit("-")), F.trim(F.regexp_replace(text("pages"), "^[^-]*-", ""))).otherwise("")
    pmid = F.when(text("pmid") != "", F.concat(F.lit("PMID:"), text("pmid"))).otherwise("")
    abstract = F.substring(F.replace(text("abstract"), F.lit("\n"), F.lit(" ")), 1, ABSTRACT_MOST)
    lines = F.concat(
        F.array(F.concat(F.lit("TY  - "), genre("CONF", "THES", "JOUR"))), each("AU", F.col("authors")), F.array(F.concat(F.lit("TI  - "), text("title"))),
        one(("JO", text("journal")), ("T2", text("journal")), ("PY", year), ("VL", text("volume")), ("IS", text("issue")), ("SP", first), ("EP", last), ("DO", text("doi")), ("UR", text("url")), ("AB", abstract)),
        each("KW", F.col("keywords")), one(("AN", pmid)), F.array(F.lit("ER  - ")),
    )
    return F.array_join(lines, "\n")


def records(papers: DataFrame, style: str, number: str = "number") -> DataFrame:
    """papers (with a column `number`) -> (number, text): entries of the style.

    Keys of BibTeX that would be equal get a to j, from the second on, in the order of their numbers; after that they repeat."""
    if style == "bibtex":
        again = F.col("_again")
        suffix = F.when((again >= 0) & (again < 10), F.substr(F.lit("abcdefghij"), again + 1, F.lit(1))).otherwise("")
        keyed = papers.withColumn("_base", key_base()).withColumn("_again", F.row_number().over(Window.partitionBy("_base").orderBy(number)) - 2)
        keyed = keyed.withColumn("_key", F.concat("_base", suffix))
        return keyed.select(number, bibtex(F.col("_key")).alias("text"))
    return papers.select(number, (ris() if style == "ris" else listed(style, F.col(number))).alias("text"))

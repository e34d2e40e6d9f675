"""Scalar text functions as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character ranges, entities, prefixes, particles and the letters without their marks.
CJK = "\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}\\x{3040}-\\x{30ff}\\x{ac00}-\\x{d7af}\\x{20000}-\\x{2fa1f}"
HAN = "[\\x{4e00}-\\x{9fff}]"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'"), ("&#x27;", "'"), ("&nbsp;", " ")]
DOI_PREFIXES = ["https://doi.org/", "http://doi.org/", "https://dx.doi.org/", "doi:"]
PARTICLES = "van von de del della der den la le du di da dos bin ibn ter ten op st".split()
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Spark has no Unicode normalisation of its own."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, CONTROL, " "), "\\s+", " "))


def normalize_text(text: Column, compose: bool = True) -> Column:
    """NFKC (by an Arrow function), control characters to spaces, white space collapsed; null gives an empty text."""
    text = F.coalesce(text, F.lit(""))
    return spaced(nfkc(text) if compose else text)


def clean_abstract(text: Column, compose: bool = True) -> Column:
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]{1,80}>", " ")
    for entity, sign in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return normalize_text(out, compose)


def normalize_doi(doi: Column) -> Column:
    out = F.lower(F.trim(doi))
    for prefix in DOI_PREFIXES:
        out = F.regexp_replace(out, "^" + prefix.replace(".", "\\."), "")
    out = F.regexp_replace(F.trim(out), "^\\.+|\\.+$", "")
    return F.when(F.contains(out, F.lit("/")), out)


def title_key(title: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^\\p{L}\\p{N}]", "")


def title_fingerprint(title: Column) -> Column:
    key = title_key(title)
    return F.when(key == "", "").otherwise(F.substring(F.sha1(key.cast("binary")), 1, 16))


def has_cjk(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(HAN)), F.lit(False))


def segment_cjk(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), f"([{CJK}])", " $1 "), "\\s+", " "))


def estimate_tokens(text: Column) -> Column:
    body = F.coalesce(text, F.lit(""))
    wide = F.char_length(body) - F.char_length(F.regexp_replace(body, f"[{CJK}\\x{{3000}}-\\x{{303f}}\\x{{ff00}}-\\x{{ffef}}]", ""))
    return F.when(body == "", F.lit(0)).otherwise(F.floor(wide + (F.char_length(body) - wide) / 3.5).cast("int") + 1)


def truncate(text: Column, limit: int, suffix: str = "…") -> Column:
    body = F.coalesce(text, F.lit(""))
    return F.when(F.char_length(body) <= limit, body).otherwise(F.concat(F.substring(body, 1, max(0, limit - len(suffix))), F.lit(suffix)))


def to_family_first(name: Column) -> Column:
    """'Given Family' and 'Family, Given' as 'Family Given'; names in Chinese characters or with a leading particle stay."""
    clean = spaced(F.coalesce(name, F.lit("")))
    tokens = F.split(clean, " ")
    comma = F.trim(F.concat_ws(" ", F.trim(F.substring_index(clean, ",", 1)), F.trim(F.regexp_extract(clean, "^[^,]*,(.*)$", 1))))
    turned = F.concat_ws(" ", F.slice(tokens, -1, 1), F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))))
    return F.when(has_cjk(clean), clean).when(F.contains(clean, F.lit(",")), comma).when((F.size(tokens) < 2) | F.lower(tokens[0]).isin(PARTICLES), clean).otherwise(turned)


def coerce_int(text: Column) -> Column:
    return F.try_to_number(F.split(F.trim(text), "-")[0], F.lit("9999999999")).cast("int")


def _unmarked(text: Column) -> Column:
    """Lower-cased without the common diacritics, Chinese, Japanese and Korean signs apart; other texts need no pass for these."""
    body = F.coalesce(text, F.lit(""))
    return F.translate(F.lower(F.when(F.rlike(body, F.lit(f"[{CJK}]")), segment_cjk(body)).otherwise(body)), MARKED, PLAIN)


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits without the common diacritics; Chinese, Japanese and Korean signs one by one."""
    return F.regexp_extract_all(_unmarked(text), F.lit("[\\p{L}\\p{N}]+"), 0)


def word_line(text: Column) -> Column:
    """word_tokens with a space between, as one text."""
    return F.trim(F.regexp_replace(_unmarked(text), "[^\\p{L}\\p{N}]+", " "))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value made once, however often `use` names it: a column that stands twice in an expression is made twice."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def has_any(text: Column, signs: list[str]) -> Column:
    """Whether any of the literals is in text."""
    return reduce(or_, (F.contains(text, F.lit(s)) for s in signs))


def distinct_ignoring_case(items: Column) -> Column:
    """First of each value by lower case, in order, without blanks."""
    kept = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.filter(F.transform(kept, lambda x, i: F.when(F.array_position(F.transform(kept, lambda y: F.lower(y)), F.lower(x)) == i + 1, x)), lambda x: x.isNotNull())


def json_texts(text: Column) -> Column:
    """The items of a JSON list as texts; an empty list for a null, other JSON or a broken text."""
    return F.coalesce(F.array_compact(F.from_json(text, "array<string>")), F.array().cast("array<string>"))


def pdf_url(html: Column, base: Column) -> Column:
    """Where a page's PDF is: the address its citation_pdf_url names, else that of the first link to a .pdf; resolved
    against the page's own address, an empty text where there is none."""
    page = F.coalesce(html, F.lit(""))
    meta = F.regexp_extract(page, "(?i)(<meta[^>]+(?:name|property)\\s*=\\s*[\"']citation_pdf_url[\"'][^>]*>)", 1)
    named = F.regexp_extract(meta, "(?i)content\\s*=\\s*[\"']([^\"']+)[\"']", 1)
    link = F.regexp_extract(page, "(?i)href\\s*=\\s*[\"']([^\"']+\\.pdf(?:\\?[^\"']*)?)[\"']", 1)
    found = F.trim(F.when(named != "", named).otherwise(link))
    for entity, sign in ENTITIES:
        found = F.replace(found, F.lit(entity), F.lit(sign))
    site, scheme = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    folder = F.concat(site, F.coalesce(F.nullif(F.regexp_extract(F.regexp_replace(base, "[?#].*$", ""), "^[^/]*//[^/]*(/.*/|/)", 1), F.lit("")), F.lit("/")))
    whole = (
        F.when(F.rlike(found, F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*:")), found).when(F.startswith(found, F.lit("//")), F.concat(scheme, found))
        .when(F.startswith(found, F.lit("/")), F.concat(site, found)).otherwise(F.concat(folder, F.regexp_replace(found, "^(\\./)+", "")))
    )
    return F.when(found == "", "").otherwise(whole)

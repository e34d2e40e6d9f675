"""Citation exports (RIS, Web of Science text, tagged text, BibTeX) as papers.

Line-tagged files are cut into records by Spark's text source at the line that ends or begins a record, so files of any
size are split over tasks and no line leaves its record. Inside a record, continuation lines are joined to the line
before, then lines become (tag, value) pairs, all in column expressions. BibTeX needs balanced braces, which a small
function follows through a file; its fields are mapped by columns again.

Defined cases: records without a title give no row; other tags are ignored; line ends may be of either kind; a
continuation belongs to the line above it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litsieve.functions.text import clean_abstract, coerce_int, normalize_doi, spaced
from litsieve.sources.records import as_papers, filled, present

# The tags of each field and the names of record types, as the exporting databases write them.
RIS_TAGS = {
    "title": "TI T1 CT BT", "authors": "AU A1 A2 ED", "abstract": "AB N2", "journal": "JO JF JA T2 J2 SO", "pub_year": "PY DA Y1 PD", "doi": "DO DI", "source_id": "AN",
    "url": "UR", "full_text_url": "L1 L2", "keywords": "KW DE", "volume": "VL", "issue": "IS", "pages": "SP BP", "pages_end": "EP", "language": "LA", "publication_type": "M3 DT",
    "pmid": "PM", "cited_by_count": "TC Z9", "kind": "TY PT",
}
RIS_TYPES = {
    "JOUR": "journal-article", "JFULL": "journal-article", "EJOUR": "journal-article", "CONF": "conference-paper", "CPAPER": "conference-paper", "BOOK": "book",
    "CHAP": "book-chapter", "THES": "thesis", "RPRT": "report", "NEWS": "news", "ELEC": "web",
}
WOS_TAGS = "PT AU TI SO VL IS BP EP PY DI AB LA DT DE SN UR PU PD PG TC Z9 UT AF EM C1 RP NR WE SC ID FX".split()
WOS_TYPES = {"J": "journal-article", "C": "conference-paper", "B": "book", "S": "book", "P": "patent", "R": "report", "D": "dataset"}
TAGGED_TAGS = {
    "kind": "0", "authors": "A", "title": "T", "journal": "J B", "pub_year": "D", "doi": "R", "keywords": "K", "abstract": "X", "url": "U", "volume": "V", "issue": "N",
    "pages": "P", "language": "L", "source_id": "W",
}
TAGGED_TYPES = {"journal article": "journal-article", "conference paper": "conference-paper", "book": "book", "thesis": "thesis", "report": "report", "web page": "web"}
BIB_TYPES = {
    "article": "journal-article", "inproceedings": "conference-paper", "conference": "conference-paper", "book": "book", "inbook": "book-chapter",
    "incollection": "book-chapter", "phdthesis": "thesis", "mastersthesis": "thesis", "techreport": "report", "misc": "other", "unpublished": "other", "online": "web",
}
LATEX = [
    ("\\&", "&"), ("\\%", "%"), ("\\$", "$"), ("\\#", "#"), ("\\_", "_"), ("~", " "), ("\\,", ""), ("\\ ", " "), ("---", "—"), ("--", "-"), ('\\"a', "ä"), ('\\"o', "ö"),
    ('\\"u', "ü"), ('\\"A', "Ä"), ('\\"O', "Ö"), ('\\"U', "Ü"), ("\\'e", "é"), ("\\'a", "á"), ("\\'i", "í"), ("\\'o", "ó"), ("\\'u", "ú"), ("\\`e", "è"), ("\\`a", "à"),
    ("\\~n", "ñ"), ("\\c{c}", "ç"), ("\\ss", "ß"), ("\\aa", "å"), ("\\o", "ø"),
]
ITEM = "\u001f"  # stands between the items of a value that goes over several lines


def records_of(spark: SparkSession, path: str | DataFrame, line_sep: str) -> DataFrame:
    """(value) between separators: of the files at path, or of whole texts (value) that are there already."""
    if isinstance(path, DataFrame):
        return path.select(F.explode(F.split("value", f"\\Q{line_sep}\\E")).alias("value"))
    return spark.read.option("lineSep", line_sep).option("recursiveFileLookup", "true").text(path)


def pairs(record: Column, line: str, joiner: str, more: str) -> Column:
    """(tag, value) of a record's lines. `line` has a group for each; what `more` finds is a line end to be replaced by joiner."""
    whole = F.regexp_replace(record, more, joiner)
    lines = F.filter(F.split(whole, "\\r?\\n"), lambda x: F.rlike(x, F.lit(line)))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, line, 1).alias("tag"), F.trim(F.regexp_extract(x, line, 2)).alias("value")))


def values(tags: str) -> Column:
    """All values of the tags, in the order of their lines."""
    wanted = F.array(*(F.lit(t) for t in tags.split()))
    return F.transform(F.filter("pairs", lambda p: F.array_contains(wanted, p["tag"])), lambda p: p["value"])


def split_keywords(items: Column) -> Column:
    return present(F.flatten(F.transform(items, lambda x: F.transform(F.split(x, "[;,；，]"), lambda y: F.trim(y)))))


def mapped(value: Column, names: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(value == k, F.lit(v)) for k, v in names.items()), F.lit(""))


def line_papers(rows: DataFrame, tags: dict[str, str], source: str, types: dict[str, str], prefer_own: bool) -> DataFrame:
    """rows (pairs) as papers."""
    one = lambda field: F.coalesce(F.get(values(tags[field]), F.lit(0)) if field in tags else F.lit(None), F.lit(""))
    text = lambda field: F.trim(F.replace(one(field), F.lit(ITEM), F.lit(" ")))
    many = lambda field: F.flatten(F.transform(values(tags[field]), lambda x: F.transform(F.split(x, ITEM), lambda y: F.trim(y))))
    kind = F.lower(text("kind")) if "T" in tags["title"].split() else F.upper(text("kind"))
    own = mapped(kind, types)
    pages, end = text("pages"), text("pages_end")
    joined = F.when((pages != "") & (end != "") & ~F.contains(pages, end), F.concat(pages, F.lit("-"), end)).otherwise(pages)
    doi = text("doi")
    return as_papers(
        rows, source, title=spaced(text("title")), abstract=clean_abstract(text("abstract"), compose=False), authors=present(many("authors")), journal=text("journal"),
        pub_year=coerce_int(text("pub_year")), doi=normalize_doi(F.nullif(doi, F.lit(""))), pmid=text("pmid"), keywords=split_keywords(many("keywords")), volume=text("volume"),
        issue=text("issue"), pages=joined, language=text("language"), publication_type=F.when(own != "", own).otherwise(text("publication_type")) if prefer_own else own,
        url=filled(text("url"), F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi))), full_text_url=text("full_text_url"), source_id=text("source_id"),
        cited_by_count=F.coalesce(coerce_int(text("cited_by_count")), F.lit(0)).cast("long"), is_open_access=text("full_text_url") != "",
    )


def ris(spark: SparkSession, path: str | DataFrame, source: str = "import") -> DataFrame:
    """'TY  - JOUR' to 'ER  - '; a record may lack either."""
    ended = records_of(spark, path, "\nER  -").select(F.explode(F.split("value", "(?m)(?=^TY\\s{1,2}-)")).alias("record"))
    lines = pairs(F.col("record"), "^([A-Z][A-Z0-9])\\s{1,2}-\\s?(.*)$", " ", "\\s*\\r?\\n(?!\\s*[A-Z][A-Z0-9]\\s{1,2}-)\\s*")
    return line_papers(ended.select(lines.alias("pairs")), RIS_TAGS, source, RIS_TYPES, True)


def wos(spark: SparkSession, path: str | DataFrame, source: str = "import") -> DataFrame:
    """'PT J' to 'ER'; indented lines go on, for authors and keywords as further items. What follows 'EF' is not read."""
    read = F.regexp_replace("value", "(?s)(^|\\n)EF\\s*(\\n.*)?$", "")
    ended = records_of(spark, path, "\nER").select(F.explode(F.split(read, "(?m)(?=^PT\\s)")).alias("record"))
    known = f"^({'|'.join(WOS_TAGS)})\\s(.*)$"
    lines = pairs(F.col("record"), known, ITEM, "\\s*\\r?\\n[ \\t]{2,}(?=\\S)")
    return line_papers(ended.select(lines.alias("pairs")), RIS_TAGS, source, WOS_TYPES, True)


def tagged(spark: SparkSession, path: str | DataFrame, source: str = "import") -> DataFrame:
    """'%0 Journal Article' begins a record; a file without %0 is one."""
    begun = records_of(spark, path, "\n%0 ").select(F.when(F.startswith("value", F.lit("%")), F.col("value")).otherwise(F.concat(F.lit("%0 "), "value")).alias("record"))
    lines = pairs(F.col("record"), "^\\s*%(\\S+) ?(.*)$", " ", "\\r(?=\\n)")
    return line_papers(begun.select(lines.alias("pairs")), TAGGED_TAGS, source, TAGGED_TYPES, False)


def closing(text: str, at: int, opener: str, closer: str) -> int:
    """Place of the closer that balances the opener at `at`, -1 if there is none; quoted and escaped signs don't count."""
    depth, quoted = 0, False
    for found in re.compile(rf'\\.|["{re.escape(opener + closer)}]', re.S).finditer(text, at):
        sign = found[0]
        if sign == '"':
            quoted = not quoted
        elif not quoted and sign == opener:
            depth += 1
        elif not quoted and sign == closer:
            depth -= 1
            if not depth:
                return found.start()
    return -1


def bib_entries(text: str) -> Iterator[tuple[str, dict[str, str]]]:
    """(type, fields) of each balanced entry; the file ends at the first that isn't."""
    at = 0
    while found := re.compile(r"@([a-zA-Z]+)\s*[{(]").search(text, at):
        start = found.end() - 1
        end = closing(text, start, text[start], "}" if text[start] == "{" else ")")
        if end < 0:
            return
        yield found[1].lower(), bib_fields(text[start + 1 : end])
        at = end + 1


def bib_fields(body: str) -> dict[str, str]:
    fields, at = {}, body.find(",") + 1
    while (equals := body.find("=", at)) >= 0:
        key = body[at:equals].strip().strip(",").strip().lower()
        begin = equals + 1 + len(body[equals + 1 :]) - len(body[equals + 1 :].lstrip())
        if body[begin : begin + 1] == "{":
            end = closing(body, begin, "{", "}")
            end = len(body) if end < 0 else end
            value, at = body[begin + 1 : end], end + 1
        elif quoted := re.compile(r'"((?:[^"\\]|\\.)*)"?', re.S).match(body, begin):
            value, at = quoted[1], quoted.end()
        else:
            bare = re.compile(r"[^,\n]*").match(body, begin)
            value, at = bare[0], bare.end()
        if key:
            fields[key] = value.strip()
    return fields


ENTRY_CHARS = 1 << 20  # of the entries that a task holds besides their file
BIB_SCHEMA = pa.schema([("kind", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))])


def _bibtex(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0):
            held, size = [], 0
            for kind, fields in bib_entries(text.as_py()):
                held.append({"kind": kind, "fields": list(fields.items())})
                size += sum(map(len, fields.values()))
                if size > ENTRY_CHARS:
                    yield pa.RecordBatch.from_pylist(held, schema=BIB_SCHEMA)
                    held, size = [], 0
            yield pa.RecordBatch.from_pylist(held, schema=BIB_SCHEMA)


def latex_to_text(value: Column) -> Column:
    out = F.coalesce(value, F.lit(""))
    for sign, plain in LATEX:
        out = F.replace(out, F.lit(sign), F.lit(plain))
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "[{}]", ""), "\\\\[a-zA-Z]+\\s*", ""), "\\s{2,}", " "))


def bibtex(spark: SparkSession, path: str | DataFrame, source: str = "import") -> DataFrame:
    """Entries of .bib files, one file a row; a file has at most 2 GB."""
    files = path.select("value") if isinstance(path, DataFrame) else spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    rows = files.mapInArrow(_bibtex, "kind string, fields map<string,string>")
    raw = lambda name: F.trim(F.coalesce(F.col("fields")[name], F.lit("")))
    authors = F.filter(F.transform(F.split(latex_to_text(F.col("fields")["author"]), "\\s+and\\s+"), lambda x: F.trim(x)), lambda x: (x != "") & (F.lower(x) != "others"))
    year = F.regexp_extract(filled(raw("year"), raw("date")), "(1[6-9]\\d{2}|20\\d{2})", 1)
    keywords = F.filter(F.transform(F.split(raw("keywords"), "[;,]"), latex_to_text), lambda x: x != "")
    return as_papers(
        rows, source, title=spaced(latex_to_text(raw("title"))), abstract=clean_abstract(latex_to_text(raw("abstract")), compose=False), authors=authors,
        journal=filled(latex_to_text(filled(raw("journal"), raw("journaltitle"))), latex_to_text(raw("booktitle"))), pub_year=coerce_int(year),
        doi=normalize_doi(F.nullif(raw("doi"), F.lit(""))), pmid=raw("pmid"), pmcid=raw("pmcid"), keywords=keywords, volume=raw("volume"), issue=raw("number"), pages=raw("pages"),
        publication_type=mapped(F.col("kind"), BIB_TYPES), url=filled(raw("url"), F.when(raw("doi") != "", F.concat(F.lit("https://doi.org/"), raw("doi")))), is_open_access=raw("eprint") != "",
    )


# Heads of columns, in lower case, of each field; encodings in the order in which they are tried.
CSV_HEADS = {
    "title": ["title", "标题", "题名", "ti", "article title"], "authors": ["author", "authors", "作者", "au"], "abstract": ["abstract", "摘要", "ab"],
    "journal": ["journal", "期刊", "来源", "刊名", "so", "source title", "publication name"], "pub_year": ["year", "年份", "年", "py", "publication year", "date"], "doi": ["doi", "di"],
    "pmid": ["pmid", "pubmed id"], "keywords": ["keywords", "关键词", "author keywords"], "volume": ["volume", "卷"], "issue": ["issue", "期"], "pages": ["pages", "页码", "page start"],
    "url": ["url", "链接", "link"], "language": ["language", "语种"], "publication_type": ["document type", "文献类型"], "cited_by_count": ["cited by", "被引频次", "citations"],
}
ENCODINGS = ["utf-8-sig", "gb18030", "utf-16"]


def csv_files(spark: SparkSession, path: str | list[str], source: str = "import", encoding: str = "utf-8") -> DataFrame:
    """Papers of tables with one head (comma, tab or semicolon, as often as it stands in the head); a table without a
    title column gives none. Of several columns for a field the last with a value stands; lists take all."""
    head = (spark.read.option("encoding", encoding).text(path).head(1) or [[""]])[0][0].lstrip("\ufeff")
    sep = max((",", "\t", ";"), key=head.count)
    rows = spark.read.csv(path, sep=sep, header=True, multiLine=True, escape='"', encoding=encoding)
    own = {f: [c for c in rows.columns if c.lstrip("\ufeff").strip().lower() in names] for f, names in CSV_HEADS.items()}
    texts = lambda f: [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in own[f]]
    one = lambda f: F.coalesce(*reversed(texts(f)), F.lit(""))
    many = lambda f: present(F.flatten(F.array(F.array().cast("array<string>"), *(F.transform(F.split(F.coalesce(t, F.lit("")), "[;|]"), lambda x: F.trim(x)) for t in texts(f)))))
    return as_papers(
        rows if own["title"] else rows.limit(0), source, title=spaced(one("title")), abstract=clean_abstract(one("abstract"), compose=False), authors=many("authors"), journal=one("journal"),
        pub_year=coerce_int(one("pub_year")), doi=normalize_doi(F.nullif(one("doi"), F.lit(""))), pmid=one("pmid"), keywords=many("keywords"), volume=one("volume"), issue=one("issue"), pages=one("pages"),
        language=one("language"), publication_type=one("publication_type"), cited_by_count=F.coalesce(coerce_int(one("cited_by_count")), F.lit(0)).cast("long"),
        url=filled(one("url"), F.when(one("doi") != "", F.concat(F.lit("https://doi.org/"), one("doi")))),
    )


def decoded(content: bytes) -> tuple[str, str]:
    """The text and the first encoding that fits; what fits none is read as UTF-8 with signs for its faults."""
    for name in ENCODINGS:
        try:
            return content.decode(name), name
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "replace"), "utf-8"


@F.pandas_udf(T.StructType([T.StructField("value", T.StringType()), T.StructField("encoding", T.StringType())]))
def decode(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decoded(c) for c in content], columns=["value", "encoding"])


def format_of(value: Column, path: Column) -> Column:
    """ris, bibtex, tagged, wos, csv or an empty text: by what stands in the file, then by its name."""
    has = lambda pattern: F.rlike(value, F.lit(pattern))
    head = F.lower(F.regexp_extract(value, "^\\s*([^\r\n]*)", 1))
    first_lines = F.regexp_extract(value, "^((?:[^\n]*\n?){0,12})", 1)
    wos_like = F.rlike(first_lines, F.lit("(?m)^(FN|VR|PT)\\s")) & F.rlike(first_lines, F.lit("(?m)^(AU|TI|SO)\\s")) & ~F.rlike(first_lines, F.lit("(?m)^[A-Z][A-Z0-9]\\s{1,2}-"))
    counts = [(s, F.char_length(head) - F.char_length(F.replace(head, F.lit(s), F.lit("")))) for s in (",", "\t", ";")]
    best = F.greatest(*(n for _, n in counts))
    sep = F.coalesce(*(F.when(n == best, F.lit(s)) for s, n in counts))
    columns = F.transform(F.split(head, F.concat(F.lit("\\Q"), sep, F.lit("\\E"))), lambda c: F.btrim(F.trim(c), F.lit('"')))
    names = F.array(*(F.lit(n) for heads in CSV_HEADS.values() for n in heads))
    known = F.size(F.filter(columns, lambda c: F.array_contains(names, c)))
    table = (best >= 1) & (known >= 2) & (known * 2 >= F.size(columns)) & ~F.rlike(head, F.lit("^(@|%|ty |fn |pt )"))
    ending = F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))
    return (
        F.when(has("@[a-zA-Z]+\\s*[{(]"), "bibtex").when(has("(?m)^TY\\s{1,2}-") & has("(?m)^ER\\s{1,2}-"), "ris").when(wos_like, "wos").when(has("(?m)^%[0-9A-Z@]"), "tagged").when(has("(?m)^TY\\s{1,2}-"), "ris")
        .when(ending == "ris", "ris").when(ending.isin("bib", "bibtex"), "bibtex").when(ending.isin("enw", "ref", "note"), "tagged").when(ending.isin("csv", "tsv") | table, "csv").otherwise("")
    )


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """(path, value, encoding, format) of all files at path, decoded; a file has at most 2 GB."""
    held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", decode("content").alias("x")).select("path", "x.*")
    return held.withColumn("format", format_of(F.col("value"), F.col("path")))


def any_export(spark: SparkSession, path: str, source: str = "import") -> DataFrame:
    """Papers of all exports at path, each file by its own format and encoding; tables of different heads are read one by one."""
    held = files_of(spark, path)
    readers = {"ris": ris, "wos": wos, "tagged": tagged, "bibtex": bibtex}
    parts = [reader(spark, held.where(F.col("format") == name).select("value"), source) for name, reader in readers.items()]
    tables = held.where("format = 'csv'").select("path", "encoding").collect()  # names only; a list of files that a driver can list
    parts += [csv_files(spark, r["path"], source, "utf-8" if r["encoding"] == "utf-8-sig" else r["encoding"]) for r in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

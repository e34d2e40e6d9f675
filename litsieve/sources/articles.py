"""PubMed files and JATS archives as papers and full texts.

Spark's text source cuts PubMed files at the end tag of a record, so large files are split over tasks and compressed ones
are streamed (its XML source decodes references inside mixed content, which then can't be read). Archives are read member
by member, an archive a task, so that memory is bounded by a member. What is inside a record is mixed content, which
columns can't hold, so a small function takes the values of the wanted paths; all else is column expressions.
"""

from __future__ import annotations

import tarfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.functions.text import clean_abstract, coerce_int, normalize_doi, spaced
from litsieve.sources.records import as_papers, filled

MEMBER_BYTES = 8 << 20


def texts(node: ET.Element | None, path: str) -> list[str]:
    """The whole text, inner markup left out, of each element at path that has any."""
    if node is None:
        return []
    return [text for text in ("".join(e.itertext()).strip() for e in node.iterfind(path)) if text]


def root_of(xml: str | bytes | None) -> ET.Element | None:
    try:
        return ET.fromstring(xml) if xml else None
    except ET.ParseError:
        return None


def first(*options: list[str]) -> str | None:
    return next((o[0] for o in options if o), None)


def persons(node: ET.Element | None, path: str, group: str, last: str, given: str, kinds: tuple[str, ...] | None = None) -> list[str]:
    """Names at path as 'Family, Given', groups as they are."""
    out = []
    for person in node.iterfind(path) if node is not None else ():
        if kinds is None or person.get("contrib-type", "") in kinds:
            name = texts(person, group)[:1] or [", ".join(texts(person, last)[:1] + texts(person, given)[:1] if texts(person, last) else [])]
            out += [n for n in name if n]
    return out


def marked(node: ET.Element | None, path: str, attribute: str, *kinds: str) -> list[str]:
    """Texts of the elements at path whose attribute is one of kinds, in lower case."""
    found = [e for e in node.iterfind(path)] if node is not None else []
    return [t for e in found if e.get(attribute, "").lower() in kinds for t in texts(e, ".")]


PUBMED = (
    "pmid string, title string, abstract string, journal string, year string, medline_date string, authors array<string>, doi string, pmcid string, "
    "mesh array<string>, keywords array<string>, kinds array<string>, volume string, issue string, pages string, language string"
)


def pubmed_fields(xml: str) -> dict:
    root = root_of(xml)
    c, d = (root.find("MedlineCitation"), root.find("PubmedData")) if root is not None else (None, None)
    article = c.find("Article") if c is not None else None
    sections = []
    for part in article.iterfind("Abstract/AbstractText") if article is not None else ():
        label = (part.get("Label") or "").strip()
        sections += [f"{label}: {text}" if label else text for text in texts(part, ".")]
    return {
        "pmid": first(texts(c, "PMID")), "title": first(texts(article, "ArticleTitle")), "abstract": "\n".join(sections),
        "journal": first(texts(article, "Journal/Title"), texts(article, "Journal/ISOAbbreviation")), "year": first(texts(article, "Journal/JournalIssue/PubDate/Year")),
        "medline_date": first(texts(article, "Journal/JournalIssue/PubDate/MedlineDate")), "authors": persons(article, "AuthorList/Author", "CollectiveName", "LastName", "ForeName"),
        "doi": first(marked(article, "ELocationID", "EIdType", "doi"), marked(d, "ArticleIdList/ArticleId", "IdType", "doi")),
        "pmcid": first(marked(d, "ArticleIdList/ArticleId", "IdType", "pmc")[-1:]), "mesh": texts(c, "MeshHeadingList/MeshHeading/DescriptorName"),
        "keywords": texts(c, "KeywordList/Keyword"), "kinds": texts(article, "PublicationTypeList/PublicationType"), "volume": first(texts(article, "Journal/JournalIssue/Volume")),
        "issue": first(texts(article, "Journal/JournalIssue/Issue")), "pages": first(texts(article, "Pagination/MedlinePgn")), "language": first(texts(article, "Language")),
    }


def _pubmed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pylist([pubmed_fields(xml) for xml in batch.column(0).to_pylist()], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "array<string>": pa.list_(pa.string()), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split(" ") for x in ddl.split(", "))])


def pubmed(spark: SparkSession, path: str, names: str = "*.{xml,xml.gz}") -> DataFrame:
    """Papers of PubMed files (`names`) at path; records without a title, and broken ones, give none.

    The abstract's labelled sections are 'LABEL: text'. The year is that of Year, else the first of MedlineDate; the DOI
    that of the article's locations, else of its ids; the publication type is the first.
    """
    read = spark.read.option("lineSep", "</PubmedArticle>").option("recursiveFileLookup", "true").option("pathGlobFilter", names).text(path)
    record = F.regexp_extract("value", "(?s)(<PubmedArticle[ >].*)", 1)
    records = read.select(F.concat(record, F.lit("</PubmedArticle>")).alias("xml")).where(F.startswith("xml", F.lit("<PubmedArticle")))
    r = records.mapInArrow(partial(_pubmed, schema=_arrow(PUBMED)), PUBMED)
    page = F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "pmid", F.lit("/"))
    year = F.coalesce(coerce_int(F.col("year")), F.try_to_number(F.regexp_extract("medline_date", "(\\d{4})", 1), F.lit("9999")).cast("int"))
    return as_papers(
        r, "bulk", title=spaced(F.col("title")), abstract=clean_abstract(F.col("abstract"), compose=False), authors=F.col("authors"), journal=F.col("journal"), pub_year=year,
        doi=normalize_doi(F.col("doi")), pmid=F.col("pmid"), pmcid=F.col("pmcid"), mesh_terms=F.col("mesh"), keywords=F.col("keywords"), volume=F.col("volume"), issue=F.col("issue"),
        pages=F.col("pages"), publication_type=F.get("kinds", F.lit(0)), language=F.col("language"), url=F.coalesce(page, F.lit("")), source_id=F.col("pmid"),
    )


def matching(papers: DataFrame, terms: str = "", year_from: int | None = None, year_to: int | None = None, require_abstract: bool = False) -> DataFrame:
    """Papers of the years, with an abstract if asked for, that hold all terms (split at , and ;) in title, abstract, headings or keywords.

    Papers without a year pass the bounds."""
    hay = F.lower(F.concat_ws(" ", "title", "abstract", F.array_join("mesh_terms", " "), F.array_join("keywords", " ")))
    for term in filter(None, (t.strip() for t in terms.replace("，", ",").replace("；", ",").replace(";", ",").split(","))):
        papers = papers.where(F.contains(hay, F.lit(term.lower())))
    if year_from:
        papers = papers.where(F.col("pub_year").isNull() | (F.col("pub_year") >= year_from))
    if year_to:
        papers = papers.where(F.col("pub_year").isNull() | (F.col("pub_year") <= year_to))
    return papers.where(F.trim("abstract") != "") if require_abstract else papers


MEMBERS = "archive string, member string, xml binary, error string"


def _members(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Streams archives; a member is given on as soon as it is read."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows, size = [], 0
            try:
                files, name = pafs.FileSystem.from_uri(path)
                with files.open_input_stream(name, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|gz") as archive:
                    for member in archive:
                        if member.isfile() and member.name.lower().endswith((".nxml", ".xml")):
                            rows.append({"archive": path, "member": member.name, "xml": archive.extractfile(member).read(), "error": None})
                            size += member.size
                        if size > MEMBER_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
            except (tarfile.TarError, EOFError, OSError) as e:  # what was read before the end stays
                rows.append({"archive": path, "member": None, "xml": None, "error": f"{type(e).__name__}: {e}"})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


def archive_members(spark: SparkSession, path: str, tasks: int = 200) -> DataFrame:
    """(archive, member, xml, error) of the XML members of all .tar.gz and .tgz archives below path; a row with an error
    where an archive ends before its time. Only the listing is read by Spark; archives are dealt over tasks."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{tar.gz,tgz}").load(path).select("path")
    return listed.repartition(tasks).mapInArrow(partial(_members, schema=_arrow(MEMBERS)), MEMBERS)


JATS = "title string, journal string, year string, authors array<string>, abstract string, doi string, pmcid string, fulltext string, plain string"


def jats_fields(xml: bytes | None) -> dict | None:
    """Fields of an article, its sections as text ('## heading', paragraphs), and all of its body's text in order."""
    root = root_of(xml)
    front = root.find(".//front") if root is not None else None
    if front is None:
        return None
    body, parts, plain = root.find(".//body"), [], []
    if body is not None:
        for section in body.iter("sec"):
            parts += [f"\n## {t}" for t in texts(section, "title")[:1]] + texts(section, "p")
        parts = parts or texts(body, ".//p")
        for e in body.iter():
            if str(e.tag).rpartition("}")[2] in ("title", "p", "td", "th", "caption", "label"):
                plain += texts(e, ".")
    return {
        "title": first(texts(front, ".//article-title")), "journal": first(texts(front, ".//journal-title"), texts(front, ".//journal-meta//abbrev-journal-title")),
        "year": first(texts(front, ".//pub-date/year"), texts(front, ".//pub-date//year"), texts(front, ".//pub-date//string-date")),
        "authors": persons(front, ".//contrib", ".//collab", ".//surname", ".//given-names", ("author", "")), "abstract": first(texts(front, ".//abstract")),
        "doi": first(marked(front, ".//article-id", "pub-id-type", "doi")), "pmcid": first(marked(front, ".//article-id", "pub-id-type", "pmc", "pmcid")),
        "fulltext": "\n\n".join(parts).strip(), "plain": "\n".join(plain),
    }


def _jats(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for xml in batch.column(0):
            fields = jats_fields(xml.as_py())
            if fields and fields["title"]:
                yield pa.RecordBatch.from_pylist([fields], schema=schema)


def jats(members: DataFrame) -> DataFrame:
    """Papers with `fulltext` (sections and paragraphs; where there are none, the abstract) and `plain` (tables too) of
    members (xml). Members that aren't articles, or without a title, give none."""
    r = members.where("xml is not null").select("xml").mapInArrow(partial(_jats, schema=_arrow(JATS)), JATS)
    abstract = clean_abstract(F.col("abstract"), compose=False)
    page = F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/"), "pmcid", F.lit("/"))
    return as_papers(
        r, "bulk", title=spaced(F.col("title")), abstract=abstract, authors=F.col("authors"), journal=F.col("journal"),
        pub_year=coerce_int(F.col("year")), doi=normalize_doi(F.col("doi")), pmcid=F.col("pmcid"), is_open_access=F.lit(True), url=F.coalesce(page, F.lit("")), source_id=F.col("pmcid"),
        fulltext=filled(F.col("fulltext"), abstract), plain=F.col("plain"),
    )

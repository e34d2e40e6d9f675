"""Records of Europe PMC and DOAJ (one JSON object a row) and Atom feeds of arXiv as papers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.functions.text import clean_abstract, coerce_int, normalize_doi, spaced, to_family_first
from litsieve.sources.articles import first, root_of, texts
from litsieve.sources.records import as_papers, filled, parsed, present

EUROPE_PMC = """id string, source string, title string, abstractText string, authorString string, authorList struct<author: array<struct<collectiveName: string, fullName: string, lastName: string, firstName: string>>>,
pmid string, pmcid string, doi string, meshHeadingList struct<meshHeading: array<struct<descriptorName: string>>>, keywordList struct<keyword: array<string>>,
fullTextUrlList struct<fullTextUrl: array<struct<documentStyle: string, availability: string, url: string>>>, journalInfo struct<journal: struct<title: string>, yearOfPublication: string, volume: string, issue: string>,
pubYear string, citedByCount string, isOpenAccess string, pageInfo string, pubType string, language string"""
DOAJ = """id string, bibjson struct<title: string, abstract: string, author: array<struct<name: string>>, journal: struct<title: string, volume: string, number: string>,
identifier: array<struct<type: string, id: string>>, link: array<struct<type: string, url: string>>, year: string, month: string, keywords: array<string>, start_page: string>"""


def whole(text: Column) -> Column:
    return F.try_to_number(F.nullif(F.trim(text), F.lit("")), F.lit("9999999999")).cast("int")


def europe_pmc(records: DataFrame, column: str = "record") -> DataFrame:
    """Authors from the list, else the author string cut at commas; the year of the record, else of the journal's issue; the full
    text is the first open address that is no PDF, else the page of the PMCID."""
    r = parsed(records, EUROPE_PMC, column)
    named = lambda a: F.when(filled(F.trim(a["lastName"])) != "", F.trim(F.concat_ws(" ", F.trim(a["lastName"]), F.trim(a["firstName"]))))
    listed = present(F.transform("authorList.author", lambda a: filled(a["collectiveName"], named(a), to_family_first(F.trim(a["fullName"])))))
    cut = present(F.transform(F.split(F.regexp_replace(F.coalesce("authorString", F.lit("")), "\\.+$", ""), ","), lambda a: to_family_first(F.trim(a))))
    pmcid = F.nullif(F.trim(F.coalesce("pmcid", F.lit(""))), F.lit(""))
    free = lambda u: F.rlike(F.coalesce(u["availability"], F.lit("")), F.lit("Open access|Free")) & (F.lower(F.coalesce(u["documentStyle"], F.lit(""))) != "pdf")
    open_url = F.get(F.filter("fullTextUrlList.fullTextUrl", lambda u: free(u) & (filled(u["url"]) != "")), F.lit(0))["url"]
    page = F.concat(F.lit("https://europepmc.org/article/"), F.coalesce("source", F.lit("MED")), F.lit("/"), F.coalesce("id", F.lit("")))
    return as_papers(
        r, "europepmc", title=clean_abstract(F.col("title"), compose=False), abstract=clean_abstract(F.col("abstractText"), compose=False), authors=F.when(F.size(listed) > 0, listed).otherwise(cut),
        journal=F.col("journalInfo.journal.title"), pub_year=F.coalesce(whole(F.col("pubYear")), whole(F.col("journalInfo.yearOfPublication"))), source_id=F.col("id"), pmid=F.trim("pmid"), pmcid=pmcid,
        doi=normalize_doi(F.col("doi")), mesh_terms=present(F.transform("meshHeadingList.meshHeading", lambda m: m["descriptorName"])), keywords=present(F.col("keywordList.keyword")),
        cited_by_count=F.coalesce(whole(F.col("citedByCount")), F.lit(0)).cast("long"), is_open_access=F.upper(F.coalesce("isOpenAccess", F.lit(""))) == "Y",
        full_text_url=filled(open_url, F.concat(F.lit("https://europepmc.org/article/PMC/"), pmcid)), url=page, volume=F.col("journalInfo.volume"), issue=F.col("journalInfo.issue"),
        pages=F.col("pageInfo"), publication_type=F.col("pubType"), language=F.col("language"),
    )


def doaj(records: DataFrame, column: str = "record") -> DataFrame:
    """All are open; the DOI is the first of that type, the page the first link that is no full text (or a second full text)."""
    r = parsed(records, DOAJ, column).select("id", "bibjson.*")
    doi = F.trim(F.get(F.filter("identifier", lambda i: F.lower(i["type"]) == "doi"), F.lit(0))["id"])
    links = F.filter(F.coalesce("link", F.array()), lambda x: F.trim(F.coalesce(x["url"], F.lit(""))) != "")
    full = F.filter(links, lambda x: F.coalesce(F.lower(x["type"]) == "fulltext", F.lit(False)))
    second = F.get(full, F.lit(0))
    other = F.filter(links, lambda x, i: ~F.coalesce(F.lower(x["type"]) == "fulltext", F.lit(False)) | (i > F.array_position(links, second).cast("int") - 1))
    return as_papers(
        r, "doaj", title=F.trim("title"), abstract=clean_abstract(F.col("abstract"), compose=False), authors=present(F.transform("author", lambda a: F.trim(a["name"]))), journal=F.col("journal.title"),
        pub_year=F.coalesce(coerce_int(F.col("year")), coerce_int(F.substring("month", 1, 4))), doi=normalize_doi(F.nullif(doi, F.lit(""))), keywords=present(F.transform("keywords", lambda k: F.trim(k))),
        volume=F.col("journal.volume"), issue=F.col("journal.number"), pages=F.col("start_page"), url=filled(F.trim(F.get(other, F.lit(0))["url"]), F.concat(F.lit("https://doi.org/"), F.nullif(doi, F.lit("")))),
        is_open_access=F.lit(True), full_text_url=F.trim(second["url"]), source_id=F.col("id"),
    )


ATOM, ARXIV = "{http://www.w3.org/2005/Atom}", "{http://arxiv.org/schemas/atom}"
ENTRY = pa.schema([("id", pa.string()), ("title", pa.string()), ("summary", pa.string()), ("published", pa.string()), ("authors", pa.list_(pa.string())), ("categories", pa.list_(pa.string())), ("doi", pa.string()), ("journal", pa.string())])


def _entries(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for xml in batch.column(0).to_pylist():
            e = root_of(f'<feed xmlns="{ATOM[1:-1]}" xmlns:arxiv="{ARXIV[1:-1]}">{xml}</entry></feed>')
            e = e.find(f"{ATOM}entry") if e is not None else None
            if e is not None:
                one = {name: first(texts(e, ATOM + name)) for name in ("id", "title", "summary", "published")}
                named = {"authors": texts(e, f"{ATOM}author/{ATOM}name"), "categories": [c.get("term") for c in e.iterfind(f"{ATOM}category") if c.get("term")]}
                rows.append(one | named | {"doi": first(texts(e, f"{ARXIV}doi")), "journal": first(texts(e, f"{ARXIV}journal_ref"))})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def arxiv(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom feeds at path, cut at their end tags; ids lose their version; broken entries give none."""
    read = spark.read.option("lineSep", "</entry>").option("recursiveFileLookup", "true").text(path)
    cut = read.select(F.regexp_extract("value", "(?s)(<entry[ >].*)", 1).alias("xml")).where("xml <> ''")
    r = cut.mapInArrow(partial(_entries, schema=ENTRY), "id string, title string, summary string, published string, authors array<string>, categories array<string>, doi string, journal string")
    number = F.nullif(F.regexp_replace(F.substring_index("id", "/", -1), "v\\d+$", ""), F.lit(""))
    return as_papers(
        r, "arxiv", title=spaced(F.col("title")), abstract=spaced(F.col("summary")), authors=present(F.transform("authors", lambda a: to_family_first(a))), journal=filled(F.col("journal"), F.lit("arXiv preprint")),
        pub_year=whole(F.nullif(F.regexp_extract("published", "^(\\d{4})", 1), F.lit(""))), source_id=number, doi=normalize_doi(F.col("doi")), keywords=present(F.col("categories")), is_open_access=F.lit(True),
        full_text_url=F.concat(F.lit("https://arxiv.org/pdf/"), number), url=filled(F.concat(F.lit("https://arxiv.org/abs/"), number), F.col("id")), publication_type=F.lit("preprint"), language=F.lit("en"),
    )


EDGE = "source string, id string, doi string, title string, pubYear string, journalAbbreviation string, journalTitle string, authorString string"
EUROPE_LISTS = f"id string, source string, referenceList struct<reference: array<struct<{EDGE.replace(' string', ': string')}>>>, citationList struct<citation: array<struct<{EDGE.replace(' string', ': string')}>>>"
OTHER = "struct<paperId: string, title: string, year: int, venue: string, citationCount: long, externalIds: struct<DOI: string, PubMed: string>, authors: array<struct<name: string>>>"
SEMANTIC_LISTS = f"paperId string, data array<struct<citedPaper: {OTHER}, citingPaper: {OTHER}>>"


def europe_pmc_edges(records: DataFrame, column: str = "record") -> DataFrame:
    """Edges (paper, place, direction, pmid, pmcid, doi, title, journal, year, authors) of each record's reference or citation list."""
    r = parsed(records, EUROPE_LISTS, column)
    listed = F.when(F.col("referenceList").isNotNull(), F.col("referenceList.reference")).otherwise(F.col("citationList.citation"))
    rows = r.select(F.concat_ws(":", "source", "id").alias("paper"), F.when(F.col("referenceList").isNotNull(), "cites").otherwise("cited_by").alias("direction"), F.posexplode(listed).alias("place", "x"))
    number = F.nullif(F.trim("x.id"), F.lit(""))
    own = lambda kind: F.when(F.upper("x.source") == kind, number)
    return rows.select(
        "paper", "place", "direction", own("MED").alias("pmid"), own("PMC").alias("pmcid"), normalize_doi(F.col("x.doi")).alias("doi"), clean_abstract(F.col("x.title"), compose=False).alias("title"),
        filled(F.col("x.journalAbbreviation"), F.col("x.journalTitle")).alias("journal"), F.col("x.pubYear").alias("year"), filled(F.col("x.authorString")).alias("authors"),
    )


def semantic_scholar_edges(records: DataFrame, column: str = "record") -> DataFrame:
    """Edges of lists of cited or citing papers; entries without either are left out."""
    r = parsed(records, SEMANTIC_LISTS, column).select("paperId", F.posexplode("data").alias("place", "e"))
    rows = r.select(F.col("paperId").alias("paper"), "place", F.when(F.col("e.citedPaper").isNotNull(), "cites").otherwise("cited_by").alias("direction"), F.coalesce("e.citedPaper", "e.citingPaper").alias("x")).where("x is not null")
    return rows.select(
        "paper", "place", "direction", F.col("x.paperId").alias("s2_id"), F.nullif(F.col("x.externalIds.PubMed"), F.lit("")).alias("pmid"), normalize_doi(F.col("x.externalIds.DOI")).alias("doi"), filled(F.col("x.title")).alias("title"),
        filled(F.col("x.venue")).alias("journal"), F.col("x.year").cast("string").alias("year"), F.array_join(present(F.col("x.authors.name")), ", ").alias("authors"), F.col("x.citationCount").alias("cited_by_count"),
    )


LINKS = "linksets array<struct<ids: array<string>, linksetdbs: array<struct<dbto: string, linkname: string, links: array<string>>>>>"


def pubmed_edges(records: DataFrame, column: str = "record") -> DataFrame:
    """Edges (paper, linkname, place, pmid) of link sets into PubMed; other databases are left out."""
    sets = parsed(records, LINKS, column).select(F.explode("linksets").alias("s")).select(F.get("s.ids", F.lit(0)).alias("paper"), F.explode("s.linksetdbs").alias("d"))
    return sets.where("d.dbto = 'pubmed'").select("paper", F.col("d.linkname").alias("linkname"), F.posexplode("d.links").alias("place", "pmid"))

"""Records of literature indexes (one JSON object a row, as in their dumps) as papers and as citation edges.

Every mapper takes a DataFrame with a string column and gives one row per record that has a title, with the columns of
PAPER. All are column expressions over from_json: a broken record, or a null, gives no row; other fields are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.functions.text import clean_abstract, coerce_int, normalize_doi, to_family_first

TEXTS = "title abstract journal source full_text_url url volume issue pages publication_type language".split()
IDS = "source_id pmid pmcid doi".split()
LISTS = "authors mesh_terms keywords".split()
PAPER = [*TEXTS, *IDS, *LISTS, "pub_year", "cited_by_count", "is_open_access"]

OPENALEX = """id string, title string, display_name string, doi string, type string, language string, publication_year int, cited_by_count long,
authorships array<struct<author: struct<display_name: string>>>, primary_location struct<source: struct<display_name: string>>,
open_access struct<is_oa: boolean>, best_oa_location struct<pdf_url: string, landing_page_url: string>, mesh array<struct<descriptor_name: string>>,
keywords array<struct<display_name: string>>, concepts array<struct<display_name: string, score: double>>, ids struct<pmid: string, pmcid: string>,
biblio struct<volume: string, issue: string, first_page: string, last_page: string>, abstract_inverted_index map<string, array<int>>,
referenced_works array<string>"""
CROSSREF = """title array<string>, subtitle array<string>, author array<struct<name: string, family: string, given: string>>, DOI string, URL string,
issued struct<`date-parts`: array<array<int>>>, published struct<`date-parts`: array<array<int>>>, `published-online` struct<`date-parts`: array<array<int>>>,
subject array<string>, abstract string, `container-title` array<string>, publisher string, `is-referenced-by-count` long, license array<struct<URL: string>>,
link array<struct<URL: string>>, volume string, issue string, page string, type string, language string,
reference array<struct<DOI: string, `article-title`: string, `volume-title`: string, `journal-title`: string, year: string, author: string>>"""
SEMANTIC = """paperId string, title string, abstract string, tldr struct<text: string>, authors array<struct<name: string>>, year int,
externalIds struct<DOI: string, PubMed: string, PubMedCentral: string>, journal struct<name: string, volume: string, pages: string>,
publicationVenue struct<name: string>, venue string, openAccessPdf struct<url: string>, fieldsOfStudy array<string>, citationCount long, url string,
publicationTypes array<string>"""
CORE = """id string, title string, abstract string, authors array<struct<name: string>>, doi string, downloadUrl string, links array<string>,
yearPublished string, publishedDate string, publisher string, fieldOfStudy array<string>, language struct<code: string>"""


def filled(*options: Column) -> Column:
    """The first option that is neither null nor empty, else an empty text."""
    return F.coalesce(*(F.nullif(x.cast("string"), F.lit("")) for x in options), F.lit(""))


def present(items: Column) -> Column:
    """Items without nulls and blanks; an empty list for a null."""
    return F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))


def last_part(url: Column) -> Column:
    return F.nullif(F.substring_index(url, "/", -1), F.lit(""))


def parsed(records: DataFrame, schema: str, column: str) -> DataFrame:
    """The fields of each record. The generator keeps tests on them above itself: else each test parses the record anew."""
    return records.select(F.inline(F.array(F.from_json(column, schema))))


def as_papers(rows: DataFrame, source: str, **given: Column) -> DataFrame:
    """rows as papers: given columns, the rest empty, columns beyond those of a paper last; rows without a title go."""
    blank = dict.fromkeys(TEXTS, F.lit("")) | dict.fromkeys(IDS, F.lit(None).cast("string")) | dict.fromkeys(LISTS, F.array().cast("array<string>"))
    blank |= {"pub_year": F.lit(None).cast("int"), "cited_by_count": F.lit(0).cast("long"), "is_open_access": F.lit(False), "source": F.lit(source)}
    out = blank | given
    out |= {c: F.coalesce(out[c], blank[c]) for c in [*TEXTS, *LISTS, "cited_by_count", "is_open_access"]}
    out |= {c: F.nullif(out[c], F.lit("")) for c in IDS}
    return rows.select(*(out[c].alias(c) for c in [*PAPER, *(c for c in given if c not in PAPER)])).where(F.trim("title") != "")


def text_of_index(index: Column) -> Column:
    """The text of an inverted index (word -> places): the words in the order of their places."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.sort_array(F.filter(placed, lambda x: x["at"].isNotNull())), lambda x: x["word"]), " ")


def openalex(records: DataFrame, column: str = "record") -> DataFrame:
    r = parsed(records, OPENALEX, column)
    names, own = F.col("authorships.author.display_name"), present(F.col("keywords.display_name"))
    concepts = present(F.transform(F.filter("concepts", lambda c: c["score"] >= 0.3), lambda c: c["display_name"]))
    first, last = F.col("biblio.first_page"), F.col("biblio.last_page")
    both = (filled(first) != "") & (filled(last) != "")
    return as_papers(
        r, "openalex", title=filled(F.col("title"), F.col("display_name")), abstract=text_of_index(F.col("abstract_inverted_index")),
        authors=F.transform(present(names), to_family_first), journal=F.col("primary_location.source.display_name"), pub_year=F.col("publication_year"),
        source_id=last_part(F.col("id")), pmid=last_part(F.col("ids.pmid")), pmcid=last_part(F.col("ids.pmcid")), doi=normalize_doi(F.col("doi")),
        mesh_terms=present(F.col("mesh.descriptor_name")), keywords=F.when(F.size(own) > 0, own).otherwise(concepts), cited_by_count=F.col("cited_by_count"),
        is_open_access=F.col("open_access.is_oa"), full_text_url=filled(F.col("best_oa_location.pdf_url"), F.col("best_oa_location.landing_page_url")),
        url=F.col("id"), volume=F.col("biblio.volume"), issue=F.col("biblio.issue"), pages=F.when(both, F.concat_ws("-", first, last)).otherwise(first),
        publication_type=F.col("type"), language=F.col("language"),
    )


def crossref(records: DataFrame, column: str = "record") -> DataFrame:
    r = parsed(records, CROSSREF, column)
    year = lambda c: F.get(F.get(F.col(c)["date-parts"], F.lit(0)), F.lit(0))
    head = lambda c: F.get(F.col(c), F.lit(0))
    names = F.transform("author", lambda a: filled(a["name"], F.trim(F.concat_ws(" ", a["family"], a["given"]))))
    dated = F.coalesce(F.when(F.col("issued").isNotNull(), year("issued")).otherwise(year("published")), year("`published-online`"))
    return as_papers(
        r, "crossref", title=filled(head("title"), head("subtitle")), abstract=clean_abstract(F.col("abstract")), authors=present(names),
        journal=filled(head("`container-title`"), F.col("publisher")), pub_year=dated, source_id=normalize_doi(F.col("DOI")), doi=normalize_doi(F.col("DOI")),
        keywords=present(F.col("subject")), cited_by_count=F.col("`is-referenced-by-count`"), is_open_access=F.coalesce(F.size("license") > 0, F.lit(False)),
        full_text_url=head("link.URL"), url=F.col("URL"), volume=F.col("volume"), issue=F.col("issue"), pages=F.col("page"), publication_type=F.col("type"),
        language=F.col("language"),
    )


def semantic_scholar(records: DataFrame, column: str = "record") -> DataFrame:
    r = parsed(records, SEMANTIC, column)
    short = F.when(filled(F.col("tldr.text")) != "", F.concat(F.lit("[TLDR] "), F.col("tldr.text")))
    page = F.concat(F.lit("https://www.semanticscholar.org/paper/"), F.coalesce("paperId", F.lit("")))
    return as_papers(
        r, "semantic_scholar", title=F.col("title"), abstract=filled(F.col("abstract"), short), authors=F.transform(present(F.col("authors.name")), to_family_first),
        journal=filled(F.col("journal.name"), F.col("publicationVenue.name"), F.col("venue")), pub_year=F.col("year"), source_id=F.col("paperId"),
        pmid=F.col("externalIds.PubMed"), pmcid=F.col("externalIds.PubMedCentral"), doi=normalize_doi(F.col("externalIds.DOI")), keywords=present(F.col("fieldsOfStudy")),
        cited_by_count=F.col("citationCount"), is_open_access=filled(F.col("openAccessPdf.url")) != "", full_text_url=F.col("openAccessPdf.url"),
        url=filled(F.col("url"), page), volume=F.col("journal.volume"), pages=F.col("journal.pages"), publication_type=F.array_join(present(F.col("publicationTypes")), "; "),
    )


def core(records: DataFrame, column: str = "record") -> DataFrame:
    r = parsed(records, CORE, column)
    doi = normalize_doi(F.col("doi"))
    return as_papers(
        r, "core", title=F.trim("title"), abstract=F.col("abstract"), authors=F.transform(present(F.col("authors.name")), lambda x: F.trim(x)), journal=F.col("publisher"),
        pub_year=coerce_int(F.coalesce("yearPublished", "publishedDate")), doi=doi, keywords=F.transform(present(F.col("fieldOfStudy")), lambda x: F.trim(x)), language=F.col("language.code"),
        url=filled(F.trim(F.get("links", F.lit(0))), F.concat(F.lit("https://doi.org/"), doi)), is_open_access=filled(F.trim("downloadUrl")) != "",
        full_text_url=F.trim("downloadUrl"), source_id=F.col("id"),
    )


def crossref_references(records: DataFrame, column: str = "record") -> DataFrame:
    """Edges (citing_doi, place, doi, title, journal, year, authors) of each record's reference list."""
    r = parsed(records, CROSSREF, column).select(normalize_doi(F.col("DOI")).alias("citing_doi"), F.posexplode("reference").alias("place", "x"))
    title = filled(F.col("x.article-title"), F.col("x.volume-title"))
    return r.select("citing_doi", "place", normalize_doi(F.col("x.DOI")).alias("doi"), title.alias("title"), filled(F.col("x.journal-title")).alias("journal"), F.col("x.year").alias("year"), filled(F.col("x.author")).alias("authors"))


def openalex_references(records: DataFrame, column: str = "record") -> DataFrame:
    """Edges (citing_id, place, cited_id) of each work's list of works."""
    return parsed(records, OPENALEX, column).select(last_part(F.col("id")).alias("citing_id"), F.posexplode("referenced_works").alias("place", "url")).select("citing_id", "place", last_part(F.col("url")).alias("cited_id"))


def combined(results: DataFrame, per_source: int) -> DataFrame:
    """The first per_source results of each (query_id, source) by rank: what the sources put together before the merge."""
    from pyspark.sql import Window

    return results.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "source").orderBy("rank"))).where(F.col("_n") <= per_source).drop("_n")


def merged_search(results: DataFrame, sources: list[str], per_source: int, limit: int) -> DataFrame:
    """What a search over several sources returns: per query at most 2 * limit merged records in order of first_seq.

    results: (query_id, source, rank, paper fields). Each source gives its first per_source; they are put together in the
    order of `sources` (others after them by name), then by rank, and merged by dedup key within the query.
    """
    from pyspark.sql import Window

    from litsieve.operators.resolve import merge_papers

    turn = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, sources)).cast("array<string>"), F.col("source")), F.lit(0)), F.lit(len(sources) + 1))
    order = Window.partitionBy("query_id").orderBy(turn, "source", "rank")
    merged = merge_papers(combined(results, per_source).withColumn("ingest_seq", F.row_number().over(order)), by=("query_id",))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("first_seq"))
    return merged.withColumn("place", place).where(F.col("place") <= 2 * limit)


def search_status(queries: DataFrame, results: DataFrame, errors: DataFrame, sources: list[str], per_source: int, limit: int) -> DataFrame:
    """(query_id, source, ok, found, error, raw_count, merged_count): a row for each query and source, also for those that gave nothing.

    queries: (query_id); errors: (query_id, source, error), a source that failed. raw_count is the query's records before
    the merge, merged_count those that merged_search returns.
    """
    capped = combined(results, per_source).groupBy("query_id", "source").agg(F.count("*").alias("found"))
    raw = capped.groupBy("query_id").agg(F.sum("found").alias("raw_count"))
    merged = merged_search(results, sources, per_source, limit).groupBy("query_id").agg(F.count("*").alias("merged_count"))
    failed = errors.groupBy("query_id", "source").agg(F.min("error").alias("error"))
    rows = queries.select("query_id").distinct().select("query_id", F.explode(F.array(*map(F.lit, sources)).cast("array<string>")).alias("source"))
    joined = rows.join(capped.hint("merge"), ["query_id", "source"], "left").join(failed.hint("merge"), ["query_id", "source"], "left").join(raw.hint("merge"), "query_id", "left").join(merged.hint("merge"), "query_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return joined.select("query_id", "source", F.col("error").isNull().alias("ok"), none("found"), "error", none("raw_count"), none("merged_count"))

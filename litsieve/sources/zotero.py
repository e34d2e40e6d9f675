"""A Zotero library's tables (entity, attribute, value) as papers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.functions.text import clean_abstract, coerce_int, normalize_doi, spaced
from litsieve.sources.records import as_papers, filled, present

# Fields of each column in the order in which they count, and the names of the item types.
FIELDS = {
    "title": ["title"], "abstract": ["abstractNote"], "doi": ["DOI"], "pub_year": ["date"], "journal": ["publicationTitle", "journalAbbreviation", "proceedingsTitle", "bookTitle"],
    "volume": ["volume"], "issue": ["issue"], "pages": ["pages"], "url": ["url"], "language": ["language"],
}
TYPES = {
    "journalArticle": "journal-article", "conferencePaper": "conference-paper", "thesis": "thesis", "book": "book", "bookSection": "book-chapter", "report": "report",
    "preprint": "preprint", "manuscript": "manuscript",
}


def texts(lookup: Mapping[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in lookup.items() for x in pair))


def wide_fields(data: DataFrame, fields: DataFrame, values: DataFrame) -> DataFrame:
    """One row an item of its (itemID, fieldID, valueID) rows; of several fields for a column the first that has a value."""
    order = {f: i for names in FIELDS.values() for i, f in enumerate(names)}
    target = {f: column for column, names in FIELDS.items() for f in names}
    known = fields.where(F.col("fieldName").isin(list(target))).select("fieldID", texts(target)[F.col("fieldName")].alias("target"), texts({k: str(v) for k, v in order.items()})[F.col("fieldName")].cast("int").alias("place"))
    # fields has a row for each kind of field, some hundred; values are joined by key
    rows = data.join(known.hint("merge"), "fieldID").join(values.select("valueID", "value").hint("merge"), "valueID").where(F.coalesce("value", F.lit("")) != "")
    return rows.groupBy("itemID").agg(*(F.min_by(F.when(F.col("target") == c, F.col("value")), F.when(F.col("target") == c, F.col("place"))).alias(c) for c in FIELDS))


def creator_names(item_creators: DataFrame, creators: DataFrame) -> DataFrame:
    """(itemID, authors): 'Last, First' in order; names in one field as they are, blank ones left out."""
    whole = (F.col("fieldMode") == 1) | (F.coalesce("firstName", F.lit("")) == "")
    name = F.when(whole, F.trim(F.coalesce("lastName", F.lit("")))).otherwise(F.btrim(F.concat(F.coalesce("lastName", F.lit("")), F.lit(", "), "firstName"), F.lit(", ")))
    rows = item_creators.join(creators.hint("merge"), "creatorID").select("itemID", "orderIndex", name.alias("name")).where("name <> ''")
    return rows.groupBy("itemID").agg(F.transform(F.array_sort(F.collect_list(F.struct("orderIndex", "name"))), lambda x: x["name"]).alias("authors"))


def pdf_paths(attachments: DataFrame, items: DataFrame, folder: str) -> DataFrame:
    """(itemID, pdfs) of the PDF files below each item; 'storage:name' is a file in the attachment's own folder."""
    path = F.trim(F.coalesce("path", F.lit("")))
    is_pdf = F.endswith(F.lower(path), F.lit(".pdf")) | (F.lower(F.coalesce("contentType", F.lit(""))) == "application/pdf")
    stored = F.concat(F.lit(f"{folder}/storage/"), "key", F.lit("/"), F.substr(path, F.lit(9)))
    rows = attachments.where(is_pdf & (path != "")).join(items.select("itemID", "key").hint("merge"), "itemID")
    rows = rows.select("parentItemID", F.struct("itemID", F.when(F.startswith(path, F.lit("storage:")), stored).otherwise(path).alias("path")).alias("x"))
    return rows.groupBy(F.col("parentItemID").alias("itemID")).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["path"]).alias("pdfs"))


def library(tables: Mapping[str, DataFrame], folder: str = "", types: tuple[str, ...] = tuple(TYPES)) -> DataFrame:
    """Papers, with `pdfs`, of the items of the given types that are not deleted and have a title.

    tables: items, itemTypes, deletedItems, itemData, fields, itemDataValues, itemCreators, creators, itemAttachments, itemTags, tags."""
    t = tables
    kinds = t["itemTypes"].where(F.col("typeName").isin(list(types))).select("itemTypeID", "typeName")
    items = t["items"].join(kinds.hint("merge"), "itemTypeID").join(t["deletedItems"].select("itemID").hint("merge"), "itemID", "left_anti").select("itemID", "key", "typeName")
    names = t["itemTags"].join(t["tags"].hint("merge"), "tagID").select("itemID", F.trim("name").alias("name")).where("name <> ''")
    parts = [
        wide_fields(t["itemData"], t["fields"], t["itemDataValues"]), creator_names(t["itemCreators"], t["creators"]), pdf_paths(t["itemAttachments"], t["items"], folder),
        names.groupBy("itemID").agg(F.array_sort(F.collect_list("name")).alias("tags")),
    ]
    for part in parts:
        items = items.join(part.hint("merge"), "itemID", "left")
    doi = normalize_doi(F.col("doi"))
    pdfs = present(F.col("pdfs"))
    return as_papers(
        items, "zotero", title=spaced(F.col("title")), abstract=clean_abstract(F.col("abstract"), compose=False), authors=present(F.col("authors")), journal=F.col("journal"),
        pub_year=coerce_int(F.col("pub_year")), doi=doi, keywords=present(F.col("tags")), volume=F.col("volume"), issue=F.col("issue"), pages=F.col("pages"), language=F.col("language"),
        publication_type=texts(TYPES)[F.col("typeName")], url=filled(F.col("url"), F.concat(F.lit("https://doi.org/"), doi)), is_open_access=F.size(pdfs) > 0, source_id=F.col("key"), pdfs=pdfs,
    )

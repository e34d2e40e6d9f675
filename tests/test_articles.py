"""PubMed files and JATS archives."""

import gzip
import io
import tarfile

import duckdb

from litsieve.plans import registry
from litsieve.sources import articles

PUBMED = """<?xml version="1.0"?><!DOCTYPE PubmedArticleSet><PubmedArticleSet>
<PubmedArticle><MedlineCitation Status="MEDLINE"><PMID Version="1">101</PMID><Article><Journal><JournalIssue><Volume>12</Volume><Issue>3</Issue><PubDate><Year>2021</Year></PubDate></JournalIssue><Title>Brain &amp; Mind</Title></Journal>
<ArticleTitle>Effects of <i>rTMS</i> on H<sub>2</sub>O &lt; mood</ArticleTitle><Pagination><MedlinePgn>1-9</MedlinePgn></Pagination>
<Abstract><AbstractText Label="AIM">To drop <sup>2</sup> cm.</AbstractText><AbstractText>Plain part.</AbstractText><AbstractText Label="X"> </AbstractText></Abstract>
<AuthorList><Author><LastName>Zhang</LastName><ForeName>Wei</ForeName></Author><Author><CollectiveName>The Group</CollectiveName></Author><Author><LastName>Solo</LastName></Author><Author><ForeName>None</ForeName></Author></AuthorList>
<Language>eng</Language><Language>ger</Language><PublicationTypeList><PublicationType>Review</PublicationType><PublicationType>Letter</PublicationType></PublicationTypeList><ELocationID EIdType="pii">x</ELocationID><ELocationID EIdType="doi">10.1/ABC</ELocationID></Article>
<MeshHeadingList><MeshHeading><DescriptorName>Stroke</DescriptorName></MeshHeading></MeshHeadingList><KeywordList><Keyword>rTMS</Keyword><Keyword> </Keyword></KeywordList></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/other</ArticleId><ArticleId IdType="pmc">PMC7</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>102</PMID><Article><Journal><ISOAbbreviation>B M</ISOAbbreviation><JournalIssue><PubDate><MedlineDate>2019 Nov-Dec</MedlineDate></PubDate></JournalIssue></Journal><ArticleTitle>Second</ArticleTitle></Article></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="doi">10.2/x</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>103</PMID><Article><ArticleTitle> </ArticleTitle></Article></MedlineCitation></PubmedArticle>
<PubmedArticle><PubmedData/></PubmedArticle></PubmedArticleSet>"""

JATS = """<article><front><journal-meta><journal-title>J Mood</journal-title></journal-meta><article-meta><article-id pub-id-type="pmc">PMC9</article-id><article-id pub-id-type="doi">https://doi.org/10.3/Q</article-id>
<title-group><article-title>A <bold>trial</bold></article-title></title-group><contrib-group><contrib contrib-type="author"><name><surname>Li</surname><given-names>Na</given-names></name></contrib><contrib contrib-type="editor"><name><surname>Ed</surname></name></contrib><contrib><collab>Team</collab></contrib></contrib-group>
<pub-date><year>2020</year></pub-date><abstract><p>Short.</p></abstract></article-meta></front>{}</article>"""
BODY = "<body><sec><title>Methods</title><p>We <i>did</i> it.</p><table-wrap><label>T1</label><caption><p>Cap</p></caption><table><tr><th>n</th><td>5</td></tr></table></table-wrap><sec><title>Sub</title><p>More.</p></sec></sec></body>"


def test_pubmed(spark, tmp_path):
    (tmp_path / "a.xml").write_text(PUBMED)
    with gzip.open(tmp_path / "b.xml.gz", "wt") as f:
        f.write(PUBMED.replace(">101<", ">201<"))
    papers = articles.pubmed(spark, str(tmp_path))
    got = {r.pmid: r for r in papers.collect() if r.title != "Second"}
    assert sorted(got) == ["101", "201"] and papers.count() == 4
    r = got["101"]
    assert r.title == "Effects of rTMS on H2O < mood" and r.abstract == "AIM: To drop 2 cm. Plain part." and r.journal == "Brain & Mind"
    assert r.authors == ["Zhang, Wei", "The Group", "Solo"] and (r.doi, r.pmcid, r.pub_year) == ("10.1/abc", "PMC7", 2021)
    assert (r.mesh_terms, r.keywords, r.publication_type, r.language, r.volume, r.issue, r.pages) == (["Stroke"], ["rTMS"], "Review", "eng", "12", "3", "1-9")
    s = papers.where("pmid = '102'").first()
    assert (s.pub_year, s.doi, s.journal, s.abstract, s.url) == (2019, "10.2/x", "B M", "", "https://pubmed.ncbi.nlm.nih.gov/102/")
    ids = lambda **k: sorted(r.pmid for r in articles.matching(papers, **k).collect())
    assert ids(terms="RTMS; stroke") == ["101", "201"] and ids(terms="rtms,nothing") == [] and ids(year_to=2020) == ["102", "102"] and ids(year_from=2020, require_abstract=True) == ["101", "201"]


def packed(*members):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:gz") as archive:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    return raw.getvalue()


def test_archives(spark, tmp_path):
    filler = bytes(i * 7919 % 251 for i in range(200_000))
    (tmp_path / "deep").mkdir()
    (tmp_path / "whole.tar.gz").write_bytes(packed(("a/PMC9.nxml", JATS.format(BODY).encode()), ("a/x.pdf", b"%PDF"), ("b.xml", b"<broken"), ("c.xml", JATS.format("").replace("PMC9", "PMC10").encode())))
    cut = packed(("d.nxml", JATS.format("<body><p>Bare.</p></body>").replace("PMC9", "PMC11").encode()), ("filler.pdf", filler), ("e.nxml", JATS.format(BODY).encode()))
    (tmp_path / "deep" / "cut.tgz").write_bytes(cut[: len(cut) // 2])
    (tmp_path / "none.txt").write_text("x")
    members = articles.archive_members(spark, str(tmp_path), tasks=3)
    rows = members.collect()
    assert sorted(r.member for r in rows if r.member) == ["a/PMC9.nxml", "b.xml", "c.xml", "d.nxml"] and [r.archive.rsplit("/", 1)[1] for r in rows if r.error] == ["cut.tgz"]
    got = {r.pmcid: r for r in articles.jats(members).collect()}
    assert sorted(got) == ["PMC10", "PMC11", "PMC9"]
    r = got["PMC9"]
    assert (r.title, r.journal, r.pub_year, r.doi, r.authors) == ("A trial", "J Mood", 2020, "10.3/q", ["Li, Na", "Team"])
    assert r.fulltext == "## Methods\n\nWe did it.\n\n\n## Sub\n\nMore." and r.plain.split("\n") == ["Methods", "We did it.", "T1", "Cap", "Cap", "n", "5", "Sub", "More."]
    assert got["PMC10"].fulltext == "Short." and got["PMC11"].fulltext == "Bare." and got["PMC9"].is_open_access


def test_documents_without_words(spark, tmp_path):
    """Texts that leave no words for the abstract's section give the row that the SQL gives."""
    texts = [None, "", " \n", "é", "大鼠", "|||", ".", "&", "a < b &amp; c", "\x01;", "Plain words."]
    rows = [(i, t, "en", "src1") for i, t in enumerate(texts * 3, 10) if i % 7]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, registry.queries()["src_01_pubmed"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(registry.oracle_sql()["src_01_pubmed"]).fetchall()) and len(got) == len(rows)

"""Citation exports."""

import pyarrow as pa

from litsieve.sources import exports

RIS = """TY  - JOUR
TI  - Effects of rTMS
 on mood
AU  - Zhang, Wei
AU  - Li, Na
AB  - First line
and second

third.
KW  - stroke; depression
KW  - rTMS
SP  - 10
EP  - 19
PY  - 2021/03/01
DO  - https://doi.org/10.1/ABC
L1  - http://x/pdf
TC  - 7
ZZ  - unknown
ER  - 
TY  - CHAP
T1  - No end tag
SP  - 5-9
EP  - 9
M3  - ignored
TY  - THES
TI  - Third
ER  - 

AU  - Bare, A
TI  - Bare record
DT  - Review
ER  - 
TY  - JOUR
AU  - No, Title
ER  - 
"""
WOS = """FN Clarivate
VR 1.0
PT J
AU Zhang, Wei
   Li, Na
TI Effects
   of rTMS
SO BRAIN
DE stroke; mood
   pain
BP 1
EP 9
PY 2020
DI 10.2/x
DT Article
PM 123
XX odd
UT WOS:1
ER

PT Z
AU Solo, H
TI Second
DT Review
ER

EF
PT J
TI After the end
ER
"""
TAGGED = """%0 Journal Article
%A Zhang Wei
%A Li Na
%T Effects
%J Mood
%D 2019
%K stroke;mood，pain
%R 10.3/Y
no tag
%0 Web Page
%T Page
%0 Odd
%A Nobody
"""
BIB = r"""% comment
@article{key1,
  title = {Effects of {rTMS} \& mood -- {\"a}},
  author = "Zhang, Wei and M{\"u}ller, A. and others",
  journal = {J {of} Mood}, year = 2021,
  abstract = {With a line
@inside{brace} and = sign},
  doi = {10.4/Z}, number = {3}, keywords = {a; b, c}, eprint={x}
}
@inproceedings(key2, title="Quoted \" sign", booktitle={Proc}, date={2018-05-01}) @misc{k3, author={No Title}}
@book{broken, title={never ends
"""


def by_title(df):
    return {r.title: r for r in df.collect()}


def test_ris(spark, tmp_path):
    (tmp_path / "a.ris").write_text(RIS)
    (tmp_path / "b.ris").write_bytes(RIS.replace("Effects of rTMS", "Other").replace("\n", "\r\n").encode())
    got = by_title(exports.ris(spark, str(tmp_path)))
    assert set(got) == {"Effects of rTMS on mood", "Other on mood", "No end tag", "Third", "Bare record"} and exports.ris(spark, str(tmp_path)).count() == 8
    for r in (got["Effects of rTMS on mood"], got["Other on mood"]):
        assert r.authors == ["Zhang, Wei", "Li, Na"] and r.abstract == "First line and second third." and r.keywords == ["stroke", "depression", "rTMS"] and r.pages == "10-19"
        assert (r.doi, r.url, r.full_text_url, r.is_open_access, r.cited_by_count, r.publication_type) == ("10.1/abc", "https://doi.org/https://doi.org/10.1/ABC", "http://x/pdf", True, 7, "journal-article")
    assert (got["No end tag"].pages, got["No end tag"].publication_type, got["Third"].publication_type, got["Bare record"].publication_type, got["Bare record"].authors) == ("5-9", "book-chapter", "thesis", "Review", ["Bare, A"])


def test_wos(spark, tmp_path):
    (tmp_path / "a.txt").write_text(WOS)
    got = by_title(exports.wos(spark, str(tmp_path)))
    assert set(got) == {"Effects of rTMS", "Second"}
    r = got["Effects of rTMS"]
    assert r.authors == ["Zhang, Wei", "Li, Na"] and r.keywords == ["stroke", "mood", "pain"] and (r.pages, r.journal, r.doi, r.pub_year, r.publication_type) == ("1-9", "BRAIN", "10.2/x", 2020, "journal-article")
    assert (got["Second"].publication_type, got["Second"].authors) == ("Review", ["Solo, H"])


def test_tagged(spark, tmp_path):
    (tmp_path / "a.txt").write_text(TAGGED)
    got = by_title(exports.tagged(spark, str(tmp_path)))
    assert set(got) == {"Effects", "Page"} and got["Page"].publication_type == "web"
    r = got["Effects"]
    assert r.authors == ["Zhang Wei", "Li Na"] and r.keywords == ["stroke", "mood", "pain"] and (r.doi, r.url, r.pub_year, r.journal, r.publication_type) == ("10.3/y", "https://doi.org/10.3/Y", 2019, "Mood", "journal-article")
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "b.txt").write_text("%T Only\n%A One\n%A Two\n")
    assert by_title(exports.tagged(spark, str(tmp_path / "none")))["Only"].authors == ["One", "Two"]


def test_bibtex(spark, tmp_path):
    (tmp_path / "a.bib").write_text(BIB)
    got = by_title(exports.bibtex(spark, str(tmp_path)))
    assert len(got) == 2
    r = got["Effects of rTMS & mood - ä"]
    assert r.authors == ["Zhang, Wei", "Müller, A."] and (r.journal, r.pub_year, r.doi, r.issue, r.is_open_access, r.publication_type) == ("J of Mood", 2021, "10.4/z", "3", True, "journal-article")
    assert r.abstract == "With a line @insidebrace and = sign" and r.keywords == ["a", "b", "c"]
    s = next(r for t, r in got.items() if t.startswith("Quoted"))
    assert (s.journal, s.pub_year, s.publication_type) == ("Proc", 2018, "conference-paper")


CSV = '''标题;Authors;Year;DOI;Author Keywords;Keywords;Abstract;Odd
Effects;Zhang Wei| Li Na;2020;10.5/Q;a;b|c;"two
lines ""quoted""";x
;Nobody;2000;;;;;
'''


def test_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    r, = exports.csv_files(spark, str(tmp_path)).collect()
    assert (r.title, r.authors, r.pub_year, r.doi, r.keywords, r.abstract, r.url) == ("Effects", ["Zhang Wei", "Li Na"], 2020, "10.5/q", ["a", "b", "c"], 'two lines "quoted"', "https://doi.org/10.5/Q")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "c.csv").write_text("name,year\nx,1\n")
    assert exports.csv_files(spark, str(tmp_path / "b")).count() == 0


def test_any_export_finds_format_and_encoding(spark, tmp_path):
    files = {"a.txt": RIS.encode(), "b.txt": WOS.encode(), "c.dat": TAGGED.replace("Effects", "疗效研究").encode("gb18030"), "d.txt": BIB.encode("utf-16"), "e.txt": b"\xef\xbb\xbf" + CSV.encode(), "f.txt": b"Just prose, with a title.", "g.ris": b"odd", "h.txt": b"TY  - JOUR\nTI  - Only"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.format, r.encoding) for r in exports.files_of(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("ris", "utf-8-sig"), "b.txt": ("wos", "utf-8-sig"), "c.dat": ("tagged", "gb18030"), "d.txt": ("bibtex", "utf-16"), "e.txt": ("csv", "utf-8-sig"), "f.txt": ("", "utf-8-sig"), "g.ris": ("ris", "utf-8-sig"), "h.txt": ("ris", "utf-8-sig")}
    titles = sorted(r.title for r in exports.any_export(spark, str(tmp_path)).collect())
    assert titles == sorted(["Effects of rTMS on mood", "No end tag", "Third", "Bare record", "Effects of rTMS", "Second", "疗效研究", "Page", "Effects of rTMS & mood - ä", 'Quoted \\" sign', "Effects", "Only"])


def test_entries_leave_a_file_in_bounded_batches(monkeypatch):
    text = "".join('@article{k%d, title = {T {%d} \\} "}" x}, year = 20%02d}\n' % (i, i, i) for i in range(40)) + "@book(b, title = {)}) @misc{open, title = {x}"
    monkeypatch.setattr(exports, "ENTRY_CHARS", 50)
    made = list(exports._bibtex(iter([pa.record_batch([pa.array([text, "", "@a{b}"])], names=["value"])])))
    assert max(b.num_rows for b in made) < 5 and sum(b.num_rows for b in made) == 42
    rows = [r for b in made for r in b.to_pylist()]
    assert rows[7]["fields"] == [("title", 'T {7} \\} "}" x'), ("year", "2007")] and rows[40]["kind"] == "book" and rows[41]["kind"] == "a"
    assert exports.closing('{a\\}"}"b}c', 0, "{", "}") == 8 and exports.closing("{a", 0, "{", "}") == -1 and exports.closing("(a(b)\\", 0, "(", ")") == -1

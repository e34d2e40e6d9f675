"""The SQL of queries on the inputs where it once stated another rule."""

import duckdb

from litsieve.operators import claims
from litsieve.plans import content
from litsieve.plans.base import QUERIES


def test_numbers_parted_by_white_space_only(spark):
    drafts = [(1, "Call 3296 4524132264652876 and 7.5 % or 8%x, 12% 13\n\n14 15\n(16). 5\n(9 ‰) 17 \n 18 %% [2] 0.25]"), (2, "none"), (3, "25 [1, 3] 26 [4]. 27"), (4, "5\n\nA")]
    texts = [(11, "3296 and 12% of 16"), (12, "7.5 % 17 18 %"), (13, None), (2, "none"), (3, "x")]
    frame = spark.createDataFrame(drafts, "draft_id long, draft string")
    sources = spark.createDataFrame([(1, k, t) for k, (_, t) in enumerate(texts[:3], 1)], "draft_id long, cite_id int, source_text string")
    got = sorted(map(tuple, claims.number_provenance(frame, sources).collect()))
    con = duckdb.connect()
    con.execute("create table drafts_v (draft_id bigint, draft varchar); create table documents (doc_id bigint, text varchar); create table labels (doc_id bigint)")
    con.executemany("insert into drafts_v values (?, ?)", [(i * 10 if i == 1 else i * 100, t) for i, t in drafts])
    con.executemany("insert into documents values (?, ?)", texts)
    con.execute("insert into labels values (10)")
    want = sorted(((1 if r[0] == 10 else r[0] // 100), *r[1:]) for r in con.execute("select draft_id, numbers, unknown, status from (" + content.PROVENANCE + ")").fetchall())
    assert got == want and got[0][1] == 12 and got[3][1] == 0


def test_levels_of_all_words_and_letters(spark):
    titles = ["ñrat.", "a rat.", "rats", "zebrafish", "an overview", "longitudinal", "systematic review", "case series", "guideline", "murinée", None, "cratñ mouse", "大鼠"]
    frame = spark.createDataFrame(list(enumerate(titles)), "paper_id long, title string").selectExpr("*", "cast(null as string) as abstract")
    got = sorted(map(tuple, frame.select("paper_id", content.rules.evidence_level(frame.title, frame.abstract)).collect()))
    con = duckdb.connect()
    con.execute("create table papers_v (paper_id bigint, title varchar, abstract varchar)")
    con.executemany("insert into papers_v values (?, ?, null)", list(enumerate(titles)))
    assert got == sorted(con.execute(content.sca_17_sql()).fetchall()) and got[0][1] == "其他"


def test_texts_are_checked_once(spark):
    """The tests of the result stand above the checks: no filter runs these anew."""
    made = QUERIES["saf_03_output_check"](spark, "/root/testdata/sf0.001")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1

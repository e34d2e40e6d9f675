from litsieve.operators import claims, retrieval
from litsieve.plans import registry


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rules_are_worked_out_once_for_each_claim(spark):
    drafts = spark.createDataFrame([(1, "Aspirin was shown to help 12 patients here [1]. It never helped in colder months [1].")], "draft_id long, draft string")
    sources = spark.createDataFrame([(1, 1, "aspirin helped 12 patients")], "draft_id long, cite_id int, source_text string")
    checked = claims.check(claims.claims(drafts), sources)
    assert plan_of(checked).count("array_intersect(") == 2
    assert "array_intersect(" not in plan_of(claims.issues(checked)) and claims.issues(checked).count() >= 1


def test_embedding_moves_no_words(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None), (3, "")], "id long, text string")
    made = retrieval.hashing_embedding(docs, "id", "text")
    assert "Aggregate" not in plan_of(made) and [r.id for r in made.collect()] == [1]


def long_claim(spark, folder):
    """A draft whose only claim names a number, which its source lacks, after some 500 signs."""
    words = "patients walked further after training " * 13
    texts = [(100, f"{words}and 87.31 of them were glad. "), (101, words)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(100, 1, 0)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_report_reads_whole_claims(spark, tmp_path):
    row = registry.queries()["agg_19_draft_report"](spark, long_claim(spark, tmp_path)).first()
    assert (row.claims, row.unsupported, row.supported_rate) == (1, 1, 0.0)


def test_rules_read_whole_claims(spark, tmp_path):
    rows = registry.queries()["clm_05_10_check"](spark, long_claim(spark, tmp_path)).collect()
    assert [(r.verdict, r.rules, r.n) for r in rows] == [("unsupported", "numbers", 1)]


def test_issues_read_whole_claims(spark, tmp_path):
    rows = registry.queries()["clm_15_issues"](spark, long_claim(spark, tmp_path)).collect()
    assert [tuple(r) for r in rows] == [(100, "100:0:0", "unsupported", 1)]


def test_drafts_are_cut_once(spark):
    drafts = spark.createDataFrame([(1, "Aspirin was shown to help 12 patients here [1].")], "draft_id long, draft string")
    sources = spark.createDataFrame([(1, 1, "aspirin helped 12 patients")], "draft_id long, cite_id int, source_text string")
    checked = claims.check(claims.claims(drafts), sources)
    assert "Window" not in plan_of(checked) and checked.count() == 1

"""Unit frames for the library's operators: hand-computed values and invariants."""

import pytest
from pyspark.sql import functions as F

from litsieve.functions import rules, text
from litsieve.operators import analytics, claims, filters, library, metrics, resolve, retrieval, safety, windows
from litsieve.plans import registry
from litsieve.sources.adapters import VIEWS


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return frame.select(column.alias("x")).first()["x"]


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(VIEWS) >= 12


@pytest.mark.parametrize("raw,want", [("https://doi.org/10.1/AB.", "10.1/ab"), ("doi:10.2/x", "10.2/x"), ("nothing", None), (None, None)])
def test_doi(spark, raw, want):
    assert one(spark, text.normalize_doi(F.col("d")), d=raw) == want


@pytest.mark.parametrize("raw,want", [("Wei Zhang", "Zhang Wei"), ("Zhang, Wei", "Zhang Wei"), ("van der Berg Jan", "van der Berg Jan"), ("王伟", "王伟"), ("", "")])
def test_family_first(spark, raw, want):
    assert one(spark, text.to_family_first(F.col("n")), n=raw) == want


def test_text_functions(spark):
    assert one(spark, text.segment_cjk(F.col("t")), t="加速rTMS治疗") == "加 速 rTMS 治 疗"
    assert one(spark, text.estimate_tokens(F.col("t")), t="") == 0 and one(spark, text.estimate_tokens(F.col("t")), t="中文大约一字一token") == 9
    assert one(spark, text.normalize_text(F.col("t")), t="ａ\x07 b\n c") == "a b c"
    assert one(spark, text.clean_abstract(F.col("t")), t="<h4>A</h4> &lt;b&gt; &amp;") == "A <b> &"
    assert one(spark, text.truncate(F.col("t"), 4), t="abcdef") == "abc…"
    assert one(spark, text.distinct_ignoring_case(F.split("t", ",")), t="a,B,A, ,b,c") == ["a", "B", "c"]


def test_rules(spark):
    assert one(spark, rules.classify_failure(F.col("e")), e="HTTP 429 Too Many Requests") == "rate_limited"
    assert one(spark, rules.classify_failure(F.col("e")), e="odd") == "unknown" and one(spark, rules.classify_failure(F.col("e")), e=None) == ""
    assert one(spark, rules.classify_fulltext_error(F.col("e"))["permanent"], e="HTTP 503") is False
    assert one(spark, rules.evidence_level(F.col("t"), F.col("a")), t="A randomized controlled trial in rats", a="") == "动物实验"
    assert one(spark, rules.evidence_level(F.col("t"), F.col("a")), t="A systematic review", a="") == "Meta分析/系统评价"
    assert one(spark, rules.sample_size(F.col("t"), F.col("a")), t="n = 40", a="纳入 120 例患者, 3 patients") == 120


def test_filters(spark):
    papers = spark.createDataFrame([(1, "Alpha beta", "x", 2001, "J One", 5), (2, "Gamma", None, None, "Two", 0)], "paper_id long, title string, abstract string, pub_year int, journal string, cited_by_count int")
    ids = lambda df: sorted(r["paper_id"] for r in df.collect())
    assert ids(filters.metadata(papers, year_from=2000)) == [1] and ids(filters.metadata(papers)) == [1, 2]
    assert ids(filters.bulk(papers, year_from=2000)) == [1, 2] and ids(filters.bulk(papers, ["beta"])) == [1]
    assert ids(filters.relevant(papers, ["alpha", "beta", "of"])) == [1]
    assert ids(filters.boolean_match(papers, exclude=["gamma"])) == [1]


def test_metrics_by_hand(spark):
    ranking = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (1, 11, 4), (2, 5, 1)], "query_id long, id long, rank int")
    qrels = spark.createDataFrame([(1, 11, 2.0), (1, 12, 1.0), (1, 99, 1.0), (2, 6, 1.0)], "query_id long, id long, gain double")
    got = {r["query_id"]: r for r in metrics.evaluate(ranking, qrels, 3).collect()}
    assert got[1]["recall"] == round(2 / 3, 6) and got[1]["precision"] == round(2 / 3, 6) and got[1]["mrr"] == 0.5
    assert got[1]["map"] == round((1 / 2 + 2 / 3) / 3, 6) and (got[1]["hit"], got[1]["missed"], got[1]["noise"]) == ("11,12", "99", "10")
    assert got[2]["recall"] == 0 and got[2]["mrr"] == 0


def test_fusion_keeps_a_single_route(spark):
    route = spark.createDataFrame([(1, "bm25", i, i, 1.0 / i) for i in range(1, 6)], "query_id long, route string, id long, rank int, score double")
    assert [r["id"] for r in retrieval.fuse(route).orderBy("rank").collect()] == [1, 2, 3, 4, 5]
    assert retrieval.differing(route, route).count() == 0
    assert retrieval.differing(route, route.withColumn("rank", 6 - F.col("rank"))).count() == 1


def test_knn(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0])], "id long, vector array<double>")
    queries = spark.createDataFrame([(7, [3.0, 0.0])], "query_id long, vector array<double>")
    assert [(r["id"], r["distance"]) for r in retrieval.knn(corpus, queries, 2).orderBy("rank").collect()] == [(1, 0.0), (2, round(2**0.5, 6))]
    assert retrieval.knn(corpus, queries.where("false"), 2).count() == 0


def test_merge_is_idempotent(spark):
    rows = [(1, "10.1/a", None, "T one", "short", "J", "s1", "en", 2000, 3, False), (2, "10.1/a", "9", "T one longer", "a longer abstract", None, "S1", "en", 2001, 9, True), (3, None, None, "T one", "", "J", "s2", "en", 1999, 0, False)]
    papers = spark.createDataFrame(rows, "ingest_seq long, doi string, pmid string, title string, abstract string, journal string, source string, language string, pub_year int, cited_by_count int, is_open_access boolean")
    merged = resolve.merge_papers(papers)
    got = merged.orderBy("first_seq").collect()
    assert len(got) == 2 and got[0]["title"] == "T one longer" and got[0]["pub_year"] == 2001 and got[0]["cited_by_count"] == 9 and got[0]["is_open_access"] and got[0]["pmid"] == "9" and list(got[0]["found_in"]) == ["s1"]
    assert resolve.merge_papers(merged.withColumnRenamed("first_seq", "ingest_seq")).count() == 2
    library = papers.limit(1).withColumn("paper_id", F.lit(4).cast("long"))
    actions = {r["action"]: r["paper_id"] for r in resolve.upsert(library, papers).collect()}
    assert actions == {"updated": 4} or actions == {"updated": 4, "new": 5}


def test_claims(spark):
    draft = "# Results\nThe drug was proven to work in 42% of adults [1]. Nothing cited here at all.\nIt helps elderly patients a lot [2-3], [9].\n## References\n[1] A source that is listed."
    drafts = spark.createDataFrame([(1, draft)], "draft_id long, draft string")
    sources = spark.createDataFrame([(1, 1, "The drug showed no significant difference in adults, 42% of them"), (1, 2, "elderly patients were helped"), (1, 3, "")], "draft_id long, cite_id int, source_text string")
    made = claims.claims(drafts)
    assert sorted(list(r["citations"]) for r in made.collect()) == [[1], [2, 3, 9]]
    got = {tuple(r["citations"]): r for r in claims.check(made, sources).collect()}
    assert got[(1,)]["verdict"] == "contradicted" and got[(2, 3, 9)]["verdict"] == "unsupported" and "existence" in got[(2, 3, 9)]["rules"]
    assert claims.coverage(drafts).first()["cited"] == 2


def test_redaction_is_idempotent(spark):
    said = 'key sk-abcdefgh12345678 and token = "abcd1234efgh" end'
    once = one(spark, safety.redact(F.col("t")), t=said)
    assert once == 'key sk-a***78 and token = "abcd***gh" end' and one(spark, safety.redact(F.col("t")), t=once) == once
    assert one(spark, safety.neutralize_brackets(F.col("t")), t="a<<<<b") == "a<<b"


def test_windows_and_costs(spark):
    rows = spark.createDataFrame([("r", 1, "b"), ("r", 2, "a"), ("q", 1, "z")], "run_id string, seq int, phase string")
    assert {r["run_id"]: r["phase"] for r in windows.latest(rows, "run_id", ["seq"]).collect()} == {"r": "a", "q": "z"}
    assert {r["run_id"]: list(r["phases"]) for r in windows.phases_of(rows, ["a", "b"]).collect()} == {"r": ["a", "b"], "q": ["z"]}
    usage = spark.createDataFrame([("deepseek-reasoner", 1_000_000, 0), ("qwen3:8b", 10, 10), ("new", 1, 1)], "model string, prompt_tokens long, completion_tokens long")
    assert [r["cost"] for r in analytics.with_cost(usage).collect()] == [4.0, 0.0, 0.0]


def test_redaction_leaves_no_tail(spark):
    masked = lambda t: one(spark, safety.redact(F.col("t")), t=t)
    assert masked('password = "abcd~efghSECRETTAIL"') == 'password = "abcd***IL"'
    assert masked("token=abcdefgh12~SECRETTAIL9, x") == "token=abcd***L9, x"
    assert masked("-----BEGIN RSA PRIVATE KEY-----\nMIIB") == "-----BEGIN ***PRIVATE KEY-----\nMIIB"
    assert masked("-----BEGIN ENCRYPTED PRIVATE KEY-----") == "-----BEGIN ENCR***D PRIVATE KEY-----"
    assert masked("Authorization: Bearer abcdefghij==\nsk-abcdefghijk ghp_abcdefghijklmnop") == "Authorization: Bearer abcd***==\nsk-a***jk ghp_***op"
    assert masked(masked("api_key: 'abcdefgh/ij+k'")) == "api_key: 'abcd***+k'" and masked("token: subword") == "token: subword" and masked(None) == ""


def test_phrase_search_equals_contains(spark):
    docs = spark.createDataFrame([(1, "the red fox ran"), (2, "a blue foxglove"), (3, "bored fox ranks high"), (4, None)], "doc_id long, text string")
    phrases = spark.createDataFrame([(10, "red fox ran"), (11, "fox"), (12, "nothing here at all"), (13, "")], "query_id long, query string")
    assert {(r["query_id"], r["id"]) for r in retrieval.holding(docs, phrases).collect()} == {(10, 1), (10, 3), (11, 1), (11, 3)}


def test_knn_hands_on_k_rows_a_task(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    held = rng.normal(size=(300, 8))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(held)], "id long, vector array<double>").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = retrieval.knn(corpus, corpus.where("id < 3").withColumnRenamed("id", "query_id"), 5).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    unit = held / np.linalg.norm(held, axis=1, keepdims=True)
    for q in range(3):
        want = np.argsort(-(unit @ unit[q]))[:5].tolist()
        assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want


def test_runs_are_cut_before_they_meet_artifacts(spark, monkeypatch):
    runs = spark.createDataFrame([(f"r{i:03}", i // 7, i if i % 10 == 0 else None) for i in range(300)], "run_id string, created_at int, artifact_id int")
    artifacts = spark.createDataFrame([(i, f"t{i}") for i in range(0, 300, 20)] + [(280, "again")], "artifact_id int, title string")
    held, write = [], library.written
    monkeypatch.setattr(library, "written", lambda df, name: held.append(write(df, name)) or held[-1])
    got = library.runs_with_artifacts(runs, artifacts, 25).collect()
    assert held[0].count() == 25 and len(got) == 25
    assert [(r.run_id, r.title) for r in got if r.run_id != "r280"] == [(f"r{i:03}", None) for i in range(299, 275, -1) if i != 280]
    assert sorted(r.title for r in got if r.run_id == "r280") == ["again", "t280"]

"""Golden sets, labelled cases and reviews: shapes of lines, nulls, empty tables, clashing names."""

from pyspark.sql import functions as F

from litsieve import sinks
from litsieve.operators import claims, evaluation

LINES = [
    (1, '{"query": " a b ", "relevant": {"1": 2, "2": "high", "9": 1}, "source": "manual", "tags": ["x"]}'), (2, '{"query": "c", "relevant": ["1", "1", 3]}'), (3, '{"query": "none"}'),
    (4, '{"query": "control", "expect_no_relevant": true, "source": "robot"}'), (5, '{"query": "odd", "relevant": ["1"], "source": "robot"}'), (6, "# remark"), (7, "  "), (8, None), (9, "{broken"), (10, '{"relevant": ["1"]}'),
]


def test_golden_sets(spark, tmp_path):
    cases = evaluation.golden_cases(spark.createDataFrame([(n, line, "z") for n, line in LINES], "line int, value string, `a.b` string"))
    got = {r.line: r for r in cases.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 9, 10] and [n for n in got if got[n].broken] == [9, 10] and got[1]["a.b"] == "z"
    assert (got[1].query, got[1].relevant, got[1].tags) == ("a b", {"1": 2.0, "2": 1.0, "9": 1.0}, ["x"]) and got[2].relevant == {"1": 1.0, "3": 1.0} and got[3].relevant == {}
    corpus = spark.createDataFrame([("1", "t"), ("2", " "), ("3", None), ("3", None)], "doc string, title string")
    found = sorted((r.kind, r["at"], r.detail) for r in evaluation.set_problems(cases, corpus, "line").collect())
    assert found == [("broken", "10", ""), ("broken", "9", ""), ("no_labels", "3", "none"), ("no_title", "2", ""), ("no_title", "3", ""), ("no_title", "3", ""), ("unknown_docs", "1", "9"), ("unknown_source", "5", "robot")]
    nothing = evaluation.set_problems(cases.where("false"), corpus.where("false"), "line")
    assert sorted(r.kind for r in nothing.collect()) == ["empty_corpus", "no_cases"]
    papers = spark.createDataFrame([("1", "t", None, [], 0, False, "x"), ("2", "", "a", ["k"], 3, True, "x")], "doc string, title string, abstract string, keywords array<string>, cited_by_count int, is_open_access boolean, other string")
    sinks.export_golden(cases.where("not broken"), papers, str(tmp_path))
    again = {r.query: r for r in evaluation.golden_cases(spark.read.text(f"{tmp_path}/golden")).collect()}
    assert all(again[r.query].relevant == r.relevant and again[r.query].expect_no_relevant == r.expect_no_relevant for r in got.values() if not r.broken)
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/corpus").collect()) == ['{"doc":"1","title":"t"}', '{"doc":"2","abstract":"a","keywords":["k"],"is_open_access":true,"cited_by_count":3}']


def test_rule_quality(spark):
    rows = [(1, "supported", "supported", [], None), (2, "supported", "unsupported", ["grounding"], None), (3, "unsupported", "unsupported", ["numbers"], "numbers"), (4, "overclaim", "supported", [], "overclaim"), (5, "unverifiable", "weakly_supported", [], "")]
    judged = spark.createDataFrame([(*r, "text " * 40) for r in rows], "claim_id int, gold string, predicted string, rules array<string>, expected_rule string, claim string")
    kinds = {r.verdict: (r.support, r.predicted, r.hits, r.precision, r.recall) for r in evaluation.per_class(judged).collect()}
    assert kinds == {"supported": (2, 2, 1, 0.5, 0.5), "weakly_supported": (0, 1, 0, 0.0, 0.0), "unverifiable": (1, 0, 0, 0.0, 0.0), "unsupported": (1, 2, 1, 0.5, 1.0), "overclaim": (1, 0, 0, 0.0, 0.0), "contradicted": (0, 0, 0, 0.0, 0.0)}
    row = evaluation.binary(judged).first()
    assert (row.tp, row.fp, row.tn, row.fn, row.verdict_match, row.rule_total, row.rule_hit) == (1, 1, 2, 1, 2, 2, 1) and (row.precision, row.recall, row.accuracy, row.rule_hit_rate) == (0.5, 0.5, 0.6, 0.5)
    assert {(r.claim_id, r.false_alarm, len(r.claim)) for r in evaluation.failures(judged).collect()} == {(2, True, 80), (4, False, 80), (5, False, 80)}
    none = evaluation.binary(judged.where("false")).first()
    assert (none.total, none.precision, none.accuracy, none.rule_hit_rate) == (0, 0.0, 0.0, 0.0)
    checked = judged.withColumn("draft_id", F.expr("claim_id div 4"))
    assert {r.draft_id: r.by_rule for r in claims.rule_counts(checked).collect()} == {0: {"grounding": 1, "numbers": 1}, 1: {}}


def test_checklist_and_gaps(spark):
    reviews = spark.createDataFrame([("a", 5), ("b", 0), ("c", None)], "review_id string, identified int")
    covered = spark.createDataFrame([("a", "6"), ("a", "6"), ("b", "1"), ("a", "99"), (None, "1")], "review_id string, code string")
    got = {(r.review_id, r.code): r.status for r in evaluation.checklist(reviews, covered).collect()}
    assert len(got) == 105 and got["a", "6"] == "done" and got["a", "7"] == "auto" and got["a", "1"] == "manual" and got["b", "1"] == "done" and got["b", "7"] == got["c", "7"] == "manual"
    use = [("a", "动物实验", "样本量偏小（n=9）", True)] * 2 + [("a", "RCT", "", False), ("b", "RCT", None, True), ("b", "其他", None, True), ("c", "RCT", "", False), ("d", "RCT", "", True)] + [("d", "Meta分析/系统评价", "", True)] * 4
    made = evaluation.gaps(spark.createDataFrame(use, "run string, evidence_level string, limitation string, use_in_review boolean"), "run")
    assert {r.run: r.missing for r in made.collect()} == {"a": ["no_high_level", "few_usable", "animals_only", "small_samples"], "b": ["few_high_level", "few_usable", "unclear_designs"], "c": ["nothing_usable"], "d": []}


def test_hashing_embedding_against_plain_python(spark):
    """Words weigh 1, their character pairs 0.5; places by xxHash64 with Spark's seed."""
    import math

    import xxhash

    from litsieve.operators import retrieval

    texts = {1: "Alpha beta alpha x", 2: "Über naïve 12", 3: "one-two one"}
    words = {1: ["alpha", "beta", "alpha", "x"], 2: ["uber", "naive", "12"], 3: ["one", "two", "one"]}
    got = {r.id: r.vector for r in retrieval.hashing_embedding(spark.createDataFrame(list(texts.items()), "id int, t string"), "id", "t").collect()}
    for key, found in words.items():
        want = [0.0] * 256
        for w in found:
            for term, weight in [(w, 1.0), *((w[i : i + 2], 0.5) for i in range(max(len(w) - 1, 1)))]:
                want[xxhash.xxh64_intdigest(term.encode(), seed=42) % 256] += weight
        norm = math.sqrt(sum(x * x for x in want))
        assert all(abs(a - b / norm) < 1e-9 for a, b in zip(got[key], want, strict=True)), key


def test_searches_over_sources(spark):
    from litsieve.sources import records

    kinds = "query_id string, source string, rank int, pmid string, doi string, title string, abstract string, pub_year int, cited_by_count int, is_open_access boolean"
    rows = [("q", "b", 1, "1", None, "T one", None, 2000, 1, False), ("q", "a", 1, None, "10/x", "Two", "abs", 2001, 5, True), ("q", "a", 2, None, "10/x", "Two longer", None, None, 7, None), ("q", "a", 3, "3", None, "late", None, 2002, 0, False), ("r", "z", 1, "1", None, "T one", None, 2000, 1, False)]
    results = spark.createDataFrame(rows, kinds)
    got = [(r.query_id, r.place, r.title, r.merged, r.cited_by_count) for r in records.merged_search(results, ["b", "a"], 2, 5).orderBy("query_id", "place").collect()]
    assert got == [("q", 1, "T one", 1, 1), ("q", 2, "Two longer", 2, 7), ("r", 1, "T one", 1, 1)]
    assert [r.title for r in records.merged_search(results.where("query_id = 'q'"), ["a"], 3, 1).orderBy("place").collect()] == ["Two longer", "late"]
    queries = spark.createDataFrame([("q",), ("none",)], "query_id string")
    errors = spark.createDataFrame([("q", "c", "timeout")], "query_id string, source string, error string")
    status = {(r.query_id, r.source): (r.ok, r.found, r.raw_count, r.merged_count) for r in records.search_status(queries, results, errors, ["b", "a", "c"], 2, 5).collect()}
    assert status == {("q", "b"): (True, 1, 3, 2), ("q", "a"): (True, 2, 3, 2), ("q", "c"): (False, 0, 3, 2), ("none", "b"): (True, 0, 0, 0), ("none", "a"): (True, 0, 0, 0), ("none", "c"): (True, 0, 0, 0)}
    assert records.merged_search(results.where("false"), ["a"], 2, 5).count() == 0

"""Positional index, query forms, phrases and pruning."""

import random

import pytest
from pyspark.sql import functions as F

from litsieve.operators import lexical, retrieval


def zipf_docs(spark, n=400, seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(600)]
    weights = [1 / (i + 1) for i in range(600)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(3, 6))), " ".join(rng.choices(words, weights, k=rng.randrange(0, 120)))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, title string, abstract string")


def test_forms(spark):
    queries = spark.createDataFrame([(1, "加速rTMS治疗卒中"), (2, 'COVID-19 "risk" risk'), (3, " "), (4, None), (5, "抑 郁"), (6, "— ?"), (7, "alone")], "query_id long, query string")
    got = {}
    for r in lexical.forms(queries).collect():
        got.setdefault((r.query_id, r.form), {})[r.unit] = (r.times, r.needs)
    assert got[1, "phrase"] == {"加 速": (1, 3), "rtms": (1, 3), "治 疗 卒 中": (1, 3)}
    assert got[1, "bigram"] == {u: (1, 5) for u in ("加 速", "rtms", "治 疗", "疗 卒", "卒 中")} and got[1, "or"] == {u: (1, 0) for u in got[1, "bigram"]}
    assert got[2, "phrase"] == {"covid 19": (1, 2), "risk": (2, 2)} and (2, "bigram") not in got and got[2, "or"]["risk"] == (2, 0)
    assert got[5, "phrase"] == {"抑 郁": (1, 1)} and (5, "or") not in got and set(got) >= {(7, "phrase")} and (7, "or") not in got
    assert not [k for k in got if k[0] in (3, 4, 6)]


def test_phrases_by_position(spark):
    rows = [(1, "covid 19 in lungs", "x"), (2, "19 covid", "covid and 19"), (3, "ends with covid", "19 begins"), (4, "ha ha", "ha ha ha"), (5, None, "Covid-19, covid 19!"), (6, None, None)]
    index = lexical.build(spark.createDataFrame(rows, "id long, title string, abstract string"), "id", {"title": 8.0, "abstract": 1.0})
    assert index.n_docs == 5
    units = spark.createDataFrame([("covid 19",), ("ha ha",), ("covid 20",), ("in lungs",)], "unit string")
    got = {(r.unit, r.id): r for r in lexical.phrase_hits(index, units).collect()}
    assert set(got) == {("covid 19", 1), ("covid 19", 5), ("ha ha", 4), ("in lungs", 1)}
    impact = lambda f, size: f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / index.mean_size))
    assert abs(got["ha ha", 4].impact - impact(8 + 2, 5)) < 1e-9 and abs(got["covid 19", 5].impact - impact(2, 4)) < 1e-9


def test_pruned_equals_whole(spark):
    rows, docs = zipf_docs(spark)
    rng = random.Random(9)
    asked = [(q, " ".join(rng.sample(rows[q * 7][2].split() or ["w1"], min(8, len(rows[q * 7][2].split()) or 1)) + ["w0", "w1", "w2"])) for q in range(30)] + [(90, "nowhere"), (91, "w0")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    index = lexical.build(docs, "id", {"title": 8.0, "abstract": 1.0})
    units = queries.select("query_id", F.explode(F.array_distinct(lexical.word_tokens(F.col("query")))).alias("unit"))
    hits, bounds = lexical.hits_of(index, units.select("unit").distinct())
    held = bounds.groupBy("unit").agg(F.sum("held").alias("held"))
    wanted = units.join(held, "unit").withColumn("w", lexical.idf(index, F.col("held"))).select("query_id", "unit", "w")
    want = retrieval.top_k(retrieval.bm25(retrieval.postings(docs, "id", {"title": 8.0, "abstract": 1.0}), queries), 5)
    key = lambda df: sorted((r.query_id, r.rank, r.id, round(r.score, 5)) for r in df.collect())
    for seeds in (1, 50, 10_000):
        assert key(lexical.top_any(hits, bounds, wanted, 5, seeds)) == key(want)
    read = lexical.essential(hits, bounds, wanted, 5, 50).agg(F.sum("held").alias("all"), F.sum(F.when(F.col("open"), F.col("held"))).alias("open")).first()
    assert read["open"] < read["all"] / 2  # the common words' postings stay closed


def test_search_keeps_the_best_form(spark):
    rows = [(1, "治疗卒中后抑郁", ""), (2, "治疗和卒中，后来抑郁", ""), (3, "抑郁", "治疗"), (4, "rTMS", ""), (5, "rTMS 治疗", "")] + [(10 + i, f"其他文本{i}", "filler") for i in range(20)]
    index = lexical.build(spark.createDataFrame(rows, "id long, title string, abstract string"), "id", {"title": 8.0, "abstract": 1.0})
    queries = spark.createDataFrame([(1, "治疗卒中后抑郁"), (2, "rTMS治疗"), (3, None)], "query_id long, query string")
    got = {(r.query_id, r.id): r for r in lexical.search(index, queries, 10).collect()}
    assert got[1, 1].forms == "bigram+or+phrase" and got[1, 1].rank == 1 and got[1, 2].forms == "or" and {i for q, i in got if q == 1} == {1, 2, 3, 5}
    assert got[2, 5].rank == 1 and got[2, 5].forms == "or+phrase" and got[2, 4].forms == "or" and not [k for k in got if k[0] == 3]
    assert lexical.search(lexical.build(spark.createDataFrame([], "id long, title string"), "id", {"title": 8.0}), queries, 3).count() == 0


def test_postings_are_met_where_they_lie(spark):
    rows, docs = zipf_docs(spark, 60)
    units = spark.createDataFrame([("w0",), ("w5",)], "unit string")
    index, bare = (lexical.build(docs, "id", {"title": 8.0, "abstract": 1.0}, positions=p) for p in (True, False))
    for own in (index, bare):
        hits, bounds = lexical.hits_of(own, units)
        plan = hits._jdf.queryExecution().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert bounds.agg(F.sum("held")).first()[0] == hits.count() == sum(u in (r[1] + " " + r[2]).split() for r in rows for u in ("w0", "w5"))
    assert sorted(map(tuple, bounds.collect())) == sorted(map(tuple, lexical.hits_of(index, units)[1].collect()))
    with pytest.raises(ValueError):
        lexical.hits_of(bare, spark.createDataFrame([("w0 w1",)], "unit string"))


def test_phrases_are_found_where_the_texts_lie(spark):
    """Long runs of few signs: no posting is dealt to the phrases that share its term."""
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("甲乙丙 ", k=rng.randrange(0, 60))), " ".join(rng.choices(["a", "b", "甲乙"], k=8)) if i % 3 else None) for i in range(80)]
    index = lexical.build(spark.createDataFrame(rows, "id long, title string, abstract string"), "id", {"title": 8.0, "abstract": 1.0})
    units = ["甲 乙", "乙 甲 丙", "甲 甲 甲 甲", "b 甲 乙 a", "丙 a"] + [" ".join(rows[i][1].replace(" ", "")) for i in range(10) if len(rows[i][1].replace(" ", "")) > 1]
    hits = lexical.phrase_hits(index, spark.createDataFrame([(u,) for u in units], "unit string"))
    want = {}
    for i, *fields in rows:
        lines = [" ".join(list(t) if f == 0 else t.replace("甲乙", "甲 乙").split()) for f, t in enumerate(["" if x is None else x.replace(" ", "") if f == 0 else x for f, x in enumerate(fields)])]
        size = sum(len(line.split()) for line in lines)
        for u in set(units):
            wtf = sum(w * sum(f" {line} "[at:].startswith(f" {u} ") for at in range(len(line) + 1)) for w, line in zip((8.0, 1.0), lines, strict=True))
            if wtf:
                want[u, i] = round(wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * size / index.mean_size)), 9)
    assert {(r.unit, r.id): round(r.impact, 9) for r in hits.collect()} == want and len(want) > 100
    assert "Exchange hashpartitioning" not in hits._jdf.queryExecution().toString()
    queries = spark.createDataFrame([(i, rows[i][1]) for i in range(10)] + [(20, "a b 甲乙")], "query_id long, query string")
    many = lexical.search(index, queries, 7).collect()
    lexical.QUERY_BLOCK, lexical.MATCH_BLOCK, kept = 3, 4, (lexical.QUERY_BLOCK, lexical.MATCH_BLOCK)
    try:
        assert sorted(lexical.search(index, queries, 7).collect()) == sorted(many)
    finally:
        lexical.QUERY_BLOCK, lexical.MATCH_BLOCK = kept

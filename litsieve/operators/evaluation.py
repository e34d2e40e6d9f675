"""Golden sets for searches and labelled cases for the claim rules: reading, checks of a set, and what rules reach on it.

A golden set is JSON lines, one query each; every operator works on the lines, the cases or the exploded labels as tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.operators.claims import SEVERITY, check

# Where a query may come from, verdicts that report a problem, checklist codes and those that a flow fills in.
QUERY_SOURCES = ["known-item", "llm-question", "manual"]
PROBLEMS = ["unsupported", "overclaim", "contradicted"]
CHECKLIST = (
    "1 2 3 4 5 6 7 8 9 10a 10b 11 12 13a 13b 13c 14 15 16a 16b 17 18 19 20a 20b 21 22 23a 23b 24a 24b 24c 25 26 27"
).split()
FILLED_BY_FLOW = ["6", "7", "16a", "16b", "17", "24a"]
CASE = "query string, notes string, source string, tags array<string>, expect_no_relevant boolean"


def golden_cases(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines as cases with relevant as map<string, double>; `lines` may carry more columns, such as a line number.

    relevant may be a map of ids to grades, or a list of ids (each 1.0); grades that are no numbers count 1.0. Blank lines
    and those that begin with # are left out. Lines that are no JSON objects or have no query come out with `broken` set.
    """
    line = F.trim(F.col(column))
    rows = lines.where((F.coalesce(line, F.lit("")) != "") & ~F.startswith(line, F.lit("#")))
    raw = F.get_json_object(column, "$.relevant")
    grades = F.from_json(raw, "map<string, string>")
    graded = F.map_from_entries(F.transform(F.map_entries(grades), lambda e: F.struct(e["key"], F.coalesce(e["value"].try_cast("double"), F.lit(1.0)))))
    ids = F.array_distinct(F.from_json(raw, "array<string>"))
    listed = F.map_from_arrays(ids, F.transform(ids, lambda _: F.lit(1.0)))
    relevant = F.when(F.startswith(raw, F.lit("{")), graded).when(F.startswith(raw, F.lit("[")), listed)
    kept = [F.col(f"`{c}`") for c in lines.columns if c != column]
    made = rows.select(*kept, F.from_json(column, CASE).alias("_case"), F.coalesce(relevant, F.create_map().cast("map<string, double>")).alias("relevant"))
    text = lambda c: F.coalesce(F.trim(F.col(f"_case.{c}")), F.lit("")).alias(c)
    tags, none = F.coalesce("_case.tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("_case.expect_no_relevant", F.lit(False)).alias("expect_no_relevant")
    return made.select(*kept, text("query"), "relevant", text("notes"), text("source"), tags, none).withColumn("broken", F.col("query") == "")


def qrels(cases: DataFrame, key: str) -> DataFrame:
    """(key, doc, gain) of the cases, one row a label."""
    return cases.where("not broken").select(key, F.explode("relevant").alias("doc", "gain"))


def set_problems(cases: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """(kind, at, detail): what is wrong with a golden set. corpus: (doc string, title).

    Broken cases; cases without labels that are not declared to have none; labels of unknown documents; sources that no
    query may have; documents without a title; an empty corpus; no cases. A declared case without labels is no problem,
    whatever else it holds.
    """
    at = F.col(key).cast("string").alias("at")
    row = lambda df, kind, detail: df.select(F.lit(kind).alias("kind"), at, detail.alias("detail"))
    whole = cases.where("not broken")
    labelled = whole.where(F.size("relevant") > 0)
    unknown = qrels(whole, key).join(corpus.select("doc").distinct().hint("merge"), "doc", "left_anti").groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("doc")), ",").alias("docs"))
    strange = labelled.where((F.col("source") != "") & ~F.col("source").isin(QUERY_SOURCES))
    untitled = corpus.where(F.trim(F.coalesce("title", F.lit(""))) == "").select(F.lit("no_title").alias("kind"), F.col("doc").alias("at"), F.lit("").alias("detail"))
    empty = lambda df, kind: df.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(kind).alias("kind"), F.lit("").alias("at"), F.lit("").alias("detail"))
    parts = [
        row(cases.where("broken"), "broken", F.lit("")), row(whole.where((F.size("relevant") == 0) & ~F.col("expect_no_relevant")), "no_labels", F.substring("query", 1, 24)),
        row(unknown, "unknown_docs", F.col("docs")), row(strange, "unknown_source", F.col("source")), untitled, empty(corpus, "empty_corpus"), empty(cases, "no_cases"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def judged_cases(cases: DataFrame, sources: DataFrame, min_overlap: float = 0.34) -> DataFrame:
    """cases (claim_id, draft_id, section, claim, citations, gold, expected_rule) with predicted verdict and the rules that objected."""
    found = check(cases.select("claim_id", "draft_id", "section", "claim", "citations"), sources, min_overlap)
    return cases.select("claim_id", "claim", "gold", "expected_rule").join(found.select("claim_id", "rules", F.col("verdict").alias("predicted")).hint("merge"), "claim_id")


def per_class(judged: DataFrame) -> DataFrame:
    """A row per verdict of the fixed list: support, predicted, hits, precision, recall (0 where nothing is to be divided)."""
    one = lambda verdict, g, p, h: F.struct(verdict.alias("verdict"), g.alias("g"), p.alias("p"), h.alias("h"))
    hit = (F.col("gold") == F.col("predicted")).cast("int")
    kinds = judged.select(F.inline(F.array(one(F.col("gold"), F.lit(1), F.lit(0), F.lit(0)), one(F.col("predicted"), F.lit(0), F.lit(1), hit))))
    sums = kinds.groupBy("verdict").agg(F.sum("g").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("hits"))
    every = judged.sparkSession.createDataFrame([(v,) for v in SEVERITY], "verdict string")
    rate = lambda of: F.round(F.when(F.col(of) > 0, F.col("hits") / F.col(of)).otherwise(0.0), 4)
    counts = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("support", "predicted", "hits")}
    return every.join(sums.hint("merge"), "verdict", "left").withColumns(counts).withColumns({"precision": rate("predicted"), "recall": rate("support")})


def binary(judged: DataFrame) -> DataFrame:
    """One row: is there a problem or none. Counts, precision, recall, accuracy, verdicts that match, and the share of expected rules that objected."""
    gold, told = F.col("gold").isin(PROBLEMS), F.col("predicted").isin(PROBLEMS)
    rule = F.col("expected_rule").isNotNull() & (F.col("expected_rule") != "")
    made = judged.agg(
        F.count_if(gold & told).alias("tp"), F.count_if(~gold & told).alias("fp"), F.count_if(~gold & ~told).alias("tn"), F.count_if(gold & ~told).alias("fn"), F.count("*").alias("total"),
        F.count_if(F.col("gold") == F.col("predicted")).alias("verdict_match"), F.count_if(rule).alias("rule_total"), F.count_if(rule & F.array_contains("rules", F.col("expected_rule"))).alias("rule_hit"),
    )
    rate = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 4)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return made.withColumns({"precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "accuracy": rate(tp + tn, tp + fp + tn + fn), "rule_hit_rate": rate(F.col("rule_hit"), F.col("rule_total"))})


def failures(judged: DataFrame) -> DataFrame:
    """Cases whose verdict is not the labelled one; false_alarm marks those labelled as supported."""
    rows = judged.where("gold <> predicted")
    return rows.select("claim_id", "gold", "predicted", "expected_rule", "rules", F.substring("claim", 1, 80).alias("claim"), (F.col("gold") == "supported").alias("false_alarm"))


def checklist(reviews: DataFrame, covered: DataFrame, codes: list[str] = CHECKLIST) -> DataFrame:
    """(review_id, code, status) for each review and code: done if covered (review_id, code), auto if its flow has records and fills the code, else manual."""
    rows = reviews.select("review_id", "identified", F.explode(F.array(*map(F.lit, codes))).alias("code"))
    done = covered.select("review_id", "code", F.lit(True).alias("_done")).distinct()
    joined = rows.join(done.hint("merge"), ["review_id", "code"], "left")
    status = F.when(F.col("_done"), "done").when(F.col("code").isin(FILLED_BY_FLOW) & (F.col("identified") > 0), "auto").otherwise("manual")
    return joined.select("review_id", "code", status.alias("status"))


def gaps(assessed: DataFrame, run: str) -> DataFrame:
    """Per run: papers in use, high-level and unclear designs, small samples, and what is missing. assessed: as assessment.assess gives it."""
    use = F.col("use_in_review")
    of = lambda c: F.count_if(use & c)
    made = assessed.groupBy(run).agg(
        of(F.lit(True)).alias("usable"), of(F.col("evidence_level").isin("RCT", "Meta分析/系统评价")).alias("high"), of(F.col("evidence_level") == "动物实验").alias("animal"),
        of(F.contains(F.coalesce("limitation", F.lit("")), F.lit("样本量偏小"))).alias("small"), of(F.col("evidence_level") == "其他").alias("unclear"),
    )
    usable, high, half = F.col("usable"), F.col("high"), F.floor(F.col("usable") / 2)
    some = usable > 0
    missing: list[Column] = [
        F.when(~some, "nothing_usable"), F.when(some & (high == 0), "no_high_level"), F.when(some & (high > 0) & (high < 3), "few_high_level"), F.when(some & (usable < 5), "few_usable"),
        F.when(some & (F.col("animal") == usable), "animals_only"), F.when((F.col("small") > 0) & (F.col("small") >= F.greatest(F.lit(2), half)), "small_samples"), F.when((F.col("unclear") > 0) & (F.col("unclear") >= half), "unclear_designs"),
    ]
    return made.withColumn("missing", F.array_compact(F.array(*missing)))

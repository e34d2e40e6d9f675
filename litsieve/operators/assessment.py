"""Rule-based assessment of papers for a topic: quality, relevance, limitation, key sentence, and whether to use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.functions.rules import design_score, evidence_level, sample_size

# Steps of sample size, citations and age with what they add, words that a topic leaves out, marks before a conclusion.
SAMPLES = [(1000, 1.2), (300, 0.8), (100, 0.4)]
CITED = [(500, 1.2), (100, 0.8), (30, 0.4)]
SMALL_SAMPLE, NOT_CITED, RECENT, OLD, NO_ABSTRACT = (30, -0.8), -0.3, (3, 0.5), (12, -0.6), -1.2
BASE, RANGE, BONUS, LEAST_USE, MOST = 3.0, 7.0, 0.8, 4.0, 10.0
STOPS = """the and for with from into that this are was were its their study trial effect effects analysis patients results conclusion objective methods background
研究 方法 结果 结论 目的 疗效 观察 分析 治疗""".split()
MARKERS = ["结论：", "结论:", "CONCLUSION:", "Conclusion:", "结果：", "结果:"]


def held(value: Column) -> Column:
    """Within 0 and 10, to one place; half up, as all rounding here."""
    return F.round(F.round(F.greatest(F.lit(0.0), F.least(F.lit(MOST), value)), 6), 1)


def steps(value: Column, ladder: list[tuple[int, float]], rest: Column) -> Column:
    out = F
    for least, add in ladder:
        out = out.when(value >= least, F.lit(add))
    return out.otherwise(rest)


def topic_terms(topic: Column) -> Column:
    """Latin words of three letters and more and runs of Chinese characters, each once, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(topic, F.lit(""))), F.lit("[a-z][a-z\\-]{2,}|[\\x{4e00}-\\x{9fff}]{2,}"), 0)
    return F.array_except(found, F.array(*(F.lit(w) for w in STOPS)))


def quality(level: Column, sample: Column, cited: Column, age: Column, blank: Column) -> Column:
    by_sample = F.when(sample.isNull(), 0.0).otherwise(steps(sample, SAMPLES, F.when(sample < SMALL_SAMPLE[0], SMALL_SAMPLE[1]).otherwise(0.0)))
    by_cited = steps(cited, CITED, F.when(cited == 0, NOT_CITED).otherwise(0.0))
    by_age = F.when(age <= RECENT[0], RECENT[1]).when(age >= OLD[0], OLD[1]).otherwise(0.0)
    return held(design_score(level) + by_sample + by_cited + by_age + F.when(blank, NO_ABSTRACT).otherwise(0.0))


def relevance(terms: Column, title: Column, body: Column, blank: Column) -> Column:
    """Share of the terms that the title (twice) and the abstract or keywords hold; without an abstract drawn to 6."""
    n, in_title = F.size(terms), F.size(F.filter(terms, lambda t: F.contains(title, t)))
    coverage = F.least(F.lit(1.0), (in_title * 2.0 + F.size(F.filter(terms, lambda t: F.contains(body, t)))) / (F.greatest(n, F.lit(1)) * 2.0))
    score = BASE + coverage * RANGE
    score = held(F.when((in_title > 0) & (coverage >= 0.5), F.least(F.lit(MOST), score + BONUS)).otherwise(score))
    score = F.when(n == 0, 6.0).otherwise(score)
    return F.when(blank, F.round(F.round(score * 0.7 + 6.0 * 0.3, 6), 1)).otherwise(score)


def key_sentence(abstract: Column, limit: int = 80) -> Column:
    """The sentence after the first mark of a conclusion that has one, else the first; cut, with a full stop."""
    text = F.regexp_replace(F.coalesce(abstract, F.lit("")), "\n", " ")
    first = lambda t: F.regexp_extract(F.trim(t), "^(.*?[。.!?]|.*$)", 1)
    after = [F.when(F.contains(text, F.lit(m)), F.nullif(first(F.substr(text, F.instr(text, m) + len(m))), F.lit(""))) for m in MARKERS]
    sentence = F.coalesce(*after, first(text))
    return F.when(sentence == "", "").otherwise(F.concat(F.regexp_replace(F.substring(sentence, 1, limit), "[。. ]+$", ""), F.lit("。")))


def assess(papers: DataFrame, topic: Column, year: int) -> DataFrame:
    """papers with evidence_level, quality, relevance, limitation, key_finding and use_in_review; `topic` may be a column."""
    some = lambda c: F.coalesce(F.col(c), F.lit("")) if c in papers.columns else F.lit("")
    lists = [F.array_join(c, " ") for c in ("keywords", "mesh_terms") if c in papers.columns]
    level, sample = evidence_level(F.col("title"), F.col("abstract"), some("publication_type")), sample_size(F.col("title"), F.col("abstract"))
    df = papers.withColumns({"evidence_level": level, "_sample": sample, "_cited": F.coalesce("cited_by_count", F.lit(0)), "_blank": F.trim(some("abstract")) == "", "_terms": topic_terms(topic)})
    age = F.when(F.coalesce("pub_year", F.lit(0)) != 0, F.lit(year) - F.col("pub_year"))
    limitation = (
        F.when(F.col("_sample") < SMALL_SAMPLE[0], F.concat(F.lit("样本量偏小（n="), F.col("_sample").cast("string"), F.lit("）"))).when(F.col("evidence_level") == "动物实验", "动物实验，外推至临床需谨慎")
        .when(F.col("evidence_level").isin("病例报告", "横断面"), "设计证据等级较低，难以推断因果").when(F.col("_blank"), "缺少摘要，无法评估方法学细节").when((F.col("_cited") == 0) & (F.coalesce(age, F.lit(0)) >= 1), "尚无被引记录").otherwise("")
    )
    body = F.lower(F.concat_ws(" ", some("abstract"), *lists))
    df = df.withColumns({
        "quality": quality(F.col("evidence_level"), F.col("_sample"), F.col("_cited"), age, F.col("_blank")), "relevance": relevance(F.col("_terms"), F.lower(some("title")), body, F.col("_blank")),
        "limitation": limitation, "key_finding": key_sentence(F.col("abstract")),
    })
    return df.withColumn("use_in_review", F.col("relevance") >= LEAST_USE).drop("_sample", "_cited", "_blank", "_terms")

"""Claims in drafts, checked against their cited sources.

A draft is cut into lines and sentences once; all rules are columns over that frame. Work is dealt by sentence, not by
draft, except the carrying forward of headings, which is a window within a draft.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litsieve.store import written

# Patterns of citations, references, headings, sentences, numbers and words.
CITATION = r"[\[【]\s*(\d{1,3}(?:\s*[,，\-–]\s*\d{1,3})*)\s*[\]】]"
REF_LINE = r"^\s*[\[【]\d{1,3}[\]】]\s+\S"
REF_HEADING = r"^#{1,4}\s*(参考文献|References|REFERENCES|文献列表)\s*$"
SENTENCE = r"[^。！？!?；;\n]+[。！？!?；;]?"
NUMBER = r"(?<![\w.\[])(\d+(?:\.\d+)?\s*(?:%|‰)?)(?![\w\]])"
TOKEN = r"[A-Za-z][A-Za-z\-]{2,}|[\x{4e00}-\x{9fff}]{2,}"
# Cue words and words without content.
STRONG = (
    "证实 证明 治愈 根治 完全 彻底 显著优于 明显优于 优于 必然 毫无疑问 突破性 首次证明 确凿 prove proves proven cure cures breakthrough conclusively".split()
    + ["significantly better", "superior to", "definitively"]
)
NULL_RESULT = "无显著差异 无统计学意义 未见显著 没有显著 差异无统计学意义 未达到统计学意义 不优于 未优于 与安慰剂相当 无差异".split() + [
    "no significant difference", "no significant", "not significant", "did not differ", "no difference", "failed to show", "no benefit", "not superior", "comparable to placebo", "no significant improvement",
]
WEAK = ["protocol", "study protocol", "研究方案", "preprint", "预印本", "biorxiv", "medrxiv", "case report", "病例报告", "pilot study", "初步", "会议摘要", "abstract only", "研究计划", "尚未", "正在进行"]
WEAK_TYPES = ["preprint", "protocol", "case-report"]
STOP_WORDS = (
    "的 了 和 与 及 或 在 是 为 对 中 上 下 有 无 不 也 都 而 但 并 等 这 那 其 之 从 到 本 该 这些 那些 我们 研究 结果 显示 表明 提示 提示了 可能 可以 需 要 应 通过 进行 "
    "the a an and or of in on at to for with by is are was were be been this that these those we our study results result show shows showed suggest suggests may can could should"
).split()
FUNCTION_SIGNS = "的了和与及或在是为对中上下有无不也都而但并等这那其之从到本该"
SEVERITY = {"supported": 0, "weakly_supported": 0, "unverifiable": 1, "unsupported": 1, "overclaim": 2, "contradicted": 3}


def citations_of(text: Column, max_span: int = 20) -> Column:
    """Sorted distinct numbers in citation marks; ranges of more than max_span are left out."""
    groups = F.regexp_extract_all(text, F.lit(CITATION), 1)
    tokens = F.flatten(F.transform(groups, lambda g: F.split(g, "[,，]")))

    def numbers(token: Column) -> Column:
        ends = F.split(F.regexp_replace(token, r"\s", ""), "[-–]")
        low, high = F.try_element_at(ends, F.lit(1)).cast("int"), F.try_element_at(ends, F.lit(2)).cast("int")
        whole = F.when((low > 0) & (low <= high) & (high <= low + max_span), F.sequence(low, F.least(high, low + max_span)))
        return F.when(F.size(ends) == 1, F.array(low)).otherwise(F.coalesce(whole, F.array().cast("array<int>")))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(tokens, numbers))))


def sanitized(text: Column, valid: Column) -> Column:
    """text with only the valid numbers (array<int>) left in its citation marks, ranges written out, and empty marks gone."""
    body = F.coalesce(text, F.lit(""))

    def numbers(token: Column) -> Column:
        ends = F.split(F.regexp_replace(token, r"\s", ""), "[-–]")
        low, high = F.try_element_at(ends, F.lit(1)).cast("int"), F.try_element_at(ends, F.lit(2)).cast("int")
        every = F.when(F.size(ends) == 1, F.array(low)).when((F.size(ends) == 2) & (low <= high), F.sequence(low, F.greatest(low, high)))
        return F.filter(F.coalesce(every, F.array().cast("array<int>")), lambda n: F.array_contains(valid, n))

    def mark(group: Column) -> Column:
        kept = F.flatten(F.transform(F.split(group, "[,，]"), numbers))
        return F.when(F.size(kept) > 0, F.concat(F.lit("["), F.array_join(kept.cast("array<string>"), ","), F.lit("]"))).otherwise("")

    marks = F.transform(F.regexp_extract_all(body, F.lit(CITATION), 1), mark)
    joined = F.array_join(F.zip_with(F.split(body, CITATION, -1), marks, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    joined = F.regexp_replace(F.regexp_replace(joined, r"\s+([，。；、）])", "$1"), r"\(\s*\)", "")
    return F.regexp_replace(joined, r"^\s+|\s+$", "")


def citation_check(drafts: DataFrame) -> DataFrame:
    """drafts (draft_id, draft, valid array<int>): distinct numbers cited, those missing from the list, and those never cited."""
    made = drafts.select("draft_id", F.array_sort(F.array_distinct("valid")).alias("valid"), citations_of(F.col("draft")).alias("cited"))
    missing, never = F.array_except("cited", "valid"), F.array_except("valid", "cited")
    return made.select("draft_id", "cited", missing.alias("missing"), never.alias("never_cited"), (F.size(missing) == 0).alias("ok"))


def cited_entries(entries: DataFrame, drafts: DataFrame) -> DataFrame:
    """entries (draft_id, number, ...) that their draft cites, under their numbers; all of a draft that cites none of them."""
    marks = drafts.select("draft_id", citations_of(F.col("draft")).alias("_cited"))
    hit = F.coalesce(F.array_contains("_cited", F.col("number")), F.lit(False))
    joined = entries.join(marks.hint("merge"), "draft_id", "left").withColumn("_hit", hit)
    return joined.withColumn("_any", F.max("_hit").over(Window.partitionBy("draft_id"))).where("_hit or not _any").drop("_cited", "_hit", "_any")


def sentences(drafts: DataFrame, least: int = 8) -> DataFrame:
    """draft_id, line, place, section, sentence, citations; without headings, reference lists and short sentences."""
    lines = drafts.select("draft_id", F.posexplode(F.split("draft", "\n")).alias("line", "raw"))
    bare = F.trim("raw")
    is_refs, is_heading = F.rlike(bare, F.lit(REF_HEADING)), F.startswith(bare, F.lit("#"))
    mark = F.when(is_refs, F.lit("参考文献")).when(is_heading, F.trim(F.regexp_replace(bare, "^[# ]+", "")))
    forward = Window.partitionBy("draft_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    state = F.when(is_refs, True).when(is_heading, False)
    lines = lines.withColumns({"section": F.coalesce(F.last(mark, ignorenulls=True).over(forward), F.lit("")), "in_refs": F.coalesce(F.last(state, ignorenulls=True).over(forward), F.lit(False))})
    kept = lines.where(~is_heading & ~F.col("in_refs") & ~F.rlike("raw", F.lit(REF_LINE)))
    cut = kept.select("draft_id", "line", "section", F.posexplode(F.regexp_extract_all("raw", F.lit(SENTENCE), 0)).alias("place", "sentence"))
    return cut.withColumn("sentence", F.trim("sentence")).where(F.char_length("sentence") >= least).withColumn("citations", citations_of(F.col("sentence")))


def claims(drafts: DataFrame) -> DataFrame:
    """Sentences with citations, whole: what is checked may stand at their end."""
    cited = sentences(drafts).where(F.size("citations") > 0)
    return cited.withColumn("claim", F.col("sentence")).withColumn("claim_id", F.concat_ws(":", "draft_id", "line", "place"))


def coverage(drafts: DataFrame) -> DataFrame:
    return sentences(drafts).groupBy("draft_id").agg(F.count("*").alias("sentences"), F.count_if(F.size("citations") > 0).alias("cited"))


def with_sources(claim_rows: DataFrame, sources: DataFrame) -> DataFrame:
    """claims with source (texts of the cited sources in order), known and held. sources: draft_id, cite_id, source_text[, publication_type]."""
    own = claim_rows.select("claim_id", "draft_id", F.explode("citations").alias("cite_id"))
    kind = F.col("publication_type") if "publication_type" in sources.columns else F.lit(None).cast("string")
    joined = own.join(sources.select("draft_id", "cite_id", "source_text", kind.alias("_kind"), F.lit(True).alias("_known")).hint("merge"), ["draft_id", "cite_id"], "left")
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.coalesce(F.trim("source_text"), F.lit("")) != "", F.struct("cite_id", "source_text")))), lambda x: x["source_text"])
    held = joined.groupBy("claim_id").agg(F.array_join(texts, "\n").alias("source"), F.array_sort(F.collect_list(F.when(F.col("_known").isNull(), F.col("cite_id")))).alias("missing"), F.min_by("_kind", "cite_id").alias("source_type"))
    return claim_rows.join(held.hint("merge"), "claim_id")


def cues(text: Column, words: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def content_words(text: Column) -> tuple[Column, Column]:
    """(Latin words, Chinese words and pairs) of a text, without stop words."""
    tokens = F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0), lambda t: ~t.isin(STOP_WORDS))
    latin = F.array_distinct(F.filter(tokens, lambda t: F.rlike(t, F.lit("^[a-z]"))))
    wide = F.filter(tokens, lambda t: ~F.rlike(t, F.lit("^[a-z]")))

    def pairs(t: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.char_length(t) - 1), lambda i: F.substr(t, i, F.lit(2)))
        return F.when(F.char_length(t) <= 3, F.array(t)).otherwise(F.filter(grams, lambda g: ~F.contains(F.lit(FUNCTION_SIGNS), F.substr(g, F.lit(1), F.lit(1)))))

    return latin, F.array_distinct(F.flatten(F.transform(wide, pairs)))


def number_variants(value: Column) -> Column:
    bare = F.trim(F.regexp_replace(value, "[%‰]", ""))
    number = bare.cast("double")
    whole = F.when(number == F.floor(number), F.floor(number).cast("string"))
    short = F.regexp_replace(F.regexp_replace(bare, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.filter(F.array(value, bare, short, F.format_string("%.1f", number), F.format_string("%.2f", number), whole), lambda v: F.coalesce(v, F.lit("")) != "")


def numbers_of(text: Column) -> Column:
    """Numbers that are data: not 0 to 5, not years."""
    found = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), 1), lambda x: F.regexp_replace(x, r"\s+$", ""))
    return F.filter(found, lambda v: ~v.isin("0", "1", "2", "3", "4", "5") & ~F.rlike(v, F.lit(r"^(19|20)\d{2}$")))


def check(claim_rows: DataFrame, sources: DataFrame, min_overlap: float = 0.34) -> DataFrame:
    """claims with rules (names of the rules that object) and verdict."""
    # Claims of a draft that cite the same numbers have the same sources: their words are made once and written.
    # The claims are written too, as they are read three times and each time the drafts would be cut anew.
    group = F.concat_ws(":", "draft_id", F.array_join("citations", ","))
    claim_rows = written(claim_rows.select("claim_id", "draft_id", "section", "claim", "citations", group.alias("group")), "claims")
    cited = with_sources(claim_rows.select(F.col("group").alias("claim_id"), "draft_id", "citations").distinct(), sources)
    source, low = F.col("source"), F.lower("source")
    s_latin, s_wide = content_words(source)
    weak_text = (F.size(cues(low, WEAK)) > 0) | F.coalesce(F.lower("source_type").isin(WEAK_TYPES), F.lit(False))
    held = cited.select(F.col("claim_id").alias("group"), "source", "missing", s_latin.alias("s_latin"), s_wide.alias("s_wide"), weak_text.alias("weak"), (F.size(cues(low, NULL_RESULT)) > 0).alias("null_result"))
    df = claim_rows.join(written(held, "sources").hint("merge"), "group")
    bare = F.regexp_replace("claim", CITATION, " ")
    c_latin, c_wide = content_words(bare)
    df = df.withColumns({"c_latin": c_latin, "c_wide": c_wide, "strong": cues(F.lower("claim"), STRONG), "unknown": F.filter(numbers_of(bare), lambda v: ~F.exists(number_variants(v), lambda x: F.contains(source, x)))})
    df = df.withColumns({"n_latin": F.size(F.array_intersect("c_latin", "s_latin")), "n_wide": F.size(F.array_intersect("c_wide", "s_wide"))})
    ratio = lambda n, a, b, least: F.when((F.size(a) >= least) & (F.size(b) > 0), F.col(n) / F.size(a))
    latin, wide = ratio("n_latin", "c_latin", "s_latin", 1), ratio("n_wide", "c_wide", "s_wide", 3)
    apart = ((F.size("c_latin") >= 1) & (F.size("s_latin") == 0)) | ((F.size("c_wide") >= 3) & (F.size("s_wide") == 0))
    wide_open = ((F.size("c_wide") < 3) & (F.size("s_wide") > 0)) | ((F.size("c_wide") >= 3) & (F.size("s_wide") == 0))
    best = F.greatest(latin, wide)
    shared = (F.col("n_latin") > 0) | (F.col("n_wide") > 0)
    silent = (F.trim(source) == "") & (F.size("missing") == 0)
    rules = [
        F.when(F.size("missing") > 0, "existence"),
        F.when(silent, "no_source_text"),
        F.when(~silent & (F.size("unknown") > 0), "numbers"),
        F.when(~silent & (F.size("strong") > 0) & F.col("null_result") & shared, "direction"),
        F.when(~silent & (F.size("strong") > 0) & F.col("weak"), "overclaim"),
        F.when(~silent & (best < min_overlap), "grounding"),
        F.when(~silent & best.isNull() & apart, "cross_lingual"),
        F.when(~silent & best.isNotNull() & F.coalesce(latin > 0, F.lit(False)) & wide_open, "script_independent_only"),
    ]
    out = df.withColumn("rules", F.array_compact(F.array(*rules)))
    return out.withColumn("verdict", verdict(F.col("rules"))).select("claim_id", "draft_id", "section", "claim", "citations", "rules", "verdict")


def verdict(rules: Column) -> Column:
    has = lambda *names: F.arrays_overlap(rules, F.array(*map(F.lit, names)))
    return (
        F.when(has("existence", "numbers"), "unsupported").when(has("direction"), "contradicted").when(has("overclaim"), "overclaim").when(has("grounding"), "unsupported")
        .when(has("no_source_text", "cross_lingual"), "unverifiable").when(has("script_independent_only"), "weakly_supported").otherwise("supported")
    )


def merge_tiers(rule_rows: DataFrame, judge_rows: DataFrame) -> DataFrame:
    """The more severe of the rule verdict and the judge's (claim_id, judged), which comes as a table."""
    rank = lambda c: F.coalesce(*[F.when(F.col(c) == v, F.lit(n)) for v, n in SEVERITY.items()])
    joined = rule_rows.join(judge_rows, "claim_id", "left")
    return joined.withColumn("verdict", F.when(rank("judged") > rank("verdict"), F.col("judged")).otherwise(F.col("verdict")))


def report(checked: DataFrame, covered: DataFrame) -> DataFrame:
    """Per draft: claims by verdict, share supported, citation coverage."""
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in SEVERITY]
    made = checked.groupBy("draft_id").agg(F.count("*").alias("claims"), *counts)
    rate = F.round(F.col("supported") / F.col("claims"), 4).alias("supported_rate")
    return made.join(covered.hint("merge"), "draft_id", "left").select("draft_id", "claims", *SEVERITY, rate, F.round(F.col("cited") / F.col("sentences"), 4).alias("coverage"))


def rule_counts(checked: DataFrame) -> DataFrame:
    """(draft_id, by_rule map<string, long>): how often each rule objected in a draft; drafts without objections have an empty map."""
    each = checked.select("draft_id", F.explode_outer("rules").alias("rule")).groupBy("draft_id", "rule").count()
    pairs = F.array_sort(F.collect_list(F.when(F.col("rule").isNotNull(), F.struct("rule", "count"))))
    return each.groupBy("draft_id").agg(F.map_from_entries(pairs).alias("by_rule"))


def issues(checked: DataFrame, most: int = 6) -> DataFrame:
    level = F.when(F.col("verdict").isin("contradicted", "unsupported"), 0).when(F.col("verdict") == "overclaim", 1)
    # Written, as a condition on the verdict would be pushed into the rules and work each of them out many times.
    rows = written(checked.select("claim_id", "draft_id", "section", "claim", "citations", "rules", "verdict"), "checked").withColumn("level", level).where("level is not null")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("draft_id").orderBy("level", "claim_id"))).where(F.col("n") <= most)


def number_provenance(drafts: DataFrame, sources: DataFrame) -> DataFrame:
    """Per draft: its distinct numbers, how many its sources do not hold, and pass, warn, fail or no_numbers."""
    texts = sources.groupBy("draft_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cite_id", "source_text"))), lambda x: x["source_text"]), "\n").alias("source"))
    bare = F.regexp_replace("draft", CITATION, " ")
    own = drafts.join(texts.hint("merge"), "draft_id", "left").select("draft_id", F.array_distinct(numbers_of(bare)).alias("numbers"), F.coalesce("source", F.lit("")).alias("source"))
    lost = F.size(F.filter("numbers", lambda v: ~F.exists(number_variants(v), lambda x: F.contains(F.col("source"), x))))
    made = own.select("draft_id", F.size("numbers").alias("numbers"), lost.alias("unknown"))
    status = F.when(F.col("numbers") == 0, "no_numbers").when(F.col("unknown") == 0, "pass").when(F.col("unknown") <= F.greatest(F.lit(2), F.floor(F.col("numbers") * 0.1)), "warn").otherwise("fail")
    return made.withColumn("status", status)


def confusion(cases: DataFrame) -> DataFrame:
    """cases (gold, predicted): one row per gold class with counts by predicted class, support and recall."""
    kinds = list(SEVERITY)
    made = cases.groupBy("gold").pivot("predicted", kinds).count().na.fill(0)
    support = sum((F.col(k) for k in kinds[1:]), F.col(kinds[0]))
    hit = F.coalesce(*[F.when(F.col("gold") == k, F.col(k)) for k in kinds])
    return made.withColumn("support", support).withColumn("recall", F.round(hit / F.col("support"), 4))

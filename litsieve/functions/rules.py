"""Ordered keyword rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Failure kinds with their keywords, in order of precedence.
FAILURES = [
    ("context_overflow", ["context length", "context_length", "maximum context", "context window", "too many tokens", "token limit", "上下文超长", "超出上下文"]),
    ("rate_limited", ["429", "rate limit", "ratelimit", "too many requests", "quota", "throttl", "限流", "请求过多", "配额"]),
    ("auth", ["401", "403", "unauthorized", "forbidden", "invalid api key", "invalid_api_key", "api key", "apikey", "authentication", "permission denied", "密钥", "鉴权"]),
    ("bad_request", ["400", "422", "invalid request", "validation error", "unprocessable", "bad request", "参数错误"]),
    ("not_found", ["404", "not found", "no such", "unknown model", "model_not_found", "does not exist", "未找到"]),
    ("parse", ["json", "decode", "expecting value", "unterminated", "parse error", "parseerror", "invalid json", "解析失败"]),
    ("connection", ["connection", "connect", "network", "unreachable", "reset by peer", "broken pipe", "eof", "dns", "socket", "ssl", "10061", "连接", "网络"]),
    ("timeout", ["timeout", "timed out", "deadline exceeded", "超时"]),
    ("cancelled", ["cancel", "取消"]),
    ("server_error", ["500", "502", "503", "504", "internal server error", "bad gateway", "service unavailable", "gateway timeout", "server error", "服务不可用"]),
]
# Full-text failure patterns with label and whether trying again is useless.
FULLTEXT_FAILURES = [
    ("没有提供 JATS 正文", "文献本身没有正文（会议摘要 / 勘误 / 社论等）", True),
    ("出版商拒绝了自动下载|HTTP 403", "出版商风控拒绝自动下载（403）", True),
    ("不支持直接下载|HTTP 405", "链接是落地页而非 PDF（405）", True),
    ("链接指向网页而非 PDF", "链接指向网页而非 PDF（未找到 citation_pdf_url）", True),
    ("返回内容不是 PDF", "返回内容不是 PDF", True),
    ("PDF 无可提取文本", "PDF 是扫描件，无法提取文本", True),
    ("PDF 解析失败", "PDF 解析失败（文件可能损坏）", True),
    ("PDF 体积过大", "PDF 体积过大，已跳过", True),
    ("非开放获取", "非开放获取（合规跳过）", True),
    ("既没有 PMCID", "标称 OA 但缺 PMCID 与下载链接", True),
    ("非法全文链接", "全文链接格式非法", True),
    ("HTTP 5\\d\\d|服务端错误", "对方服务端错误（5xx，可重试）", False),
    ("网络错误|ReadTimeout|ConnectError|Timeout|timed out", "网络超时/连接失败（可重试）", False),
    ("PDF 下载失败", "PDF 下载失败（其他）", False),
]
# Study designs with keywords and base quality, in order of precedence; animal words come first.
ANIMALS = "\\b(rats?|mice|mouse|murine|rabbits?)\\b|大鼠|小鼠|动物模型"
DESIGNS = [
    ("Meta分析/系统评价", ["meta-analysis", "meta analysis", "systematic review", "荟萃分析", "系统评价", "meta分析"], 8.5),
    ("指南/共识", ["guideline", "consensus", "recommendation", "指南", "共识", "专家共识"], 7.5),
    ("RCT", ["randomized controlled", "randomised controlled", "randomly assigned", "randomized trial", "rct", "随机对照", "随机分组"], 7.5),
    ("队列研究", ["cohort", "prospective study", "longitudinal", "队列", "前瞻性"], 5.5),
    ("病例对照", ["case-control", "case control", "病例对照"], 4.5),
    ("横断面", ["cross-sectional", "cross sectional", "survey", "横断面", "现况调查"], 4.0),
    ("综述", ["review", "overview", "narrative review", "综述", "研究进展"], 4.5),
    ("动物实验", ["rats", "rat ", "mice", "mouse", "murine", "rabbit", "zebrafish", "大鼠", "小鼠", "动物模型", "家兔"], 3.0),
    ("病例报告", ["case report", "case series", "个案", "病例报告", "病例系列"], 2.5),
]
SAMPLE_SIZES = [
    "(?i)n\\s*=\\s*(\\d{1,6})",
    "(?i)(\\d{1,6})\\s*(?:patients|participants|subjects|participant|adults|children|cases)\\b",
    "(\\d{1,6})\\s*(?:例|名|位)(?:患者|病人|受试者|对象)?",
    "(?:纳入|共|选取|收集)\\s*(\\d{1,6})\\s*(?:例|名|位)",
]


def any_of(text: Column, words: list[str]) -> Column:
    found = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        found = found | F.contains(text, F.lit(w))
    return found


def classify_failure(error: Column) -> Column:
    """One of the failure kinds; unknown for other texts, empty where there is no error."""
    low = F.lower(error)
    kind = F.when(error.isNull(), F.lit("")).when(F.trim(low) == "", F.lit("unknown"))
    for name, words in FAILURES:
        kind = kind.when(any_of(low, words), F.lit(name))
    return kind.otherwise(F.lit("unknown"))


def classify_fulltext_error(message: Column) -> Column:
    """struct<label, permanent>."""
    text = F.coalesce(message, F.lit(""))
    out = None
    for pattern, label, permanent in FULLTEXT_FAILURES:
        pair = F.struct(F.lit(label).alias("label"), F.lit(permanent).alias("permanent"))
        out = (F.when if out is None else out.when)(F.rlike(text, F.lit("(?i)" + pattern)), pair)
    return out.otherwise(F.struct(F.lit("其他原因").alias("label"), F.lit(False).alias("permanent")))


def evidence_level(title: Column, abstract: Column, publication_type: Column | None = None, head: int = 1500) -> Column:
    parts = [F.coalesce(publication_type, F.lit("")) if publication_type is not None else F.lit(""), F.coalesce(title, F.lit("")), F.substring(F.coalesce(abstract, F.lit("")), 1, head)]
    text = F.lower(F.concat_ws(" ", *parts))
    level = F.when(F.rlike(text, F.lit(ANIMALS)), F.lit("动物实验"))
    for name, words, _ in DESIGNS:
        level = level.when(any_of(text, words), F.lit(name))
    return level.otherwise(F.lit("其他"))


def design_score(level: Column) -> Column:
    score = None
    for name, _, value in DESIGNS:
        score = (F.when if score is None else score.when)(level == name, F.lit(value))
    return score.otherwise(F.lit(4.0))


def sample_size(title: Column, abstract: Column, head: int = 4000) -> Column:
    """The largest number from 5 to 500000 that a pattern finds, else null."""
    text = F.substring(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))), 1, head)
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), 1) for p in SAMPLE_SIZES))
    return F.array_max(F.filter(F.transform(found, lambda x: x.cast("int")), lambda x: x.between(5, 500_000)))

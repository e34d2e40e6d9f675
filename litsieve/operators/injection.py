"""Signs of instructions planted in outside texts, as columns: one finding per kind, the first rule of the kind that fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.functions.text import has_any, let

# Word groups of the patterns.
EN_ROLE = r"(?:assistant|ai|chatbot|language\s+model|llm|gpt|claude|qwen|llama|deepseek|gemini|persona|character|human|robot|agent|dan|unrestricted|jailbroken)"
EN_ROLE_ACT = r"(?:assistant|ai|chatbot|language\s+model|llm|gpt|expert|persona|character|human|dan|unrestricted|jailbroken)"
EN_REVEAL = r"(?:reveal|show|print|output|display|repeat|dump|expose|leak|disclose|translate)"
EN_PROMPT_TAIL = r"\s+(?:your|the)\s+(?:full\s+|complete\s+|entire\s+|original\s+|exact\s+|initial\s+|system\s+)*(?:system\s+)?(?:prompt|instructions?|rules?|guidelines?|configuration)"
ZH_OVERRIDE = "(?:忽略|无视|不要理会|不用理会|忘掉|忘记|抛弃|跳过)"
# Fixed values: (kind, severity, pattern, what must also be there or None), in the order in which they are tried.
# SIGNS has for each rule the literals, lower-cased, of which one is in every text that fits: without any, no expression is run.
RULES = [
    ("instruction_override", "high", r"(?i)\b(?:ignore|disregard|forget|override|bypass)\b[^.\n]{0,30}?\b(?:instructions?|prompts?|rules?|directives?|commands?)\b", None),
    ("instruction_override", "high", r"(?i)\b(?:ignore|disregard|forget|skip)\s+(?:(?:all\s+(?:of\s+)?)?(?:the\s+)?(?:above|foregoing|everything\s+above|what\s+was\s+said\s+above)|everything|anything)\b", None),
    ("instruction_override", "high", r"(?i)\b(?:new|updated|revised)\s+instructions?\s*[:：]", None),
    ("instruction_override", "high", ZH_OVERRIDE + r"(?:掉|了)?(?:你)?(?:之前|以前|先前|上面|以上|上述|前面)?(?:收到|接到|接受|看到|见过|被给(?:予)?)?的?(?:所有|全部|一切|任何)?\s*(?:指令|命令|规则|设定|提示|要求|约束)", None),
    ("instruction_override", "high", ZH_OVERRIDE + r"(?:掉)?\s*(?:以上|上述|上面|之前|前面|所有|一切)(?:的)?\s*(?:内容|文本|说明|指令|要求|提示|规则|命令|话)", None),
    ("instruction_override", "high", r"(?:从现在开始|从此刻起|从现在起|接下来|今后)[^。\n]{0,20}(?:只|必须|一律)?(?:听从|服从|执行|遵循|按)(?:我|以下|下面|新)", None),
    ("instruction_override", "high", r"(?:优先于|优先级高于|高于|覆盖|取代|凌驾于)[^。\n]{0,12}(?:系统|开发者|之前|原有|以上|上面)[^。\n]{0,6}(?:指令|设定|提示|规则|要求)", None),
    ("role_play", "high", r"(?i)<\|(?:im_start|im_end|start_header_id|end_header_id|system|assistant|user)\|>|\[/?INST\]|<<SYS>>|<</SYS>>", None),
    ("role_play", "high", r"(?im)^\s*(?:system|assistant|developer)\s*[:：]", None),
    ("role_play", "high", r"(?im)^\s*#{1,6}\s*(?:system|assistant|developer)\b", None),
    ("role_play", "high", r"(?:【|\[|〖)\s*(?:系统|开发者|管理员|system|developer)\s*(?:】|\]|〗)", None),
    ("role_play", "medium", r"(?i)\b(?:you\s+are|you're)\s+(?:now\s+)?(?:a|an|the\s+)?[^\n]{0,40}?\b" + EN_ROLE + r"\b", None),
    ("role_play", "medium", r"(?i)\b(?:act|behave|pretend|roleplay|role-play|respond)\s+as\s+(?:if\s+you\s+(?:are|were)\s+)?(?:a|an|the\s+)?[^\n]{0,30}?\b" + EN_ROLE_ACT + r"\b", None),
    ("role_play", "medium", r"(?:你现在是|你现在就是|从现在开始你是|你就是|你是一个|请你?扮演|你来扮演|请假装你是|假装你是)[^。\n]{0,20}?(?:助手|AI|人工智能|模型|机器人|专家|黑客|角色|人格|系统)", None),
    ("exfiltration", "high", "(?i)(?:(?:" + EN_REVEAL + r"(?:\s+me)?|what\s+(?:is|are|was|were))" + EN_PROMPT_TAIL + r"|\b(?:repeat|echo)\s+(?:the\s+)?(?:text|content|words)\s+(?:above|before))\b", None),
    ("exfiltration", "high", r"(?i)\b(?:send|post|upload|forward|email|transmit|exfiltrate|submit)\b[^.\n]{0,40}?\b(?:to|at)\s+(?:https?://|[\w.+-]+@)", None),
    ("exfiltration", "high", r"(?i)\b(?:api[\s_-]?key|secret[\s_-]?key|access[\s_-]?token|credentials?|password)\b[^.\n]{0,40}?\b(?:send|post|upload|reveal|leak|expose|share|forward|email|print)\b", None),
    ("exfiltration", "high", r"(?:输出|显示|打印|告诉我|透露|泄露|复述|重复|展示|给出)(?:一下)?(?:你|您)?的?\s*(?:系统|原始|初始|完整|全部)?\s*(?:提示词|提示语|系统指令|初始指令|设定|人设|prompt)", None),
    ("exfiltration", "high", r"(?:(?:把|将)(?:上面|以上|上述|前面|全部|所有|之前)[^。\n]{0,15}(?:内容|文本|信息|资料|对话)?[^。\n]{0,6}(?:发送|发给|发到|上传|转发|回传|提交)(?:到|给)|(?:API\s*密钥|密钥|秘钥|令牌|凭据|凭证|access[_\s-]?token)[^。\n]{0,20}?(?:发送|发给|发到|上传|转发|回传|泄露|公布|告诉我))", None),
    ("tool_invocation", "high", r'(?i)<\s*/?\s*(?:tool_call|tool_calls|tool_name|tool_use|function_call|function_calls|invoke|minimax:tool_call)\b|"tool_calls"\s*:\s*\[', None),
    ("tool_invocation", "high", r'\{\s*"(?:name|tool|tool_name|function)"\s*:\s*"[^"\n]{1,64}"\s*,\s*"(?:arguments|parameters|args|input)"\s*[:：]', None),
    ("tool_invocation", "high", r"(?i)\bAction\s*Input\s*[:：]", None),
    ("tool_invocation", "high", r"(?im)^\s*Action\s*[:：]", r"(?i)\b(?:Observation|Thought)\s*[:：]"),
    ("tool_invocation", "high", r"(?:调用|发起|执行|invoke|call)\s*(?:工具|函数|接口|API|tool|function)\s*[:：]?\s*[A-Za-z_][A-Za-z0-9_.]{1,}", None),
    ("tool_invocation", "low", r"(?i)\b(?:os\.system|subprocess\.(?:run|call|Popen)|shell_exec)\s*\(", None),
    ("hidden_text", "medium", r"[\x{200b}-\x{200d}\x{feff}\x{202a}-\x{202e}\x{2066}-\x{2069}]", None),
    ("hidden_text", "low", r"[ \t\x{00a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]{20,}|\n[ \t]*\n(?:[ \t]*\n){4,}", None),
]
SIGNS = [
    "ignore disregard forget override bypass".split(),
    "ignore disregard forget skip".split(),
    "instruction".split(),
    "忽略 无视 不要理会 不用理会 忘掉 忘记 抛弃 跳过".split(),
    "忽略 无视 不要理会 不用理会 忘掉 忘记 抛弃 跳过".split(),
    "从现在开始 从此刻起 从现在起 接下来 今后".split(),
    "优先于 高于 覆盖 取代 凌驾于".split(),
    "<| inst] <<sys>> <</sys>>".split(),
    "system assistant developer".split(),
    "#".split(),
    "系统 开发者 管理员 system developer".split(),
    "you".split(),
    "act behave pretend roleplay role-play respond".split(),
    "你现在 你是 你就是 扮演".split(),
    "prompt instruction rule guideline configuration repeat echo".split(),
    "http:// https:// @".split(),
    "key token credential password".split(),
    "提示词 提示语 系统指令 初始指令 设定 人设 prompt".split(),
    "把 将 密钥 秘钥 令牌 凭据 凭证 token".split(),
    "tool_ function_call invoke".split(),
    '"arguments" "parameters" "args" "input"'.split(),
    "action".split(),
    "action".split(),
    "工具 函数 接口 api tool function".split(),
    "os.system subprocess. shell_exec".split(),
    None,
    ["  ", "\t", "\n\n", "\n ", "\u00a0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u202f", "\u205f", "\u3000"],
]
BASE64, HEX, DECODED = "[A-Za-z0-9+/]{120,}={0,2}", "[0-9a-fA-F]{120,}", 4096
LONG_RUN = "(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{120}"  # what fits either holds it; tried at the start of a run only
KINDS = [*dict.fromkeys(kind for kind, *_ in RULES), "encoded_payload"]
SEVERITIES = ["high", "medium", "low"]


def _says_text(raw: Column) -> Column:
    """Bytes that are mostly printable, or UTF-8 with enough Chinese characters."""
    plain = F.octet_length(F.regexp_replace(F.decode(raw, "ISO-8859-1"), r"[^\x20-\x7e\t\n\r]", ""))
    said = F.try_validate_utf8(raw.cast("string"))
    han = F.char_length(said) - F.char_length(F.regexp_replace(said, r"[\x{4e00}-\x{9fff}]", ""))
    return (plain >= F.octet_length(raw) * 0.85) | F.coalesce((han >= 8) & (han >= F.char_length(said) * 0.3), F.lit(False))


def _encoded(text: Column) -> Column:
    def base64(blob: Column) -> Column:
        bare = F.rtrim(F.substring(blob, 1, DECODED), F.lit("="))
        whole = F.when(F.char_length(bare) % 4 == 1, F.substring(bare, F.lit(1), F.char_length(bare) - 1)).otherwise(bare)
        raw = F.try_to_binary(F.rpad(whole, (F.ceil(F.char_length(whole) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64"))
        return F.rlike(blob, F.lit("[a-z]")) & F.rlike(blob, F.lit("[A-Z]")) & F.coalesce(_says_text(raw), F.lit(False))

    def sixteen(blob: Column) -> Column:
        part = F.substring(blob, 1, DECODED)
        even = F.substring(part, F.lit(1), F.char_length(part) - F.char_length(part) % 2)
        return F.coalesce(_says_text(F.unhex(even)), F.lit(False))

    return F.rlike(text, F.lit(LONG_RUN)) & (F.exists(F.regexp_extract_all(text, F.lit(BASE64), 0), base64) | F.exists(F.regexp_extract_all(text, F.lit(HEX), 0), sixteen))


def findings(text: Column) -> Column:
    """array<struct<order, kind, severity>> by severity, then kind; null and empty texts have none."""
    return let(F.coalesce(text, F.lit("")), lambda body: let(F.lower(body), lambda lower: _findings(body, lower)))


def _findings(body: Column, lower: Column) -> Column:
    out = []
    for kind in KINDS[:-1]:
        severity = None
        for (own, level, pattern, also), signs in zip(RULES, SIGNS, strict=True):
            if own == kind:
                hit = F.rlike(body, F.lit(pattern)) if signs is None else has_any(lower, signs) & F.rlike(body, F.lit(pattern))
                if also is not None:
                    hit = hit & F.rlike(body, F.lit(also))
                severity = (F.when if severity is None else severity.when)(hit, F.lit(SEVERITIES.index(level)))
        out.append((kind, severity))
    out.append((KINDS[-1], F.when(_encoded(body), F.lit(2))))
    made = F.array(*(F.struct(order.alias("order"), F.lit(kind).alias("kind")) for kind, order in out))
    named = F.filter(made, lambda x: x["order"].isNotNull())
    levels = F.array(*map(F.lit, SEVERITIES))
    return F.transform(F.array_sort(named), lambda x: F.struct(x["order"].alias("order"), x["kind"].alias("kind"), F.get(levels, x["order"]).alias("severity")))


def risk_level(found: Column) -> Column:
    """The highest severity among findings(); null where there are none."""
    return F.get(found, F.lit(0))["severity"]


def scan_stats(scanned: DataFrame, found: str = "findings", order: str = "id") -> DataFrame:
    """One row: texts with findings, findings, and the last kind and severity in the order of `order`."""
    last = F.element_at(found, -1)
    hit = scanned.where(F.size(found) > 0)
    return hit.agg(F.count("*").alias("texts"), F.coalesce(F.sum(F.size(found)), F.lit(0)).alias("findings"), F.max_by(last["kind"], order).alias("last_kind"), F.max_by(last["severity"], order).alias("last_severity"))

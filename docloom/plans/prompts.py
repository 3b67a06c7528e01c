"""Default prompt templates as a table: system text by domain and strictness, instruction by answer format.

The table has a row for each answer format and domain; ``docloom.operators.answers.render_prompts`` joins it with the cases. Replace or extend
it to change the wording.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# How strictly each domain's answers are judged.
STRICTNESS = {"research": "high", "financial_reports": "high", "insurance": "balanced", "financial_contracts": "balanced", "regulatory": "inclusive", "general": "balanced"}

BASE = "你负责依据给定证据回答文档题。只使用证据中的内容，不补充外部知识。"
VERIFY = "现在复核一个已有答案：逐项回到证据，改正遗漏和误选。"
CHECKS = ["主体是否一致", "数值、单位和正负是否一致", "变化方向是否一致", "条件与逻辑关系是否一致", "限定词是否出现", "出处是认定还是主张", "证据是否回答了该选项"]
TRAPS = {
    "research": "留意主体混淆、数值符号与方向词。",
    "regulatory": "留意逻辑连接词、当事人主张与监管认定的区别、施行日期。",
    "insurance": "留意方向词与条件关系。",
    "financial_reports": "留意单位与限定词。",
    "financial_contracts": "留意数值与条件关系。",
}
RULES = {
    ("high", "multi"): "有疑问的选项不选，宁缺毋滥。",
    ("high", "tf"): "各项全部吻合才判正确。",
    ("high", "mcq"): "选各项吻合且证据最强的一项。",
    ("balanced", "multi"): "有直接证据的选，被证据排除的不选，部分吻合且无反证的倾向于选。",
    ("balanced", "tf"): "有直接证据判正确，被证据排除判错误，含糊时倾向正确。",
    ("balanced", "mcq"): "选证据最强的一项。",
    ("inclusive", "multi"): "有直接证据且无明确反证的都选。",
    ("inclusive", "tf"): "有直接证据且无明确反证判正确。",
    ("inclusive", "mcq"): "选有直接证据的一项。",
}
INSTRUCTIONS = {
    "mcq": "先排除有反证的选项，再从余下的选项中选一个。",
    "multi": "逐个选项独立判断，答案按字母顺序连写。",
    "tf": "注意否定与例外的表述，选一个字母。",
}
FORMAT = '先写理由再写答案，输出JSON：{"reasoning":"…","answer":"…"}。'


def strictness_rule(domain: str, answer_format: str) -> str:
    return RULES[STRICTNESS.get(domain, "balanced"), answer_format]


def system_text(domain: str, answer_format: str, verify: bool = False) -> str:
    checks = "对每个选项检查：" + "；".join(f"{i}.{c}" for i, c in enumerate(CHECKS, 1)) + "。任一项明确冲突即不选。"
    return "\n\n".join(x for x in (BASE + (VERIFY if verify else ""), checks, TRAPS.get(domain, ""), strictness_rule(domain, answer_format)) if x)


def default_templates(spark: SparkSession) -> DataFrame:
    """``answer_format, domain, system, verify_system, instruction``."""
    rows = [(f, d, system_text(d, f), system_text(d, f, verify=True), INSTRUCTIONS[f] + FORMAT) for f in INSTRUCTIONS for d in STRICTNESS]
    return spark.createDataFrame(rows, "answer_format string, domain string, system string, verify_system string, instruction string")

"""Term lists, weights and patterns of the finance domain, and a Latin variant of the chunk patterns.

Everything here is a fixed value that results depend on. Patterns are written for Java's regex engine; ``(?U)`` gives ``\\d``
and ``\\s`` their Unicode meaning.
"""

from __future__ import annotations

from dataclasses import dataclass

# ------------------------------------------------------------------ fixed values: limits and weights
FIELD_WEIGHTS = {"title": 4.0, "section_path": 3.0, "clause_no": 5.0, "chunk_text": 1.0}
BM25_K1, BM25_B = 1.2, 0.75
TOP_DOCS, TOP_CHUNKS = 8, 12
DOC_PENALTY, SECTION_PENALTY = 0.5, 1.25
MAX_CHUNK, SPLIT_TARGET = 1200, 1000
MERGE_MIN = 200
EVIDENCE_PER_DOC, EVIDENCE_TOTAL, EVIDENCE_SNIPPET, EVIDENCE_CHARS = 5, 30, 1200, 24_000
MAX_ROUNDS = 3
OPTION_NAMES = ("A", "B", "C", "D", "E", "F")

# ------------------------------------------------------------------ fixed values: domains
DOMAIN_ALIASES = {"report": "financial_reports", "financial_report": "financial_reports", "contract": "financial_contracts", "financial_contract": "financial_contracts"}
DOMAIN_TERMS = {
    "insurance": ["保险", "给付", "免责", "现金价值"],
    "regulatory": ["条例", "决议", "监管", "规定"],
    "financial_reports": ["年报", "营收", "资产", "负债", "现金流", "利润表", "资产负债表"],
    "financial_contracts": ["条款", "票息", "发行", "评级", "偿付顺序", "募集说明书"],
    "research": ["研报", "市场规模", "同比", "预测", "风险提示", "投资建议", "盈利预测"],
}
FOCUS_TERMS = {
    "insurance": ["保险责任", "身故保险金", "责任免除", "现金价值", "等待期", "给付"],
    "regulatory": ["总则", "信息披露", "受益所有人", "客户尽职调查", "适用范围", "监管要求"],
    "financial_reports": ["主要财务数据", "利润表", "资产负债表", "现金流量表", "营业收入", "净利润"],
    "financial_contracts": ["募集说明书", "发行条款", "评级", "受托管理人", "偿付顺序", "发行规模"],
    "research": ["投资建议", "盈利预测", "风险提示", "核心观点", "市场规模"],
}
DOMAIN_SECTION_TERMS = {
    "regulatory": (["办法", "规定", "条例", "指引", "监管"], 1.5),
    "financial_reports": (["财务", "资产负债", "利润", "现金流"], 2.0),
    "financial_contracts": (["发行", "票息", "评级", "偿付", "条款"], 2.0),
    "insurance": (["保险责任", "免责", "给付", "现金价值", "等待期"], 2.0),
    "research": (["风险提示", "盈利预测", "投资建议"], 2.0),
}

# ------------------------------------------------------------------ fixed values: query terms
SECTION_TERMS = ["风险提示", "盈利预测", "投资建议", "主要财务数据", "资产负债表", "利润表", "现金流量表", "保险责任", "免责", "给付", "现金价值", "受益所有人", "客户尽职调查", "信息披露", "募集说明书", "发行条款", "偿付顺序", "评级"]
STOP_WORDS = ["以下", "哪些", "下列", "相关", "规定", "根据", "关于", "结合", "是否", "其中", "说法", "描述", "正确", "错误", "符合", "内容", "要求", "情况", "以及", "或者", "并且", "可以", "应当", "不得", "进行", "公司", "机构"]
SYNONYM_GROUPS = [["营业收入", "营收"], ["归母净利润", "归属于上市公司股东的净利润"], ["责任免除", "免责"], ["现金流量表", "现金流"], ["客户尽职调查", "尽职调查"], ["受益所有人", "最终受益人"], ["退保费用", "退保手续费"]]
CALCULATION_HINTS = ["计算", "金额", "合计", "分别是多少", "排序", "高到低", "低到高", "赔付", "退保"]
COMPARISON_HINTS = ["对比", "比较", "差异", "哪份", "哪家", "两份文档", "均", "分别", "共同"]
CLAUSE_HINTS = ["条款", "条文", "根据", "依据", "规定", "办法", "条例"]
REWRITES = {
    "base": ("保留题干核心术语", ["原文", "关键术语"]),
    "comparison_focus": ("强调跨文档对比与分别抽取", ["分别", "对比", "逐文档核对"]),
    "numbers_focus": ("强调数字、金额、比例和公式依据", ["数字", "金额", "比例", "公式"]),
    "clause_focus": ("优先命中条款号、章节名和原文义务", ["条款原文", "章节标题", "义务", "责任"]),
    "section_focus": ("优先命中高价值章节标题与字段", ["高价值章节", "结构字段", "核心术语"]),
    "option_split": ("按选项逐条验证支持与反驳证据", ["逐选项", "支持证据", "反驳证据"]),
}
CALCULATION_EXTRA, COMPARISON_EXTRA, CLAUSE_EXTRA, CONTRACT_EXTRA = ["计算依据", "取较大值", "金额"], ["同一字段对照"], ["条款定位"], ["评级", "发行规模"]
ACTION_REWRITES = {"clause_focus": "clause_focus", "numbers_focus": "numbers_focus", "comparison_focus": "comparison_focus", "option_split": "option_split", "section_focus": "section_focus", "diversify_sections": "section_focus", "broaden_docs": "comparison_focus"}

# ------------------------------------------------------------------ fixed values: patterns
NUMERAL = r"[\d一二三四五六七八九十百千万]"
CLAUSE_REF = rf"(?U)第{NUMERAL}+条"
PLAN_CLAUSE_REF = r"(?U)第[\d一二三四五六七八九十百]+条"
NUMBER = r"(?U)\d+(?:\.\d+)?%?"
PLAIN_NUMBER = r"(?U)\d+(?:\.\d+)?"
OPTION_MARKER = r"(?U)\d+(?:\.\d+)?\s*(?:%|万元|亿元|元|万|亿|倍|‰|分之)|\d+(?:\.\d+)?"
LONG_NUMBER = r"(?U)\d{2,}(?:\.\d+)?%?"
CALCULATION_QUESTION = "计算|比例|增长率|增幅|占比|合计|总计|差额|相差|倍数|排序|排名|从高到低|从低到高|由大到小|由小到大"
NEGATIONS = ["不得(?!.*但)", "不予", "不包括", "不包含", "不属于", "不应", "不能", "不可", "除了?", "除外", "不视为", "免于", "免除", "无须", "不适用"]
EXCEPTIONS = ["但.*(?:应当|应|可以|允许)", "另有规定.*(?:从|按)", "除.*外.*(?:属于|包括|适用)"]
NOISE_LINES = ["仅供参考", "请仔细阅读", "版权所有", "联系电话[:：]?", "网址[:：]?", r"www\.", "https?://"]
PAGE_MARKER = r"(?iU)^(第?\s*\d+\s*页|page\s*\d+|\d+/\d+|\d+)$"
WEB_NOISE = ["【打印】", "【关闭窗口】", "【收藏】", "【分享】", r"链接：(?U:\s)*$"]
FORMULA_TAGS = [
    (r"(?U)\d+(?:\.\d+)?\s*%", "[公式] 百分比"),
    (r"(?U)\d+(?:\.\d+)?\s*倍", "[公式] 倍数"),
    (r"(?U)\d+(?:\.\d+)?\s*(?:万元|亿元|元)", "[公式] 金额"),
    (r"(?U)\d+(?:\.\d+)?\s*[÷/]\s*\d+(?:\.\d+)?", "[公式] 除法"),
    ("计算公式|等于|比例|乘以|除以|计算方式|计算方法", "[公式] 计算表述"),
]
PENALTY_MARKERS = ["行政处罚决定书", "行政监管措施决定书", "市场禁入决定书"]
TEMPLATE_ANCHORS = ["上述当事人应自收到本处罚决定书之日起", "如不服本处罚决定", "行政复议", "行政诉讼", "具体缴款方式", "当事人应于", "将罚没款", "缴纳罚没款", "自收到本处罚决定书", "逾期不履行"]
PRIORITY_SECTIONS = ["利润分配", "分红", "派发", "现金红利", "每10股", "每股", "营业收入", "营业成本", "营收", "净利润", "归母", "经营活动", "现金流量", "现金流", "研发费用", "研发投入", "回购", "股份回购", "董事会审议", "利润分配预案", "资产负债表", "利润表", "现金流量表"]
CONTENT_WORDS = ["detail-news", "article-content", "TRS_Editor", "Custom_UnionStyle", "zoom", "articleContent", "article_body"]
CONTENT_FALLBACK_WORDS = ["content", "article", "main", "detail", "正文", "news"]
SENSITIVE = [r"(?U)\b1[3-9]\d{9}\b", r"(?U)\b\d{17}[\dXx]\b", r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"]
ANSWER_FORMATS = {"mcq": "mcq", "multi": "multi", "tf": "tf", "单选": "mcq", "单选题": "mcq", "多选": "multi", "多选题": "multi", "判断": "tf", "判断题": "tf"}
TABLE_MARK, OUTLINE_WORD = "[表格]", "目录"
NO_FILE, NO_CONTENT, DEFAULT_SECTION = "未找到源文件：", "未能解析出正文内容，请检查源文件。", "默认章节"

# ------------------------------------------------------------------ fixed values: thresholds of the validation report
THRESHOLDS = {
    "format_compliance_rate": 0.995,
    "file_integrity_rate": 0.99,
    "encoding_uniformity_rate": 0.99,
    "doc_id_mapping_rate": 1.0,
    "metadata_completeness_rate": 0.98,
    "field_completeness_rate": 0.95,
    "clause_boundary_rate": 0.96,
    "logical_consistency_rate": 0.95,
    "sensitive_scan_pass_rate": 1.0,
    "copyright_retention_rate": 0.99,
    "attachment_mapping_rate": 0.98,
    "pdf_avg_seconds": 45.0,
    "html_avg_seconds": 5.0,
    "txt_avg_seconds": 3.0,
    "automation_coverage_rate": 0.75,
    "manual_review_trigger_rate": 0.20,
}
AUTOMATION_COVERAGE = 0.8125


@dataclass(frozen=True)
class ChunkProfile:
    """How text is cut: the pattern that opens a chunk, the characters after which a part may end, the clause number's pattern."""

    boundary: str
    sentence_ends: str
    clause: str
    table_mark: str = TABLE_MARK
    target: int = SPLIT_TARGET
    most: int = MAX_CHUNK


FINANCE = ChunkProfile(boundary=rf"(?U)^第{NUMERAL}+[条章节]", sentence_ends="。；", clause=rf"(?U)^\s*(第{NUMERAL}+条)")
LATIN = ChunkProfile(boundary=r"^(?:Section|Article|Chapter) [0-9]+", sentence_ends=".!?;", clause=r"^\s*((?:Section|Article) [0-9]+)", table_mark="[table]")

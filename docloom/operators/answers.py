"""Answers: rule-based choice, evidence items, evidence packing, prompts, parsing of model output."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import profiles as P
from docloom.functions import text as T
from docloom.operators.reply_log import logged_replies
from docloom.sources.shared import stored

NO_EVIDENCE = "无候选证据"


def choose_answers(results: DataFrame, questions: DataFrame) -> DataFrame:
    """``qid, answer``: supported options, else insufficient ones, else A; all of them for multiple choice, the first otherwise."""
    of = lambda v: F.array_sort(F.collect_list(F.when(F.col("verdict") == v, F.col("option"))))
    rows = questions.select("qid", "answer_format").join(results.groupBy("qid").agg(of("support").alias("yes"), of("insufficient").alias("open")), "qid", "left")
    found = F.when(F.size("yes") > 0, F.col("yes")).when(F.size("open") > 0, F.col("open")).otherwise(T.strings(["A"]))
    return rows.select("qid", F.when(F.col("answer_format") == "multi", F.array_join(found, "")).otherwise(F.get(found, F.lit(0))).alias("answer"))


def needs_self_check(results: DataFrame, questions: DataFrame) -> DataFrame:
    """``qid, self_check``: multiple choice, or no supported option; never without results."""
    any_ = results.groupBy("qid").agg(F.max(F.col("verdict") == "support").alias("some"))
    return questions.select("qid", "answer_format").join(any_, "qid", "left").select("qid", F.coalesce(F.col("some").isNotNull() & ((F.col("answer_format") == "multi") | ~F.col("some")), F.lit(False)).alias("self_check"))


def evidence_items(results: DataFrame, limit: int = 8) -> DataFrame:
    """``qid, n, doc_id, page_no, clause_no, quoted_text, supports_option, reasoning``: the options' evidence in order, each passage once, eight at most."""
    rows = results.select("qid", "option", "reasoning", F.posexplode("evidence").alias("place", "e"))
    key = F.concat_ws(":", F.col("e.doc_id"), F.col("e.page_no").cast("string"), F.substring("e.chunk_text", 1, 50))
    once = F.row_number().over(Window.partitionBy("qid", key).orderBy("option", "place"))
    n = F.row_number().over(Window.partitionBy("qid").orderBy("option", "place"))
    rows = rows.withColumn("once", once).where("once = 1").withColumn("n", n).where(F.col("n") <= limit)
    return rows.select("qid", "n", "e.doc_id", "e.page_no", "e.clause_no", F.col("e.chunk_text").alias("quoted_text"), F.array("option").alias("supports_option"), "reasoning")


# ------------------------------------------------------------------ packing evidence for a prompt
def select_evidence(evidence: DataFrame, per_doc: int = P.EVIDENCE_PER_DOC, total: int = P.EVIDENCE_TOTAL, priority: bool = True) -> DataFrame:
    """Adds ``place`` to the chosen chunks: some of every document first, then priority sections, then the rest, up to ``total``.

    ``evidence`` has ``qid, rank`` and the chunk's columns. The share of each document may exceed the total.
    """
    w = Window.partitionBy("qid")
    mine = F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy("rank"))
    first_of_doc = F.min("rank").over(Window.partitionBy("qid", "doc_id"))
    text = F.concat_ws(" ", F.coalesce("section_path", F.lit("")), F.coalesce("title", F.lit("")), F.substring("chunk_text", 1, 300))
    wanted = text.rlike(T.literal_alternatives(P.PRIORITY_SECTIONS)) if priority else F.lit(False)
    rows = evidence.withColumns({"mine": mine, "doc_order": first_of_doc}).withColumn("tier", F.when(F.col("mine") <= per_doc, 0).when(wanted, 1).otherwise(2))
    rows = rows.withColumn("place", F.row_number().over(w.orderBy("tier", F.when(F.col("tier") == 0, F.col("doc_order")).otherwise(0), "rank")))
    n_docs = F.size(F.collect_set("doc_id").over(w))
    return rows.withColumn("quota", per_doc * n_docs).where((F.col("tier") == 0) | (F.col("place") <= total)).drop("mine", "doc_order")


def evidence_line(number: Column | None = None) -> Column:
    place = F.concat(F.lit("doc="), "doc_id", F.lit(", page="), F.col("page_no").cast("string"), F.when(F.coalesce("clause_no", F.lit("")) != "", F.concat(F.lit(", clause="), "clause_no")).otherwise(""), F.when(F.coalesce("section_path", F.lit("")) != "", F.concat(F.lit(", section="), "section_path")).otherwise(""))
    line = F.concat(F.lit("["), place, F.lit("] "), T.snippet(F.col("chunk_text"), F.col("chunk_type") == "table"))
    return line if number is None else F.concat(number.cast("string"), F.lit(". "), line)


def pack_evidence(evidence: DataFrame, max_chars: int = P.EVIDENCE_CHARS) -> DataFrame:
    """``qid, evidence_text``: numbered lines up to ``max_chars``, but never fewer than every document's share.

    Once a line is over the budget all later ones are, since the running sum only grows: a window suffices.
    """
    rows = select_evidence(evidence).withColumn("line", evidence_line(F.col("place")))
    running = F.sum(F.length("line")).over(Window.partitionBy("qid").orderBy("place"))
    kept = rows.withColumn("running", running).where((F.col("place") <= F.col("quota")) | (F.col("running") <= max_chars))
    return kept.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("evidence_text"))


def simulate_packing(evidence: DataFrame, total: int = 20, max_chars: int = 18_000) -> DataFrame:
    """``qid, chunk_id, place, fate`` (included, over_count, over_chars) of the older packing, which skips a line that does not fit and goes on.

    Skipped lines do not count towards the sum: a fold over each question's lines.
    """
    chosen = select_evidence(evidence, total=1 << 30, priority=False).withColumn("size", F.length(evidence_line()))
    item = F.struct("place", "chunk_id", "size", "quota")
    grouped = chosen.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"), F.array().cast("array<struct<chunk_id:string,place:int,fate:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        over_count = x["place"] > total
        over_chars = (s["sum"] + x["size"] > max_chars) & (s["n"] >= x["quota"])
        fate = F.when(over_count, "over_count").when(over_chars, "over_chars").otherwise("included")
        took = F.when(over_count | over_chars, 0).otherwise(1)
        return F.struct((s["sum"] + took * x["size"]).alias("sum"), (s["n"] + took).alias("n"), F.concat(s["out"], F.array(F.struct(x["chunk_id"].alias("chunk_id"), x["place"].alias("place"), fate.alias("fate")))).alias("out"))

    return grouped.select("qid", F.explode(F.aggregate("items", start, step, lambda s: s["out"])).alias("o")).select("qid", "o.*")


# How a document's full text is introduced and cut.
FULL_TEXT = "=== 文档 %s（%d个chunk，%d字符，展示%d字符）===\n%s"
FULL_TEXT_NONE = "=== 文档 %s（无预处理数据）===\n"
CUT_MARK = "…[截断]"


def full_texts(chunks: DataFrame, per_doc: int = 28_000) -> DataFrame:
    """``doc_id, full_text, n_chunks, chars, shown``: a document's chunks by page and id, joined by line ends, up to ``per_doc`` characters.

    The chunk that does not fit is cut and marked if more than 100 characters are left. ``shown`` counts whole chunks only; sizes are
    summed by a window, so only what is shown is gathered.
    """
    size = F.length(F.coalesce("chunk_text", F.lit("")))
    through = F.sum(size).over(Window.partitionBy("doc_id").orderBy(F.coalesce("page_no", F.lit(0)), "chunk_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = chunks.select("doc_id", F.coalesce("page_no", F.lit(0)).alias("page_no"), "chunk_id", F.coalesce("chunk_text", F.lit("")).alias("chunk_text"), size.alias("size"), through.alias("through"))
    rows = rows.withColumns({"whole": F.col("through") <= per_doc, "left": F.lit(per_doc) - F.col("through") + F.col("size")})
    part = F.when(F.col("whole"), F.col("chunk_text")).when(F.col("left") > 100, F.concat(F.expr("substring(chunk_text, 1, CAST(left AS INT))"), F.lit(CUT_MARK)))
    # a null is not collected: chunks beyond the limit stay out of the array
    shown = F.array_sort(F.collect_list(F.when(part.isNotNull(), F.struct("page_no", "chunk_id", part.alias("part")))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(shown, lambda x: x["part"]), "\n").alias("full_text"), F.count(F.lit(1)).alias("n_chunks"), F.sum("size").alias("chars"), F.coalesce(F.sum(F.when(F.col("whole"), F.col("size"))), F.lit(0)).alias("shown"))


def document_prompts(cases: DataFrame, texts: DataFrame) -> DataFrame:
    """``qid, system, user``: prompts over the full texts (``full_texts``) of each case's documents, in their order; an unknown document says so.

    ``cases`` has ``qid, question, options, answer_format, doc_ids``.
    """
    named = cases.select("qid", F.posexplode("doc_ids").alias("place", "doc_id")).join(texts, "doc_id", "left")
    part = F.when(F.col("full_text").isNull(), F.format_string(FULL_TEXT_NONE, "doc_id")).otherwise(F.format_string(FULL_TEXT, "doc_id", "n_chunks", "chars", "shown", "full_text"))
    named = named.select("qid", "place", part.alias("part"))
    joined = named.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda x: x["part"]), "\n\n").alias("documents"))
    letters = F.when(F.col("answer_format") == "multi", "多个选项字母，按字母顺序连写。").when(F.col("answer_format").isin("mcq", "tf"), "单个选项字母。").otherwise("选项字母。")
    ask_ = F.concat(F.lit("\n\n逐个选项独立判断：有直接证据的选，被证据排除的不选，无法确认的不选。"), option_scope(), F.lit("答案是"), letters, F.lit('\n输出JSON：{"answer":"AC","reasoning":"…"}'))
    user = F.concat(F.lit("文档全文：\n\n"), F.coalesce("documents", F.lit("")), F.lit("\n\n问题："), F.coalesce("question", F.lit("")), F.lit("\n选项：\n"), option_lines(), ask_)
    return cases.join(joined, "qid", "left").select("qid", F.lit("你负责阅读文档并答题。只依据给出的文档全文选择答案，不补充外部知识。").alias("system"), user.alias("user"))


def prejudgments(results: DataFrame) -> DataFrame:
    """``qid, prejudgment``: the verdicts so far as a block for the prompt, which the evidence may overrule. Questions without results have no row."""
    line = F.concat(F.lit("- 选项"), "option", F.lit("：本地初判="), "verdict")
    rows = results.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("option", line.alias("line")))).alias("found"))
    return rows.select("qid", F.concat(F.lit("\n本地初判（仅供参考，以证据为准，可推翻）：\n"), F.array_join(F.transform("found", lambda x: x["line"]), "\n"), F.lit("\n")).alias("prejudgment"))


# ------------------------------------------------------------------ prompts: templates are data, assembly is a projection
def option_lines() -> Column:
    """The options, each after its letter."""
    return F.array_join(F.transform("options", lambda o, i: F.concat(F.get(T.strings(list(P.OPTION_NAMES)), i), F.lit(". "), o)), "\n")


def option_scope() -> Column:
    """How many options there are, and that only they can be chosen."""
    n = F.size("options")
    return F.concat(F.lit("本题共有"), n.cast("string"), F.lit("个选项（A-"), F.get(T.strings(list(P.OPTION_NAMES)), n - 1), F.lit("），只能从中选择，不得选择未列出的选项。"))


def render_prompts(cases: DataFrame, templates: DataFrame, verify: bool = False) -> DataFrame:
    """``qid, system, user`` from templates by answer format and domain (``answer_format, domain, system, verify_system, instruction``).

    ``cases`` has ``qid, domain, question, options, answer_format, evidence_text``, to verify ``first_answer``, and at will ``prejudgment``. A domain without a template uses ``general``.
    """
    general = templates.where("domain = 'general'").drop("domain")
    own = cases.join(F.broadcast(templates), ["answer_format", "domain"], "left").join(F.broadcast(general.select("answer_format", *[F.col(c).alias(f"g_{c}") for c in ("system", "verify_system", "instruction")])), "answer_format", "left")
    of = lambda c: F.coalesce(c, f"g_{c}")
    parts = [F.lit("问题："), F.col("question"), F.lit("\n选项：\n"), option_lines(), F.lit("\n\n证据：\n"), F.coalesce("evidence_text", F.lit(NO_EVIDENCE)), F.lit("\n\n")]
    parts += [F.coalesce("prejudgment", F.lit(""))] if "prejudgment" in cases.columns else []
    parts += [F.lit("初步答案："), F.col("first_answer"), F.lit("\n")] if verify else []
    return own.select("qid", of("verify_system" if verify else "system").alias("system"), F.concat(*parts, of("instruction"), option_scope()).alias("user"))


def short_prompts(cases: DataFrame, evidence: DataFrame, chunks: int = 10, chars: int = 500) -> DataFrame:
    """``qid, evidence_text`` for a retry: the first ten chunks, 500 characters each."""
    rows = evidence.where(F.col("rank") <= chunks).withColumn("line", F.concat(F.col("rank").cast("string"), F.lit(". "), F.substring(T.collapse(F.col("chunk_text")), 1, chars)))
    texts = rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("evidence_text"))
    return cases.drop("evidence_text").join(texts, "qid", "left")


# ------------------------------------------------------------------ model output
def answer_object(text: Column) -> Column:
    """struct<answer, reasoning> from the JSON object in a reply, fenced or bare; null if there is none."""
    fenced = T.null_if_empty(F.regexp_extract(text, r"```(?:json)?\s*(\{[\s\S]*\})\s*```", 1))
    body = F.coalesce(fenced, T.null_if_empty(F.regexp_extract(text, r"(\{[\s\S]*\})", 1)))
    return F.from_json(body, "answer string, reasoning string")


# Wordings that name an answer.
_RAW_PATTERNS = [r"答案[是为：:\s]+([A-Fa-f]+)", r"正确答案[是为：:\s]+([A-Fa-f]+)", r"应选[为是：:\s]+([A-Fa-f]+)", r"选择[为了是：:\s]+([A-Fa-f]+)", r"选\s*([A-Fa-f]+)\s*[。\.]", r"^\s*([A-Fa-f]+)\s*$"]


def parse_reply(text: Column, answer_format: Column) -> Column:
    """The answer of a reply: from its JSON, else from wording that names one, else letters among the first 200 characters; null without any."""
    said = [T.null_if_empty(F.regexp_extract(text, "(?m)" + p, 1)) for p in _RAW_PATTERNS]
    letters = lambda x: F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(x), F.lit("[A-F]"), 0))), "")
    found = T.null_if_empty(letters(F.coalesce(T.null_if_empty(letters(F.coalesce(answer_object(text)["answer"], F.lit("")))), *said, F.substring(text, 1, 200))))
    return F.when(answer_format.isin("mcq", "tf"), F.substring(found, 1, 1)).otherwise(found)


ANSWERS = "qid string, reply string, prompt_tokens long, completion_tokens long"
Answerer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def ask_traced(prompts: DataFrame, answerer: Answerer, ladder: list[DataFrame] | None = None, log: str | None = None, calls: int = 8, timeout: float | None = 90) -> DataFrame:
    """``qid, attempt, success, reply, prompt_tokens, completion_tokens``: every attempt at every question.

    ``answerer`` is a pluggable model: an iterator function over batches of prompts. ``ladder`` holds simpler prompts for questions
    whose reply is null, tried one after another. Each step's replies are written before anything reads them, so a model is
    called once for each question and step, however often the result is used. With ``log``, a folder that all tasks reach, each reply is
    logged by the task that got it: tasks that are run again, and later runs with the same log, send no prompt a second time; ``calls`` bounds the
    calls at a time and ``timeout`` the seconds of each (see ``reply_log``).
    """
    tried: list[DataFrame] = []
    for n, step in enumerate([prompts, *(ladder or [])], 1):
        if tried:
            failed = tried[-1].where("not success").select("qid")
            if failed.isEmpty():
                break
            step = step.join(failed, "qid", "left_semi")
        replies = step.mapInPandas(answerer, ANSWERS) if log is None else logged_replies(step, n, answerer, log, calls, timeout)
        tried.append(stored(replies.select("qid", F.lit(n).alias("attempt"), F.col("reply").isNotNull().alias("success"), "reply", "prompt_tokens", "completion_tokens"), "replies"))
    out = tried[0]
    for more in tried[1:]:
        out = out.unionByName(more)
    return out


def ask(prompts: DataFrame, answerer: Answerer, ladder: list[DataFrame] | None = None, **logging) -> DataFrame:
    """``qid, reply, prompt_tokens, completion_tokens, attempts``: each question's last attempt of ``ask_traced``."""
    last = F.max_by(F.struct("reply", "prompt_tokens", "completion_tokens"), "attempt").alias("last")
    return ask_traced(prompts, answerer, ladder, **logging).groupBy("qid").agg(last, F.max("attempt").alias("attempts")).select("qid", "last.*", "attempts")


def combine_answers(cases: DataFrame, rule: DataFrame, replies: DataFrame | None = None, checks: DataFrame | None = None) -> DataFrame:
    """``qid, domain, answer, prompt_tokens, completion_tokens, total_tokens``: a verified reply before a first one before the rule's answer; tokens add up."""
    domain = F.col("domain") if "domain" in cases.columns else F.lit("unknown")
    out = cases.select("qid", domain.alias("domain"), "answer_format").join(rule, "qid", "left")
    tokens = {"prompt_tokens": F.lit(0).cast("long"), "completion_tokens": F.lit(0).cast("long")}
    answer = F.col("answer")
    for i, r in enumerate(x for x in (replies, checks) if x is not None):
        named = r.select("qid", *[F.col(c).alias(f"{c}_{i}") for c in ("reply", "prompt_tokens", "completion_tokens")])
        out = out.join(named, "qid", "left")
        answer = F.coalesce(parse_reply(F.col(f"reply_{i}"), F.col("answer_format")), answer)
        tokens = {k: v + F.coalesce(f"{k}_{i}", F.lit(0)) for k, v in tokens.items()}
    return out.select("qid", "domain", T.normalize_answer(answer).alias("answer"), *[v.alias(k) for k, v in tokens.items()]).withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))

"""Evidence per option, verdicts, and the quality of a round of retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import profiles as P
from docloom.functions import text as T

CALCULATION = P.CALCULATION_QUESTION


def option_rows(questions: DataFrame) -> DataFrame:
    """``qid, question, option, option_text``: a row for each of the first six options."""
    named = F.transform(F.slice("options", 1, len(P.OPTION_NAMES)), lambda o, i: F.struct(F.get(T.strings(list(P.OPTION_NAMES)), i).alias("option"), o.alias("option_text")))
    return questions.select("qid", "question", F.explode(named).alias("o")).select("qid", "question", "o.option", "o.option_text")


def token_counts(rows: DataFrame, by: list[str], tokens: Column) -> DataFrame:
    """``by``, ``token, tf``: counted in the tasks first, so a row's repeats are not shuffled."""
    return rows.select(*by, F.explode(tokens).alias("token")).groupBy(*by, "token").agg(F.count(F.lit(1)).alias("tf"))


def overlaps(asked: DataFrame, by: list[str], found: DataFrame) -> DataFrame:
    """``by``, ``rank, overlap``: shared tokens of ``asked`` (``by, token, tf``) and ``found`` (``qid, rank, token, tf``) as multisets, over the norm of the asked counts plus one.

    What ``text.overlap`` gives for two arrays, by a join of counts: work grows with tokens, not with their product. Pairs without a shared token have no row.
    """
    norm = asked.groupBy(*by).agg((F.sqrt(F.sum(F.col("tf") * F.col("tf")).cast("double")) + 1.0).alias("norm"))
    common = asked.join(found.select("qid", "rank", "token", F.col("tf").alias("there")), ["qid", "token"]).groupBy(*by, "rank").agg(F.sum(F.least("tf", "there")).alias("common"))
    return common.join(norm, by).select(*by, "rank", (F.col("common") / F.col("norm")).alias("overlap"))


def score_evidence(options: DataFrame, evidence: DataFrame, top: int | None = None) -> DataFrame:
    """Every option against every candidate of its question (at most some tens): ``evidence_score`` and ``evidence_rank``, up to ``top``.

    ``evidence`` has ``qid, rank`` (each pair once) and the chunk's columns; it is read several times, so it should be stored. Texts join only the rows that stay.
    """
    found = token_counts(evidence, ["qid", "rank"], T.tokens(F.coalesce("chunk_text", F.lit(""))))
    of_option = overlaps(token_counts(options, ["qid", "option"], T.tokens(F.col("option_text"))), ["qid", "option"], found)
    of_question = overlaps(token_counts(options.select("qid", "question").dropDuplicates(["qid"]), ["qid"], T.tokens(F.col("question"))), ["qid"], found)
    own = options.select("qid", "option", T.tokens(F.col("option_text")).alias("o_tokens"), F.array_distinct(T.plain_numbers(F.col("option_text"))).alias("o_numbers"))
    theirs = evidence.select("qid", "rank", T.plain_numbers(F.coalesce("clause_no", F.lit(""))).alias("clause_numbers"), F.array_distinct(T.plain_numbers(F.coalesce("chunk_text", F.lit("")))).alias("c_numbers"), T.tokens(F.coalesce("section_path", F.lit(""))).alias("s_tokens"))
    rows = own.join(theirs, "qid").join(of_option, ["qid", "option", "rank"], "left").join(of_question.withColumnRenamed("overlap", "q_overlap"), ["qid", "rank"], "left")
    shared = lambda a, b: F.size(F.array_intersect(a, b))
    clause = F.when(shared("o_numbers", "clause_numbers") > 0, 0.2).otherwise(0.0)
    number = F.least(0.15 * shared("o_numbers", "c_numbers"), F.lit(0.3))
    section = F.least(0.05 * shared("o_tokens", "s_tokens"), F.lit(0.15))
    none = F.lit(0.0)
    total = F.coalesce("overlap", none) + 0.3 * F.coalesce("q_overlap", none) + clause + number + section
    rank = F.row_number().over(Window.partitionBy("qid", "option").orderBy(F.desc("evidence_score"), "rank"))
    scored = rows.select("qid", "option", "rank", total.alias("evidence_score")).withColumn("evidence_rank", rank)
    scored = scored if top is None else scored.where(F.col("evidence_rank") <= top)
    return options.join(scored, ["qid", "option"]).join(evidence, ["qid", "rank"])


def has_substance() -> Column:
    """Whether the evidence holds one of the option's numbers, or, without any, three tenths of its tokens."""
    markers, tokens = F.col("markers"), F.array_distinct("o_tokens")
    squeezed = F.regexp_replace("top_text", r"(?U)\s+", "")
    marked = F.exists(markers, lambda m: F.contains(squeezed, F.regexp_replace(m, r"(?U)\s+", "")))
    share = T.hits(F.col("top_text"), tokens) / F.size(tokens)
    return F.when(F.size(markers) > 0, marked).when(F.size(tokens) == 0, F.lit(True)).otherwise(share >= 0.3)


def verdicts(options: DataFrame, evidence: DataFrame) -> DataFrame:
    """``qid, option, verdict, confidence, matched_numbers, top1_score, has_negation, evidence, reasoning`` for every option.

    ``evidence`` in the result holds the three best chunks in order. Options without any candidate are insufficient.
    """
    scored = score_evidence(options, evidence, 3)
    item = F.struct("evidence_rank", "evidence_score", "chunk_id", "doc_id", "page_no", "section_path", "chunk_type", "clause_no", "chunk_text")
    grouped = scored.groupBy("qid", "option").agg(F.array_sort(F.collect_list(item)).alias("evidence"))
    rows = options.join(grouped, ["qid", "option"], "left")
    rows = rows.withColumn("evidence", F.coalesce("evidence", F.array().cast(grouped.schema["evidence"].dataType)))
    rows = rows.withColumns({"scores": F.transform("evidence", lambda e: e["evidence_score"]), "top_text": F.array_join(F.transform("evidence", lambda e: e["chunk_text"]), " "), "o_tokens": T.tokens(F.col("option_text")), "markers": T.option_markers(F.col("option_text"))})
    rows = rows.withColumns({"top1_score": F.coalesce(F.get("scores", 0), F.lit(0.0)), "average": F.aggregate("scores", F.lit(0.0), lambda a, s: a + s) / F.greatest(F.size("scores"), F.lit(1)), "has_negation": T.has_negation(F.col("top_text")), "near": T.negation_near(F.col("top_text"), F.col("option_text"))})
    numbers = F.array_sort(F.array_intersect(T.plain_numbers(F.col("option_text")), T.plain_numbers(F.col("top_text"))))
    rows = rows.withColumn("matched_numbers", F.when(F.col("top1_score") < 0.1, T.strings([])).otherwise(numbers))
    low = [(F.col("top1_score") < 0.1, 0.1), (F.col("average") < 0.2, 0.2), (~has_substance(), 0.25)]
    negated = F.col("has_negation") & ~T.has_exception(F.col("top_text"))
    verdict = F.when(low[0][0] | low[1][0] | low[2][0], "insufficient").when(negated & F.col("near"), "refute").otherwise("support")
    average = F.col("average")
    sure = F.when(negated & F.col("near"), F.least(0.5 + average * 0.5, F.lit(0.85))).when(negated, F.least(0.4 + average * 0.4, F.lit(0.7))).otherwise(F.least(0.4 + average * 0.6, F.lit(0.9)))
    sure = F.when((verdict == "support") & (F.size("matched_numbers") > 0), F.least(sure + 0.1, F.lit(0.95))).otherwise(sure)
    confidence = F.when(low[0][0], 0.1).when(low[1][0], 0.2).when(low[2][0], 0.25).otherwise(F.round(sure, 2))
    rows = rows.withColumns({"verdict": verdict, "confidence": confidence})
    return explain(calculation_override(relative_threshold(rows))).select("qid", "option", "verdict", "confidence", "matched_numbers", "top1_score", "has_negation", "evidence", "reasoning")


def relative_threshold(rows: DataFrame) -> DataFrame:
    """Among three or more options with a positive best score, one below 0.35 of their median (over 0.1) becomes insufficient."""
    positive = F.when(F.col("top1_score") > 0, F.col("top1_score"))
    middle = rows.groupBy("qid").agg(F.median(positive).alias("middle"), F.count(positive).alias("n_positive"))
    weak = (F.col("verdict") != "insufficient") & (F.col("n_positive") >= 3) & (F.col("middle") > 0.1) & (F.col("top1_score") < 0.35 * F.col("middle"))
    out = rows.join(middle, "qid").withColumn("weak", F.coalesce(weak, F.lit(False)))
    return out.withColumns({"verdict": F.when(F.col("weak"), "insufficient").otherwise(F.col("verdict")), "confidence": F.when(F.col("weak"), 0.25).otherwise(F.col("confidence"))}).drop("weak", "middle", "n_positive")


def calculation_override(rows: DataFrame) -> DataFrame:
    """In questions that ask for a calculation, matching numbers turn insufficient into support."""
    turns = F.col("question").rlike(CALCULATION) & (F.col("verdict") == "insufficient") & (F.size("matched_numbers") > 0)
    return rows.withColumn("turns", turns).withColumns({"verdict": F.when(F.col("turns"), "support").otherwise(F.col("verdict")), "confidence": F.when(F.col("turns"), F.greatest("confidence", F.lit(0.5))).otherwise(F.col("confidence"))}).drop("turns")


def explain(rows: DataFrame) -> DataFrame:
    """Adds ``reasoning``: verdict and confidence, the best evidence and an excerpt, numbers, and how a negation was taken."""
    best = F.get("evidence", 0)
    head = F.concat(F.lit("选项"), "option", F.lit("判定："), "verdict", F.lit("（置信度"), F.bround(F.col("confidence") * 100, 0).cast("int").cast("string"), F.lit("%）"))
    place = F.concat(F.lit("doc="), best["doc_id"], F.lit(", p"), best["page_no"].cast("string"), F.when(F.coalesce(best["clause_no"], F.lit("")) != "", F.concat(F.lit(", 条款"), best["clause_no"])).otherwise(""))
    found = F.when(best.isNotNull(), F.concat(F.lit("关键证据["), place, F.lit("]；证据摘要："), F.substring(T.collapse(best["chunk_text"]), 1, 150)))
    numbers = F.when(F.size("matched_numbers") > 0, F.concat(F.lit("数值匹配："), F.array_join("matched_numbers", ",")))
    negation = F.when(F.col("has_negation") & (F.col("verdict") == "refute"), "检测到否定表述，判定为反驳").when(F.col("has_negation") & (F.col("verdict") == "support"), "虽含否定词但非针对本选项")
    open_ = F.when(F.col("verdict") == "insufficient", "证据不足，无法确认")
    return rows.withColumn("reasoning", F.concat_ws("；", head, found, numbers, negation, open_))


# ------------------------------------------------------------------ quality of a round
def evaluate_rounds(plans: DataFrame, evidence: DataFrame, results: DataFrame) -> DataFrame:
    """One row per question: ``quality_score, quality_label, decision, next_action, failure_reasons, insufficient_options`` and the rates behind them.

    ``plans`` has the plan's columns and ``options, question, current_docs`` (documents in use); ``evidence`` the candidates; ``results`` the options' verdicts.
    """
    empty = F.lit("")
    joined_text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(" ", *[F.coalesce(c, empty) for c in ("title", "section_path", "clause_no", "chunk_text")]).alias("t")))), lambda x: x["t"]), " ")
    asked = evidence.join(plans.select("qid", T.tokens(F.col("question")).alias("q_tokens")), "qid")
    section = F.coalesce(T.null_if_empty(F.col("section_path")), T.null_if_empty(F.col("title")), F.col("chunk_id"))
    found = asked.groupBy("qid").agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("doc_id").alias("doc_coverage"), F.countDistinct(section).alias("section_coverage"), F.max(T.overlap(F.col("q_tokens"), T.tokens(F.col("chunk_text")))).alias("question_overlap"), joined_text.alias("all_text"))
    judged = results.groupBy("qid").agg(F.count_if(F.col("verdict") != "insufficient").alias("decided"), F.count_if(F.col("verdict") == "insufficient").alias("n_open"), F.array_sort(F.collect_list(F.when(F.col("verdict") == "insufficient", F.col("option")))).alias("insufficient_options"))
    rows = plans.join(found, "qid", "left").join(judged, "qid", "left").na.fill(0, ["n_chunks", "doc_coverage", "section_coverage", "question_overlap", "decided", "n_open"])
    rows = rows.withColumn("insufficient_options", F.coalesce("insufficient_options", T.strings([])))
    rate = lambda c: F.when(F.size(c) > 0, F.size(F.filter(c, lambda x: F.contains(F.coalesce("all_text", empty), x))) / F.size(c)).otherwise(1.0)
    rows = rows.withColumns({"number_hit_rate": rate("numbers"), "clause_hit_rate": rate("clause_refs"), "focus_term_hit_rate": rate("focus_terms"), "n_options": F.size("options")})
    one = F.lit(1.0)
    score = (
        F.least(F.col("n_chunks"), F.lit(6)) / 6 * 0.18 + F.least("doc_coverage", "min_doc_coverage") / F.greatest("min_doc_coverage", F.lit(1)) * 0.20 + F.least(F.col("section_coverage"), F.lit(4)) / 4 * 0.14
        + F.least("question_overlap", one) * 0.12 + F.col("number_hit_rate") * 0.12 + F.col("clause_hit_rate") * 0.12 + F.col("focus_term_hit_rate") * 0.06
        + F.least(F.col("decided") / F.greatest("n_options", F.lit(1)), one) * 0.06
    )
    limit = F.when(F.col("answer_format").isin("multi", "tf") | (F.col("n_options") <= 2), 1).otherwise(F.greatest(F.floor(F.col("n_options") / 2), F.lit(2)))
    rules = [
        (F.col("doc_coverage") < F.col("min_doc_coverage"), "doc_coverage_low", "comparison_focus"),
        ((F.size("clause_refs") > 0) & (F.col("clause_hit_rate") < 1), "clause_coverage_low", "clause_focus"),
        ((F.size("numbers") > 0) & (F.col("number_hit_rate") < 1), "number_coverage_low", "numbers_focus"),
        (F.col("n_open") >= limit, "insufficient_options_high", "option_split"),
        ((F.col("section_coverage") <= 1) & (F.col("n_chunks") >= 2) & F.col("question_type").isin("comparison", "calculation"), "section_diversity_low", "diversify_sections"),
    ]
    failed = F.array_compact(F.array(*[F.when(c, F.lit(reason)) for c, reason, _ in rules]))
    rows = rows.withColumn("failed", failed)
    lone = (F.size("failed") == 0) & (F.col("focus_term_hit_rate") < 0.5)
    action = F.coalesce(F.when(lone, "section_focus"), *[F.when(c, a) for c, _, a in reversed(rules)], F.lit("accept"))
    none, homeless = F.col("n_chunks") == 0, F.coalesce(F.size("current_docs"), F.lit(0)) <= 0
    reasons = F.when(none, T.strings(["candidate_chunks_empty"])).otherwise(F.concat("failed", F.when(lone, T.strings(["focus_term_coverage_low"])).otherwise(T.strings([])), F.when(homeless, T.strings(["candidate_doc_ids_empty"])).otherwise(T.strings([]))))
    rows = rows.withColumns({"failure_reasons": reasons, "next_action": F.when(none | homeless, "broaden_docs").otherwise(action), "quality_score": F.when(none, 0.0).otherwise(F.round(score, 4))})
    label = F.when(none, "low").when(F.col("quality_score") >= 0.72, "high").when(F.col("quality_score") >= 0.5, "medium").otherwise("low")
    rows = rows.withColumns({"decision": F.when(F.size("failure_reasons") == 0, "accept").otherwise("retry"), "quality_label": label})
    return rows.select("qid", "quality_score", "quality_label", "decision", "next_action", "failure_reasons", "insufficient_options", "doc_coverage", "section_coverage", F.round("number_hit_rate", 4).alias("number_hit_rate"), F.round("clause_hit_rate", 4).alias("clause_hit_rate"), F.round("focus_term_hit_rate", 4).alias("focus_term_hit_rate"))

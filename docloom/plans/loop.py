"""The retrieval loop: all open questions advance together, three rounds at most.

Each round is a DataFrame program over the open questions. Its three results (candidates, verdicts, evaluation) are written
to the shared folder, which keeps plans short and survives lost executors; the driver only learns how many questions stay open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom import profiles as P
from docloom.functions import text as T
from docloom.operators import ranking, reasoning
from docloom.sources.shared import stored

from . import planner
from .ledger import Ledger


def resolve_documents(plans: DataFrame, prepared: DataFrame, available: DataFrame) -> DataFrame:
    """Adds ``current_docs``: mode A takes the named documents that are available; mode B ranks them, after those of the round before for questions over several."""
    ids = available.select("doc_id").distinct()
    named = plans.where("mode = 'A'").select("qid", F.posexplode("doc_ids").alias("place", "doc_id")).join(ids, "doc_id", "left_semi")
    chosen = named.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id"))), lambda x: x["doc_id"]).alias("named_docs"))
    ranked = ranking.rank_documents(planner.query_contexts(plans.where("mode = 'B'"), documents_only=True), prepared.join(ids, "doc_id", "left_semi"))
    found = ranked.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_rank", "doc_id"))), lambda x: x["doc_id"]).alias("ranked_docs"))
    none = T.strings([])
    both = F.slice(F.array_distinct(F.concat(F.coalesce("previous_docs", none), F.coalesce("ranked_docs", none))), 1, P.TOP_DOCS)
    docs = F.when(F.col("mode") == "A", F.coalesce("named_docs", none)).when(F.col("requires_multi_doc"), both).otherwise(F.coalesce("ranked_docs", none))
    return plans.join(chosen, "qid", "left").join(found, "qid", "left").withColumn("current_docs", docs).drop("named_docs", "ranked_docs")


def retrieve(plans: DataFrame, chunks: DataFrame, prepared: DataFrame, carried: DataFrame | None, first_round: bool) -> DataFrame:
    """``qid, rank`` and the chunk's columns."""
    contexts = planner.query_contexts(plans.withColumn("doc_ids", F.col("current_docs")))
    ranked = ranking.rank_chunks(contexts, prepared)
    if first_round:
        asked = plans.select("qid", "options", F.col("current_docs").alias("doc_ids"))
        ranked = ranking.add_numeric_chunks(stored(ranking.add_title_chunks(ranked, asked, chunks), "titles"), asked, chunks)
    elif carried is not None:
        ranked = ranking.add_carried(stored(ranked, "ranked"), carried.join(plans.select("qid"), "qid", "left_semi"))
    return ranked.join(chunks, "chunk_id")


def run_loop(questions: DataFrame, chunks: DataFrame, available: DataFrame, max_rounds: int = P.MAX_ROUNDS, resume: str | None = None) -> dict[str, DataFrame]:
    """``results`` (verdicts), ``evidence`` (candidates), ``evaluation`` and ``log`` of each question's chosen round.

    ``questions`` has ``qid, mode, question, options, answer_format, doc_ids``; ``available`` lists usable documents (``doc_id``). A round is
    accepted when nothing fails; after the last, the best round counts, the later where equal. Once an option has a verdict
    it keeps one: a later definite verdict replaces it, insufficient does not.

    ``resume`` names a folder for the run's steps (``ledger.Ledger``): a run that stopped goes on after its last whole step. It must have been made from the same tables.
    """
    ledger = Ledger(chunks.sparkSession, resume)
    ledger.check(questions=questions, chunks=chunks, available=available)
    prepared = ledger.keep("prepared", lambda: ranking.prepare_chunks(chunks))
    base = ledger.keep("plans", lambda: planner.build_plans(questions).withColumn("mode", F.coalesce("mode", F.lit("A"))))
    plans = planner.activate(base, F.lit("base")).withColumn("previous_docs", T.strings([]))
    done: list[tuple[DataFrame, DataFrame, DataFrame]] = []
    definite, carried = None, None
    for round_no in range(1, max_rounds + 1):
        step = lambda name, make, n=round_no: ledger.keep(f"{name}-{n}", make)
        planned, earlier = plans, carried
        plans = now_planned = step("round-plans", lambda p=planned: resolve_documents(p, prepared, available))
        evidence = step("evidence", lambda p=now_planned, c=earlier, n=round_no: retrieve(p, chunks, prepared, c, n == 1).withColumn("round", F.lit(n)))
        fresh = step("verdicts", lambda p=now_planned, e=evidence: reasoning.verdicts(reasoning.option_rows(p), e))
        sure = fresh.where("verdict != 'insufficient'").withColumn("round", F.lit(round_no))
        history = sure if definite is None else definite.unionByName(sure)
        latest = history.groupBy("qid", "option").agg(F.max_by(F.struct(*[c for c in sure.columns if c not in ("qid", "option", "round")]), "round").alias("last"))
        merged = fresh
        if definite is not None:
            kept = [F.coalesce(F.col(f"last.{c}"), F.col(c)).alias(c) for c in fresh.columns if c not in ("qid", "option", "evidence")]
            merged = fresh.join(latest, ["qid", "option"], "left").select("qid", "option", *kept, "evidence")
        merged = step("merged", lambda m=merged, n=round_no: m.withColumn("round", F.lit(n)))
        evaluation = step("evaluation", lambda p=now_planned, e=evidence, m=merged, n=round_no: reasoning.evaluate_rounds(p, e, m).withColumn("round", F.lit(n)))
        done.append((merged, evidence, evaluation))
        open_ = evaluation.where("decision = 'retry'").select("qid", "next_action", "insufficient_options")
        if round_no == max_rounds or open_.isEmpty():
            break
        definite = step("definite", lambda h=history: h)
        gaps = fresh.groupBy("qid").agg(F.array_sort(F.collect_list(F.when(F.col("verdict") == "insufficient", F.col("option")))).alias("gaps"))
        # evidence of options that have a verdict, in the order of options and ranks, goes along
        named = definite.select("qid", "option").distinct().join(fresh.select("qid", "option", F.posexplode("evidence").alias("n", "e")), ["qid", "option"])
        place = F.row_number().over(Window.partitionBy("qid").orderBy("option", "n"))
        now = named.select("qid", F.col("e.chunk_id").alias("chunk_id"), (place + 1000 * round_no).alias("place"))
        carried = now if carried is None else carried.unionByName(now)
        carried = step("carried", lambda c=carried: c.groupBy("qid", "chunk_id").agg(F.min("place").alias("place")))
        # the base plan again, with what this round left open
        plans = planner.gap_plans(base.join(open_, "qid").join(gaps, "qid", "left").join(plans.select("qid", F.col("current_docs").alias("previous_docs")), "qid")).drop("next_action", "insufficient_options", "gaps")
    return choose_rounds(done)


def choose_rounds(done: list[tuple[DataFrame, DataFrame, DataFrame]]) -> dict[str, DataFrame]:
    """Each question's accepted round, else its best."""

    def all_of(i: int) -> DataFrame:
        out = done[0][i]
        for r in done[1:]:
            out = out.unionByName(r[i])
        return out

    evaluation = all_of(2)
    best = evaluation.groupBy("qid").agg(F.max(F.struct((F.col("decision") == "accept").alias("accepted"), "quality_score", "round"))["round"].alias("round"))
    pick = lambda df: df.join(best, ["qid", "round"], "left_semi")
    log = evaluation.select("qid", "round", F.to_json(F.struct("quality_score", "quality_label", "decision", "next_action", "failure_reasons")).alias("entry"))
    return {"results": pick(all_of(0)), "evidence": pick(all_of(1)), "evaluation": pick(evaluation), "log": log}


def memory_ledger(results: DataFrame, questions: DataFrame) -> DataFrame:
    """Per question: documents and pages of each option's evidence, verdicts by option, what is missing, and whether to follow up."""
    fact = F.struct("option", F.array_sort(F.array_distinct(F.transform("evidence", lambda e: e["doc_id"]))).alias("doc_ids"), F.array_sort(F.array_distinct(F.transform("evidence", lambda e: e["page_no"]))).alias("page_nos"))
    rows = results.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.when(F.size("evidence") > 0, fact))).alias("facts"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("option", "verdict")))).alias("option_status"),
        F.array_sort(F.collect_list(F.when(F.col("verdict") == "insufficient", F.col("option")))).alias("missing_fields"), F.max(F.col("verdict") == "insufficient").alias("followup_needed"),
    )
    return questions.select("qid", F.array(F.substring("question", 1, 80)).alias("question_focus")).join(rows, "qid")

"""The engine's public face: ingest, rank, answer, evaluate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import profiles as P
from docloom.functions import text as T
from docloom.operators import answers, chunking, merge, ranking, reasoning, reports
from docloom.operators.pages import clean_pages
from docloom.sources import pdf, readers

from . import loop, planner, prompts


class Engine:
    """Long documents in, answers with evidence out. Every method takes and returns DataFrames."""

    def __init__(self, spark: SparkSession, profile: P.ChunkProfile = P.FINANCE):
        self.spark, self.profile = spark, profile

    # -------------------------------------------------------------- documents
    def ingest(self, root: str, domain: str | None = None, ocr: bool = False, timeout: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(documents, chunks) of the text, HTML and PDF files below ``root``; the first folder names the domain unless given.

        PDF files need one of the libraries of ``docloom.sources.pdf`` on the workers; without, or where a file fails or takes longer
        than ``timeout`` seconds, the document has a fallback chunk and the status failed.
        """
        files = readers.raw_files(self.spark, root)
        pages = readers.read_pages(files)
        policy = chunking.extraction_policy(F.col("file_type"), F.col("category"), F.col("size"), F.col("relative"))
        in_pdf = pdf.pages_with_tables(files.where("file_type = 'pdf'").withColumn("policy", policy).select("doc_id", "content", "policy.*"), ocr, timeout)
        named = files.select("doc_id", F.lit(domain).alias("domain") if domain else F.col("category").alias("domain"), F.col("doc_id").alias("title"), F.col("path").alias("source_path"), F.lit(True).alias("exists"))
        # HTML and PDF pages are cleaned line by line; plain text is taken as it is
        ready = clean_pages(pages.where("file_type = 'html'").drop("file_type").unionByName(in_pdf)).unionByName(pages.where("file_type = 'txt'").select("doc_id", "page_no", "text", T.section_path(F.col("text"), F.col("page_no")).alias("section_path")))
        chunks = chunking.with_fallbacks(chunking.chunk_pages(ready.join(named.select("doc_id", "title", "domain"), "doc_id"), self.profile), named)
        return named.join(chunking.manifest_counts(chunks), "doc_id"), chunks

    def postprocess(self, chunks: DataFrame) -> DataFrame:
        """Noise out, neighbours merged, formulas tagged, boilerplate once."""
        merged = merge.merge_neighbours(merge.clean_noise(chunks).drop("noise_removed"), self.profile)
        # a global order: documents by name, chunks as they come; numbers rise through the sorted partitions and are fixed by writing them
        ordered = merge.annotate_formulas(merged).orderBy("doc_id", "chunk_ord").withColumn("chunk_ord", F.monotonically_increasing_id())
        return merge.dedup_templates(loop.stored(ordered, "ordered"))

    # -------------------------------------------------------------- questions
    def rank(self, questions: DataFrame, chunks: DataFrame) -> DataFrame:
        """``qid, rank`` and chunks: the diversified top twelve of each question by its base plan."""
        contexts = planner.query_contexts(planner.activate(planner.build_plans(questions), F.lit("base")))
        return ranking.rank_chunks(contexts, ranking.prepare_chunks(chunks)).join(chunks, "chunk_id")

    def rank_documents(self, questions: DataFrame, chunks: DataFrame) -> DataFrame:
        contexts = planner.query_contexts(planner.activate(planner.build_plans(questions), F.lit("base")), documents_only=True)
        return ranking.rank_documents(contexts, ranking.prepare_chunks(chunks))

    def answer(self, questions: DataFrame, chunks: DataFrame, available: DataFrame | None = None, answerer: answers.Answerer | None = None, templates: DataFrame | None = None, reply_log: str | None = None, calls: int = 8, timeout: float | None = 90, resume: str | None = None) -> dict[str, DataFrame]:
        """The loop, then the rule's answer or a model's: ``answers, items, ledger`` beside the loop's tables.

        A model needs an ``answerer``; prompts come from ``templates`` or the default ones. Questions that ask for a check get a second call.
        ``reply_log`` names a folder for replies, so that neither a lost task nor a second run sends a prompt again; ``calls`` and ``timeout`` bound the calls.
        ``resume`` names a folder for the loop's steps, so that a stopped run goes on after its last whole one.
        """
        if answerer is not None and templates is None:
            templates = prompts.default_templates(self.spark)
        if "domain" not in questions.columns:
            questions = questions.join(planner.build_plans(questions).select("qid", "domain"), "qid")
        if "mode" not in questions.columns:
            questions = questions.withColumn("mode", F.lit("A"))
        available = chunks.select("doc_id").distinct() if available is None else available
        out = loop.run_loop(questions, chunks, available, resume=resume)
        rule = answers.choose_answers(out["results"], questions)
        replies = checks = None
        logging = {"log": reply_log, "calls": calls, "timeout": timeout}
        if answerer is not None:
            cases = questions.join(answers.pack_evidence(out["evidence"]), "qid", "left")
            short = answers.render_prompts(answers.short_prompts(cases, out["evidence"]), templates)
            replies = loop.stored(answers.ask(answers.render_prompts(cases, templates), answerer, [short, short], **logging), "replies")
            first = answers.combine_answers(questions, rule, replies).select("qid", F.col("answer").alias("first_answer"))
            again = answers.needs_self_check(out["results"], questions).where("self_check").select("qid")
            checks = loop.stored(answers.ask(answers.render_prompts(cases.join(again, "qid", "left_semi").join(first, "qid"), templates, verify=True), answerer, **logging), "checks")
        out["answers"] = answers.combine_answers(questions, rule, replies, checks)
        out["items"] = answers.evidence_items(out["results"])
        out["ledger"] = loop.memory_ledger(out["results"], questions)
        return out

    def run_cases(self, questions: DataFrame, chunks: DataFrame, available: DataFrame) -> DataFrame:
        """Question files as read (``readers.read_questions``), each run once without the loop: ``row, qid, domain, status, answer, n_docs, n_chunks, n_evidence, all_issues, candidate_doc_ids, missing_doc_ids, preview``.

        Candidates are the case's documents that are ``available`` (all chunks if none is); options are judged without the question, as a check of the corpus.
        Cases go by their row, so a repeated question id has a row each time. A case without options or a known format has no answer and fails.
        """
        cases = loop.stored(reports.case_issues(questions, available), "checked")
        row = F.col("row").cast("string")
        asked = cases.where("case_options is not null and case_format is not null").select(row.alias("qid"), F.coalesce("domain", F.lit("")).alias("case_domain"), F.coalesce("question", F.lit("")).alias("question"), F.col("case_options").alias("options"), F.col("case_format").alias("answer_format"), F.coalesce("doc_ids", T.strings([])).alias("doc_ids"), F.col("missing_doc_ids"))
        plans = planner.build_plans(asked).withColumns({"domain": F.coalesce(T.null_if_empty(F.col("case_domain")), F.col("domain")), "doc_ids": F.filter("doc_ids", lambda d: ~F.array_contains(F.col("missing_doc_ids"), d))})
        plans = loop.stored(plans, "case-plans")
        contexts = planner.query_contexts(planner.activate(plans, F.lit("base")))
        evidence = loop.stored(ranking.rank_chunks(contexts, loop.stored(ranking.prepare_chunks(chunks), "prepared")).join(chunks, "chunk_id"), "case-evidence")
        results = loop.stored(reasoning.verdicts(reasoning.option_rows(plans.withColumn("question", F.lit(""))), evidence), "case-verdicts")
        items = answers.evidence_items(results).groupBy("qid").agg(F.count(F.lit(1)).alias("n_evidence"), F.array_sort(F.collect_list(F.struct("n", F.substring("quoted_text", 1, 80).alias("text")))).alias("quoted"))
        found = plans.select("qid", F.col("doc_ids").alias("candidate_doc_ids"), F.size("doc_ids").alias("n_docs")).join(answers.choose_answers(results, plans), "qid", "left")
        found = found.join(evidence.groupBy("qid").agg(F.count(F.lit(1)).alias("n_chunks")), "qid", "left").join(items, "qid", "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        outcomes = found.select(F.col("qid").cast("long").alias("row"), "answer", "candidate_doc_ids", zero("n_docs"), zero("n_chunks"), zero("n_evidence"), F.transform(F.slice("quoted", 1, 2), lambda x: x["text"]).alias("preview"))
        return reports.case_status(cases, outcomes, "row").select("row", "qid", "domain", "status", "answer", "n_docs", "n_chunks", "n_evidence", "all_issues", "candidate_doc_ids", "missing_doc_ids", "preview")

    def diagnose(self, questions: DataFrame, chunks: DataFrame, qids: list[str], gold: DataFrame | None = None, **how) -> dict[str, DataFrame]:
        """``answer`` again for the questions in ``qids`` only, with all its tables; given ``gold`` also ``differences`` (letters missed and extra)."""
        out = self.answer(questions.where(F.col("qid").isin(list(qids))), chunks, **how)
        if gold is not None:
            out["differences"] = reports.letter_differences(out["answers"], gold)
        return out

    # -------------------------------------------------------------- reports
    def evaluate(self, answered: DataFrame, gold: DataFrame) -> DataFrame:
        return reports.accuracy(answered, gold)

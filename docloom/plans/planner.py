"""Query plans: columns computed from a question alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import profiles as P
from docloom.functions import text as T


def _when_chain(cases: list[tuple[Column, object]], otherwise: object) -> Column:
    out = None
    for condition, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def _mentions(text: Column, words: list[str]) -> Column:
    return text.rlike(T.literal_alternatives(words))


def detect_domain(text: Column) -> Column:
    """The first domain, in the order listed, with a term in the question and its options."""
    return _when_chain([(_mentions(text, words), d) for d, words in P.DOMAIN_TERMS.items()], "general")


def question_type(question: Column, merged: Column, answer_format: Column, n_docs: Column) -> Column:
    return _when_chain([
        (answer_format == "tf", "tf"),
        ((F.size(T.clause_refs(question, planner=True)) > 0) | _mentions(merged, P.CLAUSE_HINTS), "clause_lookup"),
        (_mentions(question, P.CALCULATION_HINTS), "calculation"),
        ((n_docs >= 2) | _mentions(merged, P.COMPARISON_HINTS), "comparison"),
        (answer_format == "multi", "multi_select"),
    ], "fact_lookup")


def focus_terms(merged: Column, domain: Column) -> Column:
    """The domain's terms that occur, else its first three."""
    cases = []
    for d, words in P.FOCUS_TERMS.items():
        found = T.terms_in(merged, words)
        cases.append((domain == d, F.when(F.size(found) > 0, found).otherwise(T.strings(words[:3]))))
    return _when_chain(cases, T.strings([]))


def hints_of(name: str, plan: dict[str, Column]) -> Column:
    """Hints of one rewrite, with what the question adds to it."""
    none = T.strings([])
    extra = {
        "base": [F.when(plan["question_type"] == "calculation", T.strings(P.CALCULATION_EXTRA)).otherwise(none)],
        "comparison_focus": [F.when(plan["question_type"] == "comparison", T.strings(P.COMPARISON_EXTRA)).otherwise(none), F.when(plan["domain"] == "financial_contracts", T.strings(P.CONTRACT_EXTRA)).otherwise(none)],
        "numbers_focus": [plan["numbers"]],
        "clause_focus": [plan["clause_refs"], F.when(plan["question_type"] == "clause_lookup", T.strings(P.CLAUSE_EXTRA)).otherwise(none)],
        "section_focus": [plan["focus_terms"]],
    }
    return F.concat(T.strings(P.REWRITES[name][1]), *extra.get(name, []))


PLAN_COLUMNS = ["domain", "answer_format", "question_type", "numbers", "clause_refs", "focus_terms", "requires_multi_doc", "min_doc_coverage", "max_rounds"]


def build_plans(questions: DataFrame) -> DataFrame:
    """Adds the plan's columns to questions (``qid, question, options, answer_format, doc_ids``). A given domain column is kept as ``stated_domain``."""
    if "domain" in questions.columns:
        questions = questions.withColumnRenamed("domain", "stated_domain")
    merged = F.concat(F.col("question"), F.lit(" "), F.array_join("options", " "))
    n_docs = F.coalesce(F.size("doc_ids"), F.lit(0))
    out = questions.withColumn("merged", merged).withColumn("domain", detect_domain(F.col("merged")))
    out = out.withColumns({"numbers": T.numbers(F.col("question")), "clause_refs": T.clause_refs(F.col("question"), planner=True), "question_type": question_type(F.col("question"), F.col("merged"), F.col("answer_format"), n_docs), "focus_terms": focus_terms(F.col("merged"), F.col("domain"))})
    return out.withColumns({"requires_multi_doc": (n_docs >= 2) | (F.col("question_type") == "comparison"), "min_doc_coverage": F.least(F.greatest(n_docs, F.lit(1)), F.lit(2)), "max_rounds": F.lit(P.MAX_ROUNDS)}).drop("merged")


def activate(plans: DataFrame, rewrite: Column, option_focus: Column | None = None) -> DataFrame:
    """Sets ``active_rewrite, query_rewrite, query_hints, option_focus``; an unknown name acts as base."""
    plan = {c: F.col(c) for c in ("question_type", "domain", "numbers", "clause_refs", "focus_terms")}
    out = plans.withColumn("active_rewrite", F.when(rewrite.isin(list(P.REWRITES)), rewrite).otherwise("base"))
    name = F.col("active_rewrite")
    return out.withColumns({
        "query_rewrite": _when_chain([(name == n, text) for n, (text, _) in P.REWRITES.items()], ""),
        "query_hints": _when_chain([(name == n, hints_of(n, plan)) for n in P.REWRITES], T.strings([])),
        "option_focus": option_focus if option_focus is not None else T.strings([]),
    })


def rewrite_for(action: Column) -> Column:
    """The rewrite that answers an evaluation's next action."""
    return _when_chain([(action == a, r) for a, r in P.ACTION_REWRITES.items()], "base")


def options_named(options: Column, names: Column) -> Column:
    """The options whose letter is in ``names``, in order."""
    letters = T.strings(list(P.OPTION_NAMES))
    return F.filter(options, lambda o, i: F.array_contains(names, F.get(letters, i)))


def gap_plans(plans: DataFrame) -> DataFrame:
    """Next round's plans from ``next_action``, ``gaps`` and ``insufficient_options`` (letters): a rewrite by the action, and the open options as focus and hints.

    Every round starts from the base plan. Options that are still open come first as focus, with their first 60 characters as hints.
    """
    open_ = options_named(F.col("options"), F.col("gaps"))
    asked = F.when(F.size("insufficient_options") > 0, options_named(F.col("options"), F.col("insufficient_options"))).otherwise(F.col("options"))
    split = F.when(F.col("next_action") == "option_split", asked).otherwise(T.strings([]))
    out = activate(plans.withColumn("_open", open_).withColumn("_split", split), F.when(F.col("next_action") == "accept", F.lit("base")).otherwise(rewrite_for(F.col("next_action"))))
    has = (F.size("_open") > 0) & (F.col("next_action") != "accept")
    hints = F.concat("query_hints", F.transform("_open", lambda o: F.substring(o, 1, 60)))
    return out.withColumns({"query_hints": F.when(has, hints).otherwise(F.col("query_hints")), "option_focus": F.when(has, F.col("_open")).otherwise(F.col("_split"))}).drop("_open", "_split")


def query_contexts(plans: DataFrame, documents_only: bool = False) -> DataFrame:
    """Adds what ranking needs: ``query_text, query_tokens, q_numbers, q_refs, section_terms, exact_phrases, high_value_terms``.

    ``documents_only`` leaves the options out, as for ranking documents by the question.
    """
    blank = lambda arr: F.filter(arr, lambda x: T.strip(x) != "")
    focus = F.when(F.size("option_focus") > 0, F.col("option_focus")).otherwise(T.strings([]) if documents_only else F.col("options"))
    text = T.strip(F.array_join(F.concat(F.array("question", "query_rewrite"), blank(F.col("query_hints")), blank(focus)), " "))
    out = plans.withColumn("query_text", text)
    out = out.withColumn("query_tokens", T.expand_synonyms(F.col("query_text"), T.tokens(F.col("query_text"))))
    own = lambda given, found: F.when(F.size(given) > 0, F.col(given)).otherwise(F.array_distinct(found))
    out = out.withColumns({"q_numbers": own("numbers", T.numbers(F.col("query_text"))), "q_refs": own("clause_refs", T.clause_refs(F.col("query_text"))), "section_terms": F.array_distinct(F.concat(T.terms_in(F.col("query_text"), P.SECTION_TERMS), "focus_terms")), "exact_phrases": T.exact_phrases(F.col("query_text"))})
    return out.withColumn("high_value_terms", T.high_value_terms(F.col("query_text"), F.col("query_tokens"), F.col("q_numbers"), F.col("q_refs"), F.col("section_terms")))

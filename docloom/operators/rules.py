"""Ranking rules from pattern hits: questions that range over the corpus are rated without holding every chunk against every question.

All phrases, terms, numbers and references of the questions go into one automaton, which is broadcast; the corpus streams past it once and gives a row for
each (chunk, pattern) that occurs, with the fields it occurs in. Hits join the questions that hold the pattern, and the rules are scored from counts. Texts are never shuffled.

A chunk that no pattern hits and that shares no token with a question has a score that depends on the question's domain and on whether it asks for numbers
only. Hits never lower a score, so of such chunks only few can be chosen: the best ``top`` of a section, in the best ``top`` sections of a document, in the best
``top`` documents of each kind of question. The choice is the same as from all chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import profiles as P
from docloom.functions import text as T
from docloom.sources.shared import bound_batches, stored

#: Characters of the patterns of one automaton, at most (but for a single question's); more questions take further passes.
PATTERN_CHARS = 8 << 20
FORM, TEXT, SECTION, TITLE, CLAUSE = 1, 2, 4, 8, 16
COUNTS = ["phrases", "terms", "clauses", "ref_sections", "ref_texts", "section_hits", "title_hits", "numbers"]


def _some(text: Column, words: list[str]) -> Column:
    return text.rlike(T.literal_alternatives(words))


def chunk_features() -> dict[str, Column]:
    """What the rules need of a chunk besides hits."""
    section, text = (F.coalesce(c, F.lit("")) for c in ("section_path", "chunk_text"))
    clause, is_table = F.coalesce("clause_no", F.lit("")), F.coalesce(F.col("chunk_type") == "table", F.lit(False))
    per_domain = {"regulatory": F.when(F.col("chunk_type") == "clause", 2.5).otherwise(0.0), "financial_reports": F.when(is_table, 3.0).otherwise(0.0), "financial_contracts": F.when(clause != "", 1.5).otherwise(0.0)}
    by_domain = [(per_domain.get(name, F.lit(0.0)) + F.when(_some(section, words), bonus).otherwise(0.0)).alias(name) for name, (words, bonus) in P.DOMAIN_SECTION_TERMS.items()]
    outline = F.contains(section, F.lit(P.OUTLINE_WORD)) | F.contains(F.substring(text, 1, 30), F.lit(P.OUTLINE_WORD))
    return {"is_table": is_table, "outline": outline, "short": F.length(T.strip(text)) < 20, "by_domain": F.struct(*by_domain)}


def boost(counts: dict[str, Column], n_refs: Column, n_numbers: Column, q_domain: Column) -> Column:
    """The additive rules, from counts of hits (``COUNTS``) and a chunk's features."""
    refs = F.when(counts["clauses"] > 0, F.lit(8.0)).otherwise(3.0 * counts["ref_sections"] + 2.0 * counts["ref_texts"])
    sections = F.least(counts["section_hits"], F.lit(2)) * 2.5 + F.least(counts["title_hits"], F.lit(1)) * 1.5
    matched = counts["numbers"]
    numbers = F.when(matched > 0, 2.0 + 1.2 * matched + F.when(matched == n_numbers, 2.0).otherwise(0.0)).otherwise(0.0)
    domain = F.lit(0.0)
    for name in P.DOMAIN_SECTION_TERMS:
        domain = F.when(q_domain == name, F.col("by_domain")[name]).otherwise(domain)
    return (
        F.least(counts["phrases"], F.lit(2)) * 2.5 + F.least(counts["terms"], F.lit(6)) * 0.7 + F.when(counts["terms"] >= 2, 1.0).otherwise(0.0)
        + F.when(n_refs > 0, refs).otherwise(0.0) + sections + numbers + domain
        + F.when(F.col("is_table") & (n_numbers > 0), 1.2).otherwise(0.0) - F.when(F.col("outline"), 6.0).otherwise(0.0) - F.when(F.col("short"), 1.5).otherwise(0.0)
    )


def rule_boost() -> Column:
    """The rules over a chunk joined with its question's context, each term looked for in place."""
    section, text, title = (F.coalesce(c, F.lit("")) for c in ("section_path", "chunk_text", "title"))
    form, clause = F.col("search_text"), F.coalesce("clause_no", F.lit(""))
    found_in_form = lambda terms: F.size(F.filter(terms, lambda t: (T.search_form(t) != "") & F.contains(form, T.search_form(t))))
    counts = {
        "phrases": found_in_form(F.filter("exact_phrases", lambda p: F.length(p) >= 4)),
        "terms": found_in_form(F.col("high_value_terms")),
        "clauses": ((clause != "") & F.array_contains("q_refs", clause)).cast("int"),
        "ref_sections": T.hits(section, F.col("q_refs")), "ref_texts": T.hits(text, F.col("q_refs")),
        "section_hits": T.hits(section, F.col("section_terms")), "title_hits": T.hits(title, F.col("section_terms")),
        "numbers": F.size(F.array_distinct(F.filter("q_numbers", lambda n: (n != "") & (F.contains(text, n) | F.contains(section, n) | F.contains(title, n))))),
    }
    return boost(counts, F.size("q_refs"), F.size("q_numbers"), F.col("q_domain"))


# ------------------------------------------------------------------ hits
def question_patterns(asked: DataFrame) -> DataFrame:
    """``qid, pattern`` and how often it stands among the question's phrases, terms, references, section terms and numbers."""
    kinds = {"n_phrase": F.filter("exact_phrases", lambda p: F.length(p) >= 4), "n_term": F.col("high_value_terms"), "n_ref": F.col("q_refs"), "n_section": F.col("section_terms"), "n_number": F.array_distinct("q_numbers"), "n_signal": F.col("exact_phrases")}
    of_kind = lambda kind: lambda p: F.struct(p.alias("pattern"), F.lit(kind).alias("kind"))
    each = [F.transform(c, of_kind(k)) for k, c in kinds.items()]
    rows = asked.select("qid", F.explode(F.concat(*each)).alias("p")).select("qid", "p.*").where("pattern != ''")
    return rows.groupBy("qid", "pattern").agg(*[F.count_if(F.col("kind") == k).cast("int").alias(k) for k in kinds])


class Finder:
    """Which of many patterns occur in a text: an automaton where the library is there, else one search for each."""

    def __init__(self, patterns: dict[str, list[int]]):
        self.patterns = patterns
        try:
            import ahocorasick
        except ImportError:
            self.automaton = None
            return
        self.automaton = ahocorasick.Automaton()
        for text, ids in patterns.items():
            self.automaton.add_word(text, ids)
        if patterns:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> set[int]:
        if not text or not self.patterns:
            return set()
        found = (ids for _, ids in self.automaton.iter(text)) if self.automaton is not None else (ids for p, ids in self.patterns.items() if p in text)
        return {i for ids in found for i in ids}


def pattern_hits(prepared: DataFrame, patterns: DataFrame) -> DataFrame:
    """``chunk_id, doc_id, norm_domain, pattern, places``: a row for each pattern that a chunk holds, with the fields as bits. One pass over the corpus.

    ``patterns`` has ``pattern`` and its ``form``: a list of bounded size, which the driver reads.
    """
    spark = prepared.sparkSession
    bound_batches(spark)
    listed = [(r["pattern"], r["form"]) for r in patterns.select("pattern", "form").collect()]  # at most PATTERN_CHARS of text
    shared = spark.sparkContext.broadcast(listed)
    built: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [p for p, _ in shared.value]
        if not built:
            forms: dict[str, list[int]] = {}
            for i, (_, form) in enumerate(shared.value):
                if form:
                    forms.setdefault(form, []).append(i)
            built.extend([Finder(forms), Finder({p: [i] for i, p in enumerate(names)}), {p: i for i, p in enumerate(names)}])
        in_form, in_text, clauses = built
        for batch in batches:
            at, pattern, places = [], [], []
            for n, (form, text, section, title, clause) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3, 8)), strict=True)):
                found = dict.fromkeys(in_form(form), FORM)
                for value, bit in ((text, TEXT), (section, SECTION), (title, TITLE)):
                    for i in in_text(value):
                        found[i] = found.get(i, 0) | bit
                if clause and clause in clauses:
                    found[clauses[clause]] = found.get(clauses[clause], 0) | CLAUSE
                at += [n] * len(found)
                pattern += [names[i] for i in found]
                places += found.values()
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in range(3)], pa.array(pattern, pa.string()), pa.array(places, pa.int32())], ["chunk_id", "doc_id", "norm_domain", "pattern", "places"])

    texts = prepared.select("chunk_id", "doc_id", "norm_domain", "search_text", "chunk_text", "section_path", "title", "clause_no")
    return texts.mapInArrow(run, "chunk_id string, doc_id string, norm_domain string, pattern string, places int")


def question_hits(asked: DataFrame, prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For questions over the corpus: ``qid, chunk_id`` and ``COUNTS``, and ``qid, doc_id, n_signals`` (distinct patterns in a document)."""
    own = stored(question_patterns(asked).join(asked.select("qid", "only_domain"), "qid").withColumn("form", T.search_form(F.col("pattern"))), "question-patterns")
    chars = own.agg(F.sum(F.length("pattern") + F.length("form"))).first()[0] or 0
    packs = max(1, -(-int(chars) // PATTERN_CHARS))
    hits = signals = None
    for i in range(packs):
        pack = own.where(F.pmod(F.xxhash64("qid"), F.lit(packs)) == i)
        found = stored(pattern_hits(prepared, pack.select("pattern", "form").distinct()), "pattern-hits")
        pairs = found.join(F.broadcast(pack.drop("form")), "pattern").where("only_domain is null or norm_domain = only_domain")  # a pack is bounded
        at = lambda bits: (F.col("places").bitwiseAND(F.lit(bits)) != 0)
        count = lambda n, bits: F.sum(F.when(at(bits), F.col(n)).otherwise(0)).cast("int")
        counted = pairs.groupBy("qid", "chunk_id").agg(
            count("n_phrase", FORM).alias("phrases"), count("n_term", FORM).alias("terms"), count("n_ref", CLAUSE).alias("clauses"), count("n_ref", SECTION).alias("ref_sections"), count("n_ref", TEXT).alias("ref_texts"),
            count("n_section", SECTION).alias("section_hits"), count("n_section", TITLE).alias("title_hits"), count("n_number", TEXT | SECTION | TITLE).alias("numbers"),
        )
        distinct = pairs.where(at(FORM)).select("qid", "doc_id", "pattern").distinct().groupBy("qid", "doc_id").agg(F.count(F.lit(1)).alias("n_signals"))
        hits = counted if hits is None else hits.unionByName(counted)
        signals = distinct if signals is None else signals.unionByName(distinct)
    return hits, signals


# ------------------------------------------------------------------ chunks without hits
def _known(q_domain: Column) -> Column:
    """A domain that rules name; others are alike."""
    return F.when(q_domain.isin(*P.DOMAIN_SECTION_TERMS), q_domain).otherwise("")


def kind_of_question() -> dict[str, Column]:
    """What decides the score of a chunk without hits: the candidates' domain, the question's, and whether it asks for numbers."""
    return {"pool": F.coalesce("only_domain", F.lit("")), "kind_domain": _known(F.col("q_domain")), "asks_numbers": F.size("q_numbers") > 0}


KIND = ["pool", "kind_domain", "asks_numbers"]


def plain_scores(asked: DataFrame, features: DataFrame) -> DataFrame:
    """``KIND`` and each chunk of the pool with ``plain``, its score without hits. There are few kinds: two for each domain that questions have."""
    kinds = asked.select(*[c.alias(n) for n, c in kind_of_question().items()]).distinct()
    rows = features.withColumn("pool", F.explode(F.array_distinct(F.array(F.lit(""), "norm_domain")))).join(kinds, "pool")
    none = dict.fromkeys(COUNTS, F.lit(0))
    return rows.withColumn("plain", boost(none, F.lit(0), F.when(F.col("asks_numbers"), 1).otherwise(0), F.col("kind_domain")))


def _first(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("plain"), "chunk_ord"))
    return rows.withColumn("_n", order).where(F.col("_n") <= k).drop("_n")  # limited in each task before the shuffle


def plain_choice(plain: DataFrame, top: int) -> DataFrame:
    """The chunks without hits that a choice of ``top`` can take: ``KIND, chunk_id``."""
    best = lambda rows, by: rows.groupBy(*KIND, *by).agg(F.max(F.struct("plain", (-F.col("chunk_ord")).alias("minus"))).alias("m")).select(*KIND, *by, "m.plain", (-F.col("m.minus")).alias("chunk_ord"))
    docs = _first(best(plain, ["doc_id"]), KIND, top).select(*KIND, "doc_id")
    rows = plain.join(F.broadcast(docs), [*KIND, "doc_id"], "left_semi")  # top documents for each kind
    sections = _first(best(rows, ["doc_id", "section_key"]), [*KIND, "doc_id"], top).select(*KIND, "doc_id", "section_key")
    rows = rows.join(F.broadcast(sections), [*KIND, "doc_id", "section_key"], "left_semi")  # top times top for each kind
    return _first(rows, [*KIND, "doc_id", "section_key"], top).select(*KIND, "chunk_id")

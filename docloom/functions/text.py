"""Text functions as Column expressions: everything stays in the JVM but HTML entities, for which Spark has no function."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, StringType

from docloom import profiles as P

LINE_BREAKS = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def strings(values: list[str] | tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>") if values else F.array().cast("array<string>")


def any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def literal_alternatives(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


#: What ``(?U)\\s`` means to Java: controls 9 to 13, next line, and Unicode's separators.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space at both ends, Unicode spaces included: only the ends are looked at, where a pattern would try every character."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def collapse(text: Column, by: str = " ") -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", by))


def search_form(text: Column) -> Column:
    """Lower case without any white space: the form in which terms are looked for."""
    return F.regexp_replace(F.lower(text), r"(?U)\s+", "")


def null_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


@pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """HTML entities decoded once."""
    return texts.map(lambda t: html.unescape(t) if isinstance(t, str) and "&" in t else t)


def normalize(text: Column, entities: bool = True) -> Column:
    """NUL to blank, line ends to LF, entities, runs of blanks and tabs to one blank, three or more LF to two, ends stripped."""
    out = F.regexp_replace(F.regexp_replace(text, "\\x00", " "), r"\r\n?", "\n")
    out = F.coalesce(unescape(F.when(F.contains(out, F.lit("&")), out)), out) if entities else out  # other texts never leave the JVM
    return strip(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def lines(text: Column) -> Column:
    """Lines with their white space collapsed, empty ones left out."""
    return F.filter(F.transform(F.split(text, LINE_BREAKS), lambda x: collapse(x)), lambda x: x != "")


def is_page_marker(line: Column) -> Column:
    return (line == "") | line.rlike(P.PAGE_MARKER)


def is_noise_line(line: Column) -> Column:
    """Page markers (a bare number counts), notices, contacts and links."""
    return is_page_marker(line) | line.rlike("(?i)" + any_of(P.NOISE_LINES))


def clause_no(text: Column, profile: P.ChunkProfile = P.FINANCE) -> Column:
    return null_if_empty(F.regexp_extract(text, profile.clause, 1))


def section_path(text: Column, page_no: Column) -> Column:
    """The first heading, chapters before sections before numbered items; else the page's name."""
    heads = [rf"(?U)(第{P.NUMERAL}+章[^\n]{{0,30}})", rf"(?U)(第{P.NUMERAL}+节[^\n]{{0,30}})", r"([一二三四五六七八九十]+、[^\n]{0,30})"]
    found = [F.when(text.rlike(h), strip(F.regexp_extract(text, h, 1))) for h in heads]
    return F.coalesce(*found, F.concat(F.lit("第"), page_no.cast("string"), F.lit("页")))


# ------------------------------------------------------------------ tokens and terms
def tokens(text: Column) -> Column:
    """Search tokens of a text, in order and with repeats.

    A run of Han characters gives itself (up to 8), all its bigrams, and its trigrams (up to 4); a run of Latin letters, digits, dot
    and percent gives itself. Single characters and stop words are left out.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit("[\\u4e00-\\u9fff]+|[a-zA-Z0-9.%]+"), 0)

    def grams(run: Column, n: int) -> Column:
        count = F.length(run) - (n - 1)
        return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substr(run, i, F.lit(n)))).otherwise(strings([]))

    def of_run(run: Column) -> Column:
        size = F.length(run)
        han = run.rlike("^[\\u4e00-\\u9fff]")
        whole = F.when(size <= 8, F.array(run)).otherwise(strings([]))
        short = F.when(size <= 4, grams(run, 3)).otherwise(strings([]))
        return F.when(han, F.concat(whole, grams(run, 2), short)).otherwise(F.array(run))

    every = F.filter(F.flatten(F.transform(runs, of_run)), lambda t: (F.length(t) > 1) & ~t.isin(P.STOP_WORDS))
    return F.when(text.rlike("[\\u4e00-\\u9fff]"), every).otherwise(latin_tokens(text))  # texts without Han characters need no grams


def latin_tokens(text: Column) -> Column:
    """The Latin branch alone: what ``tokens`` gives for texts without Han characters."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9.%]+"), 0), lambda t: F.length(t) > 1)


def numbers(text: Column) -> Column:
    """Numbers with an optional percent sign; a unit such as 年 is never part of one."""
    return F.regexp_extract_all(text, F.lit(P.NUMBER), 0)


def plain_numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(P.PLAIN_NUMBER), 0)


def clause_refs(text: Column, planner: bool = False) -> Column:
    return F.regexp_extract_all(text, F.lit(P.PLAN_CLAUSE_REF if planner else P.CLAUSE_REF), 0)


def terms_in(text: Column, words: list[str]) -> Column:
    """Which of ``words`` occur, in the list's order."""
    return F.filter(strings(words), lambda w: F.contains(text, w))


def hits(text: Column, words: Column) -> Column:
    """How many of ``words`` occur."""
    return F.size(F.filter(words, lambda w: (w != "") & F.contains(text, w)))


def exact_phrases(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit("[\\u4e00-\\u9fff]{4,}|[A-Za-z0-9.%]{3,}"), 0)
    return F.slice(F.array_distinct(F.filter(found, lambda w: ~w.isin(P.STOP_WORDS))), 1, 16)


def high_value_terms(text: Column, query_tokens: Column, numbers_: Column, refs: Column, sections: Column) -> Column:
    every = F.array_distinct(F.concat(refs, numbers_, sections, query_tokens, F.array(text)))
    return F.slice(F.filter(every, lambda t: (F.length(t) > 1) & ~t.isin(P.STOP_WORDS)), 1, 24)


def expand_synonyms(text: Column, query_tokens: Column) -> Column:
    """Query tokens and the tokens of every synonym group that has a term in the text; ordered, distinct."""
    low = F.lower(text)
    extra = [F.when(low.rlike(literal_alternatives(g)), F.flatten(F.array(*[tokens(F.lit(t)) for t in g]))).otherwise(strings([])) for g in P.SYNONYM_GROUPS]
    return F.array_distinct(F.concat(query_tokens, *extra))


#: Characters of a synonym table that go along with each question at once.
SYNONYM_CHARS = 4 << 20


def expand_by_table(rows: DataFrame, synonyms: DataFrame, text: str, tokens_col: str, domain: str = "domain", most: int = SYNONYM_CHARS) -> DataFrame:
    """``rows`` with the tokens of every synonym group that has a term in ``text`` added to ``tokens_col``; ordered by group, distinct.

    ``synonyms`` has ``domain`` (``_global``: for all) and ``terms`` (an array). The table's size is counted first: up to ``most`` characters it is one
    array beside each question, a larger one is dealt by hash into as many as it takes, each broadcast apart. Null domains, terms and texts fit nothing.
    """
    chars = synonyms.agg(F.sum(F.coalesce(F.aggregate(F.filter("terms", lambda t: t.isNotNull()), F.lit(0).cast("long"), lambda n, t: n + F.length(t)), F.lit(0)))).first()[0] or 0
    blocks = max(1, -(-int(chars) // most))
    groups = synonyms.select("domain", F.filter("terms", lambda t: t.isNotNull()).alias("terms")).withColumn("tokens", F.flatten(F.transform("terms", tokens)))
    fits = lambda g: F.coalesce(((g["domain"] == "_global") | (g["domain"] == F.col(domain))) & F.exists(g["terms"], lambda t: F.contains(F.lower(F.col(text)), F.lower(t))), F.lit(False))
    found, out = [], rows
    for i in range(blocks):
        block = groups.where(F.pmod(F.xxhash64("domain", "terms"), F.lit(blocks)) == i).agg(F.collect_list(F.struct("domain", "terms", "tokens")).alias(f"_groups{i}"))
        out = out.join(F.broadcast(block), F.lit(True)).withColumn(f"_groups{i}", F.filter(f"_groups{i}", fits))  # one row
        found.append(f"_groups{i}")
    extra = F.flatten(F.transform(F.array_sort(F.concat(*found)), lambda g: g["tokens"]))
    return out.withColumn(tokens_col, F.array_distinct(F.concat(tokens_col, extra))).drop(*found)


def normalize_domain(domain: Column) -> Column:
    low = F.lower(domain)
    known = F.create_map(*[F.lit(x) for kv in P.DOMAIN_ALIASES.items() for x in kv])
    return F.when(F.coalesce(domain, F.lit("")) == "", "general").otherwise(F.coalesce(F.element_at(known, low), low))


def overlap(query_tokens: Column, text_tokens: Column) -> Column:
    """Shared tokens as multisets, over the norm of the query's counts plus one."""
    distinct = F.array_distinct(query_tokens)
    count = lambda arr, t: F.size(F.filter(arr, lambda x: x == t))
    common = F.aggregate(distinct, F.lit(0), lambda a, t: a + F.least(count(query_tokens, t), count(text_tokens, t)))
    norm = F.aggregate(distinct, F.lit(0), lambda a, t: a + count(query_tokens, t) * count(query_tokens, t))
    return F.when((F.size(query_tokens) == 0) | (F.size(text_tokens) == 0), F.lit(0.0)).otherwise(common / (F.sqrt(norm.cast("double")) + 1.0))


# ------------------------------------------------------------------ evidence predicates
def option_markers(option: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(option, F.lit(P.OPTION_MARKER), 0))


def has_negation(text: Column) -> Column:
    return text.rlike(any_of(P.NEGATIONS))


def has_exception(text: Column) -> Column:
    return text.rlike(any_of(P.EXCEPTIONS))


_NEGATION = re.compile(any_of(P.NEGATIONS))
_EACH_NEGATION = [re.compile(p) for p in P.NEGATIONS]
_TOKEN_RUN = re.compile("[\\u4e00-\\u9fff]+|[A-Za-z0-9.%]+")


def python_tokens(text: str) -> list[str]:
    """``tokens`` for the few places that need match offsets."""
    out: list[str] = []
    for run in _TOKEN_RUN.findall(text.lower()):
        if run[0] < "一":
            out.append(run)
            continue
        sizes = ([len(run)] if len(run) <= 8 else []) + [2] + ([3] if len(run) <= 4 else [])
        out += [run[i : i + n] for n in sizes for i in range(len(run) - n + 1)]
    return [t for t in out if len(t) > 1 and t not in P.STOP_WORDS]


@pandas_udf(BooleanType())
def negation_near(texts: pd.Series, options: pd.Series) -> pd.Series:
    """Whether some negation has a token of the option within 50 characters on either side: needs offsets of overlapping matches."""

    def near(text: str, option: str) -> bool:
        wanted = set(python_tokens(option or ""))
        for pattern in _EACH_NEGATION if wanted and _NEGATION.search(text or "") else []:
            for m in pattern.finditer(text):
                if wanted.intersection(python_tokens(text[max(0, m.start() - 50) : m.end() + 50])):
                    return True
        return False

    return pd.Series([near(t, o) for t, o in zip(texts, options, strict=True)])


# ------------------------------------------------------------------ answers, snippets, validation
def normalize_answer(answer: Column) -> Column:
    """Distinct letters A to F in order; A if there is none."""
    letters = F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(answer, F.lit(""))), F.lit("[A-F]"), 0)))
    return F.coalesce(null_if_empty(F.array_join(letters, "")), F.lit("A"))


def format_answer(answer: Column, answer_format: Column) -> Column:
    """Letters in the order given; the first alone for single-choice and true-false questions."""
    letters = F.array_join(F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(answer, F.lit(""))), F.lit("[A-F]"), 0)), "")
    return F.when(answer_format.isin("mcq", "tf"), F.substring(letters, 1, 1)).otherwise(letters)


def snippet(text: Column, is_table: Column, length: int = P.EVIDENCE_SNIPPET) -> Column:
    """Cut to ``length``; rows of a table keep their line ends."""
    return F.substring(F.when(is_table, strip(text)).otherwise(collapse(text)), 1, length)


def confidence_of(reasoning: Column) -> Column:
    return F.coalesce(F.regexp_extract(reasoning, r"(?U)置信度\s*(\d+(?:\.\d+)?)\s*%", 1).try_cast("double") / 100.0, F.lit(0.0))


def is_sensitive(text: Column) -> Column:
    """Mobile numbers, identity numbers or e-mail addresses."""
    return text.rlike(any_of(P.SENSITIVE))


def clause_marker_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(rf"(?U)(?:(?<=^)|(?<=\n)|(?<=。)|(?<=；))\s*(第{P.NUMERAL}+条)"), 1))


def pdf_links(html_text: Column) -> Column:
    return F.regexp_extract_all(html_text, F.lit(r"""(?i)href=["']([^"']+\.pdf(?:\?[^"']*)?)["']"""), 1)


def format_timestamp(raw: Column) -> Column:
    """Seconds or milliseconds since 1970 as a date in the session's time zone; other texts' first ten characters."""
    n = raw.try_cast("long")
    seconds = F.when(n > 10_000_000_000, F.floor(n / 1000)).otherwise(n)
    return F.when(n.isNotNull(), F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")).otherwise(F.substring(raw, 1, 10))


def in_context(text: Column, term: Column, reach: int = 60) -> Column:
    """The first occurrence of ``term`` (any case) with ``reach`` characters on either side; null without one."""
    at = F.position(F.lower(term), F.lower(text))
    start = F.greatest(at - 1 - reach, F.lit(0))
    return F.when(at > 0, collapse(F.substr(text, start + 1, at - 1 + F.length(term) + reach - start)))


def missing_from(dropped: Column, included: Column) -> Column:
    """Numbers of ``dropped`` that ``included`` lacks, in order."""
    return F.array_except(numbers(dropped), numbers(included))


def sentences_missing_from(dropped: Column, included: Column, least: int = 8) -> Column:
    """Sentences of ``dropped`` (``least`` characters or more) that do not occur in ``included``, white space aside; in order, distinct."""
    there = search_form(included)
    parts = F.transform(F.split(dropped, "(?<=[。；！？.!?;])|\\n"), lambda s: collapse(s))
    return F.array_distinct(F.filter(parts, lambda s: (F.length(s) >= least) & ~F.contains(there, search_form(s))))


def terms_missing_from(dropped: Column, included: Column) -> Column:
    """Search tokens of ``dropped`` that ``included`` lacks, in order, distinct."""
    return F.array_except(tokens(dropped), tokens(included))

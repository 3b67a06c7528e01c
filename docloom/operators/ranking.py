"""Ranking of chunks and documents for all questions at once.

Statistics belong to each question's candidate set. Sizes of those sets are sums over documents and domains, and only postings of
tokens that questions hold are counted: what is shuffled grows with matches, not with the vocabulary or with questions times chunks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import profiles as P
from docloom.functions import text as T
from docloom.operators import pairs, rules
from docloom.sources.shared import stored

FIELDS = list(P.FIELD_WEIGHTS)


def prepare_chunks(chunks: DataFrame) -> DataFrame:
    """Adds each field's tokens and the search form, once for all questions. Persist or store the result where it is used often."""
    empty = F.lit("")
    out = chunks.withColumns({f"{f}_tokens": T.tokens(F.coalesce(f, empty)) for f in FIELDS})
    return out.withColumns({"norm_domain": T.normalize_domain(F.col("domain")), "search_text": T.search_form(F.concat_ws(" ", *[F.coalesce(f, empty) for f in FIELDS])), "section_key": F.coalesce(T.null_if_empty(F.col("section_path")), T.null_if_empty(F.col("title")), F.col("chunk_id"))})


#: Distinct tokens of questions up to which their list is broadcast.
BROADCAST_TOKENS = 200_000
#: Questions without documents that one pass over the corpus ranks; more of them take further passes.
QUESTION_BLOCK = 500


def _names_documents() -> Column:
    return F.coalesce(F.size("doc_ids"), F.lit(0)) > 0


def _in_domain() -> Column:
    return F.col("only_domain").isNull() | (F.col("norm_domain") == F.col("only_domain"))


def resolve_domains(contexts: DataFrame, prepared: DataFrame) -> DataFrame:
    """The contexts with ``q_domain`` and ``only_domain``, the domain that candidates must have (null: any).

    A question without a domain takes the most frequent of its documents' chunks (of all chunks, if it names none), the first where equal. A domain that no
    such chunk has restricts nothing. Only counts by document and domain are joined, never chunks. Questions without an id are dropped.
    """
    named_domain = F.coalesce("domain", F.lit("")) != ""
    of_docs = prepared.groupBy("doc_id", "norm_domain").agg(F.count_if(named_domain).alias("n"), F.min(F.when(named_domain, F.col("chunk_ord"))).alias("first"))
    sums = [F.sum("n").alias("n"), F.min("first").alias("first")]
    common = F.max(F.when(F.col("n") > 0, F.struct("n", (-F.col("first")).alias("minus"), "norm_domain")))["norm_domain"]
    own = contexts.where(_names_documents()).select("qid", F.explode(F.array_distinct("doc_ids")).alias("doc_id")).join(of_docs, "doc_id").groupBy("qid", "norm_domain").agg(*sums)
    every = of_docs.groupBy("norm_domain").agg(*sums)
    asked = contexts.where("qid is not null").join(own.groupBy("qid").agg(common.alias("own")), "qid", "left").join(F.broadcast(every.agg(common.alias("every"))), F.lit(True))  # one row
    given = T.normalize_domain(F.col("domain"))
    asked = asked.withColumn("q_domain", F.when(given == "general", F.coalesce(F.when(_names_documents(), F.col("own")).otherwise(F.col("every")), F.lit("general"))).otherwise(given))
    asked = asked.join(own.select("qid", F.col("norm_domain").alias("q_domain"), F.lit(True).alias("in_own")), ["qid", "q_domain"], "left")
    asked = asked.join(every.select(F.col("norm_domain").alias("q_domain"), F.lit(True).alias("in_every")), "q_domain", "left")
    present = F.when(_names_documents(), F.col("in_own")).otherwise(F.col("in_every"))
    return asked.withColumn("only_domain", F.when((F.col("q_domain") != "general") & present, F.col("q_domain"))).drop("own", "every", "in_own", "in_every")


def candidates(asked: DataFrame, rows: DataFrame, columns: list[str], base: DataFrame | None = None) -> DataFrame:
    """Every chunk of ``rows`` a question may use: ``qid, q_domain``, ``columns`` of the question, the chunk's columns and, given ``base`` (``qid, chunk_id, base``), its score.

    ``asked`` comes from ``resolve_domains``. Questions that name documents join their chunks by them. The others range over the corpus, since rules may rank
    a chunk that shares no word with them: they are broadcast in blocks of about ``QUESTION_BLOCK``, chunks stream past a block with the scores they have, and
    no pair is shuffled.
    """
    question = ["qid", "q_domain", "only_domain", *columns]
    named = asked.where(_names_documents()).select(*question, F.explode(F.array_distinct("doc_ids")).alias("doc_id"))
    out = named.join(rows, "doc_id").where(_in_domain())
    if base is not None:
        out = out.join(base, ["qid", "chunk_id"], "left")
    open_ = asked.where(~_names_documents()).select(*question)
    blocks = -(-open_.count() // QUESTION_BLOCK)
    for i in range(blocks):
        block = open_.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)
        near = rows
        if base is not None:  # a chunk's scores for the block's questions travel in one map
            scores = base.join(F.broadcast(block.select("qid")), "qid", "left_semi").groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("qid", "base"))).alias("bases"))
            near = rows.join(scores, "chunk_id", "left")
        near = near.join(F.broadcast(block), _in_domain())
        if base is not None:
            near = near.withColumn("base", F.try_element_at("bases", F.col("qid"))).drop("bases")
        out = out.unionByName(near)
    return out.drop("only_domain")


def bm25(term_freq: Column, doc_freq: Column, n_docs: Column, length: Column, mean_length: Column) -> Column:
    idf = F.log(F.lit(1.0) + (n_docs - doc_freq + 0.5) / (doc_freq + 0.5))
    norm = term_freq + P.BM25_K1 * (1.0 - P.BM25_B + P.BM25_B * length / F.greatest(mean_length, F.lit(1.0)))
    return idf * term_freq * (P.BM25_K1 + 1.0) / norm


def base_scores(asked: DataFrame, prepared: DataFrame) -> DataFrame:
    """``qid, chunk_id, base``: BM25 over title, section, clause and text, weighted, for candidates that share a token.

    ``asked`` comes from ``resolve_domains``. Sizes of candidate sets are sums over documents and domains; postings are kept only of tokens that some question holds.
    """
    totals = {"n_docs": F.count(F.lit(1)), **{f"sum_{f}": F.sum(F.size(f"{f}_tokens")) for f in FIELDS}}
    sizes = prepared.groupBy("doc_id", "norm_domain").agg(*[c.alias(n) for n, c in totals.items()])
    sums = [F.sum(n).alias(n) for n in totals]
    named = asked.where(_names_documents()).select("qid", "only_domain", "query_tokens", F.explode(F.array_distinct("doc_ids")).alias("doc_id"))
    open_ = asked.where(~_names_documents()).select("qid", "only_domain", "query_tokens")
    by_domain = sizes.groupBy(F.col("norm_domain").alias("pool")).agg(*sums)
    pools = by_domain.unionByName(by_domain.agg(*sums).withColumn("pool", F.lit(None).cast("string")))
    of_open = open_.join(F.broadcast(pools), F.col("only_domain").eqNullSafe(F.col("pool"))).select("qid", *totals)
    stats = named.join(sizes, "doc_id").where(_in_domain()).groupBy("qid").agg(*sums).unionByName(of_open)
    means = {f: F.when(F.col(f"sum_{f}") > 0, F.col(f"sum_{f}") / F.col("n_docs")).otherwise(1.0) for f in FIELDS}

    wanted = asked.select(F.explode("query_tokens").alias("token")).distinct()
    wanted = F.broadcast(wanted) if wanted.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS else wanted
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_tokens").alias("tokens")) for f in FIELDS])).alias("f")
    place = ["chunk_id", "doc_id", "norm_domain"]
    tokens = prepared.select(*place, fields).select(*place, "f.field", F.size("f.tokens").alias("length"), F.explode("f.tokens").alias("token")).join(wanted, "token", "left_semi")
    postings = stored(tokens.groupBy(*place, "field", "length", "token").agg(F.count(F.lit(1)).alias("tf")), "question-postings")
    hit = ["qid", "chunk_id", "field", "length", "token", "tf"]
    in_docs = named.select("qid", "only_domain", "doc_id", F.explode("query_tokens").alias("token")).join(postings, ["doc_id", "token"]).where(_in_domain()).select(hit)
    anywhere = open_.select("qid", "only_domain", F.explode("query_tokens").alias("token")).join(postings, "token").where(_in_domain()).select(hit)
    found = in_docs.unionByName(anywhere)
    df = found.groupBy("qid", "field", "token").agg(F.count(F.lit(1)).alias("df"))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in P.FIELD_WEIGHTS.items() for x in kv]), F.col("field"))
    mean = F.coalesce(*[F.when(F.col("field") == f, m) for f, m in means.items()])
    scored = found.join(df, ["qid", "field", "token"]).join(stats, "qid")
    return scored.groupBy("qid", "chunk_id").agg(F.sum(weight * bm25(F.col("tf"), F.col("df"), F.col("n_docs"), F.col("length"), mean)).alias("base"))


CONTEXT = ["q_numbers", "q_refs", "section_terms", "exact_phrases", "high_value_terms"]


FEATURES = ["doc_id", "norm_domain", "chunk_ord", "section_key"]


def _with_kind(asked: DataFrame) -> DataFrame:
    return asked.select("qid", "q_domain", F.size("q_refs").alias("n_refs"), F.size("q_numbers").alias("n_numbers"), *[c.alias(n) for n, c in rules.kind_of_question().items()])


def _open_scores(asked: DataFrame, features: DataFrame, plain: DataFrame, hits: DataFrame, base: DataFrame, top: int) -> DataFrame:
    """Scores of the chunks that a question over the corpus can choose: those with hits or shared tokens, and the best without."""
    kinds = _with_kind(asked)
    zero = [F.lit(0).alias(c) for c in rules.COUNTS]
    none = F.lit(None).cast("double").alias("base")
    chosen = kinds.select("qid", *rules.KIND).join(rules.plain_choice(plain, top), rules.KIND).select("qid", "chunk_id", *zero, none)
    shared = base.join(asked.select("qid"), "qid", "left_semi").select("qid", "chunk_id", *zero, "base")
    pairs = hits.select("qid", "chunk_id", *rules.COUNTS, none).unionByName(shared).unionByName(chosen)
    pairs = pairs.groupBy("qid", "chunk_id").agg(*[F.sum(c).cast("int").alias(c) for c in rules.COUNTS], F.coalesce(F.max("base"), F.lit(0.0)).alias("base"))
    rows = pairs.join(features, "chunk_id").join(kinds, "qid")
    rows = rows.withColumn("boost", rules.boost({c: F.col(c) for c in rules.COUNTS}, F.col("n_refs"), F.col("n_numbers"), F.col("q_domain")))
    return rows.select("qid", "q_domain", "chunk_id", *FEATURES, "base", "boost", (F.col("base") + F.col("boost")).alias("score"))


def asked_of(contexts: DataFrame, prepared: DataFrame) -> DataFrame:
    return stored(resolve_domains(contexts, prepared).select("qid", "q_domain", "only_domain", "doc_ids", "query_tokens", *CONTEXT), "asked")


def _ask(contexts: DataFrame, prepared: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    asked = asked_of(contexts, prepared)
    features = stored(prepared.select("chunk_id", *FEATURES, *[c.alias(n) for n, c in rules.chunk_features().items()]), "features")
    return asked, features, stored(base_scores(asked, prepared), "base-scores")


def scored_candidates(contexts: DataFrame, prepared: DataFrame, top: int = P.TOP_CHUNKS) -> DataFrame:
    """Candidates with ``base``, ``boost`` and ``score``; ties go to the earlier chunk.

    Of questions that name documents these are all their chunks; of questions over the corpus all that can be among the ``top`` chosen.
    """
    asked, features, base = _ask(contexts, prepared)
    named, open_ = asked.where(_names_documents()), asked.where(~_names_documents())
    rows = candidates(named, prepared.drop(*[f"{f}_tokens" for f in FIELDS]), CONTEXT, base).withColumn("base", F.coalesce("base", F.lit(0.0)))
    rows = rows.withColumns(rules.chunk_features()).withColumn("boost", rules.rule_boost())
    out = rows.select("qid", "q_domain", "chunk_id", *FEATURES, "base", "boost", (F.col("base") + F.col("boost")).alias("score"))
    if open_.isEmpty():
        return out
    hits, _ = rules.question_hits(open_, prepared)
    return out.unionByName(_open_scores(open_, features, rules.plain_scores(open_, features), hits, base, top))


def diversified(scored: DataFrame, top: int = P.TOP_CHUNKS) -> DataFrame:
    """``qid, chunk_id, rank``: repeatedly the best score after penalties for documents and sections already taken.

    Chunks of one section share their penalties, so only a section's ``top`` best can be taken: that filter loses nothing and bounds
    a question's group. The choice itself depends on earlier choices and runs in Arrow batches.
    """
    order = [F.desc("score"), F.col("chunk_ord")]
    best = F.row_number().over(Window.partitionBy("qid", "doc_id", "section_key").orderBy(*order))
    few = scored.withColumn("n", best).where(F.col("n") <= top).select("qid", "chunk_id", "chunk_ord", "doc_id", "section_key", "score")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "chunk_ord"], ascending=[False, True], kind="stable").reset_index(drop=True)
        now = pdf["score"].to_numpy().copy()
        docs, sections = pdf["doc_id"].to_numpy(), (pdf["doc_id"] + "\0" + pdf["section_key"]).to_numpy()
        taken: list[int] = []
        for _ in range(min(top, len(now))):
            i = int(now.argmax())
            taken.append(i)
            now[docs == docs[i]] -= P.DOC_PENALTY
            now[sections == sections[i]] -= P.SECTION_PENALTY
            now[i] = -float("inf")
        return pd.DataFrame({"qid": pdf["qid"].iloc[taken].to_numpy(), "chunk_id": pdf["chunk_id"].iloc[taken].to_numpy(), "rank": range(1, len(taken) + 1)})

    return few.groupBy("qid").applyInPandas(choose, "qid string, chunk_id string, rank int")


def rank_chunks(contexts: DataFrame, prepared: DataFrame) -> DataFrame:
    return diversified(scored_candidates(contexts, prepared))


def rank_documents(contexts: DataFrame, prepared: DataFrame, top: int = P.TOP_DOCS) -> DataFrame:
    """``qid, doc_id, doc_score, doc_rank``: best chunk, a share of the next two, and small bonuses for signals and sections covered.

    Every pair of question and chunk is rated where the chunk is read (``pairs``); what is shuffled are three scores for each task, question and document.
    """
    found = pairs.document_scores(asked_of(contexts.withColumn("doc_ids", T.strings([])), prepared), prepared)
    found = found.select("qid", "doc_id", "first", (F.col("top") + 0.3 * F.col("n_signals") + 0.08 * F.col("n_sections")).alias("doc_score"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("doc_score"), "first"))
    return found.withColumn("doc_rank", rank).where(F.col("doc_rank") <= top).select("qid", "doc_id", "doc_score", "doc_rank")


def rank_by_rules(contexts: DataFrame, prepared: DataFrame, top: int = P.TOP_CHUNKS) -> DataFrame:
    """``qid, chunk_ord, boost``: the ``top`` chunks of the corpus that the additive rules (to four digits) lift most for each question; no words are counted."""
    return pairs.best_boosts(asked_of(contexts.withColumn("doc_ids", T.strings([])), prepared), prepared, top)


# ------------------------------------------------------------------ additions to the ranked chunks
def add_title_chunks(ranked: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each named document's first chunk (least page, then id as text) behind the ranked ones, if it is not among them."""
    first = chunks.groupBy("doc_id").agg(F.min(F.struct("page_no", "chunk_id"))["chunk_id"].alias("chunk_id"))
    wanted = questions.select("qid", F.posexplode(F.array_distinct("doc_ids")).alias("place", "doc_id")).join(first, "doc_id").select("qid", "chunk_id", "place")
    missing = wanted.join(ranked, ["qid", "chunk_id"], "left_anti")
    last = ranked.groupBy("qid").agg(F.max("rank").alias("last"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("place"))
    return ranked.unionByName(missing.join(last, "qid", "left").select("qid", "chunk_id", (F.coalesce("last", F.lit(0)) + place).alias("rank")))


def add_numeric_chunks(ranked: DataFrame, questions: DataFrame, chunks: DataFrame, per_number: int = 3, in_all: int = 10) -> DataFrame:
    """Chunks of the named documents that hold a number of the options and were not ranked: the longest numbers first, three each, ten in all.

    A chunk counts for the first number that takes it, so the choice runs through each question's matches in order.
    """
    found = F.array_distinct(F.flatten(F.transform("options", lambda o: F.regexp_extract_all(o, F.lit(P.LONG_NUMBER), 0))))
    wanted = questions.select("qid", F.explode("doc_ids").alias("doc_id"), found.alias("numbers")).distinct()
    texts = chunks.select("doc_id", "chunk_id", "chunk_ord", T.search_form(F.coalesce("chunk_text", F.lit(""))).alias("form"))
    matches = wanted.join(texts, "doc_id").join(ranked.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti").select("qid", "chunk_id", "chunk_ord", F.explode(F.filter("numbers", lambda n: F.contains(F.col("form"), F.lower(n)))).alias("number"))
    # only the first thirteen chunks of a number can matter: ten may already be taken
    early = F.row_number().over(Window.partitionBy("qid", "number").orderBy("chunk_ord"))
    matches = matches.withColumn("n", early).where(F.col("n") <= in_all + per_number).drop("n")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: list[str] = []
        for number in sorted(pdf["number"].unique(), key=lambda x: (-len(x), x)):
            fresh = [c for c in pdf[pdf["number"] == number].sort_values("chunk_ord")["chunk_id"] if c not in taken]
            taken += fresh[: min(per_number, in_all - len(taken))]
        return pd.DataFrame({"qid": pdf["qid"].iloc[0], "chunk_id": taken, "place": range(1, len(taken) + 1)})

    added = matches.groupBy("qid").applyInPandas(choose, "qid string, chunk_id string, place int")
    last = ranked.groupBy("qid").agg(F.max("rank").alias("last"))
    return ranked.unionByName(added.join(last, "qid", "left").select("qid", "chunk_id", (F.coalesce("last", F.lit(0)) + F.col("place")).alias("rank")))


def add_carried(ranked: DataFrame, carried: DataFrame) -> DataFrame:
    """Evidence confirmed in earlier rounds (``qid, chunk_id, place``) behind the ranked chunks."""
    missing = carried.join(ranked, ["qid", "chunk_id"], "left_anti")
    last = ranked.groupBy("qid").agg(F.max("rank").alias("last"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("place"))
    return ranked.unionByName(missing.join(last, "qid", "left").select("qid", "chunk_id", (F.coalesce("last", F.lit(0)) + place).alias("rank")))


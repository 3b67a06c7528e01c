"""Reports: data quality, validation, accuracy, usage. Aggregations over whole tables, pre-aggregated per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import profiles as P
from docloom.functions import text as T
from docloom.functions.html import select_simply
from docloom.sources.shared import stored


def nearest_rank(rows: DataFrame, value: str, ratio: float, by: list[str] | None = None) -> DataFrame:
    """The value at position max(int(n * ratio), 1) of the sorted values, per group; nulls aside, no row for an empty group.

    Equal values are counted first, then the counts are sorted by range, so a large group lies in several tasks. A group's count in each range (one row
    a range, so few) tells which range holds the rank; only rows of that range are looked through.
    """
    keys = by or []
    counted = rows.where(F.col(value).isNotNull()).groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    names = [f"_k{i}" for i in range(len(keys))]
    sorted_ = stored(counted.repartitionByRange(*names, "value").withColumn("part", F.spark_partition_id()), "counts")
    group = Window.partitionBy(*names)
    sums = sorted_.groupBy(*names, "part").agg(F.sum("n").alias("n"))
    sums = sums.withColumns({"before": F.sum("n").over(group.orderBy("part")) - F.col("n"), "all": F.sum("n").over(group)})
    rank = F.greatest((F.col("all") * F.lit(float(ratio))).cast("long"), F.lit(1).cast("long"))
    holding = sums.withColumn("left", rank - F.col("before")).where((F.col("left") > 0) & (F.col("left") <= F.col("n"))).select(*[F.col(k).alias(f"_{k}") for k in names], F.col("part").alias("_part"), "left")
    same = F.col("part") == F.col("_part")
    for k in names:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = sorted_.join(holding, same)
    up_to = F.sum("n").over(Window.partitionBy(*names, "part").orderBy("value"))
    found = inside.withColumn("up_to", up_to).where((F.col("up_to") >= F.col("left")) & (F.col("up_to") - F.col("n") < F.col("left")))
    return found.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "value")


def preprocessing_summary(manifest: DataFrame) -> DataFrame:
    """``facet, value, documents, avg_seconds, avg_chunks``: by type, status and category, and over all: one aggregation over grouping sets; nothing for an empty table."""
    facets = ["file_type", "status", "category"]
    rows = manifest.select(*facets, "processing_seconds", "chunk_count")
    grouped = rows.groupingSets([[F.col(c)] for c in facets] + [[]], *facets)
    out = grouped.agg(F.grouping_id().alias("which"), F.count(F.lit(1)).alias("documents"), F.avg("processing_seconds").alias("avg_seconds"), F.avg("chunk_count").alias("avg_chunks"))
    # a bit for each facet that is left out, the first facet's highest
    left_out = {c: 7 - (4 >> i) for i, c in enumerate(facets)}
    facet = F.coalesce(*[F.when(F.col("which") == bits, c) for c, bits in left_out.items()], F.lit("all"))
    value = F.when(F.col("which") == 7, "all")
    for c, bits in left_out.items():
        value = value.when(F.col("which") == bits, F.col(c))
    return out.select(facet.alias("facet"), value.alias("value"), "documents", "avg_seconds", "avg_chunks")


# ------------------------------------------------------------------ chunk quality
_CJK_OR_SPACE = r"一-鿿　-〿＀-￯\s"


def chunk_issues() -> Column:
    """Names of a chunk's issues."""
    text = F.coalesce("chunk_text", F.lit(""))
    bare = F.length(T.strip(text))
    return F.array_compact(F.array(
        F.when(F.contains(text, F.lit("\ufffd")), "garbled_chars"),
        # fifty characters without a blank first: the larger class costs ten times as much a character, and is looked for from where a run begins
        F.when(text.rlike(r"(?:^|\s)\S{50}") & text.rlike(rf"(?:^|[{_CJK_OR_SPACE}])[^{_CJK_OR_SPACE}]{{50}}"), "long_non_cjk"),
        F.when(bare == 0, "empty_text"),
        F.when(T.strip(F.coalesce("section_path", F.lit(""))) == "", "no_section_path"),
        F.when((bare < 20) & (F.coalesce("chunk_type", F.lit("")) != "table"), "excessively_short"),
    ))


def chunk_quality(chunks: DataFrame) -> DataFrame:
    """One row: counts, lengths, buckets with percentages, clause coverage, issues by name, types by name."""
    n = F.length(F.coalesce("chunk_text", F.lit("")))
    rows = chunks.select(n.alias("n"), chunk_issues().alias("issues"), F.coalesce("chunk_type", F.lit("?")).alias("chunk_type"), (F.coalesce("clause_no", F.lit("")) != "").alias("clause"))
    total = F.count(F.lit(1))
    buckets = {"lt_200": F.col("n") < 200, "range_200_500": F.col("n").between(200, 499), "range_500_800": F.col("n").between(500, 799), "gte_800": F.col("n") >= 800}
    share = lambda c: F.round(100.0 * F.count_if(c) / F.greatest(total, F.lit(1)), 1)
    names = ["garbled_chars", "long_non_cjk", "empty_text", "no_section_path", "excessively_short"]
    return rows.agg(
        total.alias("total_chunks"), F.coalesce(F.min("n"), F.lit(0)).alias("min_length"), F.coalesce(F.median("n"), F.lit(0.0)).alias("median_length"), F.coalesce(F.round(F.avg("n"), 1), F.lit(0.0)).alias("mean_length"), F.coalesce(F.max("n"), F.lit(0)).alias("max_length"),
        *[F.count_if(c).alias(k) for k, c in buckets.items()], *[share(c).alias(f"{k}_pct") for k, c in buckets.items()],
        F.count_if("clause").alias("with_clause"), share(F.col("clause")).alias("clause_pct"), *[F.count_if(F.array_contains("issues", x)).alias(x) for x in names],
    )


def issue_samples(chunks: DataFrame, limit: int = 10) -> DataFrame:
    """The first ``limit`` chunk ids of each issue, in corpus order."""
    rows = chunks.select("chunk_id", "chunk_ord", F.explode(chunk_issues()).alias("issue"))
    n = F.row_number().over(Window.partitionBy("issue").orderBy("chunk_ord", "chunk_id"))
    return rows.withColumn("n", n).where(F.col("n") <= limit).select("issue", "n", "chunk_id")


def length_buckets(rows: DataFrame, length: Column) -> DataFrame:
    bucket = F.when(length < 200, "lt_200").when(length < 500, "range_200_500").when(length < 800, "range_500_800").otherwise("gte_800")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ validation of preprocessed documents
def document_metrics(manifest: DataFrame, chunks: DataFrame, raw: DataFrame, referenced: DataFrame, attachments: DataFrame) -> DataFrame:
    """One row per document with its validation figures and ``review_reasons`` (joined by ``;``).

    ``raw`` has ``doc_id, exists, raw_text, is_utf8``; ``referenced`` the documents that questions name; ``attachments`` ``doc_id, n_attachments``.
    """
    filled = sum((F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1).otherwise(0) for c in ("page_no", "section_path", "chunk_type", "chunk_text")), F.lit(0))
    bare = lambda c: F.coalesce(c, F.lit("")) == ""
    pages = chunks.where("page_no is not null").groupBy("doc_id", "page_no").agg(F.min("chunk_ord").alias("first"))
    earlier = F.lag("page_no").over(Window.partitionBy("doc_id").orderBy("first"))
    sorted_ = pages.withColumn("back", F.coalesce(earlier > F.col("page_no"), F.lit(False))).groupBy("doc_id").agg((~F.max("back")).alias("pages_sorted"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_ord"))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("chunk_ord", F.coalesce("chunk_text", F.lit("")).alias("t"))))), lambda x: x["t"]), "\n")
    own = chunks.withColumn("nth", nth).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum(filled).alias("filled"), F.count_if(bare("section_path")).alias("no_section"), F.count_if(bare("chunk_text")).alias("no_text"),
        F.countDistinct(T.null_if_empty(F.col("clause_no"))).alias("clauses"), text(F.col("nth") <= 10).alias("sample"), text(F.lit(True)).alias("chunk_texts"),
    )
    rows = manifest.join(own, "doc_id", "left").join(sorted_, "doc_id", "left").join(raw, "doc_id", "left").join(referenced.select("doc_id").distinct().withColumn("mapped", F.lit(True)), "doc_id", "left").join(attachments, "doc_id", "left")
    rows = rows.na.fill(0, ["n_chunks", "filled", "no_section", "no_text", "clauses", "n_attachments"]).na.fill(False, ["mapped", "exists"])
    is_html, is_text = F.col("file_type") == "html", F.col("file_type").isin("txt", "html")
    source = F.when(is_html, select_simply(F.coalesce("raw_text", F.lit("")))).otherwise(F.coalesce(T.null_if_empty(F.col("raw_text")), F.col("chunk_texts"), F.lit("")))
    rows = rows.withColumns({"markers": T.clause_marker_count(source), "links": F.size(T.pdf_links(F.coalesce("raw_text", F.lit(""))))})
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    rows = rows.withColumns({
        "field_completeness": F.col("filled") / F.greatest(F.col("n_chunks") * 4, F.lit(1)),
        "consistent": F.coalesce("pages_sorted", F.lit(True)) & (F.col("no_section") == 0) & (F.col("no_text") == 0),
        "clause_rate": F.when(F.col("markers") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("clauses") / F.col("markers"))),
        "attachment_rate": F.when(~is_html | ((F.col("links") == 0) & (F.col("n_attachments") == 0)), 1.0).when(F.col("links") > 0, F.least(F.lit(1.0), F.col("n_attachments") / F.col("links"))).otherwise(0.0),
        "utf8": ~is_text | F.coalesce("is_utf8", F.lit(False)), "sensitive": T.is_sensitive(F.coalesce("sample", F.lit(""))),
        "done": F.col("status") == "done",
    })
    dated = has("metadata_pub_date")
    complete = has("title") & (F.col("page_count") > 0) & (F.col("chunk_count") > 0) & (F.col("field_completeness") >= P.THRESHOLDS["field_completeness_rate"]) & (~is_html | (has("metadata_title") & dated))
    reasons = [(~F.col("done"), "preprocess_failed"), ((F.col("char_count") == 0) | (F.col("n_chunks") == 0), "empty_content"), (~F.col("utf8"), "encoding_issue"), (F.col("field_completeness") < P.THRESHOLDS["field_completeness_rate"], "field_incomplete"), (F.col("clause_rate") < P.THRESHOLDS["clause_boundary_rate"], "clause_boundary_risk"), (~F.col("consistent"), "logical_inconsistency"), (F.col("attachment_rate") < P.THRESHOLDS["attachment_mapping_rate"], "attachment_mapping_risk"), (F.col("sensitive"), "sensitive_information_flag")]
    why = F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in reasons]))
    flag = lambda c: c.cast("int")
    return rows.select(
        "doc_id", "category", "subcategory", "file_type", "file_path", flag(F.col("exists") & (F.col("file_type") != "unknown")).alias("format_compliant"), flag(F.col("done") & (F.col("char_count") > 0)).alias("file_integrity_ok"), flag(F.col("utf8")).alias("encoding_ok"),
        flag(F.col("mapped")).alias("doc_id_mapping_applicable"), F.lit(1).alias("doc_id_match"), flag(complete).alias("metadata_complete"), F.round("field_completeness", 4).alias("field_completeness_rate"), F.round("clause_rate", 4).alias("clause_boundary_rate"),
        flag(F.col("consistent")).alias("logical_consistency_ok"), flag(~F.col("sensitive")).alias("sensitive_scan_pass"), flag(has("title") & has("file_path") & (~is_html | (has("metadata_source") & dated))).alias("copyright_retained"), F.round("attachment_rate", 4).alias("attachment_mapping_rate"),
        "processing_seconds", "chunk_count", "page_count", "char_count", flag(F.size(why) > 0).alias("manual_review_needed"), F.array_join(why, ";").alias("review_reasons"),
    )


def threshold_report(metrics: DataFrame) -> DataFrame:
    """``metric, value, threshold, passed``: sixteen rates over all documents; seconds and the review rate must not exceed their threshold."""
    mean = lambda c, where=None: F.round(F.coalesce(F.avg(F.when(where, F.col(c)) if where is not None else F.col(c)), F.lit(0.0)), 4)
    kind = lambda k: F.col("file_type") == k
    values = {
        "format_compliance_rate": mean("format_compliant"), "file_integrity_rate": mean("file_integrity_ok"), "encoding_uniformity_rate": mean("encoding_ok", F.col("file_type").isin("txt", "html")), "doc_id_mapping_rate": mean("doc_id_match", F.col("doc_id_mapping_applicable") == 1),
        "metadata_completeness_rate": mean("metadata_complete"), "field_completeness_rate": mean("field_completeness_rate"), "clause_boundary_rate": mean("clause_boundary_rate"), "logical_consistency_rate": mean("logical_consistency_ok"),
        "sensitive_scan_pass_rate": mean("sensitive_scan_pass"), "copyright_retention_rate": mean("copyright_retained"), "attachment_mapping_rate": mean("attachment_mapping_rate", kind("html")), "pdf_avg_seconds": mean("processing_seconds", kind("pdf")),
        "html_avg_seconds": mean("processing_seconds", kind("html")), "txt_avg_seconds": mean("processing_seconds", kind("txt")), "automation_coverage_rate": F.lit(P.AUTOMATION_COVERAGE), "manual_review_trigger_rate": mean("manual_review_needed"),
    }
    one = metrics.agg(*[v.cast("double").alias(k) for k, v in values.items() if k != "automation_coverage_rate"]).withColumn("automation_coverage_rate", F.lit(P.AUTOMATION_COVERAGE))
    limits = F.create_map(*[F.lit(x) for kv in P.THRESHOLDS.items() for x in kv])
    rows = one.unpivot([], list(values), "metric", "value").withColumn("threshold", F.element_at(limits, F.col("metric")))
    at_most = F.col("metric").endswith("_avg_seconds") | (F.col("metric") == "manual_review_trigger_rate")
    return rows.withColumn("passed", F.when(at_most, F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold")))


def validate_raw_files(files: DataFrame, referenced: DataFrame) -> DataFrame:
    """Severity and status of raw files (``doc_id, category, suffix, size, text``; null text: unreadable), by the first rule that applies."""
    text = F.coalesce("text", F.lit(""))
    titled = text.rlike(r"(?m)<title>|ArticleTitle|^第[\d一二三四五六七八九十百]+条|目录")
    known = referenced.select("doc_id").distinct()
    exact = files.join(known.withColumn("hit", F.lit(True)), "doc_id", "left")
    # a file's id may be part of a referenced id: theta join against the questions' ids, a small table by nature
    part = exact.where("hit is null").select("doc_id").join(known.select(F.col("doc_id").alias("known")), F.contains("known", "doc_id")).select("doc_id").distinct().withColumn("part", F.lit(True))
    rows = exact.join(part, "doc_id", "left").withColumns({"has_title": titled, "has_pubdate": text.contains("PubDate") | text.rlike(r"\d{4}-\d{2}-\d{2}"), "has_clause": text.rlike(r"第[\d一二三四五六七八九十百]+条"), "doc_id_match": F.coalesce("hit", "part", F.lit(False))})
    ladder = [(F.col("text").isNull() | (F.col("size") == 0), "critical", "fail", "file_unreadable_or_empty"), ((T.strip(text) == "") & F.col("suffix").isin(".pdf", ".txt", ".html", ".htm"), "high", "fail", "empty_content"), (~F.col("has_title") & F.col("suffix").isin(".html", ".txt"), "medium", "warning", "title_or_structure_missing"), (~F.col("doc_id_match"), "medium", "warning", "doc_id_not_matched")]
    pick = lambda i, rest: F.coalesce(*[F.when(r[0], F.lit(r[i])) for r in ladder], F.lit(rest))
    return rows.withColumns({"severity": pick(1, "low"), "status": pick(2, "pass"), "notes": pick(3, "")}).drop("hit", "part")


def status_pivot(rows: DataFrame, key: str, statuses: tuple[str, ...] = ("PASS", "WARN", "FAIL")) -> DataFrame:
    """Rows by key and status, with totals and the share of the first status."""
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in statuses]
    return rows.groupBy(F.coalesce(key, F.lit("unknown")).alias(key)).agg(F.count(F.lit(1)).alias("total"), *counts).withColumn("pass_rate", F.round(F.col(statuses[0].lower()) / F.col("total"), 4))


# ------------------------------------------------------------------ validation and execution of cases
REQUIRED = ["qid", "domain", "split", "question", "options", "answer_format", "type", "doc_ids"]


def case_issues(questions: DataFrame, available: DataFrame) -> DataFrame:
    """Questions as read, with ``missing_doc_ids``, ``case_options``, ``case_format`` and ``issues``."""
    known = available.select("doc_id").distinct()
    q = stored(questions.withColumn("row", F.monotonically_increasing_id()), "cases")  # both uses of the number see the same
    q = q.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("row")))
    missing = q.select("row", F.explode("doc_ids").alias("doc_id")).join(known, "doc_id", "left_anti").groupBy("row").agg(F.array_sort(F.collect_list("doc_id")).alias("missing_doc_ids"))
    q = q.join(missing, "row", "left").withColumn("missing_doc_ids", F.coalesce("missing_doc_ids", T.strings([])))
    letters = T.strings(list(P.OPTION_NAMES))
    own = F.filter(F.transform(letters, lambda k: F.try_element_at("options", k)), lambda x: x.isNotNull())
    low = F.lower("answer_format")
    n = F.size(own)
    listed = F.coalesce(F.size("doc_ids"), F.lit(0)) > 0
    checks = [F.when(F.col(f).isNull(), f"missing_field:{f}") for f in sorted(REQUIRED)]
    checks += [F.when(F.col("nth") > 1, "duplicate_qid"), F.when(F.col("options").isNull(), "options_not_list_or_dict"), F.when(n == 0, "options_dict_empty"), F.when((n > 0) & (F.size(F.array_except(F.map_keys("options"), letters)) > 0), "options_dict_has_nonstandard_keys")]
    checks += [F.when(F.col("answer_format").isNull(), "answer_format_not_string"), F.when(~low.isin("mcq", "multi", "tf"), "answer_format_unsupported"), F.when(low.isin("mcq", "multi", "tf") & (low != F.col("answer_format")), "answer_format_requires_normalization")]
    checks += [F.when(~listed, "doc_ids_invalid"), F.when(F.size("missing_doc_ids") > 0, "missing_doc_reference"), F.when((n > 0) & ~n.between(2, 6), "options_count_out_of_range")]
    return q.withColumns({"issues": F.array_compact(F.array(*checks)), "case_options": F.when(n > 0, own), "case_format": F.when(low.isin("mcq", "multi", "tf"), low)}).drop("nth")


def issue_counts(cases: DataFrame, top: int = 12) -> DataFrame:
    """The most frequent issues; the first seen where equal."""
    rows = cases.select("row", F.posexplode("issues").alias("at", "issue"))
    return rows.groupBy("issue").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "at")).alias("first")).orderBy(F.desc("n"), "first").limit(top).drop("first")


def corpus_assets(manifest: DataFrame, chunks: DataFrame, sample: int = 50) -> DataFrame:
    """One row: usable documents, documents with chunks, usable ones without any, and the first ``sample`` of those by id."""
    usable = manifest.where((F.coalesce("status", F.lit("done")) == "done") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    chunked = chunks.where("doc_id is not null").select("doc_id").distinct()
    both = usable.withColumn("usable", F.lit(True)).join(chunked.withColumn("chunked", F.lit(True)), "doc_id", "full")
    bare = both.where("usable and chunked is null")
    counts = both.agg(F.count("usable").alias("document_count"), F.count("chunked").alias("chunk_document_count"), F.count_if(F.col("usable") & F.col("chunked").isNull()).alias("documents_without_chunks"))
    first = bare.select("doc_id").orderBy("doc_id").limit(sample).agg(F.array_sort(F.collect_list("doc_id")).alias("sample_documents_without_chunks"))
    return counts.join(F.broadcast(first), F.lit(True))  # one row each


def case_status(cases: DataFrame, outcomes: DataFrame, key: str = "qid") -> DataFrame:
    """PASS, WARN or FAIL of each case. ``outcomes`` has ``key``, ``n_docs, n_chunks, n_evidence``; none means it could not run."""
    rows = cases.join(outcomes, key, "left")
    gaps = [F.when(F.coalesce(c, F.lit(0)) == 0, r) for c, r in (("n_docs", "candidate_doc_ids_empty"), ("n_chunks", "candidate_chunks_empty"), ("n_evidence", "evidence_empty"))]
    runs = F.col("case_format").isNotNull() & F.col("case_options").isNotNull()
    every = F.when(runs, F.concat("issues", F.array_compact(F.array(*gaps)))).otherwise(F.col("issues"))
    status = F.when(~runs | F.exists("issues", lambda x: F.startswith(x, F.lit("missing_field:"))), "FAIL").when(F.size(every) > 0, "WARN").otherwise("PASS")
    return rows.withColumns({"all_issues": every, "status": status})


def worst_cases(cases: DataFrame, limit: int = 20) -> DataFrame:
    """FAIL before WARN, slow before fast."""
    rank = F.when(F.col("status") == "PASS", 0).when(F.col("status") == "WARN", 1).when(F.col("status") == "FAIL", 2).otherwise(9)
    return cases.where("status != 'PASS'").orderBy(rank, F.desc("duration_ms"), "qid").limit(limit)


# ------------------------------------------------------------------ usage and accuracy
def usage(results: DataFrame) -> DataFrame:
    """One row of token and latency figures; token figures over rows with tokens."""
    paid = F.col("total_tokens") > 0
    tokens = [f(F.when(paid, F.col(c))) for c in ("prompt_tokens", "completion_tokens", "total_tokens") for f in (F.sum, F.avg)]
    names = [f"{f}_{c}" for c in ("prompt_tokens", "completion_tokens", "total_tokens") for f in ("sum", "avg")]
    out = results.agg(F.count(F.lit(1)).alias("cases"), F.count_if(paid).alias("llm_success"), *[F.coalesce(F.round(t, 2), F.lit(0)).alias(n) for t, n in zip(tokens, names, strict=True)], F.round(F.median(F.when(paid, F.col("total_tokens"))), 2).alias("p50_total_tokens"), F.round(F.avg("duration_ms"), 2).alias("avg_duration_ms"), F.round(F.median("duration_ms"), 2).alias("p50_duration_ms"))
    # one row each
    p95 = nearest_rank(results.where(paid), "total_tokens", 0.95).agg(F.coalesce(F.max("value"), F.lit(0)).alias("p95_total_tokens"))
    slow = nearest_rank(results, "duration_ms", 0.95).agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("p95_duration_ms"))
    return out.join(F.broadcast(p95), F.lit(True)).join(F.broadcast(slow), F.lit(True))


def usage_by_domain(results: DataFrame) -> DataFrame:
    return results.groupBy("domain").agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("total_tokens") > 0).alias("llm_success"), *[F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")], F.round(F.avg("duration_ms"), 2).alias("avg_duration_ms"), F.round(F.avg("total_tokens"), 2).alias("avg_total_tokens"))


def accuracy(answers: DataFrame, gold: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """One row: compared, correct, accuracy; with earlier answers also theirs and how many changed."""
    rows = answers.select("qid", "answer").join(gold.select("qid", F.col("answer").alias("gold")), "qid")
    if before is None:
        return rows.agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.col("answer") == F.col("gold")).alias("correct")).withColumn("accuracy", F.round(F.try_divide("correct", "compared"), 4))
    rows = rows.join(before.select("qid", F.col("answer").alias("old")), "qid", "left")
    return rows.agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.col("answer") == F.col("gold")).alias("correct"), F.count_if(F.col("old") == F.col("gold")).alias("old_correct"), F.count_if(~F.col("answer").eqNullSafe(F.col("old"))).alias("changed"))


def letter_differences(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """``qid, missed, extra``: letters of the gold answer that are missing, and letters beyond it."""
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    rows = answers.select("qid", "answer").join(gold.select("qid", F.col("answer").alias("gold")), "qid")
    return rows.select("qid", F.array_join(F.array_except(letters("gold"), letters("answer")), "").alias("missed"), F.array_join(F.array_except(letters("answer"), letters("gold")), "").alias("extra"))


def stratified_sample(rows: DataFrame, stratum: Column, key: str, sizes: dict[str, int], seed: int = 20260625) -> DataFrame:
    """A fixed number of rows of each stratum, chosen by a seeded hash of ``key``: the same rows on every run."""
    wanted = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    n = F.row_number().over(Window.partitionBy("stratum").orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string"))), key))
    return rows.withColumn("stratum", stratum).withColumn("n", n).where(F.col("n") <= F.coalesce(F.try_element_at(wanted, F.col("stratum")), F.lit(0))).drop("n")


def dashboard(documents: DataFrame, results: DataFrame) -> DataFrame:
    counts = documents.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("status") == "done").alias("done"), F.sum("chunk_count").alias("chunks"))
    return counts.join(F.broadcast(results.agg(F.count(F.lit(1)).alias("results"))), F.lit(True))  # one row each


def keyword_contexts(chunks: DataFrame, terms: list[str], limit: int = 3) -> DataFrame:
    """``doc_id, page_no, term, context``: surroundings of the first listed term of each chunk, each once, the first ``limit`` by document and page."""
    text = F.coalesce("chunk_text", F.lit(""))
    term = F.coalesce(*[F.when(F.contains(F.lower(text), F.lit(t.lower())), F.lit(t)) for t in terms])
    rows = chunks.withColumn("term", term).where("term is not null").select("doc_id", "page_no", "term", T.in_context(text, F.col("term")).alias("context"))
    return rows.groupBy("doc_id", "page_no", "context").agg(F.min("term").alias("term")).orderBy("doc_id", F.coalesce("page_no", F.lit(0)), "context").limit(limit).select("doc_id", "page_no", "term", "context")


def answers_with_default(questions: DataFrame, log: DataFrame) -> DataFrame:
    """Every question with its logged answer in the format's form; A without one."""
    rows = questions.select("qid", "answer_format").join(log.select("qid", "answer"), "qid", "left")
    return rows.select("qid", F.coalesce(T.null_if_empty(T.format_answer(F.col("answer"), F.col("answer_format"))), F.lit("A")).alias("answer"))

"""Sinks: submissions, JSON results, reports, staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import normalize_answer

SUBMISSION = ["qid", "answer", "prompt_tokens", "completion_tokens", "total_tokens"]


def submission_rows(results: DataFrame) -> DataFrame:
    """The summary of all tokens, then each answer in its normal form; ``part`` and ``ord`` give the order."""
    tokens = SUBMISSION[2:]
    detail = results.select("qid", normalize_answer(F.col("answer")).alias("answer"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in tokens], F.lit(1).alias("part"))
    total = detail.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in tokens]).select(F.lit("summary").alias("qid"), F.lit("").alias("answer"), *tokens, F.lit(0).alias("part"))
    return total.unionByName(detail)


def write_submission(results: DataFrame, path: str) -> None:
    """One CSV file, the summary first; its rows are as many as the questions."""
    rows = submission_rows(results).repartition(1).sortWithinPartitions("part", "qid").select(*SUBMISSION)
    rows.write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


def append_answers(answers: DataFrame, path: str) -> None:
    """Answers are appended to a table; the summary is a view over it (``submission_rows``), so nothing is rewritten."""
    answers.select(*SUBMISSION).write.mode("append").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_evidence(results: DataFrame, items: DataFrame, path: str) -> None:
    """One JSON object per question with its evidence nested."""
    nested = items.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("n", "doc_id", "page_no", "clause_no", "quoted_text", "supports_option", "reasoning"))).alias("evidence"))
    write_json(results.join(nested, "qid", "left"), path)


def write_report_csv(rows: DataFrame, path: str) -> None:
    """A report for spreadsheets: UTF-8 with a byte-order mark before the first column's name."""
    first = rows.columns[0]
    rows.withColumnRenamed(first, "﻿" + first).repartition(1).write.mode("overwrite").option("header", "true").csv(path)


def markdown_table(rows: DataFrame, title: str, limit: int = 1000) -> str:
    """A small aggregate as a markdown table; one of more than ``limit`` rows is an error, as it is no report and nothing is left out in silence."""
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} rows: write a table instead")
    cells = [list(map(lambda v: "" if v is None else str(v), r)) for r in found]
    line = lambda c: "| " + " | ".join(x.replace("|", "\\|") for x in c) + " |"
    return "\n".join([f"## {title}", "", line(rows.columns), line(["---"] * len(rows.columns)), *map(line, cells), ""])


def write_dumps(rows: DataFrame, path: str) -> None:
    """Plain text per question: ``qid, n, line`` becomes a folder for each qid."""
    rows.repartition("qid").sortWithinPartitions("qid", "n").select("qid", F.col("line").alias("value")).write.mode("overwrite").partitionBy("qid").text(path)


def replace_table(rows: DataFrame, path: str) -> None:
    """Write beside the target, then swap by two renames: no reader sees a part of a table, but one that opens it between them finds none. ``versioned.VersionedTable`` has no such gap."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    staged, old = f"{path}.staged", f"{path}.old"
    rows.write.mode("overwrite").parquet(staged)
    p = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(p(old), True)
    if fs.exists(p(path)):
        fs.rename(p(path), p(old))
    fs.rename(p(staged), p(path))
    fs.delete(p(old), True)


def load_or_create(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state table; an empty one is made where there is none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def new_documents(names: DataFrame) -> DataFrame:
    """Uploaded documents (``title, file_type, source_path``) as queued rows with fresh ids."""
    return names.select(F.uuid().alias("doc_id"), "title", "file_type", F.coalesce("source_path", F.lit("")).alias("source_path"), F.lit("queued").alias("status"), F.lit(0).alias("chunk_count"))

"""Scans: raw files, line and array JSON, CSV, questions, manifests."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from docloom import profiles as P
from docloom.functions.html import page_text
from docloom.functions.text import normalize

CHUNK_JSON = "chunkId string, docId string, title string, domain string, pageNo int, sectionPath string, chunkType string, clauseNo string, chunkText string"
CHUNK_NAMES = {"chunkId": "chunk_id", "docId": "doc_id", "title": "title", "domain": "domain", "pageNo": "page_no", "sectionPath": "section_path", "chunkType": "chunk_type", "clauseNo": "clause_no", "chunkText": "chunk_text"}
MANIFEST = (
    "doc_id string, title string, category string, subcategory string, file_type string, file_path string, processing_seconds double, chunk_count int, page_count int, char_count int, "
    "clause_chunk_count int, table_chunk_count int, metadata_title string, metadata_pub_date string, metadata_source string, status string, notes string"
)
QUESTION_JSON = "qid string, domain string, split string, question string, options map<string,string>, answer_format string, type string, doc_ids array<string>"


# ------------------------------------------------------------------ raw files
def file_type(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(suffix == ".pdf", "pdf").when(suffix == ".txt", "txt").when(suffix.isin(".html", ".htm"), "html").otherwise("unknown")


def raw_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, relative, doc_id, suffix, file_type, category, subcategory, size, content``: all files below ``root``.

    The content is read only if a later step uses it. Sort by (suffix, size) for the order of a work list.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].lstrip("/") + "/"
    relative = F.substring_index(F.col("path"), base, -1)
    parts = F.split(relative, "/")
    name = F.element_at(parts, -1)
    return files.select(
        "path", relative.alias("relative"), F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_id"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("suffix"), file_type(F.col("path")).alias("file_type"),
        F.element_at(parts, 1).alias("category"), F.when(F.size(parts) > 2, F.element_at(parts, 2)).otherwise("root").alias("subcategory"), F.col("length").alias("size"), "content",
    )


@pandas_udf(StringType())
def decode_utf8(contents: pd.Series) -> pd.Series:
    """Text of a file; bytes that are not UTF-8 are left out."""
    return contents.map(lambda b: bytes(b).decode("utf-8", errors="ignore") if b is not None else None)


def is_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content)


def read_pages(files: DataFrame) -> DataFrame:
    """``doc_id, page_no, text`` of text and HTML files: one page each. PDF files need ``docloom.sources.pdf``."""
    raw = decode_utf8("content")
    text = F.when(F.col("file_type") == "txt", normalize(F.col("raw"))).otherwise(page_text(F.col("raw")))
    return files.where(F.col("file_type").isin("txt", "html")).withColumn("raw", raw).select("doc_id", "file_type", F.lit(1).alias("page_no"), text.alias("text"))


def unprocessed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """The work list: files whose id the manifest does not have."""
    return files.join(manifest.select("doc_id").distinct(), "doc_id", "left_anti")


def attachments(files: DataFrame) -> DataFrame:
    """``doc_id, n_attachments`` from files named ``{doc_id}_att*.pdf``."""
    owner = F.regexp_extract("doc_id", "^(.*?)_att", 1)
    return files.where((F.col("file_type") == "pdf") & (owner != "")).groupBy(owner.alias("doc_id")).agg(F.count(F.lit(1)).alias("n_attachments"))


# ------------------------------------------------------------------ JSON and CSV
def read_json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Line JSON: a bad line stops a strict scan and is skipped by a permissive one."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", "true").option("encoding", "UTF-8")
    return (reader.schema(schema) if schema else reader).csv(path)


def read_chunks(spark: SparkSession, path: str, fallback: str | None = None, doc_ids: list[str] | None = None, strict: bool = True) -> DataFrame:
    """Chunks with an ordinal. ``fallback`` is read where ``path`` does not exist; ``doc_ids`` filters at the scan."""
    try:
        found = read_json_lines(spark, path, CHUNK_JSON, strict)
    except AnalysisException:
        if fallback is None:
            raise
        found = read_json_lines(spark, fallback, CHUNK_JSON, strict)
    found = found.select(*[F.col(a).alias(b) for a, b in CHUNK_NAMES.items()], F.monotonically_increasing_id().alias("chunk_ord"))
    return found.where(F.col("doc_id").isin(doc_ids)) if doc_ids else found


def read_manifest(spark: SparkSession, path: str, only_done: bool = False, strict: bool = False) -> DataFrame:
    found = read_json_lines(spark, path, MANIFEST, strict)
    return found.where(F.coalesce("status", F.lit("done")) == "done") if only_done else found


# ------------------------------------------------------------------ questions
def option_list(options: Column) -> Column:
    """Options of a map in the order A to F; null without any."""
    found = F.filter(F.transform(F.array(*map(F.lit, P.OPTION_NAMES)), lambda k: F.element_at(options, k)), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found)


def answer_format(raw: Column) -> Column:
    """mcq, multi or tf, aliases included; null for anything else."""
    known = F.create_map(*[F.lit(x) for kv in P.ANSWER_FORMATS.items() for x in kv])
    return F.try_element_at(known, F.lower(raw))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question files with every field as stated; ``options`` as a map, ``source_file`` for reports."""
    return read_json_array(spark, path, QUESTION_JSON).withColumn("source_file", F.col("_metadata.file_name"))


def cases(questions: DataFrame) -> DataFrame:
    """Questions that can be asked: with options and a known format."""
    out = questions.select("qid", F.coalesce("domain", F.lit("unknown")).alias("domain"), "question", option_list(F.col("options")).alias("options"), answer_format(F.col("answer_format")).alias("answer_format"), F.coalesce("type", F.lit("unknown")).alias("type"), F.coalesce("doc_ids", F.array().cast("array<string>")).alias("doc_ids"))
    return out.where("options is not null and answer_format is not null")


def referenced_docs(questions: DataFrame) -> DataFrame:
    return questions.select(F.explode("doc_ids").alias("doc_id")).distinct()


def serialize_table(rows: Column) -> Column:
    """array<array<string>> as lines of cells joined by `` | ``; rows without any text are left out."""
    cells = lambda row: F.transform(row, lambda c: F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"(?U)\s+", " "))
    kept = F.filter(F.transform(rows, cells), lambda r: F.exists(r, lambda c: c != ""))
    return F.array_join(F.transform(kept, lambda r: F.array_join(r, " | ")), "\n")

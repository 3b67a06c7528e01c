"""Incremental ingestion with Structured Streaming: new files become chunks once, and restarts add nothing twice.

The file source's checkpoint is the work list. Each micro-batch replaces the rows of the documents it has (a dynamic
overwrite of their partitions), so a batch that is run again after a failure leaves the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom import profiles as P
from docloom.operators.chunking import chunk_pages, extraction_policy
from docloom.operators.pages import clean_pages
from docloom.sources import pdf, readers
from docloom.sources.shared import stored
from docloom.sources.versioned import VersionedTable

N_PARTS = 64


def file_stream(spark: SparkSession, root: str, max_files: int = 1000) -> DataFrame:
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_id"), readers.file_type(F.col("path")).alias("file_type"), F.col("length").alias("size"), "content")


def chunks_of_files(files: DataFrame, domain: str = "general", profile: P.ChunkProfile = P.FINANCE) -> DataFrame:
    """The batch pipeline from files to numbered chunks. PDF files (``size``: theirs) give pages where a library for them is there."""
    pages = readers.read_pages(files)
    scanned = files.where("file_type = 'pdf'").withColumn("policy", extraction_policy(F.col("file_type"), F.lit(domain), F.col("size"), F.col("path"))).select("doc_id", "content", "policy.*")
    cleaned = clean_pages(pages.where("file_type = 'html'").drop("file_type").unionByName(pdf.pages_with_tables(scanned)))
    plain = pages.where("file_type = 'txt'").select("doc_id", "page_no", "text", readers_section("text"))
    return chunk_pages(cleaned.unionByName(plain).withColumns({"title": F.col("doc_id"), "domain": F.lit(domain)}), profile)


def readers_section(text: str):
    from docloom.functions.text import section_path

    return section_path(F.col(text), F.lit(1)).alias("section_path")


def upsert_documents(batch: DataFrame, path: str, key: str = "doc_id", n_parts: int = N_PARTS) -> None:
    """Rows of the batch's documents take the place of what the table at ``path`` has of them; only their partitions are rewritten."""
    spark = batch.sparkSession
    fresh = batch.withColumn("part", F.pmod(F.xxhash64(key), F.lit(n_parts)).cast("int")).persist()
    try:
        parts = [r["part"] for r in fresh.select("part").distinct().collect()]  # n_parts numbers at most
        if not parts:
            return
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        rows = fresh
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            old = spark.read.schema(fresh.schema).parquet(path).where(F.col("part").isin(parts))
            rows = old.join(fresh.select(key).distinct(), key, "left_anti").select(*fresh.columns).unionByName(fresh)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    finally:
        fresh.unpersist()


def ingest(spark: SparkSession, root: str, table: str | VersionedTable, checkpoint: str, domain: str = "general", profile: P.ChunkProfile = P.FINANCE) -> StreamingQuery:
    """Everything new below ``root`` into the chunk table, then stop; call again for what has come since.

    A ``VersionedTable`` can be read while batches come in, and a batch rewrites only the parts that hold its documents.
    """

    def write(batch: DataFrame, _: int) -> None:
        chunks = chunks_of_files(batch, domain, profile)
        if isinstance(table, VersionedTable):
            table.upsert(stored(chunks, "batch"))
        else:
            upsert_documents(chunks, table)

    return file_stream(spark, root).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

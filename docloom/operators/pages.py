"""Cleaning of pages: repeated headers and footers, noise and repeated lines, repeated pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import is_noise_line, is_page_marker, lines, section_path


def edge_lines(pages: DataFrame) -> DataFrame:
    """``doc_id, headers, footers``: first and last lines that repeat over a document's pages (twice up to 3 pages, else three times).

    ``pages`` has ``doc_id, page_no, lines``.
    """
    first, last = F.element_at("lines", 1), F.element_at("lines", -1)
    ends = pages.select("doc_id", F.when(F.size("lines") > 0, first).alias("first"), F.when(F.size("lines") > 0, last).alias("last"))
    size = pages.groupBy("doc_id").agg(F.when(F.count(F.lit(1)) <= 3, 2).otherwise(3).alias("least"))
    usable = F.when(F.col("edge") == "header", F.length("line").between(3, 80) & ~is_page_marker(F.col("line"))).otherwise(F.length("line").between(1, 80))
    counted = ends.select("doc_id", F.explode(F.array(F.struct(F.lit("header").alias("edge"), F.col("first").alias("line")), F.struct(F.lit("footer").alias("edge"), F.col("last").alias("line")))).alias("e")).select("doc_id", "e.edge", "e.line").where("line is not null").where(usable)
    often = counted.groupBy("doc_id", "edge", "line").count().join(size, "doc_id").where("count >= least")
    of = lambda edge: F.collect_set(F.when(F.col("edge") == edge, F.col("line")))
    return often.groupBy("doc_id").agg(of("header").alias("headers"), of("footer").alias("footers"))


def without_runs(items: Column) -> Column:
    """An array without elements equal to the one before."""
    return F.filter(items, lambda x, i: ~F.coalesce(F.get(items, i - 1) == x, F.lit(False)))


def clean_pages(pages: DataFrame) -> DataFrame:
    """``doc_id, page_no, text, section_path`` of the pages that keep any text; a document's repeated page stays once, where it came first.

    A line goes if it is the page's first and a repeated header, its last and a repeated footer, noise, or equal to the line kept
    before it. ``pages`` has ``doc_id, page_no, text``.
    """
    split = pages.select("doc_id", "page_no", lines(F.coalesce("text", F.lit(""))).alias("lines"))
    joined = split.join(edge_lines(split), "doc_id", "left")
    n = F.size("lines")
    none = F.array().cast("array<string>")
    is_edge = lambda x, i: ((i == 0) & F.array_contains(F.coalesce("headers", none), x)) | ((i == n - 1) & F.array_contains(F.coalesce("footers", none), x))
    kept = F.filter("lines", lambda x, i: ~is_edge(x, i) & ~is_noise_line(x))
    cleaned = joined.withColumn("kept", kept).select("doc_id", "page_no", F.array_join(without_runs(F.col("kept")), "\n").alias("text")).where("text != ''")
    once = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("page_no"))
    return cleaned.withColumn("n", once).where("n = 1").drop("n").withColumn("section_path", section_path(F.col("text"), F.col("page_no")))

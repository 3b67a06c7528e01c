"""Cutting pages into typed, addressable chunks.

Splitting at boundaries is a projection over the array of lines. Three steps depend on what they
produced before, and are folds over a page's parts with ``aggregate``: packing fragments, splitting
long parts, and splitting tables. All stay in one pass over the page; nothing is shuffled until chunks are numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import profiles as P
from docloom.functions.text import clause_no, lines, normalize, strip
from docloom.sources.shared import bound_batches

STRINGS = "array<string>"


def _nothing() -> Column:
    return F.array().cast(STRINGS)


def is_boundary(line: Column, profile: P.ChunkProfile) -> Column:
    return line.rlike(profile.boundary)


def is_table(text: Column, profile: P.ChunkProfile) -> Column:
    return F.startswith(text, F.lit(profile.table_mark))


def _group_lines(items: Column, profile: P.ChunkProfile) -> Column:
    """Groups of lines joined by LF: a table mark stands alone, a boundary opens a group.

    State: the groups so far, and whether the last is still open.
    """
    start = F.struct(_nothing().alias("done"), F.lit("").alias("open"))

    def flush(s: Column) -> Column:
        return F.when(s["open"] != "", F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])

    def step(s: Column, x: Column) -> Column:
        table = F.struct(F.concat(flush(s), F.array(x)).alias("done"), F.lit("").alias("open"))
        opened = F.struct(flush(s).alias("done"), x.alias("open"))
        longer = F.struct(s["done"].alias("done"), F.when(s["open"] == "", x).otherwise(F.concat(s["open"], F.lit("\n"), x)).alias("open"))
        return F.when(is_table(x, profile), table).when((s["open"] != "") & is_boundary(x, profile), opened).otherwise(longer)

    return F.aggregate(items, start, step, flush)


def segment(text: Column, profile: P.ChunkProfile = P.FINANCE, entities: bool = True) -> Column:
    """Parts of a page in order: tables and boundary groups whole, other groups cut after sentence ends.

    ``entities`` decodes HTML entities once more, by a pandas UDF before the split; without it the whole expression stays in the JVM.
    """
    source = normalize(text) if entities else text
    groups = _group_lines(lines(source), profile)
    cut = lambda g: F.filter(F.transform(F.split(g, f"(?<=[{profile.sentence_ends}])"), lambda x: normalize(x, entities=False)), lambda x: x != "")
    return F.flatten(F.transform(groups, lambda g: F.when(is_table(g, profile) | is_boundary(g, profile), F.array(normalize(g, entities=False))).otherwise(cut(g))))


def pack_fragments(parts: Column, profile: P.ChunkProfile = P.FINANCE) -> Column:
    """A part joins the one before, with a blank, while that is shorter than the target; tables and boundaries never do.

    Parts come normalised, as ``segment`` gives them, so joining needs no second normalisation and lengths alone decide: the fold
    runs over numbers and yields where groups begin; each group is then joined once.
    """
    sized = F.transform(parts, lambda x: F.struct(F.length(x).alias("size"), (is_table(x, profile) | is_boundary(x, profile)).alias("alone")))
    none = F.array().cast("array<struct<start:int,size:int>>")
    start = F.struct(none.alias("done"), F.lit(0).alias("first"), F.lit(profile.target).alias("size"), F.lit(1).alias("at"))

    def flush(s: Column) -> Column:
        return F.when(s["first"] > 0, F.concat(s["done"], F.array(F.struct(s["first"].alias("start"), (s["at"] - s["first"]).alias("size"))))).otherwise(s["done"])

    def step(s: Column, x: Column) -> Column:
        longer = F.struct(s["done"].alias("done"), s["first"].alias("first"), (s["size"] + 1 + x["size"]).alias("size"), (s["at"] + 1).alias("at"))
        opened = F.struct(flush(s).alias("done"), s["at"].alias("first"), x["size"].alias("size"), (s["at"] + 1).alias("at"))
        return F.when((s["size"] < profile.target) & ~x["alone"], longer).otherwise(opened)

    return F.transform(F.aggregate(sized, start, step, flush), lambda g: F.array_join(F.slice(parts, g["start"], g["size"]), " "))


def _split_table(part: Column, profile: P.ChunkProfile) -> Column:
    """Blocks of rows up to the target, each under the table's mark and first row."""
    rows = F.split(part, "\n")
    head, title = F.element_at(rows, 1), F.try_element_at(rows, F.lit(2))
    data = F.slice(rows, 3, F.greatest(F.size(rows) - 2, F.lit(0)))
    start = F.struct(_nothing().alias("done"), F.lit(None).cast("string").alias("open"), F.length(title).alias("size"))

    def step(s: Column, row: Column) -> Column:
        full = s["open"].isNotNull() & (s["size"] + F.length(row) + 1 > profile.target)
        return F.when(full, F.struct(F.concat(s["done"], F.array(s["open"])).alias("done"), row.alias("open"), (F.length(title) + F.length(row) + 1).alias("size"))).otherwise(
            F.struct(s["done"].alias("done"), F.coalesce(F.concat(s["open"], F.lit("\n"), row), row).alias("open"), (s["size"] + F.length(row) + 1).alias("size"))
        )

    under = lambda body: F.concat(head, F.lit("\n"), title, F.lit("\n"), body)
    blocks = F.aggregate(data, start, step, lambda s: F.concat(s["done"], F.filter(F.array(s["open"]), lambda x: x.isNotNull())))
    whole = F.when(F.size(data) == 0, F.array(F.concat(head, F.lit("\n"), title))).otherwise(F.transform(blocks, under))
    return F.when(F.size(rows) < 2, F.array(F.substring(part, 1, profile.most))).otherwise(whole)


def _split_long(part: Column, profile: P.ChunkProfile) -> Column:
    """Paragraphs, or sentences without any, packed greedily up to the target; a single one over the limit is cut to it."""
    paragraphs = F.split(part, r"(?<=\n\n)(?!\n)")
    pieces = F.when(part.contains("\n\n"), paragraphs).otherwise(F.split(part, f"(?<=[{profile.sentence_ends}])"))
    start = F.struct(_nothing().alias("done"), F.lit("").alias("open"))

    def step(s: Column, x: Column) -> Column:
        fits = F.length(s["open"]) + F.length(x) <= profile.target
        done = F.when(s["open"] != "", F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])
        return F.when(strip(x) == "", s).when(fits, F.struct(s["done"].alias("done"), F.concat(s["open"], x).alias("open"))).otherwise(F.struct(done.alias("done"), F.substring(x, 1, profile.most).alias("open")))

    blocks = F.aggregate(pieces, start, step, lambda s: F.when(s["open"] != "", F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))
    return F.when(F.size(blocks) > 0, blocks).otherwise(F.array(F.substring(part, 1, profile.most)))


def split_oversized(parts: Column, profile: P.ChunkProfile = P.FINANCE) -> Column:
    """Parts over the limit in several; the others as they are."""
    return F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= profile.most, F.array(p)).when(is_table(p, profile), _split_table(p, profile)).otherwise(_split_long(p, profile))))


def prefix_key(text: Column, length: int = 160) -> Column:
    return F.regexp_replace(F.substring(text, 1, length), r"(?U)\s+", "")


def chunk_pages(pages: DataFrame, profile: P.ChunkProfile = P.FINANCE) -> DataFrame:
    """Chunks of ``pages`` (``doc_id, title, domain, page_no, text, section_path``), numbered through each document.

    Within a page, a part that starts like an earlier one (160 characters, white space aside) is left out before numbers are given.
    """
    bound_batches(pages.sparkSession)
    staged = pages.where(strip(F.coalesce("text", F.lit(""))) != "").withColumn("parts", segment(F.col("text"), profile))
    staged = staged.withColumn("parts", pack_fragments(F.col("parts"), profile)).withColumn("parts", split_oversized(F.col("parts"), profile))
    # outer: an inner explode would infer a filter on the size of the array, and so cut every page twice more
    rows = staged.select("doc_id", "title", "domain", "page_no", "section_path", F.posexplode_outer("parts").alias("part_ord", "chunk_text")).where("part_ord is not null")
    first = F.row_number().over(Window.partitionBy("doc_id", "page_no", prefix_key(F.col("chunk_text"))).orderBy("part_ord"))
    rows = rows.withColumn("first", first).where("first = 1")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "part_ord"))
    rows = rows.withColumn("chunk_ord", number.cast("long")).withColumn("clause_no", clause_no(F.col("chunk_text"), profile))
    kind = F.when(is_table(F.col("chunk_text"), profile), "table").when(F.col("clause_no").isNotNull(), "clause").otherwise("prose")
    return rows.select(F.concat_ws("-chunk-", "doc_id", F.col("chunk_ord").cast("string")).alias("chunk_id"), "doc_id", "title", "domain", "page_no", "section_path", kind.alias("chunk_type"), "clause_no", "chunk_text", "chunk_ord")


def with_fallbacks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The chunks, and one that says so for each document (``doc_id, title, domain, source_path, exists``) without any."""
    bare = documents.join(chunks.select("doc_id").distinct(), "doc_id", "left_anti")
    message = F.when(F.col("exists"), F.lit(P.NO_CONTENT)).otherwise(F.concat(F.lit(P.NO_FILE), F.col("source_path")))
    rows = bare.select(F.concat("doc_id", F.lit("-chunk-1")).alias("chunk_id"), "doc_id", "title", "domain", F.lit(1).alias("page_no"), F.lit(P.DEFAULT_SECTION).alias("section_path"), F.lit("prose").alias("chunk_type"), F.lit(None).cast("string").alias("clause_no"), message.alias("chunk_text"), F.lit(1).cast("long").alias("chunk_ord"))
    return chunks.unionByName(rows)


def manifest_counts(chunks: DataFrame) -> DataFrame:
    """Counts of a document's chunks, and whether only a fallback was made."""
    text = F.col("chunk_text")
    failed = F.max(F.startswith(text, F.lit("未找到源文件")) | F.startswith(text, F.lit("未能解析出正文内容")))
    return chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunk_count"), F.countDistinct("page_no").alias("page_count"), F.sum(F.length("chunk_text")).alias("char_count"), F.count_if(F.col("clause_no").isNotNull()).alias("clause_chunk_count"),
        F.count_if(F.col("chunk_type") == "table").alias("table_chunk_count"), F.when(failed, "failed").otherwise("done").alias("status"),
    )


def extraction_policy(file_type: Column, category: Column, size_bytes: Column, relative: Column, reports: bool = True) -> Column:
    """struct<table_recovery, plumber>: tables are looked for in PDF files of 64 MB (reports) or 8 MB, never in research or regulatory attachments.

    Without ``reports``, the stricter policy: no tables of financial reports either.
    """
    limit = F.when(category == "financial_reports", (64 << 20) if reports else -1).otherwise(8 << 20)
    attachment = (category == "regulatory") & relative.contains("attachments")
    return F.struct(((file_type == "pdf") & (size_bytes <= limit) & (category != "research") & ~attachment).alias("table_recovery"), ((file_type == "pdf") & (category == "research")).alias("plumber"))


def failed_rows(files: DataFrame, reason: Column) -> DataFrame:
    """Manifest rows of files that could not be processed: zero counts and a note, instead of a failed job."""
    zero = [F.lit(0).alias(c) for c in ("chunk_count", "page_count", "char_count", "clause_chunk_count", "table_chunk_count")]
    return files.select("doc_id", F.col("doc_id").alias("title"), "category", "subcategory", "file_type", F.col("path").alias("file_path"), *zero, F.lit("failed").alias("status"), reason.alias("notes"))

"""PDF pages by an optional plug-in: PyMuPDF, pdfplumber and OCR libraries are imported only where they are used.

Without them a file yields no page, and the caller's fallback chunk says so.
"""

from __future__ import annotations

import importlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import profiles as P
from docloom.functions.text import normalize
from docloom.sources.guarded import ChildError, in_child
from docloom.sources.readers import decode_utf8

PAGES = "doc_id string, page_no int, text string, tables array<string>, error string"


def needs_ocr(text_length: Column, n_images: Column, image_share: Column) -> Column:
    """Little text and images over three tenths of the page; without images, hardly any text."""
    return (text_length < 120) & F.when(n_images > 0, image_share >= 0.30).otherwise(text_length < 40)


def _module(name: str):
    try:
        return importlib.import_module(name)
    except ImportError:
        return None


def table_lines(table: list[list[str | None]]) -> str:
    rows = [[" ".join((c or "").split()) for c in row] for row in table]
    return "\n".join(" | ".join(r) for r in rows if any(r))


_ocr: list = []


def ocr_reader():
    """A function from PNG bytes to text, made once per worker from RapidOCR or PaddleOCR; null without either."""
    if not _ocr:
        rapid, paddle = _module("rapidocr_onnxruntime"), _module("paddleocr")
        if rapid is not None:
            engine = rapid.RapidOCR()
            _ocr.append(lambda png: "\n".join(line[1] for line in (engine(png)[0] or [])))
        elif paddle is not None:
            engine = paddle.PaddleOCR(lang="ch")
            _ocr.append(lambda png: "\n".join(line[1][0] for block in (engine.ocr(png) or []) for line in (block or [])))
        else:
            _ocr.append(None)
    return _ocr[0]


def _scanned(page, text: str) -> bool:
    """``needs_ocr`` for a page at hand."""
    if len(text) >= 120:
        return False
    images = [r for info in page.get_images(full=True) for r in page.get_image_rects(info[0])]
    area = page.rect.width * page.rect.height
    return sum(r.width * r.height for r in images) >= 0.30 * area > 0 if images else len(text) < 40


def page_text(page, ocr: bool = True) -> str:
    """Text of a PyMuPDF page; a scanned page's recognised text, at twice the size, if that is longer."""
    text = page.get_text("text").strip()
    reader = ocr_reader() if ocr and _scanned(page, text) else None
    seen = reader(page.get_pixmap(dpi=144).tobytes("png")).strip() if reader else ""
    return seen if len(seen) > len(text) else text


Pages = list[tuple[int, str, list[str]]]


def _plumber_pages(content: bytes, tables: bool) -> Pages:
    with _module("pdfplumber").open(io.BytesIO(content)) as doc:
        return [(i, page.extract_text() or "", [table_lines(t) for t in page.extract_tables() or []] if tables else []) for i, page in enumerate(doc.pages, 1)]


def _tables_of(page) -> list[str]:
    """A PyMuPDF page's tables; a page on which the search fails has none."""
    try:
        return [table_lines(t.extract()) for t in page.find_tables().tables]
    except Exception:  # noqa: BLE001 - one page's tables do not cost the file
        return []


def extract(content: bytes, plumber: bool, tables: bool, ocr: bool = False) -> Pages:
    """(page, text, tables) of a file: by PyMuPDF unless ``plumber`` is asked for, by pdfplumber where PyMuPDF is missing, fails or finds no table at all; nothing without either."""
    fitz, other = (None if plumber else _module("fitz")), _module("pdfplumber")
    if fitz is not None:
        try:
            with fitz.open(stream=content, filetype="pdf") as doc:
                found = [(i, page_text(page, ocr), _tables_of(page) if tables else []) for i, page in enumerate(doc, 1)]
        except Exception:
            if other is None:
                raise
        else:
            if tables and other is not None and not any(any(t) for _, _, t in found):
                more = {n: t for n, _, t in _plumber_pages(content, True)}
                found = [(n, text, more.get(n, [])) for n, text, _ in found]
            return found
    return _plumber_pages(content, tables) if other is not None else []


def iter_pages(source: bytes | str, index: int = 0, count: int = 1, plumber: bool = False, tables: bool = False, ocr: bool = False) -> Iterator[tuple[int, str, list[str]]]:
    """(page, text, tables) of part ``index`` of ``count`` of a file's pages (its path or content), one at a time; pdfplumber takes over where PyMuPDF is missing or cannot open the file."""
    fitz, other = (None if plumber else _module("fitz")), _module("pdfplumber")
    part = lambda n: range(n * index // count, n * (index + 1) // count)
    if fitz is not None:
        try:
            doc = fitz.open(source) if isinstance(source, str) else fitz.open(stream=source, filetype="pdf")
        except Exception:
            if other is None:
                raise
        else:
            with doc:
                for i in part(len(doc)):
                    yield i + 1, page_text(doc[i], ocr), _tables_of(doc[i]) if tables else []
            return
    if other is not None:
        with other.open(source if isinstance(source, str) else io.BytesIO(source)) as doc:
            for i in part(len(doc.pages)):
                page = doc.pages[i]
                yield i + 1, page.extract_text() or "", [table_lines(t) for t in page.extract_tables() or []] if tables else []


def read_pdf_pages(files: DataFrame, ocr: bool = False, timeout: int | None = None) -> DataFrame:
    """``PAGES`` of PDF files (``doc_id, content, plumber, table_recovery``); a file that fails, ends its process or takes longer than ``timeout`` seconds gives one row with its error.

    Each file is read in a child process, which is ended after the limit whatever code it is in. A file at a time is held (``page_source`` reads large ones in parts); a null content
    counts as an empty file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PAGES.split(", ")]
        for batch in batches:
            for r in batch.itertuples():
                try:
                    pages = in_child(lambda r=r: iter(extract(bytes(r.content or b""), r.plumber, r.table_recovery, ocr)), timeout)
                    rows = [(r.doc_id, n, text, tables, None) for n, text, tables in pages]
                except ChildError as e:
                    rows = [(r.doc_id, None, None, [], str(e))]
                yield pd.DataFrame(rows, columns=names).astype({"page_no": "Int32"})

    return files.select("doc_id", "content", "plumber", "table_recovery").mapInPandas(run, PAGES)


def best_effort_text(files: DataFrame) -> DataFrame:
    """``doc_id, text`` for validation, of files (``doc_id, file_type, content``): text and HTML decoded, a PDF's pages joined by line ends, anything else or broken empty."""
    plain = files.select("doc_id", F.when(F.col("file_type").isin("txt", "html"), F.coalesce(decode_utf8("content"), F.lit(""))).otherwise("").alias("text"), "file_type")
    pages = read_pdf_pages(files.where("file_type = 'pdf'").select("doc_id", "content", F.lit(False).alias("plumber"), F.lit(False).alias("table_recovery"))).where("page_no is not null")
    read = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), "\n").alias("pages"))
    return plain.where("not (file_type <=> 'pdf')").select("doc_id", "text").unionByName(plain.where("file_type = 'pdf'").join(read, "doc_id", "left").select("doc_id", F.coalesce("pages", F.lit("")).alias("text")))


def with_tables(text: Column, tables: Column) -> Column:
    """A page's text and its tables, each under the table mark."""
    marked = F.transform(F.filter(tables, lambda t: t != ""), lambda t: F.concat(F.lit(P.TABLE_MARK + "\n"), t))
    return F.array_join(F.concat(F.filter(F.array(text), lambda x: x != ""), marked), "\n\n")


def pages_with_tables(files: DataFrame, ocr: bool = False, timeout: int | None = None) -> DataFrame:
    """``doc_id, page_no, text`` of the PDF files that can be read, tables included; files as for ``read_pdf_pages``."""
    pages = read_pdf_pages(files, ocr, timeout).where("page_no is not null")
    return pages.select("doc_id", "page_no", with_tables(normalize(F.col("text")), F.col("tables")).alias("text"))

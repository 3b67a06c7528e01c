"""Pages of PDF files as a data source: ``spark.read.format("pdf_pages").load(folder)``.

A partition is a share of one file's pages; files are cut by their size, so a large one is read by several tasks and no task, column or list holds all of
its pages. Each share is read in a child process that is ended after ``timeout`` seconds, and pages are passed on as they come. A share that fails gives the pages before the failure and
one row with its error; other shares and files are not affected.

Options: ``path`` (a folder or file, or a URI that pyarrow's file systems know), ``timeout`` (seconds a share, none by default), ``bytesPerPartition`` (of a file), ``plumber``, ``tables``, ``ocr``.
The driver lists names and sizes only.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docloom.sources import pdf
from docloom.sources.guarded import ChildError, in_child


@dataclass
class Share(InputPartition):
    """Part ``index`` of ``count`` of a file's pages."""

    path: str
    index: int
    count: int


class PdfPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf_pages"

    def schema(self) -> str:
        return "doc_id string, path string, page_no int, text string, tables array<string>, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}
        self.path = options.get("path", "")
        self.timeout = float(options["timeout"]) if options.get("timeout") else None
        self.share_bytes = int(options.get("bytesperpartition", 16 << 20))
        self.flags = {k: options.get(k, "false").lower() == "true" for k in ("plumber", "tables", "ocr")}

    def partitions(self) -> list[Share]:
        from pyarrow import fs

        system, at = _file_system(self.path)
        found = system.get_file_info(at)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
        counts = [(f.path, max(1, -(-f.size // self.share_bytes))) for f in files if f.type == fs.FileType.File and f.path.lower().endswith(".pdf")]
        return [Share(path, i, n) for path, n in sorted(counts) for i in range(n)]

    def _content(self, path: str):
        system, _ = _file_system(self.path)
        if system.type_name == "local":
            return path
        with system.open_input_file(path) as f:
            return f.read()

    def read(self, share: Share) -> Iterator[tuple]:
        name = os.path.splitext(os.path.basename(share.path))[0]
        try:
            for n, text, tables in in_child(lambda: pdf.iter_pages(self._content(share.path), share.index, share.count, **self.flags), self.timeout):
                yield name, share.path, n, text, tables, None
        except ChildError as e:
            yield name, share.path, None, None, [], str(e)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PdfPages)

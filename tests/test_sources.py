"""Extraction in child processes, pages as a data source, OCR by a stand-in, versioned tables, the reply log."""

import os
import signal
import sys
import time

import pytest
from pyspark.sql import functions as F

from docloom.sources import page_source, pdf
from docloom.sources.guarded import ChildError, in_child


# ------------------------------------------------------------------ child processes
def stuck():
    signal.signal(signal.SIGALRM, signal.SIG_IGN)
    while True:  # no exception reaches it
        time.sleep(60)


def failing(how):
    yield 1
    if how == "abort":
        os.abort()
    elif how == "exit":
        os._exit(3)
    elif how == "silent":
        os._exit(0)
    elif how == "raise":
        raise KeyError("x")
    elif how == "hang":
        stuck()
    elif how == "invalid":
        os.write(max(int(f) for f in os.listdir("/proc/self/fd") if os.path.exists(f"/proc/self/fd/{f}") and "pipe" in os.readlink(f"/proc/self/fd/{f}")), b"\x03\0\0\0abc")
        os._exit(0)


@pytest.mark.parametrize(("how", "error"), [("abort", "subprocess_exit_-6"), ("exit", "subprocess_exit_3"), ("silent", "subprocess_missing_output"), ("raise", "process_exception_KeyError"), ("hang", "subprocess_timeout_1s"), ("invalid", "subprocess_invalid_output_UnpicklingError")])
def test_child_failures_have_names(how, error):
    got, began = [], time.monotonic()
    with pytest.raises(ChildError, match=f"^{error}$"):
        for item in in_child(lambda: failing(how), 1):
            got.append(item)
    assert got == [1] and time.monotonic() - began < 5
    with pytest.raises(ChildProcessError):  # no child is left behind
        os.waitpid(-1, os.WNOHANG)


def test_child_results_come_as_they_are_made():
    def slow():
        yield "x" * 3_000_000
        time.sleep(30)
        yield 2

    items = in_child(slow)
    assert len(next(items)) == 3_000_000
    items.close()  # ends the child
    with pytest.raises(ChildProcessError):
        os.waitpid(-1, os.WNOHANG)
    assert list(in_child(lambda: iter([]))) == [] and list(in_child(lambda: iter([1, None, "é"]))) == [1, None, "é"]


# ------------------------------------------------------------------ pages
STUB = '''
import os, time

class Page:
    rect = type("R", (), {"width": 10, "height": 10})()
    def __init__(self, n, kind): self.n, self.kind = n, kind
    def get_text(self, kind="text"):
        if self.kind == "hang" and self.n == 1:
            while True: time.sleep(60)
        if self.kind == "abort" and self.n == 1: os.abort()
        return f"page {self.n} " + "x" * 2000
    def get_images(self, full=True): return []

class Pdf:
    def __init__(self, n, kind): self.n, self.kind = n, kind
    def __len__(self): return self.n
    def __getitem__(self, i): return Page(i, self.kind)
    def __enter__(self): return self
    def __exit__(self, *a): return False

def open(path=None, stream=None, filetype=None):
    import builtins
    with builtins.open(path) as f:
        n, kind = f.read().split()[:2]
    if kind == "broken": raise ValueError(kind)
    return Pdf(int(n), kind)
'''


@pytest.fixture
def paged_stub(spark, tmp_path, monkeypatch):
    """A stand-in whose files state their number of pages and how they fail, on the path of new workers."""
    folder = tmp_path / "stub"
    folder.mkdir()
    (folder / "paged_fitz.py").write_text(STUB)
    return str(folder)


def test_pages_are_a_data_source(spark, tmp_path, paged_stub):
    files = tmp_path / "files"
    files.mkdir()
    for name, n, kind, size in (("large", 10_000, "good", 100_000), ("hang", 4, "hang", 10), ("abort", 4, "abort", 10), ("broken", 4, "broken", 10), ("none", 0, "good", 10)):
        (files / f"{name}.pdf").write_text(f"{n} {kind} ".ljust(size))
    (files / "other.txt").write_text("no pages")

    class Stubbed(page_source.PdfPages):
        @classmethod
        def name(cls):
            return "stubbed_pages"

        def reader(self, schema):
            inner = page_source._Reader(dict(self.options))
            read = inner.read

            def with_stub(share):
                if paged_stub not in sys.path:
                    sys.path.insert(0, paged_stub)
                import paged_fitz

                before, pdf._module = pdf._module, lambda name: paged_fitz if name == "fitz" else None
                try:
                    yield from read(share)
                finally:  # the worker serves other tests
                    pdf._module = before

            inner.read = with_stub
            return inner

    spark.dataSource.register(Stubbed)
    rows = spark.read.format("stubbed_pages").option("bytesPerPartition", 12_500).option("timeout", 5).load(str(files))
    got = rows.select("doc_id", "page_no", "error", F.length("text").alias("n"), F.spark_partition_id().alias("task")).collect()
    large = [r for r in got if r["doc_id"] == "large"]
    assert sorted(r["page_no"] for r in large) == list(range(1, 10_001)) and len({r["task"] for r in large}) == 8 and all(r["error"] is None and r["n"] > 2000 for r in large)
    rest = {}
    for r in got:
        if r["doc_id"] != "large":
            rest.setdefault(r["doc_id"], []).append((r["page_no"], r["error"]))
    assert rest == {"hang": [(1, None), (None, "subprocess_timeout_5s")], "abort": [(1, None), (None, "subprocess_exit_-6")], "broken": [(None, "process_exception_ValueError")]}


def test_parts_of_a_file_cover_its_pages():
    class Book(list):
        pages = property(lambda self: self)
        __enter__ = lambda self: self
        __exit__ = lambda self, *a: False

    page = type("P", (), {"extract_text": lambda self: "t", "extract_tables": lambda self: [[["a", None]]]})
    module = type("M", (), {"open": staticmethod(lambda source: Book([page() for _ in range(23)]))})
    before, pdf._module = pdf._module, lambda name: module if name == "pdfplumber" else None
    try:
        for count in (1, 4, 23, 40):
            assert [n for i in range(count) for n, *_ in pdf.iter_pages("x", i, count)] == list(range(1, 24))
        assert next(pdf.iter_pages(b"x", tables=True)) == (1, "t", ["a | "])
    finally:
        pdf._module = before


def test_scanned_pages_go_through_ocr(spark, monkeypatch):
    class Page:
        rect = type("R", (), {"width": 10, "height": 10})()

        def __init__(self, text, images):
            self.text, self.images = text, images

        def get_text(self, kind):
            return self.text

        def get_images(self, full):
            return [(i,) for i in range(len(self.images))]

        def get_image_rects(self, i):
            return [type("R", (), {"width": self.images[i], "height": 10})()]

        def get_pixmap(self, dpi):
            return type("X", (), {"tobytes": lambda self, kind: b"png"})()

    seen = type("Rapid", (), {"RapidOCR": lambda: lambda png: ([(None, "recognised text"), (None, "second line")], None)})
    monkeypatch.setattr(pdf, "_ocr", [])
    monkeypatch.setattr(pdf, "_module", lambda name: seen if name == "rapidocr_onnxruntime" else None)
    cases = [("", [], True), ("x" * 39, [], True), ("x" * 40, [], False), ("x" * 119, [3], True), ("x" * 119, [2], False), ("x" * 120, [9], False), ("", [1, 1, 1], True)]
    for text, images, ocr in cases:
        assert pdf._scanned(Page(text, images), text) == ocr
        want = spark.range(1).select(pdf.needs_ocr(F.lit(len(text)), F.lit(len(images)), F.lit(sum(images) / 10))).first()[0]
        assert want == ocr
    assert pdf.page_text(Page("", [])) == "recognised text\nsecond line" and pdf.page_text(Page("", []), ocr=False) == ""
    assert pdf.page_text(Page("y" * 100, [9])) == "y" * 100  # the longer text stays
    monkeypatch.setattr(pdf, "_ocr", [])
    monkeypatch.setattr(pdf, "_module", lambda name: None)
    assert pdf.page_text(Page("z", [])) == "z"


# ------------------------------------------------------------------ replies
def test_each_prompt_is_sent_once_though_a_task_is_lost(spark, tmp_path):
    from docloom.operators import answers

    sent, marker, log = str(tmp_path / "sent"), str(tmp_path / "lost"), str(tmp_path / "log")

    def answerer(batches):
        import pandas as pd

        for b in batches:
            qid = b["qid"][0]
            if qid == "q5" and not os.path.exists(marker):
                open(marker, "w").close()
                os.kill(os.getppid(), 9)  # the task's worker is lost before the call
                time.sleep(60)
            with open(sent, "a") as f:
                f.write(qid + "\n")
            if qid == "q3":
                time.sleep(60)
            if qid == "q7":
                raise ValueError("no model")
            yield pd.DataFrame({"qid": b["qid"], "reply": ["A"], "prompt_tokens": [2], "completion_tokens": [1]})

    prompts = spark.createDataFrame([(f"q{i}", "s", f"u{i}") for i in range(10)] + [("again", "s", "u1")], "qid string, system string, user string").repartition(3)
    with pytest.raises(Exception, match="crashed|exit|lost|EOF|worker"):
        answers.ask(prompts, answerer, log=log, calls=1, timeout=2).collect()  # one at a time: no other call is under way when the worker is lost
    got = {r["qid"]: (r["reply"], r["prompt_tokens"], r["attempts"]) for r in answers.ask(prompts, answerer, log=log, calls=2, timeout=2).collect()}
    assert got == {q: (None, 0, 1) if q in ("q3", "q7") else ("A", 2, 1) for q in [*(f"q{i}" for i in range(10)), "again"]}
    calls = open(sent).read().split()
    assert len(calls) == len(set(calls)) == 10  # "again" has the prompt of q1: one call for both
    answers.ask(prompts, answerer, log=log, calls=2, timeout=2).collect()
    assert open(sent).read().split() == calls
    from docloom.operators.reply_log import read_log

    errors = {r["error"] for r in read_log(spark, log).where("error is not null").collect()}
    assert errors == {"subprocess_timeout_2s", "process_exception_ValueError"}
    second = answers.ask_traced(prompts, answerer, [prompts], log=log, calls=2, timeout=2).where("attempt = 2").collect()
    assert {r["qid"] for r in second} == {"q3", "q7"} and sorted(open(sent).read().split()) == sorted([*calls, "q3", "q7"])  # another attempt is another call


# ------------------------------------------------------------------ versioned tables
def test_versions_replace_each_other_whole(spark, tmp_path):
    import threading

    from docloom.sources.versioned import VersionedTable

    table = VersionedTable(spark, f"{tmp_path}/t", part_bytes=6_000)
    rows = lambda ids, v: spark.createDataFrame([(f"d{i}", n, f"{v}-{i}-{n}" * 20) for i in ids for n in range(3)], "doc_id string, n int, text string")
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.delete(rows([1], "x")) == 0
    table.upsert(rows(range(300), "a"))
    table.upsert(rows(range(300), "a"))  # now its size is known: it is split
    parts = len(table.state()["parts"])
    assert parts > 3
    stop, seen = threading.Event(), []

    def reader():
        while not stop.is_set():
            try:
                seen.append(table.read().groupBy().count().first()[0])
            except Exception as e:  # noqa: BLE001 - what the test looks for
                seen.append(e)

    thread = threading.Thread(target=reader)
    thread.start()
    small = table.upsert(rows([7], "b"))
    table.upsert(rows([7, 1000], "c"))
    table.delete(rows([8], "x"))
    table.replace(table.read())
    stop.set()
    thread.join()
    assert seen and set(seen) <= {900, 903}
    whole = sum(p["bytes"] for p in table.state()["parts"])
    assert 0 < small < whole / 2
    got = {(r["doc_id"], r["n"]): r["text"] for r in table.read().collect()}
    want = {(f"d{i}", n): f"{'c' if i in (7, 1000) else 'a'}-{i}-{n}" * 20 for i in [*range(300), 1000] if i != 8 for n in range(3)}
    assert got == want
    table.vacuum()
    assert table.read().count() == 900 and len([f for f in os.listdir(f"{tmp_path}/t") if f.startswith("data-")]) == 1
    table.upsert(rows([1], "z").limit(0))
    table.delete(table.read())
    assert table.read().count() == 0
    table.upsert(rows([5], "n"))
    assert table.read().count() == 3


def test_a_stream_fills_a_versioned_table(spark, tmp_path):
    from docloom.sources.versioned import VersionedTable
    from docloom.streaming import ingest

    (tmp_path / "in").mkdir()
    table = VersionedTable(spark, f"{tmp_path}/chunks")
    for name, text in (("a", "第一条 本合同等待期为90天。"), ("b", "第二条 身故保险金按基本保险金额给付。")):
        (tmp_path / "in" / f"{name}.txt").write_text(text)
        ingest.ingest(spark, f"{tmp_path}/in", table, f"{tmp_path}/checkpoint").awaitTermination(120)
    assert {r["doc_id"] for r in table.read().collect()} == {"a", "b"} and table.state()["version"] == 2

"""Operators whose work on one document, group or file is shared by several tasks, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from docloom import profiles as P
from docloom.operators import merge, reports

CHUNK = "chunk_id string, doc_id string, title string, domain string, page_no int, section_path string, chunk_type string, clause_no string, chunk_text string, chunk_ord long"


@pytest.fixture
def many_tasks(spark):
    """Small tables keep their tasks."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield spark
    spark.conf.unset(key)


def folded(rows):
    """The fold over each document's sorted chunks, one after the other."""
    out, last = [], None
    for x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", int(r[0].rsplit("-", 1)[1]), r[9])):
        x = dict(zip([c.split()[0] for c in CHUNK.split(", ")], x, strict=True)) | {"opens": (x[8] or "").startswith("第1条"), "n_merged": 0}
        if last is not None and last["doc_id"] == x["doc_id"] and merge._may_join(last, x):
            last = merge._joined(last, x)
            continue
        if last is not None:
            out.append(last)
        last = x | {"chunk_ord": last["chunk_ord"] + 1 if last is not None and last["doc_id"] == x["doc_id"] else 0}
    return [(r["doc_id"], r["chunk_ord"], r["chunk_text"], r["n_merged"], r["page_no"], r["section_path"]) for r in [*out, *([last] if last else [])]]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_one_document_is_merged_in_several_tasks(many_tasks, seed):
    dice = random.Random(seed)
    rows = []
    for doc, n, longest in (("a", 400, 30), ("b", 60, 1500), (None, 30, 700), ("c", 1, 5), ("d", 250, 700)):
        page = 1
        for i in range(n):
            page += dice.random() < 0.1
            page += 3 * (dice.random() < 0.02)
            text = None if dice.random() < 0.01 else ("第1条" if dice.random() < 0.03 else "") + "字" * dice.randint(0, longest)
            rows.append((f"x-chunk-{i}", doc, "t", "g", page - 2 * (dice.random() < 0.05), dice.choice(["", "", "s", "s", "u"]) if doc != "a" else "", dice.choice(["prose"] * 12 + ["table", "clause", None]) if doc != "a" else "prose", None, text, i))
    c = many_tasks.createDataFrame(rows, CHUNK)
    out = merge.merge_neighbours(c)
    got = sorted(out.select("doc_id", "chunk_ord", "chunk_text", "n_merged", "page_no", "section_path").collect(), key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [tuple(r) for r in got] == folded(rows)
    written = {f.rsplit("/", 1)[0] for f in out.inputFiles() if "/neighbours-" in f}
    assert many_tasks.read.parquet(*written).where("doc_id = 'a'").select("part").distinct().count() > 1


def test_document_without_a_break_over_all_tasks(many_tasks):
    rows = [(f"x-chunk-{i}", "a", "t", "g", 1, "", "prose", None, "字" * (i % 3), i) for i in range(2000)]
    c = many_tasks.createDataFrame(rows, CHUNK)
    got = merge.merge_neighbours(c).orderBy("chunk_ord").select("doc_id", "chunk_ord", "chunk_text", "n_merged", "page_no", "section_path").collect()
    assert [tuple(r) for r in got] == folded(rows)
    assert c.repartitionByRange("doc_id", "chunk_ord").select(F.spark_partition_id()).distinct().count() > 1
    assert merge.merge_neighbours(c.limit(0)).count() == 0


def test_certain_breaks_hold_for_whatever_came_before():
    dice = random.Random(5)
    for _ in range(3000):
        rows = [{"doc_id": "a", "chunk_type": dice.choice(["prose", "clause", "table"]) if dice.random() < 0.2 else "prose", "page_no": dice.randint(1, 4), "section_path": dice.choice(["", "s", "u"]), "chunk_text": "x" * dice.choice([0, 1, 200, P.MERGE_MIN - 1, P.MERGE_MIN, P.MAX_CHUNK - 1, P.MAX_CHUNK]), "clause_no": None, "opens": False, "n_merged": 0} for _ in range(4)]
        last = rows[0]
        for before, x in zip(rows, rows[1:], strict=False):
            assert not (merge._never_joins(before, x) and merge._may_join(last, x))
            last = merge._joined(last, x) if merge._may_join(last, x) else x


def test_nearest_rank_over_several_tasks(many_tasks):
    dice = random.Random(7)
    rows = [(dice.choice(["hot", "hot", "hot", "a", None]), dice.choice([None, 1.0, dice.uniform(-9, 9), float(dice.randint(0, 5)), float("nan") if dice.random() < 0.1 else 2.0])) for _ in range(3000)] + [("empty", None), ("one", 4.0)]
    df = many_tasks.createDataFrame(rows, "g string, n double").repartition(8)  # a column of the name that counts have
    for ratio in (0.0, 0.3, 0.95, 1.0):
        got = {r["g"]: r["value"] for r in reports.nearest_rank(df, "n", ratio, ["g"]).collect()}
        want = {}
        for g in {g for g, v in rows if v is not None}:
            values = sorted([v for k, v in rows if k == g and v is not None], key=lambda v: (v != v, v))
            want[g] = values[max(int(len(values) * ratio), 1) - 1]
        assert str(sorted(got.items(), key=str)) == str(sorted(want.items(), key=str))
    found = reports.nearest_rank(df, "n", 0.5)
    assert found.count() == 1 and reports.nearest_rank(df.limit(0), "n", 0.5).count() == 0
    assert sum("/counts-" in f for f in found.inputFiles()) > 1  # a group without keys lies in several files


def test_summary_by_grouping_sets(spark):
    rows = [("pdf", "done", "a", 1.0, 2), ("pdf", "failed", None, None, 4), (None, "done", "a", 4.0, None)]
    out = reports.preprocessing_summary(spark.createDataFrame(rows, "file_type string, status string, category string, processing_seconds double, chunk_count int"))
    got = {(r["facet"], r["value"]): (r["documents"], r["avg_seconds"], r["avg_chunks"]) for r in out.collect()}
    assert got == {("file_type", "pdf"): (2, 1.0, 3.0), ("file_type", None): (1, 4.0, None), ("status", "done"): (2, 2.5, 2.0), ("status", "failed"): (1, None, 4.0), ("category", "a"): (2, 2.5, 2.0), ("category", None): (1, None, 4.0), ("all", "all"): (3, 2.5, 3.0)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_duplicate_report_counts_without_shuffling_texts(spark):
    c = spark.createDataFrame([("a b",), ("ab",), ("a　b ",), ("c",), (None,), (None,), ("",), (" ",)], "chunk_text string")
    assert {r["scope"]: (r["groups"], r["surplus"]) for r in merge.duplicate_report(c).collect()} == {"global": (3, 4)}
    every = spark.createDataFrame([(chr(i),) for i in range(0x3100)], "t string")
    assert every.where(merge.template_key(F.col("t")) != F.regexp_replace("t", r"(?U)\s+", "")).count() == 0

"""The pipeline's stages: contracts, decisions, and the whole run."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as C
from docloom.llm.common import shared_path

COLUMNS = C.COLUMNS


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("the", "of", "and", "to", "in", "on") for b in "abcdefghijklmnopqrstuvwxyz"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels = [], []
    for i in range(240):
        grade = (2, 2, 2, 0, 1)[i % 5]
        t = text(rng.randrange(30, 90))
        if grade == 0:
            t = t.replace(" ", " vile ", 3)
        if grade == 1:
            t = " ".join(w.upper() + "!!" for w in t.split())
        rows.append((i, t))
        labels.append((i, int(grade != 1), int(grade == 0)))
    copy, passage = text(80), text(60)
    rows += [(1000 + i, copy) for i in range(5)] + [(1010, copy.replace(copy.split()[40], "changed", 1))]
    rows += [(1020 + i, f"{text(50)} {passage} {text(50)}") for i in range(3)]
    rows += [(1030, f"{text(60)} token=abcdefghijklmnop {text(20)}"), (1031, None)]
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumn("extra", F.lit(1)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    outs = []
    for name, stage in C.STAGES:
        out = stage(spark, docs, folder)
        path = shared_path(spark, "stage")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        outs.append(docs)
        if name != "packing":
            assert docs.columns == COLUMNS
    graded, single, stripped, masked, packed = ({r["doc_id"]: r for r in o.collect()} for o in outs)
    wrong = [i for i in range(240) if (i in graded) != (i % 5 < 3)]
    assert len(wrong) < 12
    assert {1000, 1020, 1021, 1022, 1030} <= set(graded)
    assert [i for i in range(1000, 1011) if i in single] == [1000]
    assert {1020, 1021, 1022} <= set(single)
    assert all(len(stripped[i]["text"].split()) == 100 for i in (1020, 1021, 1022))
    assert "token" not in masked[1030]["text"] and "[SECRET]" in masked[1030]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in masked.values())
    assert set(packed) == set(masked)


def test_whole_run_equals_the_stages(spark, folder):
    rows = C.run(spark, folder).collect()
    by_doc = {}
    for r in rows:
        by_doc[r["doc_id"]] = by_doc.get(r["doc_id"], 0) + r["length"]
    assert all(by_doc[r["doc_id"]] == r["doc_tokens"] for r in rows)
    fill = {}
    for r in rows:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert all(n == 2048 or n & (n - 1) == 0 for n in fill.values()) and np.mean(list(fill.values())) > 0


def test_an_empty_table_and_one_of_which_nothing_is_kept(spark, folder, tmp_path):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    for name, rows in (("none", docs.limit(0)), ("blank", docs.limit(3).withColumn("text", F.when(F.col("doc_id") > 0, F.lit(" "))))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.limit(0).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert C.run(spark, f"{tmp_path}/{name}").collect() == []


def test_registered_queries():
    names = list(entry.queries())
    assert [n for n in names if n.startswith("op")][0].startswith("op1_") and len([n for n in names if n.startswith("op")]) == 13 and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
    assert 4 <= len(C.STAGES) <= 5

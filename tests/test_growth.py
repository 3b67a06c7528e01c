"""What tasks write and hold must not grow faster than the input: the steps that once did, against plain Python."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import pairs, ranking
from docloom.plans import planner

CHUNK = "chunk_id string, doc_id string, title string, domain string, page_no int, section_path string, chunk_type string, clause_no string, chunk_text string, chunk_ord long"
QUESTION = "qid string, mode string, question string, options array<string>, answer_format string, doc_ids array<string>"


def asked(spark, texts, docs=()):
    q = spark.createDataFrame([(str(i), "A", t, ["2.5%"], "mcq", list(docs)) for i, t in enumerate(texts)], QUESTION)
    return planner.query_contexts(planner.activate(planner.build_plans(q), F.lit("base")))


@pytest.mark.parametrize("block", [500, 2])
def test_pairs_of_question_and_chunk_are_not_written(spark, monkeypatch, block):
    """Every chunk shares words with every question: once each pair was written, with each of its words (F1, F2)."""
    monkeypatch.setattr(ranking, "QUESTION_BLOCK", block)
    monkeypatch.setattr(pairs, "SLICE_PAIRS", 64)
    names = [f"d{i}" for i in range(4)]
    rows = [(f"{n}-chunk-{i}", n, "", "general", 1, "甲" if i % 3 else "乙", "table" if i % 10 == 0 else "prose", None, f"the and rate {i % 7} is 2.5% of {'营业收入' * (i % 2)} word{i % 11}", 100 * k + i) for k, n in enumerate(names) for i in range(100)]
    prepared = ranking.prepare_chunks(spark.createDataFrame(rows, CHUNK)).cache()
    texts = ["the rate and the 营业收入", "and is of 3", "the word5 2.5%", "of the rate", "the and", "rate is", "the is of"]
    written = []
    for module in (ranking, pairs):
        kept = module.stored
        monkeypatch.setattr(module, "stored", lambda df, name, kept=kept: written.append(kept(df, name)) or written[-1])
    found = ranking.rank_documents(asked(spark, texts), prepared).collect()
    lifted = ranking.rank_by_rules(asked(spark, texts), prepared, 5).collect()
    assert sum(t.count() for t in written) < len(rows) * len(texts) / 4  # three scores a task, question and document, patterns and the questions
    monkeypatch.undo()

    every = ranking.scored_candidates(asked(spark, texts, names), prepared).collect()
    by = {}
    for r in every:
        by.setdefault(r["qid"], []).append(r)
    for q, own in by.items():
        want = sorted(own, key=lambda r: (-round(r["boost"], 4), r["chunk_ord"]))[:5]
        assert [(r["chunk_ord"], round(r["boost"], 4)) for r in want] == sorted(((r["chunk_ord"], r["boost"]) for r in lifted if r["qid"] == q), key=lambda x: (-x[1], x[0]))
        assert len([r for r in found if r["qid"] == q]) == len(names)
    prepared.unpersist()


def test_a_task_gives_its_documents_away_in_parts(spark, monkeypatch):
    monkeypatch.setattr(pairs, "HELD", 1)
    monkeypatch.setattr(pairs, "SLICE_PAIRS", 4)
    rows = [(f"d{i % 3}-chunk-{i}", f"d{i % 3}", "", "general", 1, "s", "prose", None, f"营业收入 rate {i}", i) for i in range(30)]
    prepared = ranking.prepare_chunks(spark.createDataFrame(rows, CHUNK)).cache()
    parts = ranking.rank_documents(asked(spark, ["营业收入 rate 7", "28"]), prepared).orderBy("qid", "doc_rank").collect()
    monkeypatch.undo()
    whole = ranking.rank_documents(asked(spark, ["营业收入 rate 7", "28"]), prepared).orderBy("qid", "doc_rank").collect()
    assert [(r["qid"], r["doc_id"], round(r["doc_score"], 9)) for r in parts] == [(r["qid"], r["doc_id"], round(r["doc_score"], 9)) for r in whole] and len(parts) == 6
    prepared.unpersist()


def test_page_metadata_equals_its_sql(spark, tmp_path):
    """Entities other than the three of markup, and cut ones, stay in a title; a meta tag's value stays as it is (F3)."""
    import duckdb

    from docloom import oracles, queries

    html = ["<title> a &amp; b &lt;c&gt; &quot;d&#39; &amp </title>", "<title>x&nbsp;y\t z&eacute;&amp;lt;</title>", '<meta name="ArticleTitle" content=" k &amp; l "><title>t</title>', '<meta name="PubDate" content="2024&#45;01"><meta content="s &lt;" name="SiteName">', None, "", "<th> 发布机构 </th><td>x &amp; y</td>"]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in queries.html_meta(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.execute(oracles.oracle_sql()["html_meta"]).fetchall())


def test_the_driver_fits_no_model(spark, monkeypatch):
    """The sample's features stay on the executors: once they came to the driver, whose memory the pipeline outgrew."""
    from docloom.llm import quality_model

    docs = spark.createDataFrame([(i, "good words here " * 3 if i % 2 else "bad #### text " * 3) for i in range(200)], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, 1 + i % 2) for i in range(200)], "doc_id long, grade int")
    want = quality_model.train(docs, ratings, 3)

    class Refused:
        def __reduce__(self):  # in tasks the function is as it was
            return getattr, (quality_model, "fit_ordinal")

        def __call__(self, *_):
            raise AssertionError("fitted on the driver")

    monkeypatch.setattr(quality_model, "fit_ordinal", Refused())
    got = quality_model.train(docs.repartition(5), ratings, 3)
    assert (got.weights == want.weights).all() and (got.thresholds == want.thresholds).all() and got.weights.any()


@pytest.mark.parametrize("pack", [200_000, 3])
def test_best_overlaps_leave_a_task_alone(spark, monkeypatch, pack):
    """Every document shares a token with every question: once each pair was shuffled (F4)."""
    from collections import Counter

    from docloom.operators import overlap

    monkeypatch.setattr(overlap, "PACK_TOKENS", pack)
    monkeypatch.setattr(overlap, "SLICE_PAIRS", 16)
    docs = [(i, ["the"] * (i % 3 + 1) + [f"w{i % 7}", f"w{i % 5}"] * (i % 2)) for i in range(300)] + [(300, []), (301, None), (302, ["alone"])]
    texts = [(0, ["the", "the", "w1"]), (1, ["the", "w2", "w3", "w3"]), (2, []), (3, ["unseen"]), (4, ["the"])]
    frame = spark.createDataFrame(docs, "doc_id long, tokens array<string>").repartition(4)
    found = overlap.best_overlaps(spark.createDataFrame(texts, "item_id long, tokens array<string>"), "item_id", frame, "doc_id", 5)
    want = []
    for q, ts in texts:
        norm = sum(n * n for n in Counter(ts).values()) ** 0.5 + 1
        scores = [(-round(sum((Counter(ts) & Counter(d)).values()) / norm, 6), k) for k, d in docs if set(ts) & set(d or [])]
        want += [(q, k, -s) for s, k in sorted(scores)[:5]]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.replace("BroadcastHashJoin", "") and "HashAggregate" not in plan


def test_overlap_score_joins_no_tokens(spark):
    from docloom import queries

    plan = queries.overlap_score(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Generate" not in plan


def test_strip_looks_at_ends_only_and_cuts_what_the_pattern_cuts(spark):
    """Every character of the first plane at both ends, and none inside, as the pattern that tried every character did (F9)."""
    rows = [(c, f"{chr(c)} {chr(c)}a {chr(c)} b{chr(c)}\n{chr(c)}") for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000] + [(0x10000, "\U0001d7d8 x 　"), (0x10001, ""), (0x10002, " \n ")]
    from docloom.functions import text as T

    frame = spark.createDataFrame(rows, "c int, t string")
    assert frame.where(~T.strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0
    assert "regexp" not in str(T.strip(F.col("t")))


def test_long_runs_are_found_from_their_beginning(spark):
    from docloom.operators import reports

    texts = ["x" * 49, "x" * 50, "中" + "y" * 50, "a " + "z" * 49 + "。" + "z" * 50, ("w" * 49 + " ") * 9, "\U0001d7d8" * 50, "\U0001d7d8" * 49 + "\t", "�", ""]
    rows = spark.createDataFrame([(t, "s", "prose") for t in texts], "chunk_text string, section_path string, chunk_type string")
    for r in rows.select("chunk_text", reports.chunk_issues().alias("i"), F.col("chunk_text").rlike(r"[^一-鿿　-〿＀-￯\s]{50,}").alias("long")).collect():
        assert ("long_non_cjk" in r["i"]) == r["long"] and ("garbled_chars" in r["i"]) == ("�" in r["chunk_text"])


def test_texts_without_entities_stay_in_the_jvm(spark, monkeypatch):
    """Only texts with an ampersand go to Python: once all did, in batches of up to 10,000 whole texts (F6)."""
    from docloom.functions import text as T

    frame = spark.createDataFrame([("a &amp; b  c",), ("plain  text",), (None,), ("",)], "t string")
    seen = []
    kept = T.unescape
    monkeypatch.setattr(T, "unescape", lambda c: seen.append(c) or kept(c))
    got = [r[0] for r in frame.select(T.normalize(F.col("t"))).collect()]
    assert got == ["a & b c", "plain text", None, ""]
    assert [r[0] for r in frame.select(seen[0]).collect()] == ["a &amp; b  c", None, None, None]


def test_shards_are_bounded_by_their_postings(spark, monkeypatch):
    """Long texts: a shard once held 16,384 rows, whatever their length (F5, F7, F8)."""
    import numpy as np

    from docloom.functions import text as T
    from docloom.operators import retrieval

    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 97}" for j in range(1, 60))) for i in range(200)], "doc_id long, text string").repartition(40)
    index = retrieval.index_shards(docs, "doc_id", {"text": T.latin_tokens(F.col("text"))}, [f"w{i}" for i in range(97)])
    batches = index.toArrow().to_batches()
    rows = [b for b in docs.select("doc_id", T.latin_tokens(F.col("text"))).toArrow().to_batches() if b.num_rows]
    monkeypatch.setattr(retrieval, "SHARD_POSTINGS", 1000)
    monkeypatch.setattr(retrieval, "PART_TOKENS", 130)
    shards = list(retrieval.Searcher([], [], np.zeros(97), np.ones(97), np.ones(1), 1).shards(iter(batches)))
    assert len(shards) > 5 and sum(s.n for s in shards) == 200 and max(len(s.row) for s in shards) < 2000
    parts = list(retrieval._parts(iter(rows)))
    assert sum(p.num_rows for p in parts) == 200 and max(p.num_rows for p in parts) == 2
    assert sorted(k for p in parts for k in p.column(0).to_pylist()) == list(range(200))


@pytest.mark.parametrize("qids", [["a", None, "c"], [7, None, 9]])
def test_search_starts_no_workers_beside_its_tasks(spark, qids):
    """A pack's questions once were a local frame: each core of an executor then kept a second Python worker, to the end (F5, F7)."""
    from docloom.functions import text as T
    from docloom.operators import retrieval

    kind = "string" if isinstance(qids[0], str) else "int"
    tokens = T.latin_tokens(F.col("text"))
    docs = spark.createDataFrame([(1, "red stone"), (2, "green stone green"), (3, "blue")], "doc_id long, text string")
    asked = spark.createDataFrame([(qids[0], "red"), (qids[1], "green stone"), (qids[2], "none"), (qids[2], "blue blue")], f"qid {kind}, text string")
    found = retrieval.search(asked, docs, "doc_id", {"text": tokens}, {"text": 1.0}, tokens)
    assert "ExistingRDD" not in found._jdf.queryExecution().toString()
    assert found.schema["qid"].dataType == asked.schema["qid"].dataType
    assert {(r["qid"], r["doc_id"], r["rank"]) for r in found.collect()} == {(qids[0], 1, 1), (None, 2, 1), (None, 1, 2), (qids[2], 3, 1)}

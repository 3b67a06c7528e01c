"""Runs that stop and go on, and questions that come by stream."""

import pytest
from pyspark.sql import functions as F

from docloom.plans import ledger, loop
from docloom.streaming.answering import answer_stream

CHUNK = "chunk_id string, doc_id string, title string, domain string, page_no int, section_path string, chunk_type string, clause_no string, chunk_text string, chunk_ord long"
QUESTION = "qid string, mode string, question string, options array<string>, answer_format string, doc_ids array<string>"
CHUNKS = [
    ("p1-chunk-1", "p1", "甲保险", "insurance", 1, "保险责任", "clause", "第一条", "第一条 本合同等待期为90天，自合同生效日起计算。", 1),
    ("p1-chunk-2", "p1", "甲保险", "insurance", 1, "身故保险金", "clause", "第二条", "第二条 身故保险金按基本保险金额的160%给付。", 2),
    ("p2-chunk-1", "p2", "乙保险", "insurance", 1, "保险责任", "clause", "第一条", "第一条 本合同等待期为180天。", 1),
]
QUESTIONS = [
    ("q1", "A", "甲保险的等待期为多少天", ["等待期为90天", "等待期为365天"], "mcq", ["p1"]),
    ("q2", "A", "关于等待期的保险条款说法正确的有", ["身故保险金按160%给付", "星际航行补贴每日999元"], "multi", ["p1", "p2"]),
    ("q3", "B", "无文档", ["甲", "乙"], "tf", []),
]


class Spy(ledger.Ledger):
    made: list = []

    def __init__(self, *a):
        super().__init__(*a)
        Spy.made.append(self)


def rows_of(out):
    keys = {"results": ["qid", "option"], "evaluation": ["qid", "round"], "log": ["qid", "round"], "evidence": ["qid", "rank", "chunk_id"]}
    return {n: [str(r.asDict(True)) for r in out[n].select(*sorted(out[n].columns)).orderBy(*k).collect()] for n, k in keys.items()}


def test_a_stopped_loop_goes_on_after_its_last_step(spark, tmp_path, monkeypatch):
    c, q = spark.createDataFrame(CHUNKS, CHUNK), spark.createDataFrame(QUESTIONS[1:2], QUESTION)
    monkeypatch.setattr(loop, "Ledger", Spy)
    folder, available, real = f"{tmp_path}/run", c.select("doc_id").distinct(), loop.retrieve

    def fails(plans, chunks, prepared, carried, first_round):
        if not first_round:
            raise RuntimeError("lost")
        return real(plans, chunks, prepared, carried, first_round)

    monkeypatch.setattr(loop, "retrieve", fails)
    with pytest.raises(RuntimeError, match="lost"):
        loop.run_loop(q, c, available, resume=folder)
    assert "evaluation-1" in Spy.made[-1].computed
    monkeypatch.setattr(loop, "retrieve", real)
    out = loop.run_loop(q, c, available, resume=folder)
    assert not any(s.endswith("-1") for s in Spy.made[-1].computed) and Spy.made[-1].computed[:2] == ["evidence-2", "verdicts-2"]
    once = loop.run_loop(q, c, available)
    assert rows_of(out) == rows_of(once)
    loop.run_loop(q, c, available, resume=folder)
    assert Spy.made[-1].computed == []
    with pytest.raises(ValueError, match="other questions"):
        loop.run_loop(q.limit(0), c, available, resume=folder)


def test_a_step_that_was_not_finished_is_made_again(spark, tmp_path):
    steps = ledger.Ledger(spark, str(tmp_path))
    assert steps.keep("a", lambda: spark.range(3)).count() == 3
    (tmp_path / "a" / "_SUCCESS").unlink()
    assert steps.keep("a", lambda: spark.range(5)).count() == 5 and steps.keep("a", lambda: spark.range(9)).count() == 5
    assert ledger.fingerprint(spark.range(4).repartition(3)).first() == ledger.fingerprint(spark.range(4)).first()
    assert tuple(ledger.fingerprint(spark.range(0)).first()) == (0, "0")


class Stub:
    """An engine that is lost in its first batch, after a step of the loop, and answers A."""

    def __init__(self, spark):
        self.spark, self.lost, self.computed = spark, False, []

    def answer(self, questions, chunks, available, resume):
        steps = ledger.Ledger(self.spark, resume)
        steps.keep("evidence-1", lambda: questions.select("qid"))
        if not self.lost:
            self.lost = True
            raise RuntimeError("lost")
        answers = steps.keep("evidence-2", lambda: questions.select("qid", F.lit("A").alias("answer")))
        self.computed.append(steps.computed)
        return {"answers": answers}


def test_streamed_questions_go_through_rounds_apart(spark, tmp_path):
    q = spark.createDataFrame(QUESTIONS, QUESTION)
    incoming, folder, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    q.where("qid != 'q3'").coalesce(1).write.json(incoming)
    engine = Stub(spark)
    stream = lambda: answer_stream(engine, spark.readStream.schema(QUESTION).json(incoming), spark.range(0), folder, checkpoint)
    with pytest.raises(Exception, match="lost"):
        stream().awaitTermination()
    stream().awaitTermination()
    q.where("qid = 'q3'").coalesce(1).write.mode("append").json(incoming)
    stream().awaitTermination()
    stream().awaitTermination()  # nothing new
    assert engine.computed == [["evidence-2"], ["evidence-1", "evidence-2"]]  # the lost batch went on after its step
    answered = spark.read.parquet(f"{folder}/answers")
    assert sorted((r["qid"], r["batch"]) for r in answered.collect()) == [("q1", 0), ("q2", 0), ("q3", 1)]

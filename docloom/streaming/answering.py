"""Questions that come in by stream: each micro-batch goes through the retrieval loop's rounds apart from the others.

A batch keeps its rounds in a folder of its own and its answers in one partition, both named by the batch's number, which a restarted stream gives again: a batch
that was stopped goes on after its last whole round, and none is answered twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from docloom.plans.engine import Engine
from docloom.plans.ledger import Ledger


def answer_stream(engine: Engine, questions: DataFrame, chunks: DataFrame, folder: str, checkpoint: str, available: DataFrame | None = None, **how) -> StreamingQuery:
    """Answers all that has come of the streamed ``questions``, then stops; ``folder`` gets ``answers/batch=N`` and ``rounds/batch=N``. ``how`` goes to ``Engine.answer``."""

    def run(batch: DataFrame, number: int) -> None:
        rounds = f"{folder}/rounds/batch={number}"
        asked = Ledger(engine.spark, rounds).keep("questions", lambda: batch)
        out = engine.answer(asked, chunks, available, resume=rounds, **how)
        out["answers"].write.mode("overwrite").parquet(f"{folder}/answers/batch={number}")

    return questions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""A log of model replies that survives lost tasks: no prompt is sent twice, no call goes on for ever, and few run at once.

Each reply is written by the task that got it, as one small file named by a hash of the attempt and the prompt, before the next call. A step asks only for prompts that the log
lacks, and a task looks again before each call, so a task that is run again goes on where it was lost. Equal prompts of one attempt are one call.
A call that raises, dies or takes longer than its limit is logged as a failed attempt. Tasks that run at the same moment on the same prompt (speculation) may both call.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.guarded import ChildError, in_child
from docloom.sources.shared import stored

LOG = "key string, reply string, prompt_tokens long, completion_tokens long, error string"


def prompt_key(attempt: int) -> Column:
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("system", "user")]
    return F.sha2(F.concat(F.lit(f"{attempt}:"), F.length(parts[0]).cast("string"), F.lit(":"), *parts), 256)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """``LOG``; empty where nothing is logged yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).json(path)


def _folder(path: str):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    system.create_dir(at, recursive=True)
    return system, at.rstrip("/")


def logged_replies(prompts: DataFrame, attempt: int, answerer: Callable, path: str, calls: int = 8, timeout: float | None = 90) -> DataFrame:
    """``qid, reply, prompt_tokens, completion_tokens, error`` of every prompt (``qid, system, user``), from the log at ``path`` or by a call.

    At most ``calls`` tasks call at a time, one prompt each, for ``timeout`` seconds at most.
    """
    spark = prompts.sparkSession
    keyed = prompts.withColumn("_key", prompt_key(attempt))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, at = _folder(path)
        for batch in batches:
            for i in range(len(batch)):
                one = batch.iloc[i : i + 1].reset_index(drop=True)
                key, prompt = one["_key"][0], one.drop(columns="_key")
                if system.get_file_info(f"{at}/{key}.json").type != fs.FileType.NotFound:
                    continue
                try:
                    rows = [r for out in in_child(lambda p=prompt: answerer(iter([p])), timeout) for r in out.to_dict("records")]
                    found, error = (rows[0], None) if rows else ({}, "no_reply")
                except ChildError as e:
                    found, error = {}, str(e)
                value = lambda c, f=found: None if pd.isna(f.get(c)) else f[c]
                entry = {"key": key, "reply": value("reply"), **{c: int(value(c) or 0) for c in ("prompt_tokens", "completion_tokens")}, "error": error}
                staged = f"{at}/.{key}.{uuid.uuid4().hex}"
                with system.open_output_stream(staged) as f:
                    f.write((json.dumps(entry) + "\n").encode())
                system.move(staged, f"{at}/{key}.json")
                yield pd.DataFrame({"key": [key]})

    fresh = keyed.dropDuplicates(["_key"]).join(read_log(spark, path).select(F.col("key").alias("_key")), "_key", "left_anti")
    fresh.repartition(calls, "_key").mapInPandas(run, "key string").count()
    known = stored(read_log(spark, path).dropDuplicates(["key"]), "reply-log")
    return keyed.select("qid", "_key").join(known.withColumnRenamed("key", "_key"), "_key").select("qid", "reply", "prompt_tokens", "completion_tokens", "error")

"""A run's finished steps in a folder, so that a stopped run goes on where it was: a step that is written whole is read, not run again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.shared import stored


def fingerprint(rows: DataFrame) -> DataFrame:
    """``n, digest``: the number of rows and a sum over their hashes, whatever their order. One pass."""
    whole = F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(whole).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


class Ledger:
    """Steps by name. Without a ``folder`` each is written anew below the shared folder; with one, its steps outlive the run.

    A step counts once Spark's marker of a finished write is there; what a lost run left of an unfinished one is written over. The folder belongs to one set of inputs
    (``check``). Two runs must not share it at the same time.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder.rstrip("/") if folder else None
        self.computed: list[str] = []

    def _has(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def keep(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.folder}/{name}"
        if self.folder and self._has(path):
            return self.spark.read.parquet(path)
        self.computed.append(name)
        rows = make()
        if not self.folder:
            return stored(rows, name)
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def check(self, **inputs: DataFrame) -> None:
        """An error if the folder holds steps of other inputs."""
        if not self.folder:
            return
        for name, rows in inputs.items():
            now = fingerprint(rows).first()
            then = self.keep(f"input-{name}", lambda now=now: self.spark.createDataFrame([now], "n long, digest string")).first()
            if tuple(now) != tuple(then):
                raise ValueError(f"{self.folder} holds a run over other {name}")

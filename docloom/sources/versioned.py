"""A table of immutable parts and a small pointer for each version, renamed into place last: readers see the old version or the new one, whole.

Rows are dealt to parts by the leading choice of bits of their key's hash. A batch rewrites only the parts that hold its keys, and a part that passes ``part_bytes`` is
split by further bits when it is next written, so what a batch rewrites follows the batch and not the table. Folders of former versions stay until ``vacuum``, for readers
that opened them. One writer at a time: a second one's version is refused.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

POINTER = re.compile(r"_pointer-(\d+)\.json")
PART_BYTES = 64 << 20
BITS = 30


class VersionedTable:
    """``path`` with rows told apart by ``key`` (a column; several rows may share one)."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", part_bytes: int = PART_BYTES):
        self.spark, self.path, self.key, self.part_bytes = spark, path.rstrip("/"), key, part_bytes
        self.jvm = spark.sparkContext._jvm

    # -------------------------------------------------------------- files
    def _at(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._at().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        fs, at = self._fs(), self._at()
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(m[1]) for m in map(POINTER.fullmatch, names) if m)

    def state(self) -> dict:
        """``version``, ``schema`` (JSON) and ``parts`` (bits, value, folder, bytes); version 0 has none."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "schema": None, "parts": []}
        stream = self._fs().open(self._at(f"_pointer-{versions[-1]:08d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, state: dict) -> None:
        """A pointer of its own for each version, renamed to a name that was never used: no reader can meet half of one, or none."""
        fs, staged, at = self._fs(), self._at(f"_staged-{uuid.uuid4().hex}"), self._at(f"_pointer-{state['version']:08d}.json")
        out = fs.create(staged, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.exists(at) or not fs.rename(staged, at):
            raise RuntimeError(f"another writer made version {state['version']} of {self.path}")

    # -------------------------------------------------------------- parts
    def _hash(self) -> Column:
        return F.xxhash64(F.col(self.key)).bitwiseAND(F.lit((1 << BITS) - 1))

    def _part_of(self, rows: DataFrame, parts: list[dict]) -> DataFrame:
        """The rows with ``_part``, the name of the part that holds their hash; each depth in use is one candidate, and one of them exists."""
        depths = sorted({p["bits"] for p in parts})
        named = self.spark.createDataFrame([(f"{p['bits']}-{p['value']}",) for p in parts], "_part string")
        each = F.array(*[F.concat(F.lit(f"{b}-"), self._hash().bitwiseAND(F.lit((1 << b) - 1)).cast("string")) for b in depths])
        return rows.withColumn("_part", F.explode(each)).join(named, "_part") if len(depths) > 1 else rows.withColumn("_part", each[0])

    def _paths(self, parts: list[dict]) -> list[str]:
        return [f"{self.path}/{p['folder']}" for p in parts]

    def _read(self, parts: list[dict], schema: StructType) -> DataFrame:
        held = [p for p in parts if p["bytes"]]
        return self.spark.read.schema(schema).parquet(*self._paths(held)) if held else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The newest version; stays readable while others are written."""
        state = self.state()
        if not state["version"]:
            raise FileNotFoundError(self.path)
        return self._read(state["parts"], StructType.fromJson(json.loads(state["schema"])))

    def _write(self, rows: DataFrame, parts: list[dict]) -> list[dict]:
        """New folders for ``parts``; each gets as many further bits as its bytes before ask for."""
        folder = f"data-{uuid.uuid4().hex}"
        target = []
        for p in parts:
            more = 0
            while p["bytes"] >> more > self.part_bytes and p["bits"] + more < BITS:
                more += 1
            target += [{"bits": p["bits"] + more, "value": p["value"] + (j << p["bits"])} for j in range(1 << more)]
        columns = rows.columns
        self._part_of(rows, target).repartition("_part").select(*columns, "_part").write.partitionBy("_part").parquet(f"{self.path}/{folder}")
        fs = self._fs()
        for p in target:
            p["folder"] = f"{folder}/_part={p['bits']}-{p['value']}"
            at = self._at(p["folder"])
            p["bytes"] = fs.getContentSummary(at).getLength() if fs.exists(at) else 0
        return target

    def _commit(self, state: dict, schema: StructType, parts: list[dict]) -> int:
        # empty parts have no folder: they stay in the pointer, so that every hash has a part
        self._publish({"version": state["version"] + 1, "schema": schema.json(), "parts": parts})
        return sum(p["bytes"] for p in parts)

    # -------------------------------------------------------------- changes
    def replace(self, rows: DataFrame) -> None:
        """All rows anew. Readers see the old table until the last rename."""
        state = self.state()
        size = max(1, sum(p["bytes"] for p in state["parts"]))
        self._commit(state, rows.schema, self._write(rows, [{"bits": 0, "value": 0, "bytes": size}]))

    def upsert(self, rows: DataFrame) -> int:
        """Rows take the place of those with their keys; returns the bytes written. Running a batch again leaves the same table."""
        return self._change(rows, rows.select(self.key).distinct())

    def delete(self, keys: DataFrame) -> int:
        """Rows with ``keys`` go; returns the bytes written."""
        return self._change(None, keys.select(self.key).distinct())

    def _change(self, rows: DataFrame | None, keys: DataFrame) -> int:
        state = self.state()
        if not state["version"]:
            if rows is not None:
                return self._commit(state, rows.schema, self._write(rows, [{"bits": 0, "value": 0, "bytes": 0}]))
            return 0
        schema = StructType.fromJson(json.loads(state["schema"]))
        touched = {r["_part"] for r in self._part_of(keys, state["parts"]).select("_part").distinct().collect()}  # names in the pointer
        mine = lambda p: f"{p['bits']}-{p['value']}" in touched
        old, rest = [p for p in state["parts"] if mine(p)], [p for p in state["parts"] if not mine(p)]
        if not old:
            return 0
        kept = self._read(old, schema).join(keys, self.key, "left_anti").select(*schema.names)
        new = self._write(kept if rows is None else kept.unionByName(rows.select(*schema.names)), old)
        self._commit(state, schema, rest + new)
        return sum(p["bytes"] for p in new)

    def vacuum(self) -> None:
        """Removes versions before the newest and folders that it does not use; readers of older ones must be done."""
        state = self.state()
        used = {p["folder"].split("/")[0] for p in state["parts"]}
        fs = self._fs()
        for status in fs.listStatus(self._at()):
            name = status.getPath().getName()
            version = POINTER.fullmatch(name)
            if (name.startswith("data-") and name not in used) or name.startswith("_staged-") or (version and int(version[1]) < state["version"]):
                fs.delete(status.getPath(), True)

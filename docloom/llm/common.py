"""Shared pieces of the training-data operators.

* ``shared_path`` / ``materialize`` / ``discard``: written tables in the folder the cluster
  names in ``spark.checkpoint.dir`` (one of our own only on a local master where it is unset).
* ``narrow`` / ``partitions_for``: numbers of tasks that follow the stored size of what a plan reads.
* Arrow helpers that hand NumPy views over text columns, in bounded slices.
* Vectorised word and window hashing: a word is a maximal run of bytes other
  than 0x20 and 0x09-0x0D and has two independent 64-bit hashes (lanes); windows of
  words are hashed by a Rabin-Karp polynomial over word hashes modulo 2**64 through prefix sums.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once in a Python worker; temporaries stay a few times this size.
SLICE_BYTES = 1 << 19
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20
#: Stored bytes a task takes at most, where a number of tasks is chosen here.
TASK_BYTES = 128 << 20


# ---------------------------------------------------------------- shared files
def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``; sets a folder of our own only where that is unset, and only if driver and tasks share the machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "docloom-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/docloom/{name}-{uuid.uuid4().hex}"


def stored_bytes(df: DataFrame) -> int:
    """Stored size of the tables a plan reads, as Spark's file listing gives it: no job runs. Rows that come from elsewhere count nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)


def narrow(df: DataFrame, per_core: int = 4) -> DataFrame:
    """At most ``per_core`` partitions for each core, or one for each ``TASK_BYTES`` read if those are more, without a shuffle.

    Small partitions end in fewer files; large tables keep the partitions they have.
    """
    cores = max(2, df.sparkSession.sparkContext.defaultParallelism)
    return df.coalesce(max(per_core * cores, -(-stored_bytes(df) // TASK_BYTES)))


def materialize(df: DataFrame, name: str, per_core: int = 4) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    narrow(df, per_core).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove materialised tables that nothing will read again."""
    for table in tables:
        spark, files = table.sparkSession, table.inputFiles()
        if files and "/docloom/" in files[0]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def partitions_for(df: DataFrame) -> int:
    """Shuffle partitions for the rows of ``df``: the session's number, or one for each ``TASK_BYTES`` that the plan reads if those are more."""
    return max(shuffle_partitions(df.sparkSession), -(-stored_bytes(df) // TASK_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows and ``BATCH_BYTES``: long texts would make the default of 10,000 rows too large for a worker."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def docs_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (as long) and the text (null: empty), whatever other columns the table has."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


_PLACE_BITS = 33  # of the ids that Spark numbers rows with: the partition stands above


def range_sorted(rows: DataFrame, order: list, name: str, n_rows: int, part_rows: int) -> DataFrame:
    """The rows in ranges of the order, sorted and written, with their range ``part`` and their place ``at`` in it (from 0).

    ``order`` has names (ascending, nulls first) or sort orders; it should tell all rows apart, so that no value is too common to be split. ``rows`` should be
    a written table: it is read twice, for the ranges' borders and for the rows.
    """
    keys = [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in order]
    n = max(1, min(shuffle_partitions(rows.sparkSession), n_rows // 4096), -(-n_rows // part_rows))
    held = materialize(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id()), name)
    return held.select("*", F.shiftright("_row", _PLACE_BITS).cast("int").alias("part"), F.col("_row").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias("at")).drop("_row")


# ---------------------------------------------------------------- Arrow
def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """All rows of one ``part`` (a column, in order) at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        part = batch.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and part[a] != now:
                yield int(now), pa.Table.from_batches(held)
                held = []
            now = part[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield int(now), pa.Table.from_batches(held)


def utf8_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (uint8) and offsets (int64, n + 1) of a string or binary array; null: empty."""
    n = len(arr)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    buffers = arr.buffers()
    off = np.frombuffer(buffers[1], kind)[arr.offset : arr.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: int, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that ``column`` holds about ``max_bytes`` (one row at least) each."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        _, off = utf8_buffers(batch.column(column))
        start = 0
        while start < n:
            stop = int(np.searchsorted(off, off[start] + max_bytes, side="right")) - 1
            stop = min(n, max(stop, start + 1))
            yield batch.slice(start, stop - start)
            start = stop
    give_back_memory()


def give_back_memory() -> None:
    """Freed memory goes back to the system: a Python worker serves many tasks and would keep the largest one's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


# ---------------------------------------------------------------- hashing
_MASK = (1 << 64) - 1
_LENGTH_FACTOR = 0x9E3779B97F4A7C15
_LANE_SEEDS = (np.uint64(0x5851F42D4C957F2D), np.uint64(0xD1342543DE82EF95))
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Spans of more bytes are hashed by a digest of their own.
LONG_SPAN = 64
_WORD_BASE = 0xD6E8FEB86659FD93
#: Base of a second window hash, taken over the words' second lane.
SECOND_BASE = 0xA0761D6478BD642F
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept and grown."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, base & _MASK, np.uint64)
        out[0] = 1
        have = _powers[base] = np.cumprod(out, dtype=np.uint64)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, off: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (n + 1 entries); ``between`` marks the bytes that no word has."""
    inside = ~between[data]
    if len(data) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[cut[:-1]] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[cut[1:]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes; lanes 0 and 1 are independent halves of 128 bits.

    Eight bytes at a time go through a bijective, non-linear mix that starts from the length, so spans of equal length up to eight bytes never
    collide. Spans over ``LONG_SPAN`` bytes have a keyed BLAKE2b digest instead, which bounds the number of rounds.
    """
    size = ends - starts
    h = mix(size.astype(np.uint64) * np.uint64(_LENGTH_FACTOR) + _LANE_SEEDS[lane])
    if len(data) == 0 or len(starts) == 0:
        return h
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    words = np.lib.stride_tricks.as_strided(padded[: (len(padded) // 8) * 8].view(np.uint64), (len(data) + 8,), (1,))  # eight bytes from every place
    at = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    done = 0
    while len(at):
        left = np.minimum(size[at] - done, 8).astype(np.uint64)
        chunk = words[starts[at] + done] & (_FULL >> (np.uint64(64) - np.uint64(8) * left))
        h[at] = mix((h[at] ^ chunk) + _LANE_SEEDS[lane])
        done += 8
        at = at[size[at] > done]
    long = np.flatnonzero(size > LONG_SPAN)
    if len(long):
        raw = data.tobytes() if len(long) > 1 else None
        for i in long.tolist():
            span = raw[starts[i] : ends[i]] if raw is not None else data[starts[i] : ends[i]].tobytes()
            digest = hashlib.blake2b(span, digest_size=16, key=b"docloom").digest()
            h[i] = int.from_bytes(digest[8 * lane : 8 * lane + 8], "little")
    return h


class WindowHasher:
    """Rabin-Karp over word hashes: any run of words in constant time."""

    def __init__(self, words: np.ndarray, base: int = _WORD_BASE):
        self.total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers(base, len(words)), out=self.total[1:])
        self.inv = powers(inverse(base), len(words) + 1)

    def runs(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.total[start + length] - self.total[start]) * self.inv[start])


def window_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index of each full window of ``k`` words, and the number of windows of each text."""
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    return ranges(first[:-1], counts), counts


def ranges(start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start[i], start[i]+1, ... (counts[i] of them), one after another."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(start - (ends - counts), counts)


class Interner(dict):
    """Numbers keys in order of first sight; ``fresh`` gathers the new ones."""

    __slots__ = ("fresh",)

    def __init__(self):
        super().__init__()
        self.fresh: list = []

    def __missing__(self, key):
        n = self[key] = len(self)
        self.fresh.append(key)
        return n

    def number(self, keys: list) -> np.ndarray:
        self.fresh = []
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))

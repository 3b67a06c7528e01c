"""Approximate nearest neighbours by shifted space-filling curves.

Each of ``curves`` orderings projects vectors by its own random rotation to a few dimensions, shifts them by a random offset, cuts each dimension into
cells and takes the cell's place on a Hilbert curve. Spark range-sorts all vectors along each curve; consecutive ``block`` vectors are a window,
and a query meets its own window and the two next to it. What it finds there is measured on 8-bit copies of the vectors that travel with
the keys; the best of all curves merge and are reranked on the original vectors in double precision.

Equal vectors are one class: a class is ordered and searched once, whatever the number of its copies, and stands for its ``k`` + 1 least ids (no
answer can need more). So copies neither fill windows nor become a hot key.

The index is fitted on at most ``SAMPLE`` vectors (bounds of the projections); every vector is in it. Windows have a fixed number of vectors, so work
grows with the table; where a table has at most three windows, the answer is exact. Measured recall: see README (isotropic vectors are the worst case; more curves or wider windows
raise it).

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those of another length than most have (of equally
common lengths the shorter counts), nor rows without an id; repeated rows are candidates of their own, and each query row gives its answer; ties go to the smaller id; with fewer
than ``k`` candidates all are returned; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, discard, materialize, narrow, range_sorted, utf8_buffers

CURVES, BLOCK = 16, 2048
#: Curves whose orderings are on disk at a time.
TOGETHER = 4
DIMENSIONS, BITS = 6, 5
#: Vectors that the bounds of the projections are taken from.
SAMPLE = 4096
#: Candidates a query keeps from a curve, and for the exact measure.
KEEP = 32
#: Rows of a range along the curves.
ROWS = 1 << 17


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells (rows of ``bits``-bit coordinates)."""
    x = cells.astype(np.uint32).copy()
    dims = x.shape[1]
    for b in range(bits - 1, 0, -1):  # undo the rotations of each finer level
        low = np.uint32((1 << b) - 1)
        for i in range(dims):
            high = (x[:, i] >> np.uint32(b)) & 1
            swap = np.where(high == 1, 0, (x[:, 0] ^ x[:, i]) & low).astype(np.uint32)
            x[:, 0] ^= np.where(high == 1, low, swap).astype(np.uint32)
            x[:, i] ^= swap
    for i in range(1, dims):  # Gray code
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.uint32)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, -1] >> np.uint32(b)) & 1 == 1, np.uint32((1 << b) - 1), np.uint32(0))
    x ^= turn[:, None]
    place = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            place = (place << 1) | ((x[:, i] >> np.uint32(b)) & 1).astype(np.int64)
    return place


@dataclass(frozen=True)
class Curves:
    """Projections (curves x length x dimensions), lower bounds, and cells per unit, of all orderings."""

    axes: np.ndarray
    low: np.ndarray
    scale: np.ndarray

    def keys(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        cells = np.floor((vectors @ self.axes[curve] - self.low[curve]) * self.scale[curve])
        return hilbert(np.clip(np.nan_to_num(cells), 0, (1 << BITS) - 1).astype(np.uint32), BITS)


def fit_curves(sample: np.ndarray, length: int, curves: int = CURVES, seed: int = 11) -> Curves:
    """Bounds come from the sample; the grid is twice as wide as they are, moved by a random share of that, so that no two curves have their borders in one place."""
    rng = np.random.default_rng(seed)
    dims = min(DIMENSIONS, length)
    axes, low, scale = [], [], []
    for _ in range(curves):
        axis = np.linalg.qr(rng.normal(size=(length, dims)))[0]
        seen = sample @ axis if len(sample) else np.zeros((1, dims))
        a, b = seen.min(axis=0), seen.max(axis=0)
        width = np.where(b > a, b - a, 1.0)
        axes.append(axis)
        low.append(a - rng.random(dims) * width)
        scale.append((1 << BITS) / (2 * width))
    return Curves(np.array(axes), np.array(low), np.array(scale))


def _matrix(blobs: pa.Array, kind: str = "<f8") -> np.ndarray:
    """Vectors of one length from their bytes, one to a row."""
    data, off = utf8_buffers(blobs)
    return data.view(kind).reshape(len(blobs), -1) if len(data) else np.zeros((len(blobs), 0))


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vec`` (array of doubles) of the rows that take part."""
    vec = F.col(f"`{vector_col}`").cast("array<double>")
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), vec.alias("vec")).where("id is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) != double('Infinity')) and exists(vec, x -> x != 0)")
    common = rows.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    return rows.where(F.size("vec") == (common[0]["n"] if common else 0))


def keyed(rows: DataFrame) -> DataFrame:
    """``id, blob, k1, k2``: a vector's bytes (of doubles, with one kind of zero) and 120 bits that stand for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False) + 0.0
                width = len(flat) // batch.num_rows * 8
                blob = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(np.arange(0, width * batch.num_rows + 1, width, dtype=np.int32)), pa.py_buffer(flat.astype("<f8"))])
                yield pa.RecordBatch.from_arrays([batch.column(0), blob], ["id", "blob"])

    half = lambda a: F.conv(F.substring("key", a, 15), 16, 10).cast("long")
    return rows.select("id", "vec").mapInArrow(run, "id long, blob binary").withColumn("key", F.sha2("blob", 256)).select("id", "blob", half(1).alias("k1"), half(16).alias("k2"))


def ordered(classes: DataFrame, curves: Curves, first: int, last: int) -> DataFrame:
    """``curve, key, cls, query, codes, unit``: the classes along each of the curves, with an 8-bit copy of the vector and what its unit is."""
    shared = classes.sparkSession.sparkContext.broadcast(curves)  # length x dimensions numbers a curve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            vectors = _matrix(batch.column(2))
            unit = np.abs(vectors).max(axis=1) / 127
            codes = np.rint(vectors / unit[:, None]).astype(np.int8)
            blob = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(codes))])
            for c in range(first, last):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, c, np.int32)), pa.array(shared.value.keys(vectors, c)), batch.column(0), batch.column(1), blob, pa.array(unit)], ["curve", "key", "cls", "query", "codes", "unit"])

    return classes.select("cls", "query", "blob").mapInArrow(run, "curve int, key long, cls long, query boolean, codes binary, unit double")


def _windowed(sorted_: DataFrame, block: int) -> DataFrame:
    """The ordered rows with ``window``, their place along the curve over ``block``, from the ranges' row counts."""
    found = sorted_.groupBy("part", "curve").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).collect()  # a row for each range and curve in it
    before: dict[int, int] = {}
    rows = []
    for r in sorted(found, key=lambda r: (r["curve"], r["part"])):
        rows.append((r["part"], r["curve"], before.get(r["curve"], 0) - r["first"]))
        before[r["curve"]] = before.get(r["curve"], 0) + r["n"]
    moved = F.broadcast(sorted_.sparkSession.createDataFrame(rows, "part int, curve int, move long"))  # as many rows
    return sorted_.join(moved, ["part", "curve"]).withColumn("window", F.floor((F.col("at") + F.col("move")) / block)).select("curve", "window", "cls", "query", "codes", "unit")


def window_neighbours(windows: DataFrame, keep: int = KEEP) -> DataFrame:
    """``q, c, score``: for each query the best of its own and the two neighbouring windows on every curve, by squared distance of the 8-bit copies."""
    near = windows.where("query").select("curve", F.explode(F.array(F.col("window") - 1, F.col("window"), F.col("window") + 1)).alias("window"), "cls", F.lit(True).alias("asks"), "codes", "unit")
    both = near.unionByName(windows.select("curve", "window", "cls", F.lit(False).alias("asks"), "codes", "unit"))

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").combine_chunks().to_numpy(zero_copy_only=False)
        cls, unit = table.column("cls").to_numpy(), table.column("unit").to_numpy()
        own, ask = np.flatnonzero(~asks), np.flatnonzero(asks)
        if len(own) == 0 or len(ask) == 0:
            return empty
        vectors = _matrix(table.column("codes").combine_chunks(), np.int8).astype(np.float64) * unit[:, None]
        here = vectors[own]
        norm = (here * here).sum(axis=1)
        qs, cs, scores = [], [], []
        for a in range(0, len(ask), 256):  # some windows hold many queries
            at = ask[a : a + 256]
            mine = vectors[at]
            far = np.maximum(norm[None, :] + (mine * mine).sum(axis=1)[:, None] - 2 * mine @ here.T, 0)
            far[cls[at][:, None] == cls[own][None, :]] = np.inf
            best = np.argpartition(far, keep - 1, axis=1)[:, :keep] if keep < len(own) else np.tile(np.arange(len(own)), (len(at), 1))
            value = np.take_along_axis(far, best, 1)
            good = np.isfinite(value)
            qs.append(np.repeat(cls[at], best.shape[1])[good.ravel()])
            cs.append(cls[own][best][good])
            scores.append(value[good])
        return pa.table({"q": np.concatenate(qs), "c": np.concatenate(cs), "score": np.concatenate(scores)})

    empty = pa.table({"q": pa.array([], pa.int64()), "c": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    return both.groupBy("curve", "window").applyInArrow(run, "q long, c long, score double")


def measured(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``q, c, score``: the Euclidean distance of the original vectors, summed in order in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _matrix(batch.column(2)) - _matrix(batch.column(3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.sqrt(np.cumsum(d * d, axis=1)[:, -1]))], ["q", "c", "score"])

    left, right = vectors.select(F.col("cls").alias("q"), F.col("blob").alias("x")), vectors.select(F.col("cls").alias("c"), F.col("blob").alias("y"))
    return pairs.select("q", "c").join(left, "q").join(right, "c").select("q", "c", "x", "y").mapInArrow(run, "q long, c long, score double")


def _first(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def nearest(rows: DataFrame, asks: Column, k: int = 10, curves: int = CURVES, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 11) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row that ``asks`` (a condition on ``id``), nearest first, by Euclidean distance."""
    bound_batches(rows.sparkSession)
    held = materialize(keyed(usable(rows, id_col, vector_col)), "vectors")
    asking = held.where(asks).select("id", "k1", "k2")
    # a task sends no more than k + 1 rows of a class, so its copies are no hot key
    kept = _first(held, ["k1", "k2"], ["id"], k + 1).groupBy("k1", "k2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("blob").alias("blob"))
    kept = kept.join(asking.select("k1", "k2").distinct().withColumn("query", F.lit(True)), ["k1", "k2"], "left").withColumn("query", F.coalesce("query", F.lit(False)))
    classes = materialize(kept.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")

    sample = [r["blob"] for r in classes.orderBy(F.xxhash64("k1", F.lit(seed)), "cls").limit(SAMPLE).select("blob").collect()]  # at most SAMPLE vectors
    known = np.array([np.frombuffer(bytes(b), "<f8") for b in sample]) if sample else np.zeros((0, 1))
    index = fit_curves(known, known.shape[1], curves, seed)
    n_classes = classes.count()
    parts = []
    for first in range(0, curves, TOGETHER):
        last = min(first + TOGETHER, curves)
        along = materialize(ordered(classes, index, first, last), "curve-keys")
        sorted_ = range_sorted(along, ["curve", "key", "cls"], "curves", n_classes * (last - first), ROWS)
        parts.append(materialize(window_neighbours(_windowed(sorted_, block)), "window-neighbours", 1))
        discard(along, sorted_)
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    few = _first(found.groupBy("q", "c").agg(F.min("score").alias("score")), ["q"], ["score", "c"], KEEP)
    named = classes.select("cls", "ids")
    best = measured(materialize(few.select("q", "c"), "pairs"), classes).join(named.withColumnRenamed("cls", "c"), "c")
    best = _first(best, ["q"], ["score", F.get("ids", 0)], k).select("q", "score", "ids")
    own = named.join(classes.where("query").select("cls"), "cls", "left_semi").select(F.col("cls").alias("q"), F.lit(0.0).alias("score"), "ids")
    lists = own.unionByName(best).groupBy("q").agg(F.array_sort(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("score").alias("score"), i.alias("id")))))).alias("near"))  # (k + 1) squared at most
    lists = classes.select("cls", "k1", "k2").join(lists, F.col("cls") == F.col("q")).select("k1", "k2", "near")
    # a query's own row is the entry at distance 0 with its id, if that is among its class's least ids; a repeated row is another one
    me = F.array_position("near", F.struct(F.lit(0.0).alias("score"), F.col("id").alias("id")))
    others = F.when(me > 0, F.concat(F.slice("near", F.lit(1), (me - 1).cast("int")), F.slice("near", (me + 1).cast("int"), F.lit(k)))).otherwise(F.col("near"))
    answers = asking.join(lists, ["k1", "k2"]).select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("place", "n"))
    return narrow(answers.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("n.id").alias("vec_id"), F.col("n.score").alias("score")))

"""Ordinal cumulative-link regression on graded ratings.

P(grade <= k) = 1 / (1 + exp(w.x - theta_k)): one weight vector over hashed text features is shared by all grades, with
ordered thresholds. The model gives the expected grade and the tail probability P(grade >= cut) for selection.

Features (each a bucket of one hashed space, present or not): words in lower case, shapes of words (runs of
letters, capitals and digits collapsed, other bytes as they are) in bins by how common they are in the text, and a bin for the share
of words that repeat. Presence does not grow with length, so a single telling word counts the same in a long text.

The model is fitted on a bounded sample of rated documents (``SAMPLE_ROWS``, those with the least hashes of their ids);
every document is scored.

Defined results: a null or empty text has only the bin features and gets a score like any other;
ratings that are null, or whose document is missing, are left out of the fit; several ratings of a
document each count; of rows that share a rated id the text with the least hash is fitted; without any rating the weights are zero and grades equally likely; very long texts are whole; a row without an id is scored too;
repeated rows each give a row; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, docs_text, give_back_memory, lower_ascii, mix, narrow, slices, span_hashes, utf8_buffers, word_spans

BUCKETS = 1 << 18
#: Rated documents that the fit reads at most.
SAMPLE_ROWS = 12_000
#: A bucket seen in fewer sampled documents keeps weight zero.
MIN_DOCS = 6
_SHAPE_SALT, _REPEAT_SALT = np.uint64(0x51A9E), np.uint64(0x4E9EA7)
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58] = ord("0")
_CLASS[65:91] = ord("A")
_CLASS[97:123] = ord("a")
_CLASS[128:] = ord("a")


def _per_doc_unique(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, key) with counts; key below 2**40."""
    both, counts = np.unique((doc.astype(np.uint64) << np.uint64(40)) | (key & np.uint64((1 << 40) - 1)), return_counts=True)
    return (both >> np.uint64(40)).astype(np.int64), both & np.uint64((1 << 40) - 1), counts


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every present feature, sorted by document."""
    n = len(off) - 1
    starts, ends, first = word_spans(data, off)
    words = np.diff(first)
    doc = np.repeat(np.arange(n), words)
    low = lower_ascii(data)
    hashes = span_hashes(low, starts, ends)
    d1, k1, counts = _per_doc_unique(doc, hashes)
    # the share of words that are a repeat, in tenths
    distinct = np.bincount(d1, minlength=n)
    repeat = np.where(words > 0, (10 * (words - distinct)) // np.maximum(words, 1), 10).astype(np.uint64)
    # shapes: runs of one class of bytes collapsed
    cls = _CLASS[data]
    keep = np.ones(len(cls), bool)
    keep[1:] = (cls[1:] != cls[:-1]) | ((cls[1:] != ord("a")) & (cls[1:] != ord("A")) & (cls[1:] != ord("0")))
    keep[starts] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    shape = span_hashes(cls[keep], at[starts], at[ends]) if len(starts) else hashes
    d2, k2, c2 = _per_doc_unique(doc, shape)
    level = np.ceil(np.log2(np.maximum(words[d2], 1) / c2)).astype(np.uint64) if len(d2) else k2  # 0: all words, 1: half of them, ...
    word_bucket = mix(k1) % np.uint64(BUCKETS)
    shape_bucket = mix(k2 ^ mix(level + _SHAPE_SALT)) % np.uint64(BUCKETS)
    repeat_bucket = mix(mix(repeat + _REPEAT_SALT)) % np.uint64(BUCKETS)
    docs = np.concatenate([d1, d2, np.arange(n)])
    buckets = np.concatenate([word_bucket, shape_bucket, repeat_bucket]).astype(np.int64)
    both = np.unique(docs * BUCKETS + buckets)
    return both // BUCKETS, both % BUCKETS


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray  # BUCKETS, float32
    thresholds: np.ndarray  # grades - 1, rising

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 ... grades - 1; one row per score."""
        return 1.0 / (1.0 + np.exp(self.thresholds[None, :] - score[:, None]))


def fit_ordinal(doc: np.ndarray, bucket: np.ndarray, grade: np.ndarray, n_grades: int, rounds: int = 150, l2: float = 0.6) -> OrdinalModel:
    """Maximum a posteriori fit by Adam on the whole sample; deterministic."""
    weights = np.zeros(BUCKETS, np.float32)
    n = len(grade)
    if n == 0:
        return OrdinalModel(weights, np.log(np.arange(1, n_grades) / np.arange(n_grades - 1, 0, -1)))
    common = (np.bincount(bucket, minlength=BUCKETS) >= MIN_DOCS)[bucket]
    used = np.unique(bucket[common])
    place = np.zeros(BUCKETS, np.int64)
    place[used] = np.arange(len(used))
    at = place[bucket[common]]
    doc = doc[common].astype(np.int64)
    del bucket, common
    share = np.clip(np.array([(grade <= k).mean() for k in range(n_grades - 1)]), 1e-3, 1 - 1e-3)
    theta = np.log(share / (1 - share))
    # thresholds as the first one and positive gaps keeps them in order
    free = np.concatenate([[theta[0]], np.log(np.maximum(np.diff(theta), 1e-2))])
    params = np.concatenate([np.zeros(len(used)), free])
    m, v = np.zeros_like(params), np.zeros_like(params)
    sig = lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, rounds + 1):
        w, free = params[: len(used)], params[len(used) :]
        theta = np.cumsum(np.concatenate([[free[0]], np.exp(free[1:])]))
        score = np.bincount(doc, weights=w[at], minlength=n)
        upper = np.concatenate([theta, [np.inf]])[grade]
        lower = np.concatenate([[-np.inf], theta])[grade]
        hi, lo = np.where(np.isinf(upper), 1.0, sig(upper - score)), np.where(np.isinf(lower), 0.0, sig(lower - score))
        p = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_score = d_hi - d_lo  # of -log p
        g_theta = np.array([(-d_hi[grade == k]).sum() + d_lo[grade == k + 1].sum() for k in range(n_grades - 1)])
        g_free = np.cumsum(g_theta[::-1])[::-1].copy()
        g_free[1:] *= np.exp(free[1:])
        g = np.concatenate([np.bincount(at, weights=g_score[doc], minlength=len(used)) + l2 * w, g_free])
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        params = params - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w, free = params[: len(used)], params[len(used) :]
    weights[used] = w
    return OrdinalModel(weights, np.cumsum(np.concatenate([[free[0]], np.exp(free[1:])])))


def sampled_ratings(ratings: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> DataFrame:
    """At most ``sample_rows`` of ``doc_id, grade``, those with the least hash; enough rows to fit on, whatever the input."""
    return ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade")).where("doc_id is not null and grade is not null").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "grade").limit(sample_rows)


def train(docs: DataFrame, ratings: DataFrame, n_grades: int, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit on a bounded sample, in one task: the driver sees ids, grades and the finished model, never the sample's features."""
    sample = [(r["doc_id"], r["grade"]) for r in sampled_ratings(ratings, sample_rows).collect()]  # two small numbers for each of at most sample_rows
    spark = docs.sparkSession
    ids = spark.createDataFrame([(d,) for d, _ in sample], "doc_id long").distinct()
    texts = docs_text(docs, id_col, text_col).join(F.broadcast(ids), "doc_id", "left_semi")
    texts = texts.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text").alias("h"), F.length("text").alias("n"))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            doc, bucket = features(*utf8_buffers(batch.column(1)))
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            blob = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((cut * 4).astype(np.int32)), pa.py_buffer(bucket.astype("<i4"))])
            yield pa.RecordBatch.from_arrays([batch.column(0), blob], ["doc_id", "buckets"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {d: np.frombuffer(b.as_buffer(), "<i4") for batch in batches for d, b in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)}
        rated = sorted((d, g) for d, g in sample if d in found)
        grades = np.array([g for _, g in rated], np.int64)
        own = [found[d] for d, _ in rated]
        none = np.zeros(0, np.int32)
        doc, bucket = np.repeat(np.arange(len(own), dtype=np.int32), [len(b) for b in own]), np.concatenate([none, *own])
        del found, own
        model = fit_ordinal(doc, bucket, grades, n_grades)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.thresholds.tobytes()], pa.binary())], ["weights", "thresholds"])
        give_back_memory()

    fitted = texts.mapInArrow(run, "doc_id long, buckets binary").repartition(1).mapInArrow(fit, "weights binary, thresholds binary").collect()  # a sample of bounded size; one row comes back
    if not fitted:
        return fit_ordinal(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64), n_grades)
    return OrdinalModel(np.frombuffer(bytes(fitted[0]["weights"]), np.float32), np.frombuffer(bytes(fitted[0]["thresholds"]), np.float64))


def score(docs: DataFrame, model: OrdinalModel, cut: int, min_tail: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, expected_grade, tail_probability`` (of grade >= cut) and ``kept`` (tail >= min_tail) for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, 1):
            doc, bucket = features(*utf8_buffers(batch.column(1)))
            total = np.bincount(doc, weights=m.weights[bucket], minlength=batch.num_rows)
            tails = m.tails(total)
            tail = tails[:, cut - 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(tails.sum(axis=1), 6)), pa.array(np.round(tail, 6)), pa.array(tail >= min_tail)], ["doc_id", "expected_grade", "tail_probability", "kept"])

    return narrow(docs_text(docs, id_col, text_col)).mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, kept boolean")


def keep_good(docs: DataFrame, model: OrdinalModel, cut: int, min_tail: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents whose tail probability reaches ``min_tail``, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, at):
            doc, bucket = features(*utf8_buffers(batch.column(at)))
            total = np.bincount(doc, weights=m.weights[bucket], minlength=batch.num_rows)
            yield batch.filter(pa.array(m.tails(total)[:, cut - 1] >= min_tail))

    bound_batches(docs.sparkSession)
    return narrow(docs).mapInArrow(run, docs.schema)


def graded_ratings(labels: DataFrame) -> DataFrame:
    """Grades from ``doc_id, quality, toxic``: 0 toxic, 1 poor, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))

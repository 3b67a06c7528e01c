"""Importance resampling towards a target: documents are drawn in proportion to how much likelier their features are in the target than in the corpus.

Features are all runs of 1 to ``max_run`` consecutive words, hashed into buckets. The corpus becomes inverted postings (bucket, document, count), written once in
blocks. They are dealt out by bucket together with both corpora's counts of that bucket; the receiving task computes the buckets' gains from what has come
together there, and sends gain times count back to the documents, where contributions are summed. A bucket with more postings than a
task's share is split by block into several slices, each with the bucket's counts, so a feature that all documents have is no hot key.

With s of S features of the corpus and t of T of the target in a bucket, of B buckets, its gain is floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))). A
document's weight is the floored mean of its features' gains. Adding Gumbel noise (from a hash of the seed and the id) to the weights and taking the
highest draws without replacement in proportion to exp(weight / 1000). Ranks come from a range sort and the ranges' row counts, so nothing is sorted in one task.

Defined results: a null or empty text has no features and weight 0; repeated rows are documents of their own with equal scores, ranked side by side; rows that share an id and a score are ranked by their number of features; a row without an id
draws as if its id were empty and comes after others that tie; very long texts are whole, handled one at a time where they exceed a slice; an empty target, or an
empty table, gives gains (and rows) from what there is; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, docs_text, lower_ascii, materialize, narrow, partitions_for, range_sorted, slices, utf8_buffers, word_spans

BUCKETS = 10_000
#: Bytes of text in a block of postings.
BLOCK_BYTES = 2 << 20
#: Rows of a range when ranks are given.
ROWS = 1 << 20
#: Words of more bytes are left to zlib one by one.
LONG_WORD = 64

_BETWEEN = np.ones(256, bool)
_BETWEEN[48:58] = _BETWEEN[97:123] = _BETWEEN[128:] = False


def _crc_table() -> np.ndarray:
    """What each byte does to a reflected CRC-32."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


_CRC = _crc_table()


def crc_states(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 states (before the final complement) after each span's bytes."""
    state, size = state.copy(), ends - starts
    at = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    j = 0
    while len(at):
        s = state[at]
        state[at] = _CRC[(s ^ data[starts[at] + j]) & 255] ^ (s >> 8)
        j += 1
        at = at[size[at] > j]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        state[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return state


def run_buckets(data: np.ndarray, off: np.ndarray, max_run: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket) of every feature, and the number of words of each text."""
    data = lower_ascii(data)
    starts, ends, first = word_spans(data, off, _BETWEEN)
    words = np.diff(first)
    doc = np.repeat(np.arange(len(words)), words)
    last = first[1:][doc]  # each word's text ends before this one
    at = np.arange(len(starts))
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    docs, found = [], []
    for n in range(max_run):
        if n:
            inside = at + n < last[at]
            at, state = at[inside], state[inside]
            state = _CRC[(state ^ np.uint32(32)) & 255] ^ (state >> 8)
        state = crc_states(state, data, starts[at + n], ends[at + n])
        docs.append(doc[at])
        found.append(((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64))
    return np.concatenate(docs), np.concatenate(found), words


POSTINGS = "doc_ids array<long>, n_words binary, n_features binary, buckets binary, docs binary, counts binary"


def posted(texts: DataFrame, max_run: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Postings of ``doc_id, text`` in blocks, sorted by bucket: ids, words and features of a block's documents; bucket, place of the document and count of each posting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, BLOCK_BYTES):
            n = batch.num_rows
            doc, bucket, words = run_buckets(*utf8_buffers(batch.column(1)), max_run, buckets)
            both, counts = np.unique(bucket * n + doc, return_counts=True)
            ids = pa.ListArray.from_arrays(np.array([0, n], np.int32), pa.concat_arrays([batch.column(0)]))
            blobs = [words.astype("<i8"), np.bincount(doc, minlength=n).astype("<i8"), (both // n).astype("<u4"), (both % n).astype("<u4"), counts.astype("<u4")]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([b.tobytes()], pa.binary()) for b in blobs]], [c.split()[0] for c in POSTINGS.split(", ")])

    return texts.select("doc_id", "text").mapInArrow(run, POSTINGS)


def bucket_counts(postings: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n, postings``: features and postings of each bucket that has any; summed in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for b, c in zip(batch.column(0), batch.column(1), strict=True):
                bucket, count = np.frombuffer(b.as_buffer(), "<u4"), np.frombuffer(c.as_buffer(), "<u4")
                n += np.bincount(bucket, count, buckets).astype(np.int64)
                rows += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(rows[some])], ["bucket", "n", "postings"])

    return postings.select("buckets", "counts").mapInArrow(run, "bucket long, n long, postings long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("postings").alias("postings"))


@dataclass(frozen=True)
class Deal:
    """Which slices a bucket's postings go to: ``first`` and, for one that is split by block, how many."""

    first: np.ndarray
    parts: np.ndarray
    slices: int


def deal_buckets(postings: np.ndarray, tasks: int) -> Deal:
    """About equal slices: neighbouring small buckets together, a large one in several. ``postings`` has an entry for each bucket."""
    share = max(1, -(-int(postings.sum()) // max(1, tasks)))
    parts = np.maximum(1, -(-postings // share))
    first = np.zeros(len(postings), np.int64)
    now, held = 0, 0
    for b in range(len(postings)):
        if parts[b] > 1 or held + postings[b] > share:
            now, held = now + (held > 0), 0
        first[b] = now
        if parts[b] > 1:
            now += int(parts[b])
        else:
            held += int(postings[b])
    return Deal(first, parts, int((first + parts).max(initial=1)))


def gains(s: np.ndarray, t: np.ndarray, total_s: int, total_t: int, buckets: int) -> np.ndarray:
    return np.floor(1000 * np.log((t + 1.0) * (total_s + float(buckets)) / ((s + 1.0) * (total_t + float(buckets)))))


def _blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


DEALT = "slice int, block long, buckets binary, x binary, y binary"  # counts of a bucket in both corpora (no block), or documents and counts


def summed_gains(postings: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_words, n_features, total`` of every document of ``postings`` (with ``block``): the sum of its features' gains towards ``target`` (postings, too)."""
    spark = postings.sparkSession
    mine = bucket_counts(postings, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"), "postings")
    theirs = bucket_counts(target, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"), F.lit(0).cast("long").alias("postings"))
    counts = materialize(mine.unionByName(theirs).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("s", "t", "postings")]), "bucket-counts", 1)
    size = np.zeros(buckets, np.int64)
    total_s = total_t = 0
    for r in counts.select("bucket", "s", "t", "postings").collect():  # at most ``buckets`` rows
        size[r["bucket"]] = r["postings"]
        total_s, total_t = total_s + r["s"], total_t + r["t"]
    tasks = partitions_for(postings)
    shared = spark.sparkContext.broadcast(deal_buckets(size, tasks))  # two numbers a bucket

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Both corpora's counts to every slice of their bucket."""
        deal = shared.value
        for batch in batches:
            bucket, s, t = (batch.column(c).to_numpy() for c in range(3))
            n = deal.parts[bucket]
            at = np.repeat(np.arange(len(bucket)), n)
            to = deal.first[bucket][at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            yield from _sliced(to, [None], [bucket[at].astype("<u4"), s[at].astype("<i8"), t[at].astype("<i8")])

    def deal_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = shared.value
        for batch in batches:
            for block, b, d, c in zip(*(batch.column(i) for i in range(4)), strict=True):
                bucket, doc, count = (np.frombuffer(x.as_buffer(), "<u4") for x in (b, d, c))
                own = (block.as_py() * 0x9E3779B1 >> 7) % deal.parts[bucket]
                yield from _sliced(deal.first[bucket] + own, [block.as_py()], [bucket, doc, count])

    def _sliced(to: np.ndarray, block: list, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(to) == 0:
            return
        order = np.argsort(to, kind="stable")
        to = to[order]
        cuts = [0, *(np.flatnonzero(to[1:] != to[:-1]) + 1).tolist(), len(to)]
        pieces = list(zip(cuts[:-1], cuts[1:], strict=True))
        blobs = [pa.array([_blob(c[order[a:b]]) for a, b in pieces], pa.binary()) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(to[cuts[:-1]], pa.int32()), pa.array(block * len(pieces), pa.int64()), *blobs], [c.split()[0] for c in DEALT.split(", ")])

    def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A slice's rows, counts first: gains here, then what each block's documents get."""
        gain = np.zeros(buckets)
        s = t = np.zeros(0)
        for batch in batches:
            blocks, rows = [], []
            for block, b, x, y in zip(*(batch.column(i) for i in range(1, 5)), strict=True):
                bucket = np.frombuffer(b.as_buffer(), "<u4")
                if not block.is_valid:
                    s, t = np.frombuffer(x.as_buffer(), "<i8"), np.frombuffer(y.as_buffer(), "<i8")
                    gain[bucket] = gains(s, t, total_s, total_t, buckets)
                    continue
                docs, at = np.unique(np.frombuffer(x.as_buffer(), "<u4"), return_inverse=True)
                value = np.bincount(at, gain[bucket] * np.frombuffer(y.as_buffer(), "<u4"))
                blocks.append(block.as_py())
                rows.append((docs.astype("<u4").tobytes(), value.astype("<i8").tobytes()))
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), *[pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)]], ["block", "docs", "sums"])

    both = counts.select("bucket", "s", "t").mapInArrow(spread, DEALT).unionByName(postings.select("block", "buckets", "docs", "counts").mapInArrow(deal_out, DEALT))
    given = both.repartitionById(max(1, shared.value.slices), "slice").sortWithinPartitions(F.col("block").isNotNull()).select("slice", "block", "buckets", "x", "y").mapInArrow(contribute, "block long, docs binary, sums binary")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's rows one after another, its documents first."""
        now = None
        names = words = features = total = None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([names, *[pa.array(x, pa.int64()) for x in (words, features, total)]], ["doc_id", "n_words", "n_features", "total"])

        for batch in batches:
            for block, ids, w, f, d, v in zip(*(batch.column(i) for i in range(6)), strict=True):
                if now != block.as_py():
                    if now is not None:
                        yield done()
                    now, names = block.as_py(), pa.concat_arrays([ids.values])
                    words, features = np.frombuffer(w.as_buffer(), "<i8"), np.frombuffer(f.as_buffer(), "<i8")
                    total = np.zeros(len(words), np.int64)
                else:
                    total[np.frombuffer(d.as_buffer(), "<u4")] += np.frombuffer(v.as_buffer(), "<i8")
        if now is not None:
            yield done()

    none = F.lit(None).cast("binary")
    heads = postings.select("block", "doc_ids", "n_words", "n_features", none.alias("docs"), none.alias("sums"))
    rows = heads.unionByName(given.select("block", F.lit(None).cast("array<long>").alias("doc_ids"), none.alias("n_words"), none.alias("n_features"), "docs", "sums"))
    return rows.repartition(tasks, "block").sortWithinPartitions("block", F.col("doc_ids").isNull()).mapInArrow(add_up, "doc_id long, n_words long, n_features long, total long")


def noise(seed: int, doc_id: Column) -> Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of a digest."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, max_run: int = 1, buckets: int = BUCKETS, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; ``rank`` is null for those not drawn.

    Of the documents with ``min_words`` words or more, ``percent`` in a hundred are drawn: the highest scores, the smaller id where equal.
    """
    mine = materialize(narrow(posted(docs_text(docs, id_col, text_col), max_run, buckets)).withColumn("block", F.monotonically_increasing_id()), "postings")
    theirs = posted(docs_text(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(f"`{target_col}`").alias("text"))), max_run, buckets)
    n, total = F.col("n_features"), F.col("total")
    weight = F.when(n > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(0).cast("long")
    scored = summed_gains(mine, theirs, buckets).select("doc_id", "n_words", n, weight.alias("weight"))
    scored = scored.withColumn("score", (F.col("weight") + noise(seed, F.col("doc_id"))).cast("long")).withColumn("row", F.monotonically_increasing_id())
    scored = materialize(scored, "scores")
    able, rest = scored.where(F.col("n_words") >= min_words), scored.where(F.col("n_words") < min_words)
    n_able = able.count()
    ranged = range_sorted(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("row").asc()], "ranked", n_able, ROWS)
    counts = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a range
    before, held = [], 0
    for part in sorted(counts):
        before.append((part, held))
        held += counts[part]
    offsets = F.broadcast(docs.sparkSession.createDataFrame(before, "part int, before long"))  # one row a range
    rank = F.col("before") + F.col("at") + 1
    drawn = ranged.join(offsets, "part").withColumn("rank", F.when(rank <= n_able * percent // 100, rank))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    discard(mine)
    return narrow(drawn.select(*out).unionByName(rest.withColumn("rank", F.lit(None).cast("long")).select(*out)))

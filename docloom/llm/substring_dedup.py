"""Removal of passages that repeat anywhere in the corpus, exact to the word.

Rabin-Karp hashes are computed for every window of ``window`` consecutive words. To count them all without shuffling them
all, each window names an anchor: the least of the hashes of the ``ANCHOR``-word runs inside it. Equal windows have equal anchors at equal offsets, so
a window whose anchor occurs once cannot repeat.

1. Anchors (about one word in fourteen) are counted; occurrences of an anchor within one block of a task are settled there, and only one
   of them is sent on, so an anchor never brings more rows to a reducer than there are blocks.
2. Windows with a repeated anchor are counted by their own hash in the same way.
3. Repeated windows of a document merge into maximal intervals, which are removed.

Texts are shuffled once, by document; both uses read the same exchange. Two Rabin-Karp hashes stand for a window, 128 bits: each has its own base
and its own hash of every word, so a wrong removal takes independent collisions of both (odds under 10**-10 for 10**12 candidate windows, with
19 of 64 bits given away in each half for the most regular sequences of 35 words). The number of partitions
follows the stored size of the table, so what a task gathers stays bounded.

Defined results: a null or empty text has no words and stays empty; a text shorter than a window loses nothing; very long texts are whole, handled
one at a time where they exceed a slice; repeated rows are documents of their own, whether or not their ids differ (rows are told apart by a
number given at the scan; rows that do not come straight from a scan are written first, so that the number cannot change); overlapping copies
inside one text count as repeats; an empty table gives an empty table; other columns are ignored, or kept where the operator says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SECOND_BASE, WindowHasher, bound_batches, give_back_memory, materialize, mix, narrow, partitions_for, slices, span_hashes, utf8_buffers, window_starts, word_spans

WINDOW = 35
ANCHOR = 8
#: Entries settled together in a task; bounds a worker's memory.
BLOCK = 500_000

_U64 = np.uint64
BLOCKS = "bucket int, h binary, g binary, doc binary, pos binary, known binary"


def _sliding_min(values: np.ndarray, k: int) -> np.ndarray:
    """Least of each k neighbours, by doubling."""
    out, span = values, 1
    while span * 2 <= k:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = k - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


_PLACE_BITS = 28


def anchors_of(hasher: WindowHasher, first: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: its first word, its document, its anchor's first word and its anchor's hash.

    The anchor is the run with the least leading hash bits, the leftmost where equal, so equal windows have it at the same offset.
    """
    starts, counts = window_starts(first, window)
    doc = np.repeat(np.arange(len(counts)), counts)
    n = int(first[-1])
    if len(starts) == 0:
        return starts, doc, starts, np.zeros(0, _U64)
    runs = hasher.runs(np.arange(max(n - anchor + 1, 0)), anchor)
    low = _U64((1 << _PLACE_BITS) - 1)
    least = _sliding_min((runs & ~low) | np.arange(len(runs), dtype=_U64), window - anchor + 1)[starts]
    place = (least & low).astype(np.int64)
    return starts, doc, place, runs[place]


def settle(h: np.ndarray, doc: np.ndarray, pos: np.ndarray, n_buckets: int, g: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Blobs of one block by bucket of the hash; ``g`` is a second half of the hash, if there is one.

    Entries whose hash occurs again in the block are known to repeat: the first of them stays in the bucket of its hash, to tell
    others; the rest go to buckets by position, as they need no answer.
    """
    order = np.argsort(h, kind="stable") if g is None else np.lexsort((g, h))
    h, doc, pos, g = h[order], doc[order], pos[order], h[:0] if g is None else g[order]
    new = _new(h, g)
    group = np.cumsum(new) - 1
    known = np.bincount(group)[group] > 1
    route = np.where(known & ~new, (h ^ (pos.astype(_U64) * _U64(0x9E3779B97F4A7C15))) * _U64(0xD6E8FEB86659FD93), h)
    bucket = ((route >> _U64(32)) * _U64(n_buckets)) >> _U64(32)
    # a known entry away from its hash's bucket must not be counted there: it is marked
    away = (known & ~new).astype(np.uint8) * 2 + known.astype(np.uint8)
    order = np.argsort(bucket.astype(np.uint32), kind="stable")
    bucket, h, doc, pos, away = bucket[order], h[order], doc[order], pos[order], away[order]
    g = g[order] if len(g) else g
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    rows = [(int(bucket[a]), h[a:b].tobytes(), g[a:b].tobytes(), doc[a:b].tobytes(), pos[a:b].tobytes(), away[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 6)]], ["bucket", "h", "g", "doc", "pos", "known"])


def _new(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Where a new hash begins among sorted ones; ``g`` may be empty."""
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1]) if len(g) else h[1:] != h[:-1]
    return new


def _gathered(batches: Iterator[pa.RecordBatch], kinds: list) -> list[np.ndarray] | None:
    """Each column's blobs of a whole partition, one after another; the first column is the bucket."""
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for batch in batches:
        for i, kind in enumerate(kinds):
            parts[i] += [np.frombuffer(b, kind) for b in batch.column(i + 1).to_pylist()]
    return [np.concatenate(p) for p in parts] if parts[0] else None


def _cuts(sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1], [True]])) if len(sorted_) else np.zeros(1, np.int64)


def repeated(blocks: DataFrame, n: int) -> DataFrame:
    """``row_id, positions``: one row for each document with a hash that occurs twice or more, and their places as a uint32 blob.

    Answers travel as blobs as well, one for each pair of tasks at most, and are put in order by document where they arrive.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _gathered(batches, [_U64, _U64, np.int64, np.uint32, np.uint8])
        if got is None:
            return
        h, g, doc, pos, known = got
        order = np.lexsort((g, h)) if len(g) else np.argsort(h)
        h, g, doc, pos, known = h[order], g[order] if len(g) else g, doc[order], pos[order], known[order]
        group = np.cumsum(_new(h, g)) - 1
        total = np.bincount(group, weights=known < 2)[group]
        good = (known > 0) | (total > 1)
        doc, pos = doc[good], pos[good]
        bucket = (mix(doc.view(_U64)) >> _U64(33)) % _U64(n)
        order = np.argsort(bucket, kind="stable")
        bucket, doc, pos = bucket[order], doc[order], pos[order]
        cut = _cuts(bucket)
        rows = [(int(bucket[x]), doc[x:y].tobytes(), pos[x:y].tobytes()) for x, y in zip(cut[:-1], cut[1:], strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "doc", "pos"])
        del got, rows, h, g, doc, pos, known, order, group, total, good, bucket
        give_back_memory()

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _gathered(batches, [np.int64, np.uint32])
        if got is None:
            return
        doc, pos = got
        order = np.lexsort((pos, doc))
        doc, pos = doc[order], pos[order]
        cut = _cuts(doc)
        for a in range(0, len(cut) - 1, 5000):
            own = cut[a : a + 5001]
            yield pa.RecordBatch.from_arrays([pa.array(doc[own[:-1]]), pa.array([pos[x:y].tobytes() for x, y in zip(own[:-1], own[1:], strict=True)], pa.binary())], ["row_id", "positions"])

    # a bucket is a partition: hashing its number again would put several into one
    answers = blocks.repartitionById(n, "bucket").mapInArrow(count, "bucket int, doc binary, pos binary")
    return answers.repartitionById(n, "bucket").mapInArrow(collect, "row_id long, positions binary")


def _joined(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Every text with its positions (null: none)."""
    return texts.join(found, "row_id", "left")


def _positions(blob: bytes | None) -> np.ndarray:
    return np.unique(np.frombuffer(blob, np.uint32)).astype(np.int64) if blob else np.zeros(0, np.int64)


def repeated_windows(texts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``row_id, positions``: the starting words of all windows that occur twice or more.

    ``texts`` has ``row_id`` (unique) and ``text`` first; further columns ride along, so that all uses share one exchange.
    """
    n = partitions_for(texts)
    anchor = min(anchor, window)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in slices(batches, 1):
            data, off = utf8_buffers(batch.column(1))
            starts, ends, first = word_spans(data, off)
            hasher = WindowHasher(span_hashes(data, starts, ends))
            begin, doc, place, h = anchors_of(hasher, first, window, anchor)
            if len(begin) == 0:
                continue
            at = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))  # each occurrence of an anchor once
            held.append((h[at], batch.column(0).to_numpy()[doc[at]], (place[at] - first[doc[at]]).astype(np.uint32)))
            size += len(at)
            if size >= BLOCK:
                yield from settle(*(np.concatenate(x) for x in zip(*held, strict=True)), n)
                held, size = [], 0
        if held:
            yield from settle(*(np.concatenate(x) for x in zip(*held, strict=True)), n)

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in slices(batches, 1):
            marked = [i for i, b in enumerate(batch.column(batch.num_columns - 1).to_pylist()) if b]
            if not marked:
                continue
            batch = batch.take(pa.array(marked))
            data, off = utf8_buffers(batch.column(1))
            starts, ends, first = word_spans(data, off)
            hasher, second = WindowHasher(span_hashes(data, starts, ends)), WindowHasher(span_hashes(data, starts, ends, 1), SECOND_BASE)
            begin, doc, place, _ = anchors_of(hasher, first, window, anchor)
            wanted = np.concatenate([(i << 32) + _positions(b) for i, b in enumerate(batch.column(batch.num_columns - 1).to_pylist())])
            chosen = np.isin((doc << 32) + place - first[doc], wanted)
            local = begin - first[doc]
            begin, doc, local = begin[chosen], doc[chosen], local[chosen]
            if len(begin) == 0:
                continue
            held.append((hasher.runs(begin, window), batch.column(0).to_numpy()[doc], local.astype(np.uint32), second.runs(begin, window)))
            size += len(begin)
            if size >= BLOCK:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h, doc, pos, g = (np.concatenate(x) for x in zip(*held, strict=True))
        return settle(h, doc, pos, n, g)

    places = repeated(texts.mapInArrow(first_pass, BLOCKS), n)
    windows = _joined(texts, places).mapInArrow(second_pass, BLOCKS)
    return repeated(windows, n)


def removed_words(n_words: int, positions: np.ndarray, window: int) -> np.ndarray:
    """Which words lie in a repeated window; the windows merge into maximal intervals."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, positions, 1)
    np.add.at(edge, positions + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _cleaned(batch: pa.RecordBatch, text_at: int, window: int) -> Iterator[tuple[bytes, int, int]]:
    """(kept text as bytes, words, removed words) for each row; the positions are the last column."""
    data, off = utf8_buffers(batch.column(text_at))
    starts, ends, first = word_spans(data, off)
    raw = data.tobytes()
    for i, blob in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
        a, b = int(first[i]), int(first[i + 1])
        text = raw[off[i] : off[i + 1]]
        gone = removed_words(b - a, _positions(blob), window) if blob else None
        if gone is None or not gone.any():
            yield text, b - a, 0
            continue
        words = text.split()
        yield b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]), b - a, int(gone.sum())


def _dealt(docs: DataFrame, columns: list, text_col: str) -> DataFrame:
    """The rows numbered and dealt out by their number; all later uses share this exchange."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")
    bound_batches(docs.sparkSession)
    rows = docs.select(text, *columns)
    if "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        rows = materialize(rows, "rows")  # a recomputed shuffle may give its rows in another order, and so other numbers
    others = [c for c in rows.columns if c != "text"]
    return rows.select(F.monotonically_increasing_id().alias("row_id"), "text", *others).repartition(partitions_for(rows), "row_id")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` for every document; kept words are joined by one blank where anything was removed."""
    texts = _dealt(docs, [F.col(f"`{id_col}`").cast("long").alias("doc_id")], text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = list(_cleaned(batch, 1, window))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return narrow(_joined(texts, repeated_windows(texts, window)).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string"))


def strip_repeats(docs: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The documents with repeated passages taken out of ``text``; other columns stay (a null text becomes empty)."""
    others = [c for c in docs.columns if c != text_col]
    texts = _dealt(docs, [F.struct(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(others)]).alias("others")] if others else [], text_col)
    joined = _joined(texts, repeated_windows(texts, window))
    schema = joined.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            kept = pa.array([r[0] for r in _cleaned(batch, 1, window)], pa.binary()).cast(pa.string())
            yield batch.set_column(1, "text", kept)

    out = joined.mapInArrow(run, schema)
    place = {c: F.col(f"others._{i}").alias(c) for i, c in enumerate(others)}
    return narrow(out.select(*[place.get(c, F.col("text").alias(text_col)) for c in docs.columns]))

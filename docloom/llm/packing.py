"""Lexical retrieval packing with a sharded BM25 inverted index.

1. Documents are tokenised once and written as a table of id blobs in the shared folder.
2. Document frequencies of all token ids are counted over that whole table. The vocabulary
   bounds this (tens of thousands of numbers), so it is collected and broadcast.
3. The table is read again; every ``shard_tokens`` tokens of a scan partition form a shard with an
   inverted index of its own (posting lists with BM25 impacts, idf from all documents). All terms of a seed
   document are looked up, and its best unused neighbours fill the seed's window greedily. A document that
   crosses the end of a window is cut there and goes on as the next seed.

No shuffle of texts or ids takes place, a shard's size is bounded whatever the data, and no
document is dropped: every id lies in exactly one piece. Windows are full but for the last of
a shard, whose tokens are cut into sequences of powers of two, so nothing is padded.

Defined results: a null or empty text is one piece holding the end id; repeated rows are packed
like any other; very long documents fill windows of their own; an empty table gives an empty
table; columns other than the id and the text are ignored. Ties in a score go to the earlier document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WHOLE_ID, PieceCoder, piece_coder, read_bytes
from .common import Interner, docs_text, materialize, narrow, ranges, slices, utf8_buffers

#: Entries of a worker's table of encoded words (some 130 MB); it is emptied when full and lives as long as the worker.
CACHE_ENTRIES = 800_000
#: Tokens of a shard: bounds an index to some tens of MB.
SHARD_TOKENS = 2_000_000
#: Terms in more than this part of a shard's documents have a row of impacts besides their postings.
ROW_SHARE = 0.25
K1, B = 1.2, 0.75
_N_DOCS, _N_TOKENS = -1, -2


class WordCoder:
    """Ids of whole texts for vocabularies that drop white space: words are coded once and gathered."""

    def __init__(self, coder: PieceCoder, cache_entries: int = CACHE_ENTRIES):
        self.coder, self.cache_entries = coder, cache_entries
        self.kind = np.uint16 if len(coder.ids) and max(coder.ids) < 1 << 16 else np.uint32
        self.ids = np.array(coder.ids)
        self._clear()

    def _clear(self) -> None:
        self.table = Interner()
        self.pool = np.zeros(1 << 16, self.kind)
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.fill = 0

    def _add(self, words: list[bytes]) -> None:
        """Encode words that have just got the last numbers of the table."""
        coded = list(map(self.coder.word_symbols, words))
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter(chain.from_iterable(coded), np.int64, int(sizes.sum()))
        flat = np.where(flat >= WHOLE_ID, flat - WHOLE_ID, self.ids[np.where(flat >= WHOLE_ID, 0, flat)]).astype(self.kind)
        stop, fill = len(self.table), self.fill
        while stop > len(self.start):
            self.start, self.size = np.concatenate([self.start, self.start * 0]), np.concatenate([self.size, self.size * 0])
        while fill + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), self.kind)])
        self.pool[fill : fill + len(flat)] = flat
        self.size[stop - len(coded) : stop] = sizes
        self.start[stop - len(coded) : stop] = fill + np.cumsum(sizes) - sizes
        self.fill = fill + len(flat)

    def encode(self, data: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``end_id``, and their offsets."""
        raw, words, counts = data.tobytes(), [], np.zeros(len(off) - 1, np.int64)
        for i in range(len(counts)):
            own = raw[off[i] : off[i + 1]].split()
            words += own
            counts[i] = len(own)
        if len(self.table) > self.cache_entries:
            self._clear()
        at = self.table.number(words)
        if self.table.fresh:
            self._add(self.table.fresh)
        sizes = self.size[at]
        total = np.concatenate([[0], np.cumsum(sizes)])
        first = np.concatenate([[0], np.cumsum(counts)])
        own = np.diff(total[first])
        out_off = np.concatenate([[0], np.cumsum(own + 1)])
        out = np.empty(out_off[-1], self.kind)
        out[out_off[1:] - 1] = end_id
        mask = np.ones(len(out), bool)
        mask[out_off[1:] - 1] = False
        out[mask] = self.pool[ranges(self.start[at], sizes)]
        return out, out_off


@lru_cache(maxsize=2)
def word_coder(data: bytes) -> WordCoder:
    """The word coder of a vocabulary file, kept through the tasks of a Python worker."""
    return WordCoder(piece_coder(data))


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (little-endian, two bytes each where the vocabulary allows, else four), end id included."""
    data = docs.sparkSession.sparkContext.broadcast(read_bytes(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_coder(data.value)
        width = np.dtype(coder.kind).itemsize
        for batch in slices(batches, 1):
            ids, off = coder.encode(*utf8_buffers(batch.column(1)), end_id)
            blob = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((off * width).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), blob], ["doc_id", "ids"])

    return docs_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def _sorted_counts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sort(ids, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[at], np.diff(np.concatenate([at, [len(s)]]))


def document_frequencies(tokens: DataFrame, kind: type, vocab: int) -> tuple[np.ndarray, int, int]:
    """Documents of each token id, documents and tokens in all; counted over the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, total = np.zeros(vocab, np.int64), 0, 0
        for batch in slices(batches, 0):
            data, off = utf8_buffers(batch.column(0))
            ids = data.view(kind)
            off = off // np.dtype(kind).itemsize
            found = [_sorted_counts(ids[a:b])[0] for a, b in zip(off[:-1], off[1:], strict=True)]
            df += np.bincount(np.concatenate(found), minlength=vocab)
            docs += batch.num_rows
            total += len(ids)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [_N_DOCS, _N_TOKENS]])), pa.array(np.concatenate([df[at], [docs, total]]))], ["token", "n"])

    rows = tokens.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary and two
    got = {r["token"]: r["n"] for r in rows}
    df = np.zeros(vocab, np.int64)
    for t, n in got.items():
        if t >= 0:
            df[t] = n
    return df, got.get(_N_DOCS, 0), got.get(_N_TOKENS, 0)


class Shard:
    """An inverted index over some documents, and the packing of them."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.docs, self.idf = docs, idf
        n = len(docs)
        counted = [_sorted_counts(d) for d in docs]
        sizes = np.fromiter((len(t) for t, _ in counted), np.int64, n)
        self.terms = [t for t, _ in counted]
        term = np.concatenate([t for t, _ in counted])
        tf = np.concatenate([c for _, c in counted]).astype(np.float32)
        doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
        length = np.fromiter(map(len, docs), np.float32, n)
        norm = (K1 * (1 - B + B * length / max(mean_length, 1.0))).astype(np.float32)
        order = np.argsort(term, kind="stable")
        self.posting = doc[order]
        self.impact = (idf[term] * tf * (K1 + 1) / (tf + norm[doc]))[order].astype(np.float32)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(idf)))])
        self.free = np.ones(n, bool)
        common = np.flatnonzero(np.diff(self.first) > ROW_SHARE * n)
        self.row = dict(zip(common.tolist(), range(len(common)), strict=True))
        self.rows = np.zeros((len(common), n), np.float32)
        for i, t in enumerate(common.tolist()):
            a, b = self.first[t], self.first[t + 1]
            self.rows[i, self.posting[a:b]] = self.impact[a:b]
        self.scored: tuple[int, np.ndarray] | None = None

    def scores(self, seed: int) -> np.ndarray:
        """Scores of all documents, free or not; the last seed's are kept, as it may be asked again."""
        if self.scored is None or self.scored[0] != seed:
            terms = self.terms[seed]
            start, counts = self.first[terms], self.first[terms + 1] - self.first[terms]
            rare = counts <= ROW_SHARE * len(self.docs)
            at = ranges(start[rare], counts[rare])
            scores = np.bincount(self.posting[at], self.impact[at], len(self.docs)).astype(np.float32)
            for t in terms[~rare].tolist():
                scores += self.rows[self.row[t]]
            self.scored = seed, scores
        return self.scored[1]

    def neighbours(self, seed: int, k: int = 16) -> np.ndarray:
        """Unused documents by falling score, the earlier first where equal; [] if none shares a term."""
        scores = self.scores(seed) * self.free
        least = np.partition(scores, -k)[-k] if len(scores) > k else 0
        best = np.flatnonzero(scores >= least) if least > 0 else np.flatnonzero(scores)  # all ties of the last place, then the earlier ones
        return best[np.argsort(-scores[best], kind="stable")][:k]

    def pack(self, window: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """(seed, pieces) of each sequence; a piece is (document, start, length)."""
        n, nxt = len(self.docs), 0
        current, start = -1, 0  # a document that goes on in the next window
        pieces: list[tuple[int, int, int]] = []
        room, seed = window, -1
        while True:
            if current < 0:
                while nxt < n and not self.free[nxt]:
                    nxt += 1
                if nxt == n:
                    break
                queue = self.neighbours(seed).tolist() if pieces else []
                for current in queue or [nxt]:
                    self.free[current] = False
                    start = 0
                    current, start, room = self._place(current, start, room, pieces)
                    if not pieces[1:]:
                        seed = pieces[0][0]
                    if room == 0:
                        break
            else:
                seed = current
                current, start, room = self._place(current, start, room, pieces)
            if room == 0:
                yield seed, pieces
                pieces, room = [], window
        if pieces:
            yield from self._tail(seed, pieces, window - room)

    def _place(self, doc: int, start: int, room: int, pieces: list) -> tuple[int, int, int]:
        length = min(room, len(self.docs[doc]) - start)
        pieces.append((doc, start, length))
        done = start + length == len(self.docs[doc])
        return (-1 if done else doc), (0 if done else start + length), room - length

    @staticmethod
    def _tail(seed: int, pieces: list[tuple[int, int, int]], used: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """The last tokens, as sequences of powers of two."""
        left = list(pieces)
        for bit in reversed(range(used.bit_length())):
            room, own = used & (1 << bit), []
            while room:
                doc, start, length = left.pop(0)
                take = min(room, length)
                own.append((doc, start, take))
                if take < length:
                    left.insert(0, (doc, start + take, length - take))
                room -= take
            if own:
                yield seed, own


PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, seed_doc_id long, input_ids binary"


def pack_tokens(tokens: DataFrame, kind: type, vocab: int, window: int = 2048, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces of all documents of ``tokens`` (``doc_id, ids``); ``input_ids`` are little-endian unsigned 32-bit ids."""
    df, n_docs, n_tokens = document_frequencies(tokens, kind, vocab)
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)
    stats = tokens.sparkSession.sparkContext.broadcast((idf, n_tokens / max(n_docs, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = -1
        names: list[int] = []
        docs: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            rows: list[tuple[int, int, int, int, int, int, int]] = []
            blobs: list[bytes] = []
            for seed, pieces in Shard(docs, *stats.value).pack(window):
                offset = 0
                for doc, start, length in pieces:
                    rows.append((names[doc], start, length, len(docs[doc]), sequence, offset, names[seed]))
                    blobs.append(docs[doc][start : start + length].astype("<u4").tobytes())
                    offset += length
                sequence += 1
                if len(blobs) >= 1000:
                    yield batch_of(rows, blobs)
                    rows, blobs = [], []
            if blobs:
                yield batch_of(rows, blobs)

        def batch_of(rows: list, blobs: list[bytes]) -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(blobs, pa.binary())], [c.split()[0] for c in PIECES.split(", ")])

        for batch in slices(batches, 1):
            if sequence < 0:
                sequence = batch.column(2)[0].as_py() << 40
            data, off = utf8_buffers(batch.column(1))
            ids = data.view(kind)
            off = off // np.dtype(kind).itemsize
            for name, a, b in zip(batch.column(0).to_pylist(), off[:-1], off[1:], strict=True):
                if docs and held + b - a > shard_tokens:
                    yield from flush()
                    names, docs, held = [], [], 0
                names.append(name)
                docs.append(ids[a:b].copy())
                held += int(b - a)
        if docs:
            yield from flush()

    # the stream's own number: a task that joins several streams has one number for all of them
    streams = narrow(tokens.select("doc_id", "ids")).select("doc_id", "ids", F.spark_partition_id().alias("stream"))
    return streams.mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document into sequences of at most ``window`` tokens; one row per piece (``PIECES``)."""
    coder = WordCoder(piece_coder(read_bytes(tokenizer_path)))
    vocab = coder.coder.library.get_vocab_size(with_added_tokens=True)
    tokens = materialize(tokenize(docs, tokenizer_path, end_id, id_col, text_col), "tokens")
    return pack_tokens(tokens, coder.kind, vocab, window, shard_tokens)

"""Token counts with a whole-token shortcut.

The library's pre-tokeniser splits a text into pre-tokens that are merged
independently. Offline, once per vocabulary, ``PieceCoder.whole_tokens`` proves
with the library itself which vocabulary strings are a single pre-token that
encodes alone as exactly one token. Such pre-tokens count 1 at once; only the
rest are merged.

Texts are cut at single blanks between two characters that are not white space:
no pre-token continues over such a place, so the pieces' counts add up exactly.
A bounded table keeps the counts of recent pieces.

Defined results: a null text counts as empty (0 bytes, 0 tokens); very long texts are
counted whole; a row without an id keeps its null; repeated rows
each give a row; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import PieceCoder, piece_coder, read_bytes
from .common import Interner, docs_text, slices, utf8_buffers

#: Entries of a worker's table of piece counts; it is emptied when full and lives as long as the worker.
CACHE_ENTRIES = 400_000
#: White space beside a blank: there a pre-token may take several of them.
_AWKWARD = regex.compile(r" \s|^\s")
_SAFE_CUT = regex.compile(r"(?<=\S)(?= \S)")


class TokenCounter:
    """Exact counts of texts for one worker (byte-level vocabularies)."""

    def __init__(self, coder: PieceCoder, cache_entries: int = CACHE_ENTRIES):
        self.coder, self.cache_entries = coder, cache_entries
        self.table, self.counts = Interner(), np.zeros(0, np.int64)

    def count(self, texts: list[str]) -> np.ndarray:
        parts: list[str] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if not t:
                continue
            if _AWKWARD.search(t) is None:
                head, *tail = t.split(" ")
                parts.append(head)
                parts.extend(map(" ".__add__, tail))
                sizes[i] = 1 + len(tail)
            else:
                own = _SAFE_CUT.split(t)
                parts.extend(own)
                sizes[i] = len(own)
        if len(self.table) > self.cache_entries:
            self.table, self.counts = Interner(), np.zeros(0, np.int64)
        at = self.table.number(parts)
        if self.table.fresh:
            encode = self.coder.encode
            self.counts = np.concatenate([self.counts, np.fromiter((len(encode(p)) for p in self.table.fresh), np.int64, len(self.table.fresh))])
        total = np.zeros(len(parts) + 1, np.int64)
        np.cumsum(self.counts[at], out=total[1:])
        ends = np.cumsum(sizes)
        return total[ends] - total[ends - sizes]


@lru_cache(maxsize=2)
def token_counter(data: bytes) -> TokenCounter:
    """The counter of a vocabulary file, kept through the tasks of a Python worker."""
    return TokenCounter(piece_coder(data))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit`` (n_tokens > limit)."""
    data = docs.sparkSession.sparkContext.broadcast(read_bytes(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(data.value)
        for batch in slices(batches, 1):
            _, off = utf8_buffers(batch.column(1))
            tokens = counter.count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

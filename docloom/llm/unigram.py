"""SentencePiece-style encoding and decoding: unigram Viterbi over a double-array trie.

Pieces come from a sentencepiece model file. A unigram model's log scores are used as they are; a merge-ranked model
states ranks instead, which become Zipf log scores, -ln(rank + 1). A character that no piece covers costs ten less than the
lowest score and is written as byte pieces. A user-defined piece scores the highest score for each of its bytes, less a tenth. Blanks are
written as the marker U+2581, one is put in front of a text unless the model says not to, and
decoding turns them back; a literal U+2581 in a text therefore decodes to a blank. A model that rewrites characters, drops blanks or puts the marker
behind words is refused when it is loaded.

Where no piece has a marker after another character (checked at load), the best path of a text is the best paths of its parts between such
places, one after another; otherwise a text is one part. The parts' paths are kept in a bounded table.

Defined results: a null text counts as empty, which has no pieces; ties go to the longer last piece; repeated rows each
give a row; an empty table gives an empty table; other columns are ignored; very long texts take time and memory in proportion to
their length.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import read_bytes
from .common import Interner, docs_text, ranges, slices, utf8_buffers

MARKER = "▁"
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
_UNIGRAM = 1
#: Parts and ids of a worker's table of paths; it is emptied when full and lives as long as the worker.
CACHE_ENTRIES, CACHE_IDS = 800_000, 8_000_000
_PARTS = re.compile(f"{MARKER}+[^{MARKER}]*|[^{MARKER}]+")


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol-buffer message: ints, floats and bytes."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    at = 0
    while at < len(data):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
        elif wire == 1:
            yield number, data[at : at + 8]
            at += 8
        elif wire == 2:
            size = varint()
            yield number, data[at : at + size]
            at += size
        else:
            yield number, struct.unpack_from("<f", data, at)[0]
            at += 4


@dataclass(frozen=True)
class Piece:
    text: str
    score: float
    kind: int


def read_pieces(data: bytes) -> list[Piece]:
    """The pieces of a model file with log scores."""
    pieces, model_type = [], _UNIGRAM
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append(Piece(own[1].decode("utf-8"), own.get(2, 0.0), own.get(3, _NORMAL)))
        elif number == 2:
            model_type = dict(_fields(value)).get(3, _UNIGRAM)
    if model_type == _UNIGRAM:
        return pieces
    order = sorted((i for i, p in enumerate(pieces) if p.kind == _NORMAL), key=lambda i: (-pieces[i].score, i))
    score = {i: -math.log(rank + 1.0) for rank, i in enumerate(order, 1)}
    return [Piece(p.text, score.get(i, 0.0), p.kind) for i, p in enumerate(pieces)]


def read_prefix(data: bytes) -> bool:
    """Whether a model file puts a marker in front of a text; an error if it asks for what is not done here."""
    spec = dict(f for number, value in _fields(data) if number == 3 for f in _fields(value))
    trainer = dict(f for number, value in _fields(data) if number == 2 for f in _fields(value))
    if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1) or trainer.get(24, 0):
        raise ValueError("only models without character rules that keep all blanks and mark them in front of words can be read")
    return bool(spec.get(3, 1))


class DoubleArray:
    """A trie over bytes in two integer arrays: child of s by byte c is base[s] + c, if check there is s."""

    def __init__(self, keys: list[bytes]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for i, key in enumerate(keys):
            s = 0
            for c in key:
                t = children[s].get(c)
                if t is None:
                    t = children[s][c] = len(children)
                    children.append({})
                    value.append(-1)
                s = t
            value[s] = i
        size = 1 << 16
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        place, work, low = {0: 0}, [0], 1
        self.check[0] = -2  # the root is nobody's child
        while work:
            node = work.pop()
            s, kids = place[node], children[node]
            self.value[s] = value[node]
            if not kids:
                continue
            codes = sorted(kids)
            first, b = codes[0], max(1, low - codes[0])
            while True:
                while b + 256 >= len(self.check):
                    grow = len(self.check)
                    self.base += [0] * grow
                    self.check += [-1] * grow
                    self.value += [-1] * grow
                if self.check[b + first] < 0 and all(self.check[b + c] < 0 for c in codes):
                    break
                b += 1
            self.base[s] = b
            for c in codes:
                self.check[b + c] = s
                place[kids[c]] = b + c
                work.append(kids[c])
            if len(codes) > 1:
                low = max(low, b + first - 64)
            while self.check[low] >= 0:
                low += 1

    def prefixes(self, data: bytes, at: int) -> Iterator[tuple[int, int]]:
        """(end, key number) of every key that starts at ``at``."""
        s, base, check, value = 0, self.base, self.check, self.value
        for i in range(at, len(data)):
            t = base[s] + data[i]
            if check[t] != s:
                return
            s = t
            if value[s] >= 0:
                yield i + 1, value[s]


class UnigramCoder:
    def __init__(self, data: bytes, cache_entries: int = CACHE_ENTRIES):
        self.pieces = read_pieces(data)
        self.cache_entries = cache_entries
        self.front = MARKER if read_prefix(data) else ""
        found = [i for i, p in enumerate(self.pieces) if p.kind in (_NORMAL, _USER)]
        keys = [self.pieces[i].text.encode("utf-8") for i in found]
        self.trie = DoubleArray(keys)
        self.number = found
        normal = [p.score for p in self.pieces if p.kind == _NORMAL]
        most = max(normal)
        self.scores = [self.pieces[i].score if self.pieces[i].kind == _NORMAL else len(key) * most - 0.1 for i, key in zip(found, keys, strict=True)]
        self.unknown_score = min(normal) - 10.0
        self.cuts = not any(MARKER in self.pieces[i].text.lstrip(MARKER) for i in found)
        self.bytes = [0] * 256
        for i, p in enumerate(self.pieces):
            if p.kind == _BYTE:
                self.bytes[int(p.text[3:5], 16)] = i
        self.is_byte = np.array([p.kind == _BYTE for p in self.pieces])
        raw = [bytes([int(p.text[3:5], 16)]) if p.kind == _BYTE else p.text.replace(MARKER, " ").encode("utf-8") if p.kind in (_NORMAL, _USER) else b"" for p in self.pieces]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(r) for r in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self._clear()

    def _clear(self) -> None:
        self.table = Interner()
        self.pool, self.start, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.held = 0

    def _add(self, parts: list[str]) -> None:
        """Paths of parts that have just got the last numbers of the table."""
        paths = [self.viterbi(p) for p in parts]
        sizes = np.fromiter(map(len, paths), np.int64, len(paths))
        flat = np.fromiter(chain.from_iterable(paths), np.int32, int(sizes.sum()))
        stop, held = len(self.table), self.held
        while stop > len(self.start):
            self.start, self.size = np.concatenate([self.start, self.start * 0]), np.concatenate([self.size, self.size * 0])
        while held + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, self.pool * 0])
        self.pool[held : held + len(flat)] = flat
        self.size[stop - len(paths) : stop] = sizes
        self.start[stop - len(paths) : stop] = held + np.cumsum(sizes) - sizes
        self.held = held + len(flat)

    def viterbi(self, part: str) -> list[int]:
        """Ids of the best path of one part."""
        data = part.encode("utf-8")
        n = len(data)
        low = -math.inf
        best = [low] * (n + 1)
        came, piece = [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        scores, base, check, value, unknown = self.scores, self.trie.base, self.trie.check, self.trie.value, self.unknown_score
        for at in range(n):
            here = best[at]
            if here == low:
                continue
            lead = data[at]
            char_end = at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            covered = False
            s, i = 0, at
            while i < n:
                t = base[s] + data[i]
                if check[t] != s:
                    break
                s = t
                i += 1
                k = value[s]
                if k >= 0:
                    if i == char_end:
                        covered = True
                    total = here + scores[k]
                    if total > best[i]:
                        best[i] = total
                        came[i] = at
                        piece[i] = k
            if not covered and here + unknown > best[char_end]:
                best[char_end] = here + unknown
                came[char_end] = at
                piece[char_end] = -1
        ids, at = [], n
        while at > 0:
            start, k = came[at], piece[at]
            if k >= 0:
                ids.append(self.number[k])
            else:
                ids.extend([self.bytes[b] for b in reversed(data[start:at])])
            at = start
        ids.reverse()
        return ids

    def parts(self, text: str) -> list[str]:
        if not text:
            return []
        if self.cuts and self.front and "  " not in text and text[0] != " " and MARKER not in text:
            return list(map(MARKER.__add__, text.split(" ")))
        marked = self.front + text.replace(" ", MARKER)
        return _PARTS.findall(marked) if self.cuts else [marked]

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and each text's offsets."""
        if len(self.table) > self.cache_entries or self.held > CACHE_IDS:
            self._clear()
        split = [self.parts(t) for t in texts]
        at = self.table.number(list(chain.from_iterable(split)))
        if self.table.fresh:
            self._add(self.table.fresh)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        sizes = self.size[at]
        ids = self.pool[ranges(self.start[at], sizes)]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return ids, total[np.concatenate([[0], np.cumsum(counts)])]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes, markers as blanks, without the one put in front, if the model has one."""
        ids = np.asarray(ids, np.int64)
        out = self.raw[ranges(self.raw_start[ids], self.raw_size[ids])].tobytes()
        return out[1:] if self.front and out[:1] == b" " else out


_coders: dict[bytes, UnigramCoder] = {}


def _coder(data: bytes) -> UnigramCoder:
    if data not in _coders:
        _coders.clear()
        _coders[data] = UnigramCoder(data)
    return _coders[data]


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, n_pieces, n_byte_pieces, round_trip``; ids are little-endian unsigned 32-bit, round_trip is
    whether decoding them gives the text's bytes back."""
    data = docs.sparkSession.sparkContext.broadcast(read_bytes(model_path))  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(data.value)
        for batch in slices(batches, 1):
            raw, off = utf8_buffers(batch.column(1))
            raw = raw.tobytes()
            ids, at = coder.encode_batch([t or "" for t in batch.column(1).to_pylist()])
            spans = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            trips = [coder.decode(ids[a:b]) == raw[c:d] for (a, b), c, d in zip(spans, off[:-1].tolist(), off[1:].tolist(), strict=True)]
            byte = np.concatenate([[0], np.cumsum(coder.is_byte[ids])])
            blob = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays([batch.column(0), blob, pa.array(np.diff(at)), pa.array(byte[at[1:]] - byte[at[:-1]]), pa.array(trips)], ["doc_id", "ids", "n_pieces", "n_byte_pieces", "round_trip"])

    return docs_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, n_pieces long, n_byte_pieces long, round_trip boolean")


def decode_pieces(coded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids`` (little-endian unsigned 32-bit)."""
    data = coded.sparkSession.sparkContext.broadcast(read_bytes(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(data.value)
        for batch in slices(batches, 1):
            texts = [coder.decode(np.frombuffer(b or b"", "<u4")).decode("utf-8", "replace") for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")

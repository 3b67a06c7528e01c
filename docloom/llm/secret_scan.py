"""Secret scan with a recursive decoding worklist.

Base spans are found in the text itself. A worklist then unwraps layers: percent
encoding (also %u), \\u, \\u{} and \\x escapes, UTF-16, base64 (plain and URL-safe, also in lines or behind a prefix) and
gzip or zlib data (any window) inside those, also where only some of its bytes are escaped. Each new layer is scanned again and put back on the list until nothing new
turns up; a set of layers already seen, each with where it came from, ends cycles. Every layer carries, for each of
its characters, the span of the original text it came from, so findings are reported
in code points of the original.

Defined results: a null text counts as empty; an empty text has no spans; repeated rows each give a
row; an empty table gives an empty table; other columns are ignored; very long texts are scanned whole. Overlapping findings of different kinds are all
reported; a span found both in the text and in a layer is reported once, as a base span.
Findings and encodings are ASCII, so decoded bytes matter only in runs of printable ASCII. Decompressed data is read to its end,
in layers of some ``LAYER_BYTES`` (a guard against decompression bombs); a run that crosses the end of one goes on in the next.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, docs_text, narrow, slices, utf8_buffers

KINDS = ("assign", "access", "hex")
LAYER_BYTES, OVERLAP, BLOCK = 64 << 20, 1 << 20, 1 << 20
#: Escapes nested deeper than this are unwrapped to the end in one pass.
DEEP = 8

_ASSIGN = re.compile(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"[\\%]u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\x[0-9A-Fa-f]{2})+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]++(?:[ \t]*+(?:\r?\n|\r|(?:\\r)?\\n)[ \t>]*+[A-Za-z0-9+/_-]++)*+")  # one run, or lines of them
_BREAK = re.compile(r"[ \t]*+(?:\r?\n|\r|(?:\\r)?\\n)[ \t>]*+")
_PADDING = re.compile(r"(?:={1,2}|(?:%3[Dd]){1,2})?")
_PRINTABLE = re.compile(rb"[\t\n\r\x20-\x7e]{16,}")  # no finding is shorter
_WIDE = (re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){16,}"), re.compile(rb"(?:\x00[\t\n\r\x20-\x7e]){16,}"))  # UTF-16
_WIDE_TEXT = tuple(re.compile(p.pattern.decode("latin-1")) for p in _WIDE)
_GZIP = b"\x1f\x8b\x08"
#: First two bytes of zlib data: a window of 256 bytes to 32 KiB, no dictionary, and a checksum.
_ZLIB = [(m, f) for m in range(0x08, 0x79, 16) for f in range(256) if (m * 256 + f) % 31 == 0 and not f & 32]
_PACKED = re.compile(rb"\x1f\x8b\x08|" + b"|".join(re.escape(bytes(x)) for x in _ZLIB))



def _escaped_starts(escape: Callable[[int], str], plain: str) -> str:
    """Ways to write the first two bytes of zlib data of which one at least is escaped."""
    known = lambda x: re.fullmatch(plain, chr(x)) is not None
    ways = {f"{escape(m)}{escape(f)}" for m, f in _ZLIB}
    ways |= {f"{re.escape(chr(m))}{escape(f)}" for m, f in _ZLIB if known(m)} | {f"{escape(m)}{re.escape(chr(f))}" for m, f in _ZLIB if known(f)}
    return "|".join(sorted(ways))


_ANY_CASE = lambda x: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in f"{x:02x}")
_PERCENT_PACKED = re.compile(r"%1[Ff]%8[Bb]%08|x\^|" + _escaped_starts(lambda x: "%" + _ANY_CASE(x), "[!-$&-~]"))
_PERCENT_BYTE = re.compile(r"%([0-9A-Fa-f]{2})|([!-$&-~])")
_ESCAPE_PACKED = re.compile(r"\\(?:x|u00)1[Ff]\\(?:x|u00)8[Bb]\\(?:x08|u0008|b)|x\^|" + _escaped_starts(lambda x: r"\\(?:x|u00)" + _ANY_CASE(x), r"[ -\[\]-~]"))
_ESCAPE_BYTE = re.compile(r"\\(?:x|u00)([0-9A-Fa-f]{2})|([ -\[\]-~])|\\([abfnrtv0\\'\"/])")
_NAMED = dict(zip("abfnrtv0", b"\a\b\f\n\r\t\v\0", strict=True))
#: Characters of findings and encodings: a layer's end is cut in front of them.
_RUN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=%\\.:\"'> \t\r\n"
_HEX_CLASS = np.zeros(256, bool)
_HEX_CLASS[list(b"0123456789abcdef")] = True
_BASE64_CLASS = np.zeros(256, bool)
_BASE64_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True


def find(text: str, hex_runs: bool = True) -> list[tuple[str, int, int]]:
    """Base findings: (kind, start, end), leftmost and non-overlapping within a kind."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if hex_runs:
        found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


class Layer:
    """A text and, for each character, where it came from in the original; None: the original itself; numbers: all from one place."""

    __slots__ = ("text", "start", "end", "depth")

    def __init__(self, text: str, start: list[int] | int | None = None, end: list[int] | int | None = None, depth: int = 0):
        self.text, self.start, self.end, self.depth = text, start, end, depth  # depth: steps of escapes that led here

    def key(self) -> bytes:
        """A digest of text and places: equal texts at different places are different layers."""
        out = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=24)
        out.update(repr((self.start, self.end)).encode() if self.start is None or isinstance(self.start, int) else array("q", [*self.start, *self.end]).tobytes())
        return out.digest()

    def origin(self, a: int, b: int) -> tuple[int, int]:
        if self.start is None or isinstance(self.start, int):
            return (a, b) if self.start is None else (self.start, self.end)
        return min(self.start[a:b]), max(self.end[a:b])


def _bytes_layer(raw: bytes, spans: list[tuple[int, int]]) -> Layer:
    """Bytes that came from ``spans``, a character each: findings and encodings are ASCII, so other bytes need no decoding and none is left out."""
    return Layer(raw.decode("latin-1"), [a for a, _ in spans], [b for _, b in spans])


def _inflate(blocks: Iterable[bytes], used: list[int]) -> Iterator[bytes]:
    """Decompressed data in bounded blocks, of all gzip members in a row, to the end or the first error; ``used[0]`` counts the bytes read."""
    opener = zlib.decompressobj(47)
    try:
        for block in blocks:
            if opener is None:
                if not _GZIP.startswith(block[:3]):
                    return
                opener = zlib.decompressobj(47)
            used[0] += len(block)
            while True:
                out = opener.decompress(block, BLOCK)
                if out:
                    yield out
                if opener.eof:
                    block = opener.unused_data
                    opener = None
                    if not block:
                        break
                    if not _GZIP.startswith(block[:3]):
                        used[0] -= len(block)
                        return
                    opener = zlib.decompressobj(47)
                    continue
                block = opener.unconsumed_tail
                if not block and len(out) < BLOCK:
                    break
    except zlib.error:
        return


def _inflated(blocks: Callable[[], Iterable[bytes]], place: Callable[[int], tuple[int, int]]) -> tuple[int, Iterator[Layer]]:
    """Bytes of compressed data (0: it is none), and its layers; ``place`` tells where so many bytes came from."""
    used = [0]
    if not sum(map(len, _inflate(blocks(), used))):
        return 0, iter(())

    def layers() -> Iterator[Layer]:
        where, held, n, most = place(used[0]), [], 0, LAYER_BYTES
        for out in _inflate(blocks(), [0]):
            held.append(out.decode("latin-1"))  # a byte a character; what is not ASCII ends a run in any case
            n += len(out)
            if n >= most:
                text = "".join(held)
                yield Layer(text, *where)
                cut = min(len(text.rstrip(_RUN)), n - OVERLAP)
                held = [text[cut if n - cut <= LAYER_BYTES else n - OVERLAP :]]
                n = len(held[0])
                most = n + LAYER_BYTES
        yield Layer("".join(held), *where)

    return used[0], layers()


def _packed(raw: bytes, place: Callable[[int, int], tuple[int, int]]) -> Iterator[Layer]:
    """What compressed data anywhere in ``raw`` holds; ``place`` tells where the bytes of a range came from."""
    done = 0
    for m in _PACKED.finditer(raw):
        if (a := m.start()) >= done:
            cuts = lambda a=a: (raw[i : i + 1024] for i in range(a, len(raw), 1024))
            used, layers = _inflated(cuts, lambda n, a=a: place(a, a + n))
            done = a + used
            yield from layers


def _packed_escapes(layer: Layer, first: re.Pattern, byte: re.Pattern, value: Callable[[re.Match], int]) -> Iterator[Layer]:
    """What compressed data holds of which some bytes are escaped and others stand for themselves."""
    text, done = layer.text, 0
    for m in first.finditer(text):
        if (a := m.start()) < done:
            continue
        ends: list[int] = []

        def blocks(a: int = a, ends: list[int] = ends) -> Iterator[bytes]:
            at, out = a, bytearray()
            ends.clear()
            while one := byte.match(text, at):
                at = one.end()
                ends.append(at)
                out.append(value(one))
                if len(out) == 1024:
                    yield bytes(out)
                    out.clear()
            yield bytes(out)

        used, layers = _inflated(blocks, lambda n, a=a, ends=ends: layer.origin(a, ends[n - 1]))
        if used:
            done = ends[used - 1]
            yield from layers


def _percent_value(m: re.Match) -> int:
    return int(m[1], 16) if m[1] else 32 if m[2] == "+" else ord(m[2])


def _escape_value(m: re.Match) -> int:
    return int(m[1], 16) if m[1] else ord(m[2]) if m[2] else _NAMED.get(m[3], ord(m[3]))


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Iterator[Layer]:
    """The layer with every match decoded."""
    text, out, starts, ends, last, changed = layer.text, [], [], [], 0, False

    def keep(a: int, b: int) -> None:
        out.append(text[a:b])
        if not isinstance(layer.start, int):
            starts.extend(range(a, b) if layer.start is None else layer.start[a:b])
            ends.extend(range(a + 1, b + 1) if layer.end is None else layer.end[a:b])

    for m in pattern.finditer(text):
        raw, spans = decode(m)
        part = _bytes_layer(raw, [layer.origin(a, b) for a, b in spans])
        keep(last, m.start())
        out.append(part.text)
        starts.extend(part.start)
        ends.extend(part.end)
        last, changed = m.end(), True
    if changed:
        keep(last, len(text))
        yield Layer("".join(out), layer.start, layer.end, layer.depth + 1) if isinstance(layer.start, int) else Layer("".join(out), starts, ends, layer.depth + 1)


_COMPLETE = re.compile(_PERCENT.pattern.removesuffix("+") + "|" + _ESCAPE.pattern.removesuffix("+"))


def _settled(layer: Layer) -> Iterator[Layer]:
    """The layer with percent encoding and escapes decoded until none is left, in one pass: what ends with a complete escape is decoded at once, and what that gives may end another.

    Nothing that a step between would show is lost: a finding holds no ``%`` or backslash, so a later step can take characters from its front
    only, behind an escape whose digits make the finding of the step before longer.
    """
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    opened: list[int] = []  # places of % and \\ in out that may begin an escape
    changed = False
    work: list[tuple[str, int, int]] = []
    for i, c in enumerate(layer.text):
        work.append((c, *layer.origin(i, i + 1)))
        while work:
            c, a, b = work.pop()
            if c in "%\\":
                opened.append(len(out))
            out.append(c)
            starts.append(a)
            ends.append(b)
            while opened and len(out) - opened[-1] > 10:
                opened.pop()
            m = _COMPLETE.fullmatch("".join(out[opened[-1] :])) if opened and len(out) - opened[-1] > 2 else None
            if m:
                at = opened.pop()
                a, b = min(starts[at:]), max(ends[at:])
                del out[at:], starts[at:], ends[at:]
                raw = (_percent if m[0][0] == "%" and m[0][1] != "u" else _escape)(m)[0]
                work += [(chr(x), a, b) for x in reversed(raw)]
                changed = True
    if changed:
        yield Layer("".join(out), layer.start, layer.end) if isinstance(layer.start, int) else Layer("".join(out), starts, ends)


def _wide(layer: Layer) -> Iterator[Layer]:
    """Text in UTF-16, every other byte zero."""
    for order, pattern in enumerate(_WIDE_TEXT):
        yield from _replaced(layer, pattern, lambda m, o=order: (m[0][o::2].encode("latin-1"), [(i, i + 2) for i in range(m.start(), m.end(), 2)]))


def _percent(m: re.Match) -> tuple[bytes, list[tuple[int, int]]]:
    return bytes.fromhex(m[0].replace("%", "")), [(i, i + 3) for i in range(m.start(), m.end(), 3)]


def _escape(m: re.Match) -> tuple[bytes, list[tuple[int, int]]]:
    if m[0][1] == "x":
        return bytes.fromhex(m[0].replace("\\x", "")), [(i, i + 4) for i in range(m.start(), m.end(), 4)]
    code = int(m[0][2:].strip("{}"), 16)
    raw = chr(code).encode("utf-8", "surrogatepass") if code < 0x110000 else b"\xff"
    return raw, [(m.start(), m.end())] * len(raw)


def _base64(layer: Layer) -> Iterator[Layer]:
    """Printable and compressed data in runs of base64, lines joined, at each of the four alignments."""
    for m in _BASE64.finditer(layer.text):
        if m.end() - m.start() < 16:
            continue
        parts, last = [], m.start()
        for gap in _BREAK.finditer(layer.text, m.start(), m.end()):
            parts.append((last, gap.start()))
            last = gap.end()
        parts.append((last, m.end()))
        body = "".join(layer.text[a:b] for a, b in parts).translate({45: 43, 95: 47})
        if len(body) < 16:
            continue
        at = np.concatenate([np.arange(a, b) for a, b in parts]) if parts[1:] else np.arange(m.start(), m.end())
        for shift in range(4):
            rest = (len(body) - shift) % 4
            coded = body[shift : len(body) - (rest == 1)]
            raw = base64.b64decode(coded + "=" * (-len(coded) % 4))
            place = lambda i, j, s=shift, at=at: layer.origin(int(at[s + i * 8 // 6]), int(at[s + (j * 8 - 1) // 6]) + 1)
            for p in _PRINTABLE.finditer(raw):
                text = p[0].decode("ascii")
                if isinstance(layer.start, int):
                    yield Layer(text, layer.start, layer.end)
                else:
                    spans = [place(i, i + 1) for i in range(p.start(), p.end())]
                    yield Layer(text, [a for a, _ in spans], [b for _, b in spans])
            for order, pattern in enumerate(_WIDE if b"\0" in raw else ()):
                for p in pattern.finditer(raw):
                    spans = [place(i, i + 2) for i in range(p.start(), p.end(), 2)]
                    text = p[0][order::2].decode("ascii")
                    yield Layer(text, layer.start, layer.end) if isinstance(layer.start, int) else Layer(text, [a for a, _ in spans], [b for _, b in spans])
            yield from _packed(raw, place)


def unwrap(layer: Layer) -> Iterator[Layer]:
    """The layers directly below."""
    if "\0" in layer.text:
        yield from _wide(layer)
    if layer.depth >= DEEP:
        yield from _settled(layer)
        return
    if "%" in layer.text:
        yield from _replaced(layer, _PERCENT, _percent)
        yield from _packed_escapes(layer, _PERCENT_PACKED, _PERCENT_BYTE, _percent_value)
    if "\\" in layer.text or "%u" in layer.text:
        yield from _replaced(layer, _ESCAPE, _escape)
    if "\\" in layer.text:
        yield from _packed_escapes(layer, _ESCAPE_PACKED, _ESCAPE_BYTE, _escape_value)
    if isinstance(layer.start, int):  # decompressed: it may be compressed twice
        yield from _packed(layer.text.encode("latin-1", "replace"), layer.origin)
    yield from _base64(layer)


def scan(text: str, hex_runs: bool = True, wrapped: bool = True) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base findings, and those that only decoding shows, both sorted by start, kind, end."""
    base = find(text, hex_runs)
    more: set[tuple[str, int, int]] = set()
    if wrapped:
        top = Layer(text)
        seen, work = {top.key()}, [unwrap(top)]
        while work:  # one layer of each depth is held
            below = next(work[-1], None)
            if below is None:
                work.pop()
            elif (key := below.key()) not in seen:
                seen.add(key)
                more.update((kind, *below.origin(a, b)) for kind, a, b in find(below.text))
                work.append(unwrap(below))
        more.difference_update(base)
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return sorted(base, key=order), sorted(more, key=order)


def _may_wrap(text: str, coded: bool) -> bool:
    """Whether a text may hold layers; ``coded``: it has a run of base64."""
    return coded or any(c in text for c in "%\\\n\r\0")


def _with_run(data: np.ndarray, off: np.ndarray, kind: np.ndarray, length: int = 16) -> np.ndarray:
    """Which texts may have a run of ``length`` bytes of a class."""
    breaks = np.concatenate([[-1], np.flatnonzero(~kind[data]), [len(data)]])
    at = breaks[:-1][np.diff(breaks) > length] + 1
    out = np.zeros(len(off), bool)
    ends = np.minimum(breaks[1:][np.diff(breaks) > length], len(data))
    first, last = np.searchsorted(off, at, side="right") - 1, np.searchsorted(off, ends, side="left") - 1
    for a, b in zip(first.tolist(), last.tolist(), strict=True):  # few: long runs
        out[a : b + 1] = True
    return out[:-1]


SPANS = "array<struct<kind:string,start:long,end:long>>"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, decoded``: arrays of (kind, start, end), sorted by start, kind, end."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            data, off = utf8_buffers(batch.column(1))
            hexes, coded = _with_run(data, off, _HEX_CLASS), _with_run(data, off, _BASE64_CLASS)
            found = [scan(t, h, _may_wrap(t, c)) for t, h, c in zip(batch.column(1).to_pylist(), hexes, coded, strict=True)]
            columns = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in f[i]] for f in found], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "base", "decoded"])

    return docs_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, base {SPANS}, decoded {SPANS}")


def redact(docs: DataFrame, mask: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """The documents with every finding, decoded ones included, replaced by ``mask``; all columns stay.

    Overlapping findings become one mask, and the padding of an encoded one goes with it. A null text stays null; very long texts are whole.
    """
    at = docs.columns.index(text_col)

    def clean(text: str | None, hexes: bool, coded: bool) -> str | None:
        if not text:
            return text
        base, more = scan(text, hexes, _may_wrap(text, coded))
        if not base and not more:
            return text
        out, last = [], 0
        more = [(kind, a, _PADDING.match(text, b).end()) for kind, a, b in more]
        for _, a, b in sorted([*base, *more], key=lambda s: s[1]):
            if a >= last:
                out += [text[last:a], mask]
            last = max(last, b)
        return "".join([*out, text[last:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            data, off = utf8_buffers(batch.column(at))
            hexes, coded = _with_run(data, off, _HEX_CLASS), _with_run(data, off, _BASE64_CLASS)
            texts = [clean(*x) for x in zip(batch.column(at).to_pylist(), hexes, coded, strict=True)]
            yield batch.set_column(at, batch.schema.field(at).name, pa.array(texts, batch.schema.field(at).type))

    bound_batches(docs.sparkSession)
    return narrow(docs).mapInArrow(run, docs.schema)


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sort_spans(spans: Column) -> Column:
    """By start, then kind as listed, then end."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

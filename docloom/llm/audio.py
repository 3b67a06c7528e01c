"""Audio columns: polyphase resampling, log-mel features and energy segments.

A payload is stored losslessly as 8-bit unsigned PCM in a RIFF/WAVE container. Features are computed from the
samples read back from the stored bytes:

* rational resampling by a windowed-sinc low-pass evaluated in polyphase form (only output samples are computed),
* overlapped Hann frames, power spectra and a triangular mel filterbank, in decibels,
* segments by energy with hysteresis: a segment opens above ``high`` and closes below ``low``.

Log-mel frames are stored as tensors of one fixed shape ``(block_frames, n_mels)``: the last is padded with the floor value
and carries its true number of frames. Tasks build them as Arrow fixed-shape tensors, whose storage Spark holds as lists of floats;
``to_tensors`` gives the tensor column again. Long media are handled in
blocks of frames, but all samples and tensors of a recording are held while it is described: memory grows with its length (some 100 MB for 4 MB).

Defined results: a null text counts as empty, whose payload is 64 zero bytes; equal payloads give equal values, as each row
is computed by itself; repeated rows each give a row; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import docs_text, materialize, slices, utf8_buffers


@dataclass(frozen=True)
class AudioSpec:
    rate: int = 16_000  # of the stored samples
    target_rate: int = 8_000
    frame: int = 256
    hop: int = 128
    n_mels: int = 32
    block_frames: int = 64
    taps: int = 8  # half width of the low-pass, in output samples
    high_db: float = 3.0  # above the mean frame energy a segment opens
    low_db: float = -3.0  # below it a segment closes
    floor_db: float = -100.0


def wav_bytes(payload: bytes, rate: int) -> bytes:
    """One channel of 8-bit unsigned PCM."""
    pad = len(payload) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def wav_payload(media: bytes) -> bytes:
    """The samples' bytes, found by walking the chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def low_pass(up: int, down: int, taps: int) -> np.ndarray:
    """Hann-windowed sinc at ``up`` times the rate; gain ``up``."""
    widest = max(up, down)
    half = taps * widest
    t = np.arange(-half, half + 1)
    return (np.sinc(t / widest) * (0.5 + 0.5 * np.cos(np.pi * t / (half + 1))) / widest * up).astype(np.float32)


def resample(x: np.ndarray, up: int, down: int, taps: int = 8) -> np.ndarray:
    """x at up/down times the rate: output m is a dot product with one phase of the filter, strided over the input."""
    if up == down:
        return x.astype(np.float32)
    h = low_pass(up, down, taps)
    half = len(h) // 2
    n_out = -(-len(x) * up // down)
    out = np.empty(n_out, np.float32)
    reach = half // up + 1
    padded = np.concatenate([np.zeros(reach, np.float32), x.astype(np.float32), np.zeros(reach + down + 1, np.float32)])
    for phase in range(up):
        # outputs m with (m * down) % up == phase; up and down are coprime, so m steps by up
        m = np.arange(next(m for m in range(up) if m * down % up == phase), n_out, up)
        if len(m) == 0:
            continue
        base = m * down // up  # input sample at or before the output's time
        offsets = np.arange(-reach + 1, reach + 1)
        index = phase - offsets * up + half
        good = (index >= 0) & (index < len(h))
        step = down
        acc = np.zeros(len(m), np.float32)
        for o, k in zip(offsets[good].tolist(), index[good].tolist(), strict=True):
            first = int(base[0]) + o + reach
            acc += h[k] * padded[first : first + step * (len(m) - 1) + 1 : step]
        out[m] = acc
    return out


def mel_filters(rate: int, frame: int, n_mels: int) -> np.ndarray:
    mel = lambda f: 2595.0 * math.log10(1 + f / 700.0)
    edges = 700.0 * (10 ** (np.linspace(0, mel(rate / 2), n_mels + 2) / 2595.0) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid))).astype(np.float32).T


class Features:
    """Filters and windows of one spec, reused for every row."""

    def __init__(self, spec: AudioSpec):
        g = math.gcd(spec.rate, spec.target_rate)
        self.spec, self.up, self.down = spec, spec.target_rate // g, spec.rate // g
        self.window = np.hanning(spec.frame + 1)[:-1].astype(np.float32)
        self.mel = mel_filters(spec.target_rate, spec.frame, spec.n_mels)

    def log_mel(self, samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Frames (n, n_mels) in dB, and frame energies in dB; one frame at least."""
        s = self.spec
        y = resample((samples.astype(np.float32) - 128.0) / 128.0, self.up, self.down, s.taps)
        if len(y) < s.frame:
            y = np.concatenate([y, np.zeros(s.frame - len(y), np.float32)])
        frames = np.lib.stride_tricks.sliding_window_view(y, s.frame)[:: s.hop]
        mels, energy = np.empty((len(frames), s.n_mels), np.float32), np.empty(len(frames), np.float32)
        for a in range(0, len(frames), 1024):
            spectrum = np.fft.rfft(frames[a : a + 1024] * self.window, axis=1).astype(np.complex64)
            power = spectrum.real**2 + spectrum.imag**2
            mels[a : a + 1024] = power @ self.mel
            energy[a : a + 1024] = power.sum(axis=1)
        db = lambda p: np.maximum(10 * np.log10(np.maximum(p, 1e-10)), s.floor_db).astype(np.float32)
        return db(mels), db(energy)

    def segments(self, energy: np.ndarray) -> list[tuple[int, int]]:
        """Runs of frames: opened above mean + high, closed below mean + low; last frame exclusive."""
        s, mean = self.spec, float(energy.mean())
        state = np.where(energy > mean + s.high_db, 1, np.where(energy < mean + s.low_db, 0, -1))
        known = np.flatnonzero(state >= 0)
        if len(known) == 0:
            return []
        held = np.searchsorted(known, np.arange(len(energy)), side="right") - 1
        on = np.where(held >= 0, state[known[np.maximum(held, 0)]], 0)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
        return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))

    def seconds(self, frame: int) -> float:
        return frame * self.spec.hop / self.spec.target_rate

    def blocks(self, mels: np.ndarray) -> list[tuple[float, float, int, np.ndarray]]:
        """(start, end, frames, tensor) of each fixed-shape tensor."""
        s, out = self.spec, []
        for a in range(0, len(mels), s.block_frames):
            part = mels[a : a + s.block_frames]
            tensor = np.full((s.block_frames, s.n_mels), s.floor_db, np.float32)
            tensor[: len(part)] = part
            out.append((self.seconds(a), self.seconds(a + len(part) - 1) + s.frame / s.target_rate, len(part), tensor))
        return out


def payload_of(text: bytes) -> bytes:
    """The bytes, zero-filled to a positive multiple of 64."""
    return text + b"\0" * (max(64, -(-len(text) // 64) * 64) - len(text))


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    data, off = utf8_buffers(batch.column(1))
    raw = data.tobytes()
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        yield raw[a:b]


def store_media(docs: DataFrame, spec: AudioSpec = AudioSpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, media, n_bytes``: each text's payload as a WAVE file, and the bytes of the text itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts = list(_texts(batch))
            media = pa.array([wav_bytes(payload_of(t), spec.rate) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), media, pa.array(map(len, texts), pa.int64())], ["doc_id", "media", "n_bytes"])

    return docs_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, media binary, n_bytes long")


def tensor_array(tensors: list[np.ndarray], spec: AudioSpec) -> pa.ExtensionArray:
    """Blocks as one Arrow array of fixed-shape tensors."""
    shape = (spec.block_frames, spec.n_mels)
    values = np.stack(tensors) if tensors else np.empty((0, *shape), np.float32)
    storage = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), shape[0] * shape[1])
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), shape), storage)


def log_mel_tensors(media: DataFrame, spec: AudioSpec = AudioSpec()) -> DataFrame:
    """``doc_id, block, start_s, end_s, n_frames, tensor``: tensors of ``block_frames * n_mels`` floats, row by row."""
    schema = "doc_id long, block int, start_s double, end_s double, n_frames int, tensor array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(spec)
        for batch in slices(batches, 1, 1 << 18):
            rows: list[tuple] = []
            for name, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if m is None:
                    continue
                mels, _ = features.log_mel(np.frombuffer(wav_payload(m), np.uint8))
                rows += [(name, i, *b) for i, b in enumerate(features.blocks(mels))]
            if rows:
                flat = tensor_array([r[5] for r in rows], spec).storage.flatten()
                size = spec.block_frames * spec.n_mels
                tensor = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, size, dtype=np.int32), flat)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.float64()), pa.array([r[4] for r in rows], pa.int32()), tensor], ["doc_id", "block", "start_s", "end_s", "n_frames", "tensor"])

    return media.select("doc_id", "media").mapInArrow(run, schema)


def to_tensors(table: pa.Table, spec: AudioSpec = AudioSpec()) -> pa.Table:
    """The same table with ``tensor`` as an Arrow fixed-shape tensor column."""
    kind = pa.fixed_shape_tensor(pa.float32(), (spec.block_frames, spec.n_mels))
    size = spec.block_frames * spec.n_mels
    column = table.column("tensor").combine_chunks()
    values = column.flatten() if len(column) else pa.array([], pa.float32())
    storage = pa.FixedSizeListArray.from_arrays(values.cast(pa.float32()), size)
    return table.set_column(table.schema.get_field_index("tensor"), "tensor", pa.ExtensionArray.from_storage(kind, storage))


def describe_media(docs: DataFrame, spec: AudioSpec = AudioSpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as media in a written table, and describe what is read back from there."""
    return describe_stored(materialize(store_media(docs, spec, id_col, text_col), "media"), spec)


def describe_stored(media: DataFrame, spec: AudioSpec = AudioSpec()) -> DataFrame:
    """Stored media (``doc_id, media, n_bytes``) described: sizes, digests, all segments and a text form of the features.

    ``feature`` names frames, all segments (start to end in seconds), a digest of all log-mel values rounded to 0.1 dB, and the
    number of fixed-shape tensors with a digest of their values, likewise rounded, true frames and time spans.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, segments array<struct<start_s:double,end_s:double>>"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(spec)
        for batch in slices(batches, 1):
            rows = []
            for name, wave, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = wav_payload(wave)
                mels, energy = features.log_mel(np.frombuffer(payload, np.uint8))
                spans = [(features.seconds(a), features.seconds(b)) for a, b in features.segments(energy)]
                digest = hashlib.sha256(np.rint(mels * 10).astype("<i2").tobytes()).hexdigest()[:16]
                blocks = features.blocks(mels)
                tensors = tensor_array([b[3] for b in blocks], spec)
                own = hashlib.sha256(np.rint(tensors.to_numpy_ndarray() * 10).astype("<i2").tobytes())
                own.update(";".join(f"{a:.3f}-{b:.3f}:{n}" for a, b, n, _ in blocks).encode())
                shown = ",".join(f"{a:.3f}-{b:.3f}" for a, b in spans)
                feature = f"frames={len(mels)};mel={float(mels.mean()):.1f};segments={len(spans)}[{shown}];digest={digest};tensors={len(tensors)}:{own.hexdigest()[:16]}"
                rows.append((name, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(wave), hashlib.sha256(wave).hexdigest(), feature, [dict(zip(("start_s", "end_s"), s, strict=True)) for s in spans]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return media.select("doc_id", "media", "n_bytes").mapInArrow(run, schema)

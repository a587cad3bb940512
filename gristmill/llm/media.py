"""Audio features of media columns.

Each payload is stored as a mono WAV file of unsigned 8-bit samples and read back
from those bytes.  The samples are resampled by a polyphase filter, cut into
overlapped windows, turned into log-mel energies, and segmented by hysteresis on
the frame energy.  Frames are stored as Arrow tensors of one fixed shape
``(FRAMES, MELS)`` (the last one zero-padded), each with the time span it covers: a document's ``tensors`` is an Arrow stream of
one batch with the columns ``tensor`` (of the extension type ``arrow.fixed_shape_tensor``, which carries the shape), ``start_s`` and ``end_s``.
Spark has no such type, so the column is binary; ``read_tensors`` gives the arrays back, and so does any reader of Arrow.

A null text is an empty payload; payloads are padded with zero bytes to a
positive multiple of 64.  Equal payloads give equal values wherever they run,
because each payload is computed alone in blocks of a fixed size.  Memory is
bounded by one payload plus one block; there is no shuffle.  Other columns are
ignored and repeated rows are kept.  An empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

RATE, UP, DOWN = 16_000, 2, 3
WIDTH, HOP, MELS, FRAMES = 256, 128, 16, 32
TAPS = 24
BLOCK = 1 << 17
ON_DB, OFF_DB = 3.0, 0.5
PAD = 64

SCHEMA = (
    "n_bytes bigint, media binary, payload binary, n_frames int, tensors binary, level double, "
    "spans array<struct<start_s: double, end_s: double>>, active array<struct<start_s: double, end_s: double>>"
)
_SPAN = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))


def write_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A RIFF WAVE file of mono unsigned 8-bit samples."""
    pad = b"\0" * (len(samples) % 2)
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples))
    return b"RIFF" + struct.pack("<I", len(head) + len(samples) + len(pad)) + head + samples + pad


def read_wav(media: bytes) -> tuple[int, bytes]:
    """Rate and samples of a file that ``write_wav`` made, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            rate = struct.unpack_from("<I", media, at + 12)[0]
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache(maxsize=8)
def prototype(up: int, down: int, taps: int = TAPS) -> np.ndarray:
    """The low-pass filter of the resampler, one row of taps for each phase."""
    n = np.arange(taps * up) - (taps * up - 1) / 2
    cut = 1 / max(up, down)
    h = np.sinc(n * cut) * cut * np.hamming(taps * up) * up
    return (h / h.sum() * up).reshape(taps, up).T.copy()


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Polyphase rational resampling; output ``n`` only evaluates phase ``n * down % up``."""
    h = prototype(up, down, taps)
    n_out = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps - 1, x.dtype), x, np.zeros(down + 1, x.dtype)])
    y = np.zeros(n_out, x.dtype)
    for r in range(min(up, n_out)):
        base, phase = divmod(r * down, up)
        count = len(y[r::up])
        for t in range(taps):
            at = base + taps - 1 - t
            y[r::up] += x.dtype.type(h[phase, t]) * padded[at : at + (count - 1) * down + 1 : down]
    return y


@lru_cache(maxsize=8)
def mel_bank(rate: float, width: int = WIDTH, mels: int = MELS) -> np.ndarray:
    """Triangular filters evenly spaced on the mel scale."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1) / rate * width
    bins = np.arange(width // 2 + 1)[:, None]
    rise, fall = (bins - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - bins) / np.diff(edges)[1:]
    return np.clip(np.minimum(rise, fall), 0, None)


def log_mel(y: np.ndarray, rate: float) -> np.ndarray:
    """Log-mel energies of overlapped Hann windows, in blocks; at least one frame."""
    n = max(1, -(-(len(y) - WIDTH + HOP) // HOP))
    y = np.concatenate([y, np.zeros((n - 1) * HOP + WIDTH - len(y), y.dtype)]) if (n - 1) * HOP + WIDTH > len(y) else y
    hann, bank, out, step = np.hanning(WIDTH), mel_bank(rate), [], BLOCK // HOP
    for at in range(0, n, step):
        part = y[at * HOP : (min(n, at + step) - 1) * HOP + WIDTH]
        frames = np.lib.stride_tricks.sliding_window_view(part, WIDTH)[::HOP] * hann
        out.append(np.log10(np.maximum((np.abs(np.fft.rfft(frames, axis=1)) ** 2) @ bank, 1e-10)))
    return np.concatenate(out)


def segments(energy: np.ndarray, on: float = ON_DB, off: float = OFF_DB) -> list[tuple[int, int]]:
    """Runs of frames above the lower level that somewhere exceed the higher one; levels are dB over the median."""
    floor = np.median(energy)
    low, high = energy > floor + off, energy > floor + on
    edges = np.flatnonzero(np.diff(np.concatenate([[0], low.view(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2) if high[a:b].any()]


def features(payload: bytes, rate: int = RATE) -> tuple[np.ndarray, int, list[tuple[float, float]], list[tuple[float, float]]]:
    """Tensors ``(k, FRAMES, MELS)``, frame count, span of each tensor, and active spans, in seconds."""
    x = np.frombuffer(payload, np.uint8).astype(np.float32)
    y = resample((x - 128) / 128)
    new = rate * UP / DOWN
    mel = log_mel(y, new)
    n, k = len(mel), -(-len(mel) // FRAMES)
    tensors = np.zeros((k * FRAMES, MELS), np.float32)
    tensors[:n] = mel
    at = lambda frame: round(frame * HOP / new, 6)
    spans = [(at(i * FRAMES), at(min(n, (i + 1) * FRAMES) - 1 + WIDTH / HOP)) for i in range(k)]
    active = [(at(a), at(b - 1 + WIDTH / HOP)) for a, b in segments(10 * mel.mean(axis=1))]
    return tensors.reshape(k, FRAMES, MELS), n, spans, active


_TENSORS = pa.schema([("tensor", pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))), ("start_s", pa.float64()), ("end_s", pa.float64())])


def write_tensors(tensors: np.ndarray, spans: list[tuple[float, float]]) -> bytes:
    """Tensors ``(k, FRAMES, MELS)`` and their time spans as an Arrow stream."""
    columns = [pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(tensors)), *(pa.array([s[i] for s in spans], pa.float64()) for i in (0, 1))]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _TENSORS) as out:
        out.write_batch(pa.record_batch(columns, schema=_TENSORS))
    return sink.getvalue().to_pybytes()


def read_tensors(stored: bytes) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """What ``write_tensors`` stored; the shape comes from the stream."""
    found = pa.ipc.open_stream(stored).read_all().combine_chunks()
    tensors = found.column("tensor").chunk(0).to_numpy_ndarray()
    return tensors, list(zip(found.column("start_s").to_pylist(), found.column("end_s").to_pylist(), strict=True))


def audio_features(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the columns of ``SCHEMA`` for the UTF-8 bytes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            rows = []
            for value in batch.column("text").cast(pa.binary()).to_pylist():
                raw = value or b""
                media = write_wav(raw + b"\0" * (PAD - len(raw) % PAD if len(raw) % PAD or not raw else 0))
                rate, payload = read_wav(media)
                tensors, frames, spans, active = features(payload, rate)
                stored = write_tensors(tensors, spans)
                level = float(read_tensors(stored)[0].sum(dtype=np.float64)) / (frames * MELS)
                rows.append((len(raw), media, payload, frames, stored, level, spans, active))
            n, media, payload, frames, tensors, level, spans, active = map(list, zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(n, pa.int64()), pa.array(media, pa.binary()), pa.array(payload, pa.binary()), pa.array(frames, pa.int32()), pa.array(tensors, pa.binary()), pa.array(level, pa.float64())]
                + [pa.array([[{"start_s": a, "end_s": b} for a, b in x] for x in part], _SPAN) for part in (spans, active)],
                ["key", "n_bytes", "media", "payload", "n_frames", "tensors", "level", "spans", "active"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, f"key {kind}, {SCHEMA}").withColumnRenamed("key", key)

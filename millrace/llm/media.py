"""Audio columns: lossless 8-bit samples, polyphase resampling, log-mel tensors and energy segments.

`store` writes each payload as an 8-bit PCM WAV in a media column of a table; `analysed` reads the
stored bytes back and writes, for each row: the log-mel frames of the resampled signal (integer polyphase filter, so
equal bytes always give equal values), overlapped and cut into fixed-shape tensors with
their time spans, and the spans in which the frame energy is high, with a higher threshold to enter
than to leave a span. `features` reads the tensors back as Arrow fixed-shape tensors and describes them; `tensor_rows` lists them.
Log-mel values are stored as 32-bit floats in steps of 1 / `STEPS`.

Defined results: null and empty texts give one unit of 64 zero bytes; a payload is never truncated, and very long ones are
resampled and analysed in blocks of bounded memory; a payload shorter than a window gives one frame, and the last tensor is filled with zeros;
repeated rows give repeated rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._store import writing

UNIT = 64
RATE = 8000
#: Steps of a stored log-mel value in a unit.
STEPS = 64
#: Bytes of payloads, frames and samples that are worked on at once; a payload may be longer.
BLOCK_BYTES, BLOCK_FRAMES, BLOCK_SAMPLES = 1 << 20, 8192, 1 << 16
TENSOR_KEY, SHAPE_KEY = "ARROW:extension:name", "ARROW:extension:metadata"


@dataclass(frozen=True)
class Settings:
    """Rates are in samples a second, window and hop in resampled samples, frames in frames a tensor."""

    up: int = 3
    down: int = 4
    taps: int = 8
    window: int = 256
    hop: int = 128
    mels: int = 16
    frames: int = 32
    enter: float = 1.10
    leave: float = 0.95


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the unit."""
    return data + b"\0" * (-len(data) % UNIT if data else UNIT)


def to_wav(payload: bytes) -> bytes:
    """Mono 8-bit PCM; the samples are the payload's bytes as they are."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV")
    at = 12
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


def _in_blocks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows in runs of about BLOCK_BYTES of one column, of at least one row each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + BLOCK_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def store(docs: DataFrame, path: str) -> DataFrame:
    """Write doc_id, n_bytes and the media column as a table; the table read back."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _in_blocks(batch, 1):
                raw = [(t or "").encode() for t in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([to_wav(pad(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    media = rows.mapInArrow(encode, "doc_id bigint, n_bytes bigint, media binary")
    with writing(docs.sparkSession):
        media.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(media.schema).parquet(path)


@lru_cache(maxsize=4)
def _filter(up: int, down: int, taps: int) -> tuple[np.ndarray, int]:
    """Windowed-sinc low-pass in whole numbers (scale 2**12), one row of coefficients for each phase."""
    half = taps * max(up, down)
    t = np.arange(-half, half + 1)
    cutoff = 1 / max(up, down)
    h = np.sinc(t * cutoff) * np.hamming(len(t)) * cutoff * up
    width = -(-len(h) // up)
    h = np.pad(np.round(h * 4096), (0, width * up - len(h)))
    return h.reshape(width, up).T.copy(), half


def resample(samples: np.ndarray, up: int, down: int, taps: int) -> np.ndarray:
    """Whole-number samples at up/down times the rate; every product and sum is exact."""
    phases, half = _filter(up, down, taps)
    width, n = phases.shape[1], len(samples)
    total = -(-n * up // down)
    out = np.zeros(total)
    padded = np.zeros(n + 2 * width + half)
    padded[width : width + n] = samples
    windows = np.lib.stride_tricks.sliding_window_view(padded, width)
    for first in range(min(up, total)):
        # output m sits at m * down in the upsampled signal; outputs m, m + up, .. share a phase
        at = first * down + half
        phase, base = at % up, at // up
        count = len(range(first, total, up))
        # sum over k of h[phase + k * up] * x[base - k]
        rows = windows[base + 1 : base + 1 + count * down : down][:count]
        for at in range(0, count, BLOCK_SAMPLES):
            out[first + at * up :: up][:BLOCK_SAMPLES] = rows[at : at + BLOCK_SAMPLES] @ phases[phase][::-1]
    return np.floor(out / 4096 + 0.5)


@lru_cache(maxsize=4)
def _mel(window: int, mels: int, rate: float) -> np.ndarray:
    """Triangular filters evenly spaced on the mel scale, one column for each."""
    hz = np.linspace(0, rate / 2, window // 2 + 1)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), mels + 2) / 2595) - 1)
    rise = (hz[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - hz[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


def spans(energy: np.ndarray, enter: float, leave: float) -> list[tuple[int, int]]:
    """Frame spans: entered at `enter` times the mean energy or above, left below `leave` times."""
    if not len(energy) or not energy.any():
        return []
    mean = energy.mean()
    high, low = energy >= enter * mean, energy < leave * mean
    last = np.maximum.accumulate(np.where(high | low, np.arange(len(energy)), -1))
    on = np.concatenate([[False], (last >= 0) & high[np.maximum(last, 0)], [False]])
    edges = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def analyse(payloads: list[bytes], s: Settings) -> list[tuple[np.ndarray, list[tuple[int, int]]]]:
    """Log-mel frames (frames x mels, in whole steps) and energy spans of each payload."""
    mel = _mel(s.window, s.mels, RATE * s.up / s.down)
    signals: list[np.ndarray] = []
    for p in payloads:
        y = resample(np.frombuffer(p, dtype=np.uint8).astype(np.float64) - 128, s.up, s.down, s.taps)
        n = max(1, 1 + -(-(len(y) - s.window) // s.hop))
        padded = np.zeros((n - 1) * s.hop + s.window)
        padded[: len(y)] = y
        signals.append(np.lib.stride_tricks.sliding_window_view(padded, s.window)[:: s.hop])
    ends = np.cumsum([len(x) for x in signals])
    logs, energy = np.empty((int(ends[-1]) if len(ends) else 0, s.mels), dtype=np.float32), []
    done, held, size = 0, [], 0
    for k, frames in enumerate(signals):
        at = 0
        while at < len(frames):
            held.append(frames[at : at + BLOCK_FRAMES - size])
            at, size = at + len(held[-1]), size + len(held[-1])
            if size == BLOCK_FRAMES or (k == len(signals) - 1 and at == len(frames)):
                some = np.concatenate(held)
                energy.append((some * some).sum(1))
                power = np.abs(np.fft.rfft(some * np.hanning(s.window), axis=1)) ** 2
                logs[done : done + size] = np.round(np.log(power @ mel + 1.0) * STEPS) / STEPS
                done, held, size = done + size, [], 0
    every = np.concatenate(energy) if energy else np.zeros(0)
    return [(logs[e - len(x) : e], spans(every[e - len(x) : e], s.enter, s.leave)) for e, x in zip(ends, signals, strict=True)]


def tensors(logs: np.ndarray, s: Settings) -> np.ndarray:
    """Frames in fixed shapes (tensor, frames, mels), zeros after the last frame."""
    n = -(-len(logs) // s.frames)
    out = np.zeros((n * s.frames, s.mels), dtype=np.float32)
    out[: len(logs)] = logs
    return out.reshape(n, s.frames, s.mels)


def seconds(frame: int, s: Settings) -> float:
    return frame * s.hop * s.down / s.up / RATE


_SPAN = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])
_TENSOR = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64()), ("values", pa.list_(pa.float32()))])
_STORED = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string"
_TENSORS = "n_frames bigint, tensors array<struct<start_s:double,end_s:double,values:array<float>>>, active array<struct<start_s:double,end_s:double>>"


def analysed(media: DataFrame, path: str, settings: Settings = Settings()) -> DataFrame:
    """Write a row for each stored one, of digests of its bytes, its tensors and energy spans; the table read back.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, n_frames, tensors
    (start_s, end_s and settings.frames x settings.mels values each) and active (start_s, end_s).
    """
    s = settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _in_blocks(batch, 2):
                stored = rows.column(2).to_pylist()
                read = [from_wav(x) for x in stored]
                found = analyse(read, s)
                cut = [tensors(logs, s) for logs, _ in found]
                counts, spans_ = [len(x) for x in cut], [[(seconds(a, s), seconds(b, s)) for a, b in active] for _, active in found]
                flat = pa.array(np.concatenate([x.ravel() for x in cut]) if cut else np.zeros(0, dtype=np.float32))
                values = pa.ListArray.from_arrays(pa.array(np.arange(sum(counts) + 1) * (s.frames * s.mels), pa.int32()), flat)
                starts = [seconds(k * s.frames, s) for n in counts for k in range(n)]
                last = [min(len(logs), (k + 1) * s.frames) - 1 for (logs, _), n in zip(found, counts, strict=True) for k in range(n)]
                stops = [seconds(k, s) + s.window * s.down / s.up / RATE for k in last]
                made = pa.StructArray.from_arrays([pa.array(starts, pa.float64()), pa.array(stops, pa.float64()), values], fields=list(_TENSOR))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        rows.column(1),
                        pa.array([len(x) for x in read], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in read], pa.string()),
                        pa.array([zlib.crc32(x[-UNIT:]) for x in read], pa.int64()),
                        pa.array([len(x) for x in stored], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in stored], pa.string()),
                        pa.array([len(logs) for logs, _ in found], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), made),
                        pa.array([[dict(zip(("start_s", "end_s"), x, strict=True)) for x in row] for row in spans_], pa.list_(_SPAN)),
                    ],
                    names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "tensors", "active"],
                )

    out = media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"{_STORED}, {_TENSORS}")
    with writing(media.sparkSession):
        out.write.option("compression", "zstd").parquet(path)
    return media.sparkSession.read.schema(out.schema).parquet(path)


def as_tensors(column: pa.Array | pa.ChunkedArray, settings: Settings = Settings()) -> pa.Array:
    """A column of tensor values read from a table, as an Arrow fixed-shape tensor array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.fixed_shape_tensor(pa.float32(), (settings.frames, settings.mels))
    flat = pa.FixedSizeListArray.from_arrays(column.flatten().cast(pa.float32()), math.prod((settings.frames, settings.mels)))
    return pa.ExtensionArray.from_storage(kind, flat)


def features(stored: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A description of the stored tensors and spans of each row of `analysed`, read back.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.
    """
    s = settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = []
            column = batch.column(8)
            every = as_tensors(column.flatten().field("values"), s).to_numpy_ndarray() if len(column.flatten()) else np.zeros((0, s.frames, s.mels))
            stops = np.cumsum(column.value_lengths().to_numpy())
            for n, stop, count, active in zip(batch.column(7).to_pylist(), stops, column.value_lengths().to_pylist(), batch.column(9).to_pylist(), strict=True):
                own = every[stop - count : stop]
                steps = np.round(own.reshape(-1, s.mels).astype(np.float64) * STEPS).astype(np.int64)
                mean = ",".join(f"{x:.2f}" for x in (steps[:n].sum(0) / (n * STEPS)).tolist())
                when = ",".join(f"{x['start_s']:.3f}-{x['end_s']:.3f}" for x in active)
                said.append(f"frames={n};tensors={count};mel={mean};crc={zlib.crc32(np.ascontiguousarray(own, dtype='<f4').tobytes())};active={when}")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(7)), pa.array(said, pa.string())], names=[*batch.schema.names[:7], "feature"])

    return stored.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "tensors", "active").mapInArrow(run, f"{_STORED}, feature string")


def tensor_rows(stored: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per stored tensor: doc_id, tensor_no, start_s, end_s, tensor (with the shape in its metadata)."""
    rows = stored.select("doc_id", F.posexplode("tensors").alias("tensor_no", "t")).select("doc_id", "tensor_no", "t.start_s", "t.end_s", F.col("t.values").alias("tensor"))
    shape = f'{{"shape":[{settings.frames},{settings.mels}]}}'
    return rows.withColumn("tensor", F.col("tensor").alias("tensor", metadata={TENSOR_KEY: "arrow.fixed_shape_tensor", SHAPE_KEY: shape}))

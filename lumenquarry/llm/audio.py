"""Operator 2: media columns with audio features.

A WAV column (PCM of 8, 16, 24 or 32 bits or 32-bit floats, any channels, which are averaged)
is resampled to ``RATE`` by a polyphase filter (a Kaiser-windowed sinc, in the L/M branches
that the output needs), framed by overlapping Hann windows and turned into log-mel energies.
Speech is found by hysteresis: a segment begins where a frame's level exceeds ``ON`` decibels
over the noise floor (the 10th percentile of the levels, at most ``CEILING``) and goes on
until it is below ``OFF`` for ``HANG`` frames. Every segment is cut into tensors of ``FRAMES``
frames by ``MELS`` bands, which overlap by half; the last is filled up with the floor. A row
has one tensor, its time span, and the span of its segment.

Tensors have one shape. ``audio_features`` gives a row for each, as ARRAY<FLOAT> of FRAMES *
MELS values, row by row, since Spark has no tensor type. ``audio_tensors`` gives a row for
each recording and stores its tensors as Arrow's fixed-shape tensor extension type with their
time spans: a BINARY column of Arrow IPC streams. Whatever sink takes that DataFrame writes
them, through Spark's own commit and file system, so lost executors leave no halves.
``unpack`` turns it into rows again, ``read_tensors`` one stream into a numpy array.

Records are worked on one by one within their tasks; no shuffle, no record meets another.

Defined cases: NULL, empty, broken or silent audio (no frame over the threshold) has no
tensors, as does audio shorter than one window, and a WAV header with a sampling rate out of
``RATES`` or an encoding other than those above counts as broken; cut-off WAV data count as far as they go;
a very long recording needs memory in proportion to its length (some 40 bytes a sample); NULLs in other columns
pass through; repeated rows give repeated tensors; there are no ties; an empty table gives an empty one; other
columns keep their names, and the new ones must not be among them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh, prepare

RATE, WINDOW, HOP, FFT, MELS, FRAMES = 16_000, 400, 160, 512, 32, 32
ON, OFF, HANG, CEILING, FLOOR = 12.0, 6.0, 4, -50.0, 1e-10
TAPS, BETA = 16, 8.6
#: Sampling rates that are taken for such; others come from broken headers and would need filters of any size.
RATES = (1_000, 384_000)
COLUMNS = T.StructType([T.StructField("segment", T.IntegerType(), False), T.StructField("chunk", T.IntegerType(), False), *[T.StructField(x, T.DoubleType(), False) for x in ("start_s", "end_s", "segment_start_s", "segment_end_s")], T.StructField("log_mel", T.ArrayType(T.FloatType(), False), False)])


def read_wav(data: bytes | None) -> tuple[np.ndarray, int] | None:
    """Samples in -1 .. 1 and their rate; None for what isn't a readable WAV file."""
    if not data or len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, how = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            how = struct.unpack("<HHIIHH", body[:16])
            if how[0] == 0xFFFE:  # the kind stands in the extension
                how = (int.from_bytes(body[24:26], "little"), *how[1:]) if len(body) >= 26 else (0, *how[1:])
        elif name == b"data":
            if how is None:
                return None
            kind, channels, rate, _, _, bits = how
            width = bits // 8
            if not (channels and width and RATES[0] <= rate <= RATES[1]) or bits % 8 or width > 4 or kind not in (1, 3) or (kind == 3 and width != 4):
                return None
            raw = np.frombuffer(body[: len(body) // (width * channels) * width * channels], np.uint8).reshape(-1, width)
            if kind == 3:
                x = np.nan_to_num(raw.copy().view("<f4")[:, 0].astype(np.float64), posinf=0, neginf=0)
            elif width == 1:
                x = (raw[:, 0].astype(np.float64) - 128) / 128
            else:
                wide = np.zeros((len(raw), 4), np.uint8)
                wide[:, 4 - width :] = raw
                x = wide.view("<i4")[:, 0] / 2.0**31
            return x.reshape(-1, channels).mean(axis=1), rate
        at += 8 + size + (size & 1)
    return None


def write_wav(samples: np.ndarray, rate: int) -> bytes:
    pcm = np.clip(np.rint(samples * 32767), -32768, 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(pcm)) + pcm


@lru_cache(4)
def _branches(up: int, down: int) -> tuple[np.ndarray, int]:
    """The filter's taps by phase, (up, taps), and how many input samples lie before the middle."""
    wide = max(up, down)
    half = TAPS * wide // 2 if up >= down else -(-TAPS * wide // (2 * up)) * up
    n = np.arange(-half, half + 1)
    h = np.sinc(n / wide) * np.kaiser(2 * half + 1, BETA) * up / wide
    taps = -(-(2 * half + 1) // up)
    h = np.append(h, np.zeros(taps * up - h.size)).reshape(taps, up).T
    h = h / h.sum(axis=1, keepdims=True)  # a constant stays one in every phase
    return h, half


def resample(x: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Polyphase: only the taps that meet an input sample, only at the output's places."""
    g = gcd(rate, to)
    up, down = to // g, rate // g
    if up == down or not x.size:
        return x
    h, half = _branches(up, down)
    taps = h.shape[1]
    size = -(-x.size * up // down)
    ahead = ((size - 1) * down + half) // up + 1 - x.size
    padded = np.concatenate([np.zeros(taps - 1), x, np.zeros(max(0, ahead))])
    near = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(size)
    for p in range(min(up, size)):  # outputs p, p + up, ... have one phase and lie down samples apart
        last, phase = divmod(p * down + half, up)
        rows, branch = near[last::down], h[phase, ::-1]
        n = -(-(size - p) // up)
        for i in range(0, n, 1 << 16):
            j = min(n, i + (1 << 16))
            out[p + i * up : p + (j - 1) * up + 1 : up] = rows[i:j] @ branch
    return out


@lru_cache(4)
def mel_bank(mels: int = MELS) -> np.ndarray:
    """Triangles in the mel scale, (FFT / 2 + 1, mels)."""
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edge = 700 * (10 ** (np.linspace(to_mel(20), to_mel(RATE / 2), mels + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1)[:, None] * RATE / FFT
    return np.maximum(0, np.minimum((f - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - f) / (edge[2:] - edge[1:-1])))


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, MELS) of natural logs and each frame's level in decibels."""
    if x.size < WINDOW:
        return np.zeros((0, MELS), np.float32), np.zeros(0)
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    bank, shape = mel_bank(), np.hanning(WINDOW + 1)[:-1]
    out, level = np.empty((len(frames), MELS), np.float32), np.empty(len(frames))
    for i in range(0, len(frames), 4096):
        part = frames[i : i + 4096]
        power = np.abs(np.fft.rfft(part * shape, FFT)) ** 2
        out[i : i + 4096] = np.log(np.maximum(power @ bank, FLOOR))
        level[i : i + 4096] = 10 * np.log10(np.maximum((part**2).mean(axis=1), FLOOR))
    return out, level


def speech(level: np.ndarray) -> list[tuple[int, int]]:
    """Segments of frames by hysteresis, (first, end)."""
    if not level.size:
        return []
    floor = min(float(np.percentile(level, 10)), CEILING)
    loud, quiet = level > floor + ON, level < floor + OFF
    out, i = [], 0
    starts = np.flatnonzero(loud)
    while True:
        k = np.searchsorted(starts, i)
        if k == starts.size:
            return out
        first = int(starts[k])
        run = 0
        j = first + 1
        while j < level.size and run < HANG:
            run = run + 1 if quiet[j] else 0
            j += 1
        end = j - run
        out.append((first, end))
        i = j


def features(data: bytes | None) -> Iterator[tuple[int, int, float, float, float, float, np.ndarray]]:
    got = read_wav(data)
    if got is None:
        return
    mel, level = log_mel(resample(*got))
    at, wide = HOP / RATE, WINDOW / RATE
    for s, (first, end) in enumerate(speech(level)):
        span = (first * at, (end - 1) * at + wide)
        for c, i in enumerate(range(first, max(first + 1, end - FRAMES // 2), FRAMES // 2)):
            j = min(i + FRAMES, end)
            tensor = np.full((FRAMES, MELS), np.log(FLOOR), np.float32)
            tensor[: j - i] = mel[i:j]
            yield s, c, i * at, (j - 1) * at + wide, *span, tensor


def audio_features(df: DataFrame, audio: str = "audio") -> DataFrame:
    """The other columns of ``df`` with one row for each tensor of the WAV column ``audio``."""
    clash = {c.lower() for c in df.columns if c != audio} & set(COLUMNS.names)
    if clash:
        raise ValueError(f"there are columns {sorted(clash)} already")
    prepare(df.sparkSession)
    others = [c for c in df.columns if c != audio]
    inner = T.StructType([*[T.StructField(f"c{i}", df.schema[c].dataType, True) for i, c in enumerate(others)], *COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[int] = []
            cells: list[tuple] = []
            for i, data in enumerate(b.column(0)):
                for x in features(data.as_py()):
                    rows.append(i)
                    cells.append(x)
                if cells and (len(cells) >= 512 or i == b.num_rows - 1):
                    yield _batch(b, rows, cells, inner)
                    rows, cells = [], []
            if cells:
                yield _batch(b, rows, cells, inner)

    plain = df.select(col(audio).alias("audio"), *[col(c).alias(f"c{i}") for i, c in enumerate(others)])
    return plain.mapInArrow(run, inner).toDF(*others, *COLUMNS.names)


def _batch(b: pa.RecordBatch, rows: list[int], cells: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    own = [c.take(pa.array(rows, pa.int64())) for c in b.columns[1:]]
    *plain, tensors = zip(*cells)
    n = FRAMES * MELS
    arrays = [pa.array(plain[0], pa.int32()), pa.array(plain[1], pa.int32()), *[pa.array(x, pa.float64()) for x in plain[2:]]]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32) * n), pa.array(np.concatenate([t.ravel() for t in tensors])))
    return pa.RecordBatch.from_arrays([*own, *arrays, lists], schema.names)


def tensor_type() -> pa.ExtensionType:
    return pa.fixed_shape_tensor(pa.float32(), [FRAMES, MELS], dim_names=["frame", "mel"])


def packed(rows: list[tuple]) -> bytes:
    """An Arrow IPC stream of a recording's tensors (the extension type) with their places and spans."""
    *plain, tensors = zip(*rows)
    kinds = [pa.int32(), pa.int32(), *[pa.float64()] * 4]
    flat = pa.array(np.concatenate([t.ravel() for t in tensors]))
    arrays = [*[pa.array(x, k) for x, k in zip(plain, kinds)], pa.ExtensionArray.from_storage(tensor_type(), pa.FixedSizeListArray.from_arrays(flat, FRAMES * MELS))]
    batch, sink = pa.RecordBatch.from_arrays(arrays, COLUMNS.names), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def stream_of(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def read_tensors(data: bytes) -> np.ndarray:
    """The tensors of one stream, (tensors, FRAMES, MELS)."""
    return stream_of(data).column("log_mel").combine_chunks().to_numpy_ndarray()


def audio_tensors(df: DataFrame, audio: str = "audio", out: str = "tensors", count: str = "n_tensors") -> DataFrame:
    """``df`` with its WAV column ``audio`` replaced by ``count`` and ``out``: the recording's tensors as an Arrow IPC stream, NULL where there are none."""
    clash = {c.lower() for c in df.columns if c != audio} & {out.lower(), count.lower()}
    if clash:
        raise ValueError(f"there are columns {sorted(clash)} already; name others")
    prepare(df.sparkSession)

    @F.pandas_udf("n int, x binary")
    def pack(s: pd.Series) -> pd.DataFrame:
        n, x = [], []
        for data in s:  # one recording's features at a time
            rows = list(features(data))
            n.append(len(rows))
            x.append(packed(rows) if rows else None)
        return pd.DataFrame({"n": np.array(n, np.int32), "x": x})

    (at,) = fresh(df, "packed")
    return df.withColumn(at, pack(col(audio))).select(*[col(c) for c in df.columns if c != audio], F.col(at)["n"].alias(count), F.col(at)["x"].alias(out))


def unpack(df: DataFrame, tensors: str = "tensors") -> DataFrame:
    """A row for each tensor of what ``audio_tensors`` made, as ``audio_features`` gives it."""
    prepare(df.sparkSession)
    others = [c for c in df.columns if c != tensors]
    inner = T.StructType([*[T.StructField(f"c{i}", df.schema[c].dataType, True) for i, c in enumerate(others)], *COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data in enumerate(b.column(0)):
                if data.is_valid:
                    t = stream_of(data.as_py()).combine_chunks()
                    own = [c.take(pa.array([i] * t.num_rows, pa.int64())) for c in b.columns[1:]]
                    x = t.column("log_mel").chunk(0).storage
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(t.num_rows + 1, dtype=np.int32) * FRAMES * MELS), x.flatten())
                    yield pa.RecordBatch.from_arrays([*own, *[t.column(n).chunk(0) for n in COLUMNS.names[:-1]], lists], inner.names)

    plain = df.select(col(tensors).alias("x"), *[col(c).alias(f"c{i}") for i, c in enumerate(others)])
    return plain.mapInArrow(run, inner).toDF(*others, *COLUMNS.names)


VOICE_RATE = 8_000


def voiced(text: str | None) -> bytes | None:
    """A stand-in for recorded speech, as the tables have none: each letter half a millisecond of a
    tone of its own, a blank silence of as long, the end of a sentence 60 ms of silence."""
    if text is None:
        return None
    code = np.frombuffer(text.encode(), np.uint8)
    ends = np.isin(code, np.frombuffer(b".!?\n", np.uint8))
    size = np.where(ends, VOICE_RATE * 60 // 1000, 4)
    own = np.repeat(np.arange(code.size), size)
    tone = 200 + 25.0 * (code % 96)
    sound = np.sin(2 * np.pi * np.cumsum(tone[own] / VOICE_RATE)) * np.where((code <= 32) | ends, 0, 0.5)[own]
    return write_wav(sound, VOICE_RATE)

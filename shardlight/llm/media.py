"""Media columns: WAV bytes to spectral-peak fingerprints, kept as time-coded arrays.

A WAV value is read with the ``wave`` module and its channels are averaged. The short-time Fourier transform uses a Hann
window of ``FRAME`` samples every ``HOP``. A peak is a cell of the spectrogram that is the largest within
``NEAR_T`` frames and ``NEAR_F`` bins and stands ``FLOOR`` times above the mean of its frame. Every peak is paired with all
peaks in its target zone, 1 to ``ZONE_T`` frames later and within ``ZONE_F`` bins; a pair's code holds the first
bin, the second bin and the frames between, so it doesn't depend on where in the recording it lies. Codes and their times
are two arrays of equal length, ordered by time.

Long recordings are transformed block by block, with the frames around, so beside the file's own bytes and its codes nothing grows with its length.

Defined cases: a null value gives null arrays and the error ``null``; bytes that aren't a PCM WAV give null arrays
and the error ``unreadable``; the rate is what the header says, up to 2**32 - 1; a recording shorter than a frame, or silent, gives empty arrays; rows are handled one by
one, so repeated rows or null ids change nothing; other columns aren't read; an empty table gives none.

The tables have no recordings, so ``tones`` makes one from each embedding, as a stand-in for a column of files.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, only

FRAME, HOP = 256, 128
NEAR_T, NEAR_F, FLOOR = 3, 4, 4.0
ZONE_T, ZONE_F = 16, 32
BLOCK = 4096


class Recording:
    """Samples between -1 and 1, averaged over channels, made from the file's bytes for the stretch that is asked for."""

    def __init__(self, raw: bytes):
        with wave.open(io.BytesIO(raw)) as w:
            self.width, self.channels, self.rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
            self.data = w.readframes(w.getnframes())
        self.size = len(self.data) // (self.width * self.channels)

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, span: slice) -> np.ndarray:
        a, z, _ = span.indices(self.size)
        frame = self.width * self.channels
        data = self.data[a * frame : z * frame]
        if self.width == 1:
            x = np.frombuffer(data, np.uint8).astype(np.float64) / 128 - 1
        elif self.width == 3:
            b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
            x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 2.0**23
        else:
            x = np.frombuffer(data, f"<i{self.width}") / 2.0 ** (8 * self.width - 1)
        return x.reshape(-1, self.channels).mean(1)


def read_wav(raw: bytes) -> tuple[np.ndarray, int, int]:
    """All samples, with rate and channels."""
    own = Recording(raw)
    return own[:], own.rate, own.channels


def spectrogram(x: np.ndarray) -> np.ndarray:
    """Magnitudes, frames by bins."""
    if len(x) < FRAME:
        return np.zeros((0, FRAME // 2 + 1))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    return np.abs(np.fft.rfft(frames * np.hanning(FRAME)))


def _widest(a: np.ndarray, near: int, axis: int) -> np.ndarray:
    """The maximum within ``near`` cells to both sides along an axis."""
    a = np.moveaxis(a, axis, 0)
    out = a.copy()
    for d in range(1, min(near, len(a) - 1) + 1):
        np.maximum(out[d:], a[:-d], out=out[d:])
        np.maximum(out[:-d], a[d:], out=out[:-d])
    return np.moveaxis(out, 0, axis)


def peaks(x: np.ndarray | Recording) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the peaks, by frame and bin."""
    total = max(0, (len(x) - FRAME) // HOP + 1)
    times, bins = [], []
    for start in range(0, total, BLOCK):
        lo, hi = max(0, start - NEAR_T), min(total, start + BLOCK + NEAR_T)
        s = spectrogram(x[lo * HOP : (hi - 1) * HOP + FRAME])
        top = (s == _widest(_widest(s, NEAR_T, 0), NEAR_F, 1)) & (s > FLOOR * s.mean(1, keepdims=True)) & (s > 1e-6)
        t, f = np.nonzero(top)
        own = (t + lo >= start) & (t + lo < start + BLOCK)
        times.append(t[own] + lo)
        bins.append(f[own])
    return (np.concatenate(times), np.concatenate(bins)) if times else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def pairs(t: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame of the first peak and code of every pair in a target zone."""
    lo, hi = np.searchsorted(t, t, "right"), np.searchsorted(t, t + ZONE_T, "right")
    n = hi - lo
    first = np.repeat(np.arange(len(t)), n)
    second = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    ok = np.abs(f[first] - f[second]) <= ZONE_F
    first, second = first[ok], second[ok]
    return t[first], f[first] << 20 | f[second] << 8 | (t[second] - t[first])


def fingerprint(raw: bytes | None) -> tuple:
    """(sample_rate, channels, samples, peaks, time_ms, code, error)."""
    if raw is None:
        return None, None, None, None, None, None, "null"
    try:
        x = Recording(raw)
    except (wave.Error, EOFError, ValueError, TypeError, ZeroDivisionError):
        return None, None, None, None, None, None, "unreadable"
    t, f = peaks(x)
    at, code = pairs(t, f)
    return x.rate, x.channels, len(x), len(t), at * HOP * 1000 // max(1, x.rate), code, None


_FIELDS = (("sample_rate", pa.int64()), ("channels", pa.int32()), ("samples", pa.int64()), ("peaks", pa.int32()), ("time_ms", pa.list_(pa.int64())), ("code", pa.list_(pa.int64())), ("error", pa.string()))


def fingerprints(rows: DataFrame, id_column: str = "vec_id", wav_column: str = "wav") -> DataFrame:
    """(id, sample_rate, channels, samples, peaks, time_ms, code, error) of each row."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                c = b.slice(i, 512)
                got = zip(*(fingerprint(x.as_py()) for x in c.column("wav")), strict=True)
                yield pa.RecordBatch.from_arrays([c.column("id"), *(pa.array(v, t) for v, (_, t) in zip(got, _FIELDS, strict=True))], [id_column, *(n for n, _ in _FIELDS)])

    own = only(rows, id_column, wav_column).toDF("id", "wav").select(F.col("id").cast("long"), "wav")
    return own.mapInArrow(run, f"`{id_column}` long, sample_rate long, channels int, samples long, peaks int, time_ms array<long>, code array<long>, error string")


def write_wav(x: np.ndarray, rate: int = 8000) -> bytes:
    """Mono, 16 bits."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 2, rate, 0, "NONE", ""))
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def tones(vectors: np.ndarray, rate: int = 8000, step: int = 512) -> np.ndarray:
    """A recording for each vector: steps of eight tones, whose loudness is the vector's values."""
    n = vectors.shape[1]
    t = np.arange(step) / rate
    basis = np.zeros((n, -(-n // 8) * step))
    for d in range(n):
        basis[d, d // 8 * step : (d // 8 + 1) * step] = np.sin(2 * np.pi * (300 + 420 * (d % 8) + 7 * (d // 8)) * t) * np.hanning(step)
    x = np.abs(vectors) @ basis
    return x / np.maximum(1e-9, np.abs(x).max(1, keepdims=True)) * 0.9


def with_tones(vectors: DataFrame) -> DataFrame:
    """(vec_id, wav) from (vec_id, embedding); a null embedding, or one with nulls, gives a null."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                c = b.slice(i, 512)
                rows = [None if v is None or not v or any(x is None for x in v) else v for v in c.column("embedding").to_pylist()]
                wavs: list[bytes | None] = [None] * len(rows)
                for size in {len(v) for v in rows if v}:
                    at = [k for k, v in enumerate(rows) if v and len(v) == size]
                    for k, x in zip(at, tones(np.nan_to_num(np.array([rows[k] for k in at]))), strict=True):
                        wavs[k] = write_wav(x)
                yield pa.RecordBatch.from_arrays([c.column("vec_id"), pa.array(wavs, pa.binary())], ["vec_id", "wav"])

    return only(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, wav binary")

"""WAV files as tables of pitch frames, onsets and energies.

Signals never become rows: a task reads a file, reduces it to frames and emits those.  The
estimators are plain and work on a few hundred frames at a time, whatever the length of a file:
median filters for the harmonic part, YIN with parabolic interpolation and a two-state Viterbi
path for pitch, spectral flux for onsets, root mean square for energy.
"""

from __future__ import annotations

import io
import time
import wave
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.sources.files import peak_mb

#: Frames that are worked on at a time; rows that are emitted at a time.
CHUNK, ROWS = 256, 8192


@dataclass(frozen=True)
class Signal:
    """Settings of the analysis: samples a second, samples from frame to frame and in a frame,
    lowest and highest pitch in Hz, how far an onset stands out, what is done to the signal first."""

    rate: int = 22050
    hop: int = 512
    frame: int = 2048
    low: float = 32.7  # C1
    high: float = 4186.0  # C8
    delta: float = 0.1
    normalise: bool = True  # peak 1, and ends that are quieter by trim_db cut off
    trim_db: float = 20.0
    harmonic: bool = True  # pitch from the harmonic part only


#: What the reference values of a plain transcription are made with.
PLAIN = Signal(low=65.4, high=2093.0, delta=0.07, normalise=False, harmonic=False)

SIGNALS = (
    "path string, kind string, frame_idx long, time double, f0_hz double, confidence double, energy double, length double, offset double,"
    " seconds double, peak_mb double, error string")
_NAMES = [x.split()[0] for x in SIGNALS.split(", ")]


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """PCM of 8, 16, 24 or 32 bits as mono floats, and its rate."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 3:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8, len(wide) * 3).reshape(-1, 3)
        y, full = wide.view("<i4").ravel(), 1 << 31
    elif width in (1, 2, 4):
        y, full = np.frombuffer(raw, {1: "u1", 2: "<i2", 4: "<i4"}[width]), 1 << 8 * width - 1
    else:
        raise ValueError(f"samples of {width} bytes are not supported")
    y = y.astype(np.float32)
    y = (y - 128) / 128 if width == 1 else y / full
    return y[: len(y) // channels * channels].reshape(-1, channels).mean(axis=1, dtype=np.float32), rate


def resample(y: np.ndarray, rate: int, wanted: int) -> np.ndarray:
    """Linear interpolation, after a windowed sinc has taken away what the new rate can't hold."""
    if rate == wanted or not len(y):
        return y
    if rate > wanted:
        half = 16 * rate // wanted
        t = np.arange(-half, half + 1)
        kernel = np.sinc(t * wanted / rate) * np.hanning(len(t) + 2)[1:-1]
        y = np.convolve(y, (kernel / kernel.sum()).astype(np.float32), "full")[half : half + len(y)]
    return np.interp(np.arange(int(len(y) * wanted / rate)) * rate / wanted, np.arange(len(y)), y).astype(np.float32)


def load_wav(data: bytes, s: Signal = Signal()) -> tuple[np.ndarray, float]:
    """A file's signal at s.rate, and the seconds cut off before it."""
    y = resample(*decode_wav(data), s.rate)
    if s.normalise and len(y) and (peak := np.abs(y).max()) > 0:
        y = y / peak
        level = energies(y, s)
        loud = np.flatnonzero(level >= level.max() * 10 ** (-s.trim_db / 20))
        return y[loud[0] * s.hop : min(len(y), (loud[-1] + 1) * s.hop)], loud[0] * s.hop / s.rate
    return y, 0.0


def _frames(y: np.ndarray, s: Signal, halo: int = 0) -> Iterator[tuple[int, int, np.ndarray]]:
    """Frames of a signal, some at a time: the number of the first, how many of those given stand
    before it (up to halo, and as many after), and the frames."""
    count = 1 + len(y) // s.hop
    view = np.lib.stride_tricks.sliding_window_view(np.pad(y, (s.frame // 2, 2 * s.frame)), s.frame)[: count * s.hop : s.hop]
    for first in range(0, count, CHUNK):
        begin = max(0, first - halo)
        yield first, first - begin, view[begin : first + CHUNK + halo]


def energies(y: np.ndarray, s: Signal = Signal()) -> np.ndarray:
    return np.concatenate([np.sqrt((f.astype(np.float64) ** 2).mean(axis=1)) for _, _, f in _frames(y, s)])


def harmonic(y: np.ndarray, s: Signal = Signal(), margin: float = 3.0, width: int = 31) -> np.ndarray:
    """The part of a signal that lasts: bins whose median over time outweighs that over pitch."""
    window = np.hanning(s.frame + 1)[:-1].astype(np.float32)
    out, weight = np.zeros(len(y) + 3 * s.frame, np.float32), np.full(len(y) + 3 * s.frame, 1e-6, np.float32)
    half = width // 2
    medians = lambda x, axis: np.median(np.lib.stride_tricks.sliding_window_view(x, width, axis=axis), axis=-1)
    for first, before, frames in _frames(y, s, half):
        spectrum = np.fft.rfft(frames * window).astype(np.complex64)
        size = np.abs(spectrum)
        n = min(CHUNK, len(frames) - before)
        after = len(frames) - before - n
        lasting = medians(np.pad(size, ((half - before, half - after), (0, 0)), mode="edge"), 0)
        own = size[before : before + n]
        sudden = margin * medians(np.pad(own, ((0, 0), (half, half)), mode="edge"), 1)
        mask = lasting**2 / (lasting**2 + sudden**2 + 1e-12)
        for i, x in enumerate(np.fft.irfft(spectrum[before : before + n] * mask, s.frame).astype(np.float32) * window):
            at = (first + i) * s.hop
            out[at : at + s.frame] += x
            weight[at : at + s.frame] += window**2
    return (out / weight)[s.frame // 2 : s.frame // 2 + len(y)]


def _yin(frames: np.ndarray, s: Signal) -> tuple[np.ndarray, np.ndarray]:
    """Pitch and aperiodicity of frames by the normalised difference; 1 where there is no sound."""
    frames = frames.astype(np.float64)
    longest, shortest = min(int(s.rate / s.low), s.frame // 2), max(2, int(s.rate / s.high))
    half = s.frame - longest
    spectrum = np.fft.rfft(frames, 2 * s.frame)
    own = np.fft.irfft(spectrum * np.conj(np.fft.rfft(frames[:, :half], 2 * s.frame)))[:, :longest]
    power = np.cumsum(np.pad(frames**2, ((0, 0), (1, 0))), axis=1)
    lags = np.arange(longest)
    difference = power[:, half : half + 1] + power[:, lags + half] - power[:, lags] - 2 * own
    total = np.cumsum(difference, axis=1)
    shape = np.ones_like(difference)
    shape[:, 1:] = difference[:, 1:] * lags[1:] / np.maximum(total[:, 1:], 1e-12)
    f0, rough = np.full(len(frames), np.nan), np.ones(len(frames))
    for i in np.flatnonzero(frames.std(axis=1) >= 1e-4).tolist():
        d = shape[i]
        low_enough = np.flatnonzero(d[shortest:-1] < 0.15)
        lag = shortest + (low_enough[0] if len(low_enough) else int(np.argmin(d[shortest:-1])))
        while lag + 1 < longest - 1 and d[lag + 1] < d[lag]:
            lag += 1
        a, b, c = d[lag - 1], d[lag], d[lag + 1]
        shift = 0.5 * (a - c) / (a - 2 * b + c) if a - 2 * b + c > 0 else 0.0
        f0[i], rough[i] = s.rate / (lag + shift), min(1.0, b)
    return f0, rough


def voicing(confidence: np.ndarray, stay: float = 0.99) -> np.ndarray:
    """Which frames are voiced: the likeliest path through two states that rarely change."""
    c = np.clip(confidence, 0.01, 0.99)
    gain = np.log(c / (1 - c)) + np.log(1.5)  # a confidence of 0.4 is as likely voiced as not
    switch, score, back = np.log(stay / (1 - stay)), 0.0, np.zeros((len(c), 2), bool)
    for i, g in enumerate(gain.tolist()):  # score: of the voiced state over the other
        back[i] = score > switch, score > -switch  # where each state comes from
        score = min(max(score, -switch), switch) + g
    out, state = np.zeros(len(c), bool), int(score > 0)
    for i in range(len(c) - 1, -1, -1):
        out[i] = state
        state = int(back[i, state])
    return out


def pitches(y: np.ndarray, s: Signal = Signal()) -> tuple[np.ndarray, np.ndarray]:
    """Pitch in Hz (NaN: unvoiced) and confidence of each frame."""
    found = [_yin(f, s) for _, _, f in _frames(y, s)]
    f0, confidence = np.concatenate([f for f, _ in found]), 1 - np.concatenate([r for _, r in found])
    return np.where(voicing(confidence), f0, np.nan), confidence


def onset_times(y: np.ndarray, s: Signal = Signal()) -> np.ndarray:
    """Peaks of spectral flux that stand out by delta, moved back to the rise that leads there."""
    window, rises = np.hanning(s.frame), []
    for first, before, frames in _frames(y, s, 1):
        magnitude = np.log1p(np.abs(np.fft.rfft(frames[: before + CHUNK] * window)))
        rises.append(np.maximum(0, np.diff(magnitude, axis=0)).sum(axis=1))
    flux = np.concatenate(rises)
    if not len(flux) or flux.max() <= 0:
        return np.array([])
    flux = flux / flux.max()
    found = []
    for i in range(len(flux)):
        near = flux[max(0, i - 3) : i + 4]
        if flux[i] == near.max() and flux[i] >= flux[max(0, i - 20) : i + 20].mean() + s.delta and (not found or i - found[-1] > 3):
            found.append(i)
    back = []
    for i in found:
        while i > 0 and flux[i - 1] < flux[i]:
            i -= 1
        back.append(i)
    return (np.array(sorted(set(back))) + 1) * s.hop / s.rate


def _rows(path: str, kind: str, n: int, **columns) -> Iterator[pd.DataFrame]:
    frame = pd.DataFrame({"path": path, "kind": kind, **columns}, index=range(n)).reindex(columns=_NAMES)
    floats = {c: float for c in ("time", "f0_hz", "confidence", "energy", "length", "offset", "seconds", "peak_mb")}
    frame = frame.astype(floats | {"frame_idx": "Int64", "error": object})
    for i in range(0, n, ROWS):
        yield frame.iloc[i : i + ROWS]


def _signals(s: Signal):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                begun = time.perf_counter()
                if not path.lower().endswith(".wav"):
                    yield from _rows(path, "error", 1, error=f"format not decoded: {path.rpartition('.')[2].lower()}")
                    continue
                try:
                    y, offset = load_wav(bytes(content), s)
                    none = np.array([])
                    f0, confidence = pitches(harmonic(y, s) if s.harmonic else y, s) if len(y) else (none, none)
                    energy, onsets = (energies(y, s), onset_times(y, s)) if len(y) else (none, none)
                except (ValueError, EOFError, wave.Error) as e:
                    yield from _rows(path, "error", 1, error=str(e) or "damaged file")
                    continue
                n, length = len(f0), len(y) / s.rate
                yield from _rows(path, "frame", n, frame_idx=np.arange(n), time=np.arange(n) * s.hop / s.rate, f0_hz=f0, confidence=confidence, energy=energy)
                yield from _rows(path, "onset", len(onsets), frame_idx=np.arange(len(onsets)), time=onsets)
                yield from _rows(path, "file", 1, length=length, offset=offset, seconds=time.perf_counter() - begun, peak_mb=peak_mb())

    return run


def read_signals(files: DataFrame, settings: Signal = Signal()) -> DataFrame:
    """Binary files (path, content) -> rows of kind frame, onset, file or error; see SIGNALS.

    A frame without a pitch has f0_hz NaN.  Onsets have their time only.  Times count from offset
    seconds into the file, where its quiet beginning ends; length is that of what is left.  A
    file that is not WAV, or damaged, is one row with its error.
    """
    rows = files.select("path", "content").mapInPandas(_signals(settings), SIGNALS)
    return rows.withColumn("f0_hz", F.when(F.col("kind") == "frame", F.coalesce("f0_hz", F.lit(float("nan")))))


def tables(signals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """frames, onsets and energies of signals; a track is a hash of its path."""
    track = F.xxhash64("path").alias("track_id")
    frame = signals.filter("kind = 'frame'")
    return (
        frame.select(track, "frame_idx", "time", "f0_hz", "confidence"),
        signals.filter("kind = 'onset'").select(track, F.col("time").alias("onset_time")),
        frame.select(track, "frame_idx", "energy"),
    )


def _lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for content in batch["content"]:
            try:
                with wave.open(io.BytesIO(bytes(content))) as w:
                    found.append(w.getnframes() / w.getframerate())
            except (EOFError, wave.Error, ZeroDivisionError):
                found.append(None)
        yield pd.DataFrame({"path": batch["path"], "audio_length": pd.array(found, "Float64")})


def lengths(files: DataFrame) -> DataFrame:
    """Binary files (path, content) -> path, audio_length in seconds; null if it can't be read."""
    return files.select("path", "content").mapInPandas(_lengths, "path string, audio_length double")

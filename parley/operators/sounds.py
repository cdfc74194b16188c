"""Sound samples: silence cut away, speech kept, and features of frames: level, crossings and cepstra."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parley.operators.audio import peak_normalise

# --- fixed values: frames, silence in decibels below the loudest frame, least share of speech, mel bands and cepstra ---
FRAME, HOP = 2048, 512
TRIM_DB, SPEECH_DB, LEAST_SPEECH = 35.0, 30.0, 0.3
MELS, CEPSTRA, FLOOR, RANGE_DB = 128, 13, 1e-10, 80.0
#: Frames that are held at once.
BLOCK = 1024


def _frames(y: np.ndarray, mode: str) -> Iterator[np.ndarray]:
    """Blocks of frames centred on every ``HOP``-th sample; beyond the ends zeros, or the end's value ('edge')."""
    padded = np.pad(y, FRAME // 2, mode=mode)
    every = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    for lo in range(0, len(every), BLOCK):
        yield every[lo : lo + BLOCK]


def level(y: np.ndarray) -> np.ndarray:
    """Root mean square of each frame."""
    return np.concatenate([np.sqrt((f * f).mean(axis=1)) for f in _frames(y, "constant")])


def crossings(y: np.ndarray) -> np.ndarray:
    """Share of each frame's samples whose sign isn't that of the one before; next to nothing counts as positive."""
    def rate(f: np.ndarray) -> np.ndarray:
        sign = np.where(np.abs(f) <= FLOOR, 0.0, f) < 0
        return (sign[:, 1:] != sign[:, :-1]).sum(axis=1) / FRAME

    return np.concatenate([rate(f) for f in _frames(y, "edge")])


def loud(y: np.ndarray, decibels: float) -> np.ndarray:
    """Which frames are no further than this below the loudest."""
    power = np.maximum(level(y) ** 2, FLOOR)
    return 10 * np.log10(power) - 10 * np.log10(power.max()) > -decibels


def trim(y: np.ndarray, decibels: float = TRIM_DB) -> np.ndarray:
    """Without the silence at both ends; all of it if nothing else is there."""
    if not len(y):
        return y
    at = np.flatnonzero(loud(y, decibels))
    return y[at[0] * HOP : min((at[-1] + 1) * HOP, len(y))] if len(at) and at[0] * HOP < len(y) else y


def keep_speech(y: np.ndarray, decibels: float = SPEECH_DB) -> np.ndarray:
    """The runs of loud frames one after the other; the whole if they are less than ``LEAST_SPEECH`` of it."""
    if not len(y):
        return y
    inside = np.concatenate([[False], loud(y, decibels), [False]])
    edges = np.minimum(np.flatnonzero(inside[1:] != inside[:-1]) * HOP, len(y))
    kept = np.concatenate([y[:0], *(y[a:b] for a, b in zip(edges[::2], edges[1::2]))])
    return kept if len(kept) >= LEAST_SPEECH * len(y) and len(kept) else y


def _mel(hertz: np.ndarray) -> np.ndarray:
    """Linear below 1000 Hz, logarithmic above."""
    step = np.log(6.4) / 27
    return np.where(hertz < 1000, hertz * 3 / 200, 15 + np.log(np.maximum(hertz, 1000) / 1000) / step)


def _hertz(mel: np.ndarray) -> np.ndarray:
    step = np.log(6.4) / 27
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp(step * (mel - 15)))


@lru_cache(maxsize=8)
def mel_filters(rate: int) -> np.ndarray:
    """Triangles over the frequencies of a frame, of equal area, evenly spaced in mel."""
    at = np.linspace(0, rate / 2, FRAME // 2 + 1)
    edge = _hertz(np.linspace(_mel(np.array(0.0)), _mel(np.array(rate / 2)), MELS + 2))
    rise = (at - edge[:-2, None]) / np.diff(edge)[:-1, None]
    fall = (edge[2:, None] - at) / np.diff(edge)[1:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (edge[2:] - edge[:-2]))[:, None]


def cepstra(y: np.ndarray, rate: int) -> np.ndarray:
    """The first ``CEPSTRA`` cosines of each frame's mel levels in decibels, at most ``RANGE_DB`` below the sound's highest."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)
    power = np.concatenate([(np.abs(np.fft.rfft(f * window, axis=1)) ** 2) @ mel_filters(rate).T for f in _frames(y, "constant")])
    decibels = 10 * np.log10(np.maximum(power, FLOOR))
    decibels = np.maximum(decibels, decibels.max() - RANGE_DB)
    k = np.arange(CEPSTRA)[:, None]
    basis = np.cos(np.pi * k * (2 * np.arange(MELS) + 1) / (2 * MELS)) * np.sqrt(np.where(k == 0, 1, 2) / MELS)
    return decibels @ basis.T


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, int]]:
    for batch in batches:
        for k in range(batch.num_rows):
            values = batch.column(1)[k].values
            y = np.zeros(0) if values is None else np.nan_to_num(values.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False), nan=0.0, posinf=0.0, neginf=0.0)
            yield batch.column(0).slice(k, 1), y, batch.column(2)[k].as_py() or 0


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, y, rate in _each(batches):
        if len(y) and rate > 0:
            r, z, c = level(y), crossings(y), cepstra(y, rate)
            row = [r.tolist(), z.tolist(), c.mean(axis=0).tolist(), c.std(axis=0).tolist(), float((r < np.percentile(r, 20)).mean()), len(y) / rate]
        else:
            row = [[], [], [], [], 0.0, 0.0]
        yield pa.RecordBatch.from_arrays([key, *(pa.array([v]) if not isinstance(v, list) else pa.array([v], pa.list_(pa.float64())) for v in row)], names=["id", "rms", "zcr", "mfcc_mean", "mfcc_std", "silence_ratio", "duration_seconds"])


def features(sounds: DataFrame, key: str, samples: str, rate: str) -> DataFrame:
    """id, rms and zcr (a number a frame), mfcc_mean and mfcc_std (13 numbers), silence_ratio and duration_seconds of every sound.

    ``samples``: numbers from -1 to 1; ``rate``: samples a second. A sound
    without samples or rate has empty lists; samples that are null or no finite
    numbers are 0. Frames are taken in blocks, so long sounds need little more memory than their samples.
    """
    kind = sounds.schema[key].dataType.simpleString()
    schema = f"id {kind}, rms array<double>, zcr array<double>, mfcc_mean array<double>, mfcc_std array<double>, silence_ratio double, duration_seconds double"
    return sounds.select(key, samples, rate).mapInArrow(_features, schema)


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, y, rate in _each(batches):
        yield pa.RecordBatch.from_arrays([key, pa.array([keep_speech(trim(y)).tolist()], pa.list_(pa.float64())), pa.array([rate], pa.int32())], names=["id", "samples", "rate"])


def prepared(sounds: DataFrame, key: str, samples: str, rate: str) -> DataFrame:
    """id, samples and rate of every sound without silence at its ends and between speech, its peak at -1 decibel."""
    kind = sounds.schema[key].dataType.simpleString()
    cut = sounds.select(key, samples, rate).mapInArrow(_prepare, f"id {kind}, samples array<double>, rate int")
    return cut.select("id", peak_normalise(cut["samples"]).alias("samples"), "rate")

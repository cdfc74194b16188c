"""Sound features against plain sums."""

import math

import numpy as np
from pyspark.sql import functions as F

from parley.operators import sounds as S

RATE = 8000


def tone(seconds, hertz, loudness, seed=0):
    n = int(RATE * seconds)
    return loudness * np.sin(2 * np.pi * hertz * np.arange(n) / RATE) + np.random.default_rng(seed).normal(size=n) * loudness * 0.05


def test_frames_against_plain_sums():
    y = tone(0.4, 440, 0.3)
    r, z = S.level(y), S.crossings(y)
    assert len(r) == len(z) == 1 + len(y) // S.HOP
    for k in (0, 3, len(r) - 1):
        at = range(k * S.HOP - S.FRAME // 2, k * S.HOP + S.FRAME // 2)
        assert math.isclose(r[k], math.sqrt(sum(y[i] ** 2 for i in at if 0 <= i < len(y)) / S.FRAME))
        held = [y[min(max(i, 0), len(y) - 1)] for i in at]
        assert math.isclose(z[k], sum((a < 0) != (b < 0) for a, b in zip(held, held[1:])) / S.FRAME)


def test_cepstra_against_a_plain_transform():
    y = tone(0.15, 900, 0.2)
    got = S.cepstra(y, RATE)
    frames = []
    for k in range(1 + len(y) // S.HOP):
        frame = [(y[i] if 0 <= i < len(y) else 0.0) * (0.5 - 0.5 * math.cos(2 * math.pi * j / S.FRAME)) for j, i in enumerate(range(k * S.HOP - S.FRAME // 2, k * S.HOP + S.FRAME // 2))]
        turn = np.exp(-2j * np.pi * np.outer(np.arange(S.FRAME // 2 + 1), np.arange(S.FRAME)) / S.FRAME)
        frames.append(np.abs(turn @ np.array(frame)) ** 2)
    step = math.log(6.4) / 27
    mel = lambda f: f * 3 / 200 if f < 1000 else 15 + math.log(f / 1000) / step
    hertz = lambda m: m * 200 / 3 if m < 15 else 1000 * math.exp(step * (m - 15))
    edges = [hertz(mel(RATE / 2) * i / (S.MELS + 1)) for i in range(S.MELS + 2)]
    bins = [i * RATE / S.FRAME for i in range(S.FRAME // 2 + 1)]
    weight = np.array([[max(0.0, min((f - a) / (b - a), (c - f) / (c - b))) * 2 / (c - a) for f in bins] for a, b, c in zip(edges, edges[1:], edges[2:])])
    decibels = 10 * np.log10(np.maximum(np.array(frames) @ weight.T, 1e-10))
    decibels = np.maximum(decibels, decibels.max() - 80)
    want = [[sum(x * math.cos(math.pi * k * (2 * m + 1) / (2 * S.MELS)) for m, x in enumerate(row)) * math.sqrt((1 if k == 0 else 2) / S.MELS) for k in range(S.CEPSTRA)] for row in decibels]
    assert np.allclose(got, want, atol=1e-6)


def test_silence_goes_unless_little_is_left():
    loud, quiet = tone(1.0, 300, 0.5), tone(1.0, 300, 0.0001)
    whole = np.concatenate([quiet, loud, quiet, loud, quiet])
    cut = S.trim(whole)
    assert len(loud) * 3 <= len(cut) <= len(loud) * 3 + 3 * S.FRAME
    kept = S.keep_speech(cut)
    assert 2 * len(loud) <= len(kept) <= 2 * len(loud) + 5 * S.FRAME
    rare = np.concatenate([quiet] * 9 + [loud])
    assert S.keep_speech(rare) is rare
    assert len(S.trim(np.zeros(0))) == 0 and len(S.keep_speech(np.zeros(5000))) == len(S.trim(np.zeros(5000))) == 5000


def test_sounds_as_a_table(spark):
    rows = [(1, tone(0.3, 200, 0.4).tolist(), RATE), (2, None, RATE), (3, [], RATE), (4, [0.1, None, float("nan"), -0.2], RATE), (5, [0.1], None)]
    df = spark.createDataFrame(rows, "k long, y array<double>, r int")
    got = {r["id"]: r for r in S.features(df, "k", "y", "r").collect()}
    assert len(got[1]["mfcc_mean"]) == 13 and math.isclose(got[1]["duration_seconds"], 0.3) and np.allclose(got[1]["rms"], S.level(np.array(rows[0][1])))
    assert got[2]["rms"] == got[3]["rms"] == got[5]["rms"] == [] and got[4]["duration_seconds"] == 4 / RATE
    done = {r["id"]: r["samples"] for r in S.prepared(df, "k", "y", "r").collect()}
    assert math.isclose(max(map(abs, done[1])), 10 ** (-1 / 20)) and done[2] == done[3] == [] and len(done[4]) == 4
    assert S.features(df.limit(0), "k", "y", "r").count() == 0 and df.filter(F.col("k") > 5).count() == 0

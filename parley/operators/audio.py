"""Acoustic features and transcripts to delivery scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.operators.scoring import speaking_speed


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    """Null for an empty array."""
    return F.try_divide(_sum(a), F.size(a))


def deviation(a: Column) -> Column:
    """Population deviation; the mean is found once."""
    held = F.struct(a.alias("a"), mean(a).alias("m"))
    return F.transform(F.array(held), lambda s: F.sqrt(F.try_divide(F.aggregate(s["a"], F.lit(0.0), lambda t, x: t + (x - s["m"]) * (x - s["m"])), F.size(s["a"]))))[0]


def _steady(a: Column, factor: float, default: float) -> Column:
    score = 100 - deviation(a) / (mean(a) + 1e-6) * factor
    return F.when(F.size(a) > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).otherwise(default)


def confidence(f0: Column, rms: Column, transcript: Column) -> Column:
    """Steady pitch, level and steadiness of the voice (70 %), and the transcriber's confidence (30 %)."""
    voiced = F.filter(f0, lambda x: ~F.isnan(x))
    pitch = F.when(F.size(voiced) > 5, _steady(voiced, 200, 50.0)).otherwise(50.0)
    energy = F.when(F.size(rms) > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), mean(rms) / 0.15 * 80))).otherwise(50.0)
    return (pitch * 0.40 + energy * 0.35 + _steady(rms, 60, 50.0) * 0.25) * 0.70 + transcript * 0.30


def fluency(silence: Column, zcr: Column, fillers: Column, words: Column) -> Column:
    """Pauses, steady articulation and few fillers."""
    pause = F.when(silence < 0.10, 75.0).when(silence <= 0.30, 100.0).when(silence <= 0.50, F.greatest(F.lit(0.0), 100 - (silence - 0.30) * 200)).otherwise(10.0)
    filler = F.greatest(F.lit(0.0), 100 - fillers / F.greatest(words, F.lit(1)) * 100 * 15)
    return pause * 0.40 + _steady(zcr, 80, 60.0) * 0.25 + filler * 0.35


def feature_vector(wpm: Column, fluency_: Column, confidence_: Column, rms: Column, f0: Column, silence: Column, mfcc: Column) -> Column:
    """21 numbers: delivery, energy, pitch, silence and 13 cepstral means."""
    voiced = F.filter(f0, lambda x: ~F.isnan(x))
    base = [wpm, confidence_, fluency_, speaking_speed(wpm), mean(rms), F.coalesce(mean(voiced), F.lit(100.0)), F.coalesce(deviation(voiced), F.lit(0.0)), silence]
    return F.concat(F.array(*(c.cast("double") for c in base)), F.slice(mfcc, 1, 13))


def wpm_from_segments(words: Column, segments: Column) -> Column:
    """Words per minute up to the end of the last segment; 0 without segments."""
    return F.coalesce(F.try_divide(words, F.try_element_at(segments, F.lit(-1))["end"] / 60), F.lit(0.0))


def mean_log_probability(segments: Column) -> Column:
    """Of the segments that have one."""
    return mean(F.transform(F.filter(segments, lambda s: s["avg_logprob"].isNotNull()), lambda s: s["avg_logprob"]))


def performance_band(score: Column) -> Column:
    return F.when(score >= 80, "ADVANCED").when(score >= 55, "INTERMEDIATE").otherwise("BEGINNER")


def collapse_repeats(text: Column, threshold: int = 3) -> Column:
    """Of a run of equal words only the first ``threshold - 1`` stay."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def kept(ws: Column) -> Column:
        def stays(w: Column, i: Column) -> Column:
            again = i >= threshold - 1
            for k in range(1, threshold):
                again = again & (F.get(ws, i - k) == w)
            return ~again

        return F.filter(ws, stays)

    return F.array_join(F.transform(F.array(words), kept)[0], " ")


def punctuation(text: Column) -> Column:
    """No space before a mark, one after it, single spaces."""
    t = F.regexp_replace(F.regexp_replace(text, r"\s+([.,!?])", "$1"), r"([.,!?])(\S)", "$1 $2")
    return F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^ | $", "")


def windows(n_samples: Column, rate: int = 16_000, seconds: int = 30) -> Column:
    """(start, end) of consecutive windows over samples; none for no samples."""
    step = rate * seconds
    at = F.sequence(F.lit(0), F.greatest(n_samples - 1, F.lit(0)), F.lit(step))
    return F.when(n_samples > 0, F.transform(at, lambda s: F.struct(s.alias("start"), F.least(s + step, n_samples).alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def peak_normalise(samples: Column, decibels: float = -1.0) -> Column:
    """Samples with their peak at so many decibels; the peak is found once."""
    held = F.struct(samples.alias("y"), F.array_max(F.transform(samples, F.abs)).alias("top"))
    scaled = F.transform(F.array(held), lambda s: F.transform(s["y"], lambda x: x * (10 ** (decibels / 20)) / s["top"]))[0]
    return F.when(F.array_max(F.transform(samples, F.abs)) > 0, scaled).otherwise(samples)


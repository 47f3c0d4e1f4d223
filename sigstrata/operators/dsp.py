"""Frequency analysis and filters: what built-in expressions cannot say, in numpy over Arrow groups.

A spectrogram's windows are independent: stretches of records, each with the samples its windows reach, are
groups. Filters and the phase-following spectral analysis are recurrences: a lane's samples go in the order of frames
through an object that keeps the state, batch by batch, so that a task holds no more than a batch of a lane.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigstrata.operators.rollups import spectrogram_shift
from sigstrata.sources.signals import lanes, lengths

ANALYSIS_RATE = 22050.0
N = 1024
#: Four-term window, power code and K-weighting sections.
BH = (0.35875, 0.48829, 0.14128, 0.01168)
SHELF = (1681.974450955533, 3.999843853973347, 0.7071752369554196, 0.4996667741545416)
HIGH_PASS = (38.13547087602444, 0.5003270373238773)


def steps(step: float, n: int) -> np.ndarray:
    """0, step, step + step, ...: by repeated addition, as the format's phases are."""
    return np.concatenate([[0.0], np.cumsum(np.full(max(n - 1, 0), step))])[:n]


def window256(length: int = 256) -> np.ndarray:
    x = steps(0.0 if length == 1 else 2 * math.pi / (length - 1), length)
    raw = BH[0] - BH[1] * np.cos(x) + BH[2] * np.cos(x + x) - BH[3] * np.cos(3.0 * x)
    return raw.astype(np.float32) * np.float32(1.0 / np.cumsum(raw)[-1])


def power_codes(p: np.ndarray) -> np.ndarray:
    from sigstrata.functions.codes import POWER_BIAS, POWER_SCALE

    with np.errstate(divide="ignore", invalid="ignore"):
        raw = np.log(p) * POWER_SCALE + POWER_BIAS
    code = np.clip(np.nan_to_num(raw, nan=0.0, neginf=0.0, posinf=0.0), 0, 4095).astype(np.int64)
    return np.where(p >= 1, np.where(np.isfinite(p), 4095, 0), code)


def spectrogram_frames(x: np.ndarray, first: int, starts: np.ndarray) -> np.ndarray:
    """Codes (windows, 128); x holds the samples from frame `first` on, as float32; beyond them is silence."""
    full = window256()
    data = np.zeros((len(starts), 256))
    for i, s in enumerate(starts.tolist()):
        if s < 0:  # a shorter window over what there is
            part, w = x[: 256 + s], window256(256 + s)
        else:
            part, w = x[s - first : s - first + 256], full
        part = np.where(np.isfinite(part), part, 0).astype(np.float32)
        data[i, : len(part)] = part * w[: len(part)]
    spectrum = 2.0 * np.fft.rfft(data, axis=1)[:, 1:]
    return power_codes(spectrum.real**2 + spectrum.imag**2)


def scale_of(samples: DataFrame) -> float:
    """16-bit samples count as fractions of full scale."""
    return 1.0 / 32768.0 if dict(samples.dtypes)["v"] == "smallint" else 1.0


def lane_types(samples: DataFrame) -> str:
    return ", ".join(f"{c} {dict(samples.dtypes)[c]}" for c in lanes(samples))


def spectrogram_base(samples: DataFrame, division: int, stretch: int = 512) -> DataFrame:
    """(lane, record, bin, code) of all base windows. v is float, or 16-bit scaled by 1/32768."""
    shift, scale, keys = spectrogram_shift(division), scale_of(samples), lanes(samples)
    # the stretches whose windows may reach a frame; first and last differ by one at most
    lo = F.greatest(F.floor((F.floor((F.col("frame") - shift - 255) / division)) / stretch), F.lit(0))
    hi = F.greatest(F.floor(F.floor((F.col("frame") - shift) / division) / stretch), F.lit(0))
    dealt = samples.select(*keys, "frame", F.col("v").cast("float").alias("v"), F.explode(F.sequence(lo, hi)).alias("part"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        part, first, last = int(pdf["part"].iloc[0]), int(pdf["frame"].iloc[0]), int(pdf["frame"].iloc[-1])
        records = np.arange(part * stretch, (part + 1) * stretch)
        # a window must end within the track; a stretch has all frames that its windows reach, where there are any
        records = records[records * division + shift + 256 <= last + 1]
        codes = spectrogram_frames(pdf["v"].to_numpy(np.float32) * np.float32(scale), first, records * division + shift)
        r, b = np.divmod(np.arange(codes.size), 128)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "record": records[r], "bin": b, "code": codes.ravel()})

    return dealt.groupBy(*keys, "part").applyInPandas(run, f"{lane_types(samples)}, record long, bin int, code int")


def product(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Coefficients of the product of two polynomials, each summed from the first of p on: the order shows in the last digit."""
    out = []
    for n in range(len(p) + len(q) - 1):
        total = 0.0
        for i in range(max(0, n - len(q) + 1), min(n, len(p) - 1) + 1):
            total += float(p[i]) * float(q[n - i])
        out.append(total)
    return np.array(out)


def k_weighting(rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of the shelf and the high-pass as one fourth-order section."""
    if rate < 16:
        raise ValueError("sample rate is too low for loudness filtering")

    def section(frequency: float, q: float) -> tuple[float, float, np.ndarray]:
        k = math.tan(math.pi * frequency / rate)
        a0 = 1 + k / q + k * k
        return k, a0, np.array([1.0, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])

    frequency, gain, q, power = SHELF
    k, a0, shelf = section(frequency, q)
    vh = 10 ** (gain / 20)
    vb = vh**power
    num = np.array([(vh + vb * k / q + k * k) / a0, 2 * (k * k - vh) / a0, (vh - vb * k / q + k * k) / a0])
    return product(num, np.array([1.0, -2.0, 1.0])), product(shelf, section(*HIGH_PASS)[2])


def k_filter_from(x: np.ndarray, rate: int, state: tuple[float, float, float, float]) -> tuple[np.ndarray, tuple[float, float, float, float]]:
    """The filtered samples and the state after them."""
    b, a = (c.tolist() for c in k_weighting(rate))
    b0, b1, b2, b3, b4 = b
    _, a1, a2, a3, a4 = a
    s1, s2, s3, s4 = state
    out = np.empty(len(x))
    for i, v in enumerate(x.tolist()):
        v = v - a1 * s1 - a2 * s2 - a3 * s3 - a4 * s4  # in this order: long tails show the last digit
        out[i] = b0 * v + b1 * s1 + b2 * s2 + b3 * s3 + b4 * s4
        s4, s3, s2, s1 = s3, s2, s1, v
    return out, (s1, s2, s3, s4)


def k_filter(x: np.ndarray, rate: int) -> np.ndarray:
    return k_filter_from(x, rate, (0.0, 0.0, 0.0, 0.0))[0]


class KFilter:
    """The K-weighting of a lane whose samples come in pieces."""

    def __init__(self, rate: int):
        self.rate, self.state = rate, (0.0, 0.0, 0.0, 0.0)

    def push(self, x: np.ndarray) -> np.ndarray:
        y, self.state = k_filter_from(x, self.rate, self.state)
        return y.reshape(-1, 1)


def through(samples: DataFrame, start: Callable[[], object], columns: str, number: str = "record") -> DataFrame:
    """(lane, number, columns): what an object's push gives for a lane's samples, in the order of frames, numbered from 0.

    start() makes the object of a lane; its push takes a piece of samples and gives rows of numbers (or a tuple of
    columns). Lanes are dealt to tasks and their rows sorted, which spills; a task holds one batch and one state.
    """
    keys, scale = lanes(samples), scale_of(samples)
    names = [c.split()[0] for c in columns.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    kinds = [types[c.split()[1]] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, meter, done = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lane = [batch.column(i).dictionary_encode() for i in range(len(keys))]
            ids = np.stack([x.indices.to_numpy() for x in lane])
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(ids, axis=1) != 0).any(axis=0)) + 1, [batch.num_rows]])
            v = batch.column(len(keys)).to_numpy(zero_copy_only=False).astype(np.float64) * scale
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                key = tuple(batch.column(i)[a].as_py() for i in range(len(keys)))
                if key != now:
                    now, meter, done = key, start(), 0
                made = meter.push(v[a:b])
                made = np.stack(made, axis=1) if isinstance(made, tuple) else made
                if not len(made):
                    continue
                ahead = [pa.array([k] * len(made), type=batch.schema.field(i).type) for i, k in enumerate(now)]
                body = [pa.array(np.ascontiguousarray(made[:, i])).cast(t, safe=False) for i, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*ahead, pa.array(np.arange(done, done + len(made))), *body], names=[*keys, number, *names])
                done += len(made)

    dealt = samples.select(*keys, F.col("v").cast("double").alias("v"), "frame").repartition(*keys).sortWithinPartitions(*keys, "frame")
    return dealt.drop("frame").mapInArrow(run, f"{lane_types(samples)}, {number} long, {columns}")


def k_weighted(samples: DataFrame, rate: int) -> DataFrame:
    """(lane, frame, v double): each lane filtered in the order of its frames, which count from 0."""
    return through(samples, lambda: KFilter(rate), "v double", "frame")


def loudness(samples: DataFrame, rate: int) -> DataFrame:
    """(lane, block, momentary, short_term) after each whole block, in the format's order of operations."""
    return through(samples, lambda: LoudnessMeter(rate), "momentary double, short_term double", "block")


class LowPass:
    """The biquad before a reduction of the rate; without one it passes samples on."""

    def __init__(self, ratio: float):
        self.on = ratio > 1
        self.state = (0.0, 0.0, 0.0, 0.0)
        if self.on:
            at = 1.0 / ratio * float(np.float32(0.693)) * math.pi
            alpha = math.sin(at) / (2 * float(np.float32(0.707)))
            sc = 1 / (1 + alpha)
            b1 = (1 - math.cos(at)) * sc
            self.taps = b1 * 0.5, b1, -2 * math.cos(at) * sc, (1 - alpha) * sc

    def push(self, x: np.ndarray) -> np.ndarray:
        if not self.on:
            return x
        (b0, b1, a1, a2), (x1, x2, y1, y2) = self.taps, self.state
        out = np.empty(len(x))
        for i, v in enumerate(x.tolist()):
            y = v * b0 + x1 * b1 + x2 * b0 - y1 * a1 - y2 * a2
            x2, x1, y2, y1 = x1, v, y1, y
            out[i] = y
        self.state = x1, x2, y1, y2
        return out


def hann(n: int) -> np.ndarray:
    half = n // 2
    table = (0.5 - 0.5 * np.cos(steps(2 * math.pi / (n - 1), half + 1))).astype(np.float32)
    i = np.arange(n)
    return table[np.where(i <= half, i, n - i)]


class SpectralAnalyzer:
    """Spectral records of a channel whose samples come in pieces; any cutting gives the same records."""

    def __init__(self, rate: int, division: int):
        self.ratio, self.hop = rate / ANALYSIS_RATE, division * ANALYSIS_RATE / rate
        rounded = math.floor(self.hop + 0.5)
        self.span = max(rounded, N)
        self.phase = (rounded - N) * 0.5 if rounded <= N - 1 else 0.0
        self.window = hann(self.span)
        self.ring = np.zeros(self.span, np.float32)
        self.before = np.zeros(N // 2 + 1, np.complex64)
        self.elapsed = 0
        self.low_pass = LowPass(self.ratio)
        self.rest, self.first, self.at = np.zeros(0), 0, 0.0  # source samples still needed, index of the first, position

    def resampled(self, x: np.ndarray) -> np.ndarray:
        x = self.low_pass.push(x)
        if self.ratio == 1:
            return x
        x = np.concatenate([self.rest, x])
        end = self.first + len(x)
        p = np.cumsum(np.concatenate([[self.at], np.full(max(int((end - self.at) / self.ratio), 0) + 2, self.ratio)]))
        i = p.astype(np.int64)
        n = int(np.searchsorted(i, end - 1))
        f, j = p[:n] - i[:n], i[:n] - self.first
        y = x[j] * (1 - f) + x[j + 1] * f if n else np.zeros(0)
        self.at = float(p[n])
        drop = min(max(int(self.at) - self.first, 0), len(x))
        self.rest, self.first = x[drop:], self.first + drop
        return y

    def stops(self, n: int, limit: int | None = None) -> list[tuple[int, int]]:
        """(samples taken, samples since the record before) of each record that n more samples complete.

        The phase grows by repeated addition, as the format's does; a record's stretch of it is one running sum.
        """
        out: list[tuple[int, int]] = []
        at = 0
        while at < n and (limit is None or len(out) < limit):
            left = min(n - at, max(int(self.hop - self.phase), 0) + 2)
            phases = np.cumsum(np.concatenate([[self.phase], np.ones(left)]))[1:]
            hit = int(np.searchsorted(phases, self.hop))
            taken = min(hit + 1, left)
            at, self.elapsed, self.phase = at + taken, self.elapsed + taken, float(phases[taken - 1])
            while self.phase >= self.hop and (limit is None or len(out) < limit):
                out.append((at, self.elapsed))
                self.elapsed = 0
                self.phase -= self.hop
        return out

    def push(self, x: np.ndarray, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(frequency_hz, density) of the records that x completes."""
        y = self.resampled(np.asarray(x, dtype=np.float64)).astype(np.float32)
        held = np.concatenate([self.ring, y])
        out = [self._record(held[j : j + self.span], elapsed) for j, elapsed in self.stops(len(y), limit)]
        self.ring = held[len(held) - self.span :]
        made = np.array(out, dtype=np.int64).reshape(-1, 2)
        return made[:, 0], made[:, 1]

    def _record(self, part: np.ndarray, elapsed: int) -> tuple[int, int]:
        product = (part * self.window).astype(np.float64)
        folded = np.zeros(N)
        for s in range(0, self.span, N):
            piece = product[s : s + N]
            folded[: len(piece)] += piece
        spec = np.fft.rfft(folded)
        mags = np.abs(spec)
        total = float(np.cumsum(mags)[-1])
        last, self.before = self.before, spec.astype(np.complex64)
        if not total > 0:
            return 0, 0
        top = 1 + int(mags[1:-1].argmax())
        if mags[top] <= mags[-1]:
            top = N // 2
        best = float(N // 2)
        if top != N // 2 and elapsed:
            old = complex(last[top])
            turn = (math.atan2(spec[top].imag, spec[top].real) - math.atan2(old.imag, old.real)) / math.pi - 2.0 * (elapsed / N) * top
            turn = math.fmod(turn, 2.0)
            turn += 2.0 if turn <= -1 else -2.0 if turn > 1 else 0.0
            best = top + N / 2 / elapsed * turn
        spread = float((mags.astype(np.float32).astype(np.float64) * (np.arange(N // 2 + 1) - best) ** 2).sum())
        frequency = min(max(math.trunc(0.5 + best * ANALYSIS_RATE / N), 0), 32767)
        return frequency, min(max(math.trunc(0.5 + 16383.0 * (1 - 4 * spread / (total * 262144.0))), 0), 16383)


def spectral_peaks(x: np.ndarray, rate: int, division: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(frequency_hz, density) of a whole channel; limit caps the number of records (the source-length rule)."""
    return SpectralAnalyzer(rate, division).push(x, limit)


def analysis_count(frames: int, rate: int, division: int) -> int:
    """Records of `frames` frames of the resampled signal, by the scheduler alone."""
    if min(frames, rate, division) < 1:
        return 0
    return len(SpectralAnalyzer(rate, division).stops(frames))


class LoudnessMeter:
    """Momentary and short-term energy after each whole block of a lane whose samples come in pieces.

    Energies are summed in the order of samples; a window's sum takes the new block in and the oldest out, in this order.
    """

    def __init__(self, rate: int):
        self.rate, self.size = rate, max(1, rate // 40)
        self.state, self.rest = (0.0, 0.0, 0.0, 0.0), np.zeros(0)
        self.rings = [[0.0] * 16, [0.0] * 120]
        self.sums, self.blocks = [0.0, 0.0], 0
        self.spans = 2 * rate // 5, 3 * rate

    def push(self, x: np.ndarray) -> np.ndarray:
        """(blocks, 2)."""
        y, self.state = k_filter_from(np.asarray(x, dtype=np.float64), self.rate, self.state)
        y = np.concatenate([self.rest, y])
        n = len(y) // self.size
        self.rest = y[n * self.size :]
        energies = np.cumsum(y[: n * self.size].reshape(n, self.size) ** 2, axis=1)[:, -1].tolist() if n else []
        out = []
        for e in energies:
            for k, ring in enumerate(self.rings):
                i = self.blocks % len(ring)
                self.sums[k] = self.sums[k] + e - ring[i]
                ring[i] = e
            self.blocks += 1
            out.append([s / span for s, span in zip(self.sums, self.spans, strict=True)])
        return np.array(out).reshape(-1, 2)


def spectral_fine(samples: DataFrame, rate: int, division: int, rule: str = "analysis", frames: DataFrame | None = None) -> DataFrame:
    """(lane, record, frequency_hz, density). rule: "analysis" counts records of the resampled signal, "source" caps
    them at (frames - 1024) / division; signals of at most 22,050 Hz give zero records by rule "analysis".

    frames: the lengths of the tracks, where they are known.
    """
    frames = lengths(samples) if frames is None and (rule == "source" or rate <= ANALYSIS_RATE) else frames
    keys = [c for c in lanes(samples) if c != "channel"]
    if rule == "analysis" and rate <= ANALYSIS_RATE:
        count = F.when(F.col("frames") > 512, F.floor((F.col("frames") - 512 + division // 2) / division)).otherwise(0)
        some = frames.withColumn("n", count).where("n > 0 and channels > 0")
        each = some.withColumn("channel", F.explode(F.sequence(F.lit(0), F.col("channels") - 1)))
        zero = F.lit(0)
        return each.select(*keys, F.col("channel").cast("int").alias("channel"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("record"), zero.alias("frequency_hz"), zero.alias("density"))
    made = through(samples, lambda: SpectralAnalyzer(rate, division), "frequency_hz int, density int")
    if rule != "source":
        return made
    most = F.floor(F.greatest(F.col("frames") - N, F.lit(0)) / division)
    if keys:
        return made.join(frames.select("track_id", "frames"), "track_id").where(F.col("record") < most).drop("frames")
    only = frames.first()["frames"]
    return made.where(F.col("record") < max(only - N, 0) // division)

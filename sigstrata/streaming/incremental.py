"""Incremental levels: the finest extrema of a stream of samples, and loudness blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigstrata.operators import dsp, wave
from sigstrata.sources.signals import lanes


def streaming_extrema(samples: DataFrame, division: int) -> DataFrame:
    """(lane, peak, hi, lo), for writeStream in update mode: state is one pair a bucket. As in batch, NaN does not count."""
    return wave.extrema(samples, division)


def streaming_blocks(samples: DataFrame, rate: int) -> DataFrame:
    """(channel, block, energy, n): blocks of 25 ms; those with n below the block's size are not yet whole."""
    v = F.col("v").cast("double")
    return samples.groupBy(*lanes(samples), F.floor(F.col("frame") / max(1, rate // 40)).alias("block")).agg(F.sum(v * v).alias("energy"), F.count(F.lit(1)).alias("n"))


def _stateful(samples: DataFrame, start, columns: str) -> DataFrame:
    """Push each micro-batch of a channel, in the order of frames, through an object whose state is kept as bytes.

    start() makes the object; its push(samples) gives rows of numbers. Records are numbered from the first on.
    Samples must arrive in order from batch to batch, as from a recording.
    """
    import pickle

    import numpy as np
    import pandas as pd

    names, keys, scale = columns.split(", "), lanes(samples), dsp.scale_of(samples)

    def run(key, parts, state):
        meter, n = pickle.loads(state.get[0]) if state.exists else (start(), 0)
        pdf = pd.concat(list(parts)).sort_values("frame")
        made = meter.push(pdf["v"].to_numpy(np.float64) * scale)
        made = np.stack(made, axis=1) if isinstance(made, tuple) else made
        state.update((pickle.dumps((meter, n + len(made))),))
        out = pd.DataFrame({c.split()[0]: made[:, i] for i, c in enumerate(names)})
        ahead = {k: [v] * len(made) for k, v in zip(keys, key, strict=True)}
        yield pd.concat([pd.DataFrame({**ahead, "record": np.arange(n, n + len(made))}), out], axis=1)

    return samples.select(*keys, "frame", F.col("v").cast("double").alias("v")).groupBy(*keys).applyInPandasWithState(
        run, f"{dsp.lane_types(samples)}, record long, {columns}", "data binary", "append", "NoTimeout"
    )


def streaming_spectral(samples: DataFrame, rate: int, division: int) -> DataFrame:
    """(channel, record, frequency_hz, density), for writeStream in append mode."""
    return _stateful(samples, lambda: dsp.SpectralAnalyzer(rate, division), "frequency_hz int, density int")


def streaming_loudness(samples: DataFrame, rate: int) -> DataFrame:
    """(channel, record, momentary, short_term) after each whole block, for writeStream in append mode."""
    return _stateful(samples, lambda: dsp.LoudnessMeter(rate), "momentary double, short_term double")

"""Roll-ups of spectral, spectrogram and loudness records, and loudness windows by row position."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigstrata.sources.signals import extent, lanes

MOMENTARY, SHORT = 16, 120


def spectral_rollup(fine: DataFrame, ratio: int, count: int | None = None) -> DataFrame:
    """Groups of `ratio` whole records: floor mean of density, frequency of the first largest density * (32768 - frequency)."""
    score = F.col("density").cast("long") * (32768 - F.col("frequency_hz").cast("long"))
    g = fine.withColumn("score", score).groupBy(*lanes(fine), F.floor(F.col("record") / ratio).alias("record"))
    made = g.agg(
        F.count(F.lit(1)).alias("n"), F.sum("density").alias("total"), F.max("score").alias("best"),
        F.max_by("frequency_hz", F.struct(F.col("score"), -F.col("record"))).alias("f"),
    )
    whole = F.col("n") == ratio
    return made.where(whole if count is None else whole & (F.col("record") < count)).select(
        *lanes(fine), "record", F.when(F.col("best") == 0, 0).otherwise(F.col("f")).cast("int").alias("frequency_hz"),
        F.floor(F.col("total") / ratio).cast("int").alias("density"),
    )


def spectrogram_shift(division: int) -> int:
    """Offset of a window of 256 from its base frame; a negative half is cut toward zero."""
    return division - 256 if division >= 256 else math.trunc((division - 256) / 2)


def spectrogram_counts(frames: int, divisions: list[int]) -> list[int]:
    """Records of each stored level."""
    reach = spectrogram_shift(divisions[0]) + 256
    base = 0 if frames < reach else 1 + (frames - reach) // divisions[0]
    ratios = [b // a for a, b in zip(divisions, divisions[1:], strict=False)]
    out = [0 if base == 0 else 1 + (base - 1) // ratios[0]]
    for r in ratios[1:]:
        out.append(out[-1] // r)
    return out


def bin_rollup(bins: DataFrame, ratio: int, whole: bool) -> DataFrame:
    """(channel, record, bin, code): integer mean of groups; a partial group is dropped if `whole`, else divided by its size."""
    g = bins.groupBy(*lanes(bins), "bin", F.floor(F.col("record") / ratio).alias("record")).agg(F.sum("code").alias("s"), F.count(F.lit(1)).alias("n"))
    return (g.where(F.col("n") == ratio) if whole else g).select(*lanes(bins), "record", "bin", F.floor(F.col("s") / F.col("n")).cast("int").alias("code"))


def block_energy(samples: DataFrame, rate: int) -> DataFrame:
    """(lane, block, energy) of whole blocks of 25 ms, summed in any order; dsp.loudness sums in the order of frames."""
    size = max(1, rate // 40)
    v = F.col("v").cast("double")
    g = samples.groupBy(*lanes(samples), F.floor(F.col("frame") / size).alias("block")).agg(F.sum(v * v).alias("energy"), F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") == size).drop("n")


def sliding(blocks: DataFrame, rate: int, span: int = 1 << 16) -> DataFrame:
    """momentary and short_term over the last 16 and 120 blocks, by fixed divisors with a start of zeros.

    Blocks are dealt in stretches of `span` with the 119 blocks before each, so that a long lane is many tasks.
    """
    part = F.floor(F.col("block") / span)
    owner = F.explode(F.array_distinct(F.array(part, F.floor((F.col("block") + SHORT - 1) / span))))
    dealt = blocks.withColumn("part", owner)
    w = Window.partitionBy(*lanes(blocks), "part").orderBy("block")
    over = lambda n: F.sum("energy").over(w.rowsBetween(-(n - 1), 0))
    out = dealt.withColumn("momentary", over(MOMENTARY) / float(2 * rate // 5)).withColumn("short_term", over(SHORT) / float(3 * rate))
    return out.where(F.floor(F.col("block") / span) == F.col("part")).select(*lanes(blocks), "block", "momentary", "short_term")


def loudness_records(windows: DataFrame, frames: int | DataFrame, division: int, rate: int, channels: int = 1) -> DataFrame:
    """A record after every `division` frames and at the end: the state after the last block that was whole by then.

    frames: of the one track, or the lengths of many.
    """
    size = max(1, rate // 40)
    tracks = extent(windows.sparkSession, frames, channels).where("frames > 0 and channels > 0")
    keys = [c for c in tracks.columns if c == "track_id"]
    last = F.floor((F.col("frames") - 1) / division)
    grid = tracks.select(*keys, "frames", "channels", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("record"))
    at = F.least((F.col("record") + 1) * division, F.col("frames"))
    grid = grid.select(*keys, "record", (F.floor(at / size) - 1).alias("block"), F.explode(F.sequence(F.lit(0), F.col("channels") - 1)).alias("channel"))
    joined = grid.join(windows, [*keys, "channel", "block"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).cast("float").alias(c)
    return joined.select(*keys, "channel", "record", zero("momentary"), zero("short_term"))


def loudness_coarse(records: DataFrame, group: int) -> DataFrame:
    """Means in double precision of whole groups of records, summed in their order."""
    g = records.groupBy(*lanes(records), F.floor(F.col("record") / group).alias("of")).agg(F.sort_array(F.collect_list(F.struct("record", "momentary", "short_term"))).alias("rows"))
    mean = lambda c: (F.aggregate("rows", F.lit(0.0), lambda a, x: a + x[c].cast("double")) / float(group)).alias(c)
    return g.where(F.size("rows") == group).select(*lanes(records), F.col("of").alias("record"), mean("momentary"), mean("short_term"))

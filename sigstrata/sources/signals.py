"""Sample views: one row a sample, with explicit frames, of one track or (with a column track_id) of many.

Every operator groups by the lane of a sample: its channel, within its track where there are tracks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lanes(df: DataFrame) -> list[str]:
    """The columns that name a lane."""
    return [c for c in ("track_id", "channel") if c in df.columns]


def lengths(samples: DataFrame) -> DataFrame:
    """(track_id where there are tracks, frames, channels): the extent of each track."""
    keys = [c for c in lanes(samples) if c != "channel"]
    ends = (F.coalesce(F.max("frame") + 1, F.lit(0)).cast("long").alias("frames"), F.coalesce(F.max("channel") + 1, F.lit(0)).cast("int").alias("channels"))
    return samples.groupBy(*keys).agg(*ends) if keys else samples.agg(*ends)


def extent(spark: SparkSession, frames: int | DataFrame, channels: int = 1) -> DataFrame:
    """lengths() of one track of which they are known; a table of lengths stays as it is."""
    if isinstance(frames, DataFrame):
        return frames
    return spark.range(1).select(F.lit(frames).cast("long").alias("frames"), F.lit(channels).cast("int").alias("channels"))


def samples_of(blocks: DataFrame) -> DataFrame:
    """(track_id, channel, frame, v) of blocks (track_id, channel, start_frame, samples array)."""
    each = blocks.select("track_id", "channel", "start_frame", F.posexplode("samples").alias("pos", "v"))
    return each.select("track_id", "channel", (F.col("start_frame") + F.col("pos")).alias("frame"), "v")


def vector_samples(vectors: DataFrame, channels: int = 1) -> DataFrame:
    """(channel, frame, v float): vectors end to end, their components dealt to channels in turn."""
    each = vectors.select("vec_id", F.size("embedding").alias("n"), F.posexplode("embedding").alias("pos", "v"))
    frame = (F.col("vec_id") * F.col("n") + F.col("pos")) / channels
    return each.select((F.col("pos") % channels).cast("int").alias("channel"), F.floor(frame).alias("frame"), "v")


def event_samples(events: DataFrame) -> DataFrame:
    """(channel, frame, v short) from the value of each event, in the order of event_id."""
    v = F.pmod(F.floor(F.col("value") * 100), F.lit(65536)) - 32768
    return events.select(F.lit(0).alias("channel"), F.col("event_id").alias("frame"), v.cast("short").alias("v"))


def pcm24(b0, b1, b2):
    """Little-endian packed 24-bit sample to [-1, 1)."""
    raw = b0 + b1 * 256 + b2 * 65536
    return (F.when(raw >= 8388608, raw - 16777216).otherwise(raw) / 8388608.0).cast("float")


def pcm24_whole(value):
    """A 24-bit sample held in a wider whole number, to [-1, 1); values that need more bits are refused."""
    far = (value < -8388608) | (value > 8388607)
    return F.when(far, F.raise_error(F.concat(F.lit("sample needs more than 24 bits: "), value.cast("string"))).cast("float")).otherwise((value / 8388608.0).cast("float"))


#: Bytes of a sample of interleaved little-endian data.
WIDTHS = {"pcm16": 2, "pcm24": 3, "f32": 4}


def decoded(data: bytes, kind: str) -> np.ndarray:
    """Samples of little-endian data: 16-bit whole numbers as they are, the others as floats."""
    if kind not in WIDTHS:
        raise ValueError(f"a sample is one of {', '.join(WIDTHS)}")
    if len(data) % WIDTHS[kind]:
        raise ValueError("the data ends within a sample")
    if kind == "pcm24":
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        return (((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000).astype(np.float32) / np.float32(8388608)
    return np.frombuffer(data, "<i2" if kind == "pcm16" else "<f4")


def byte_blocks(files: DataFrame, kind: str, channels: int, block: int = 65536) -> DataFrame:
    """Blocks (track_id, channel, start_frame, samples) of interleaved bytes (track_id, content), each cut out and decoded alone."""
    step = block * channels * WIDTHS[kind]
    size = F.octet_length("content")
    whole = F.when(size % (channels * WIDTHS[kind]) != 0, F.raise_error(F.lit("the data ends within a frame")).cast("int")).otherwise(size)
    cuts = files.withColumn("size", whole).where("size > 0").select(
        "track_id", "content", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / step).cast("int"))).alias("i")
    )
    part = cuts.select("track_id", (F.col("i") * F.lit(block).cast("long")).alias("start_frame"), F.substring("content", F.col("i") * step + 1, F.lit(step)).alias("data"))

    def run(batches):
        for b in batches:
            for track, start, data in zip(b["track_id"], b["start_frame"], b["data"], strict=True):
                x = decoded(data, kind).reshape(-1, channels)
                yield pd.DataFrame({"track_id": [track] * channels, "channel": range(channels), "start_frame": [start] * channels, "samples": list(x.T.copy())})

    return part.mapInPandas(run, f"track_id string, channel int, start_frame long, samples array<{'smallint' if kind == 'pcm16' else 'float'}>")

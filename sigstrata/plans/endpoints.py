"""What a viewer asks of a cache, each as a DataFrame: levels, plans, records, tiles, windows and overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigstrata.functions import codes
from sigstrata.operators import render, wave, windows
from sigstrata.sources import cache


def meta(files: DataFrame) -> DataFrame:
    """Header and layers of each file."""
    head = files.select("track_id", *[c.alias(k) for k, c in cache.header(F.col("content")).items()])
    return head.join(cache.layer_index(files), "track_id")


def peaks(files: DataFrame, division: int) -> DataFrame:
    """(track_id, channel, peak, max_code, min_code) of a native wave level."""
    r = cache.read_records(files, ("wave",)).where(F.col("division") == division)
    code = lambda i: F.element_at("values", i).cast("smallint")
    return r.select("track_id", "channel", F.col("record").alias("peak"), code(1).alias("max_code"), code(2).alias("min_code"))


def plan(views: DataFrame, native: list[tuple[int, int]], frames: int, ratio: int = 4) -> DataFrame:
    """The level and the records of each view; native holds (division, count) of the wave levels."""
    return wave.plan_views(views, wave.pyramid(native, frames, ratio))


def records(files: DataFrame, kind: str, first: int, count: int) -> DataFrame:
    """Raw bytes of a range of records of each layer of a kind."""
    return cache.raw_range(files, kind, first, count)


def pcm_window(samples: DataFrame, first: int, count: int, division: int, channels: int, total_frames: int | None = None) -> DataFrame:
    return windows.display_window(samples, first, count, division, channels, total_frames)[0]


def wave_tile(files: DataFrame, division: int, tile_index: int) -> DataFrame:
    """Pixels of a tile of a native level, a row a channel."""
    return render.envelope_rows(wave.tile_page(peaks(files, division), tile_index))


def spectral_tile(files: DataFrame, desired: int, divisions: list[int], tile_index: int) -> DataFrame:
    """Pixels of a tile of the spectral level nearest to a division."""
    view = files.sparkSession.createDataFrame([(0, float(desired))], "view_id int, desired double")
    division = wave.nearest_division(view, divisions).first()["division"]
    r = cache.read_records(files, ("spectral",)).where((F.col("division") == division) & (F.floor(F.col("record") / wave.TILE) == tile_index))
    value = lambda i: F.element_at("values", i).cast("int")
    return render.spectral_rows(r.select("track_id", "channel", "record", value(1).alias("frequency_hz"), value(2).alias("density")))


def overview(files: DataFrame, division: int, start: int, end: int, width: int, height: int, channels: int) -> DataFrame:
    """Lit pixels of the waveform between two frames."""
    return render.raster(wave.overview(peaks(files, division), division, start, end, width), height, channels, decode=codes.from_unit_code)

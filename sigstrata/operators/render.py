"""Pixels and drawing geometry of summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigstrata.functions import codes
from sigstrata.operators.wave import TILE
from sigstrata.sources.signals import lanes


def _hex16(x: Column) -> Column:
    """Little-endian hex of a 16-bit number."""
    u = F.pmod(x.cast("int"), F.lit(65536))
    return F.lpad(F.hex((u % 256) * 256 + F.shiftright(u, 8)), 4, "0")


def envelope_rows(peaks: DataFrame) -> DataFrame:
    """(channel, tile, rgba binary): a row of at most TILE pixels, red and green the maximum, blue and alpha the minimum."""
    pixel = F.struct("peak", F.concat(_hex16(F.col("max_code")), _hex16(F.col("min_code"))).alias("p"))
    rows = peaks.groupBy(*lanes(peaks), F.floor(F.col("peak") / TILE).alias("tile")).agg(F.sort_array(F.collect_list(pixel)).alias("ps"))
    return rows.select(*[c for c in ("track_id", "channel") if c in rows.columns], "tile", F.unhex(F.array_join(F.transform("ps", lambda x: x["p"]), "")).alias("rgba"))


def spectral_rows(records: DataFrame) -> DataFrame:
    """(channel, tile, rgba binary): packed spectral codes as at most TILE pixels, little-endian."""
    code = codes.pack_spectral(F.col("frequency_hz"), F.col("density"))
    word = F.concat(_hex16(code % 65536), _hex16(F.floor(code / 65536)))
    rows = records.groupBy(*lanes(records), F.floor(F.col("record") / TILE).alias("tile")).agg(F.sort_array(F.collect_list(F.struct("record", word.alias("p")))).alias("ps"))
    return rows.select(*[c for c in ("track_id", "channel") if c in rows.columns], "tile", F.unhex(F.array_join(F.transform("ps", lambda x: x["p"]), "")).alias("rgba"))


def bin_tiles(bins: DataFrame, frames: int) -> DataFrame:
    """(tile, width, codes binary) of (channel, record, bin, code): tiles of `frames` records, little-endian by channel, bin and time."""
    cell = F.struct("channel", "bin", "record", _hex16(F.col("code")).alias("p"))
    tiles = bins.groupBy(F.floor(F.col("record") / frames).alias("tile")).agg(F.sort_array(F.collect_list(cell)).alias("ps"), (F.max("record") - F.min("record") + 1).alias("width"))
    return tiles.select("tile", "width", F.unhex(F.array_join(F.transform("ps", lambda x: x["p"]), "")).alias("codes"))


def raster(columns: DataFrame, height: int, channels: int, full_scale: float = 1.0, decode=codes.from_unit_code) -> DataFrame:
    """(x, y) of the lit pixels of a waveform, from extrema of pixel columns (channel, x, max_code, min_code)."""
    band = height / channels
    center, scale = (F.col("channel") + 0.5) * band, band * 0.47 / full_scale
    y = lambda c: F.round(center - decode(F.col(c)).cast("double") * scale).cast("int")
    clip = lambda v: F.greatest(F.least(v, F.lit(height - 1)), F.lit(0))
    a, b = y("max_code"), y("min_code")
    track = [c for c in lanes(columns) if c == "track_id"]
    return columns.select(*track, "x", F.explode(F.sequence(clip(F.least(a, b)), clip(F.greatest(a, b)))).alias("y")).distinct()


def draw_plans(windows: DataFrame, point_threshold: float = 3.0) -> DataFrame:
    """Geometry of a window of records in a view.

    windows: view_id, view_start, view_end (double), width, first_frame, division, record_count (long).
    A division of 1 means samples, which need one neighbour outside each edge.
    """
    w = windows.where("view_end > view_start and division > 0 and record_count > 0").selectExpr("*", "division = 1 as samples", "view_end - view_start as span")
    w = w.selectExpr("*", "(view_start - first_frame) / division as record0", "span / division as records_across", "greatest(width, 1) / span as pixels_per_frame")
    w = w.selectExpr("*", "if(samples, ceil(record0) - 1, floor(record0)) as a", "floor(record0 + records_across) + if(samples, 2, 1) as b")
    w = w.selectExpr("*", "greatest(0, least(record_count, a)) as v0").selectExpr("*", "greatest(v0, least(record_count, b)) as v1")
    return w.selectExpr(
        "view_id", "record0", "records_across", "pixels_per_frame", "cast(v0 as bigint) as first_visible", "cast(v1 - v0 as bigint) as visible",
        "(first_frame + v0 * division - view_start) * pixels_per_frame as x_origin", "pixels_per_frame * division as x_step",
        "samples and v1 - v0 >= 2 as draw_lines", f"samples and v1 > v0 and pixels_per_frame >= {point_threshold}D as draw_points",
    )

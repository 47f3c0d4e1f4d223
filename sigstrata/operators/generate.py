"""Whole caches from samples of one track or many: the layer set of a mode, built level by level, one binary a track."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigstrata.functions import codes
from sigstrata.operators import dsp, rollups, wave
from sigstrata.sources import cache
from sigstrata.sources.signals import extent, lanes, lengths

#: Kinds of layers of each mode, in file order.
MODES = {
    "waveform": ("wave",),
    "spectral": ("wave", "spectral", "loudness"),
    "spectrogram": ("wave", "spectral", "spectrogram", "loudness"),
}


def check_options(channels: int, rate: int, divisions: list[int], mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if not 1 <= channels <= 255 or rate < 1:
        raise ValueError("channels or rate out of range")
    if not divisions or any(not 1 <= d < 1 << 31 for d in divisions):
        raise ValueError("divisions are positive 32-bit integers, one at least")
    nested = all(b > a and b % a == 0 for a, b in zip(divisions, divisions[1:], strict=False))
    if mode != "waveform" and (len(divisions) < 2 or not nested):
        raise ValueError("layers beyond the waveform need two divisions or more, each a multiple of the one before")
    if len(divisions) * len(MODES[mode]) > 255:
        raise ValueError("too many layers")


def _layer(df: DataFrame, kind: str, order: int, division: int) -> DataFrame:
    return df.select(
        *[c for c in lanes(df) if c == "track_id"], F.lit(order).alias("layer_ord"), F.lit(kind).alias("kind"), F.lit(division).cast("long").alias("division"),
        F.col("record").cast("long").alias("record"), F.col("channel").cast("int").alias("channel"), "values",
    )


def _valued(df: DataFrame, values) -> DataFrame:
    return df.select(*lanes(df), "record", values.alias("values"))


def _doubles(*names: str):
    return F.array(*[F.col(n).cast("double") for n in names])


def wave_layers(samples: DataFrame, frames: int | DataFrame, divisions: list[int], code) -> list[DataFrame]:
    made = wave.levels(samples, divisions, frames, code).withColumnRenamed("peak", "record")
    return [_valued(made.where(F.col("division") == d), _doubles("max_code", "min_code")) for d in divisions]


def spectral_layers(samples: DataFrame, frames: DataFrame, divisions: list[int], rate: int, rule: str) -> list[DataFrame]:
    """Every level rolls up the finest one; rule "source" caps each by the frames of its track."""
    fine = dsp.spectral_fine(samples, rate, divisions[0], rule, frames)
    out = [fine]
    for d in divisions[1:]:
        made = rollups.spectral_rollup(fine, d // divisions[0])
        if rule == "source":
            most = F.floor(F.greatest(F.col("frames") - dsp.N, F.lit(0)) / d)
            if "track_id" in frames.columns:
                made = made.join(frames.select("track_id", "frames"), "track_id").where(F.col("record") < most).drop("frames")
            else:
                made = made.where(F.col("record") < max(frames.first()["frames"] - dsp.N, 0) // d)
        out.append(made)
    return [_valued(x, _doubles("frequency_hz", "density")) for x in out]


def spectrogram_layers(samples: DataFrame, divisions: list[int]) -> list[DataFrame]:
    """Each level rolls up the stored one before; only the first keeps a partial group."""
    now, out = dsp.spectrogram_base(samples, divisions[0]), []
    for i, (a, b) in enumerate(zip(divisions, divisions[1:], strict=False)):
        now = rollups.bin_rollup(now, b // a, i > 0)
        bins = F.sort_array(F.collect_list(F.struct("bin", "code")))  # 128 of each record
        out.append(now.groupBy(*lanes(now), "record").agg(F.transform(bins, lambda x: x["code"].cast("double")).alias("values")))
    return out


def loudness_layers(samples: DataFrame, frames: DataFrame, divisions: list[int], rate: int) -> list[DataFrame]:
    """Records of the second division, and means of whole groups of them for the coarser ones."""
    base = rollups.loudness_records(dsp.loudness(samples, rate), frames, divisions[1], rate)
    out = [base, *(rollups.loudness_coarse(base, d // divisions[1]) for d in divisions[2:])]
    stored = F.array(*[F.col(n).cast("float").cast("double") for n in ("momentary", "short_term")])
    return [_valued(x, stored) for x in out]


def cache_records(
    samples: DataFrame, rate: int, divisions: list[int], mode: str = "waveform", channels: int = 1, frames: int | DataFrame | None = None,
    wide: bool = False, rule: str = "analysis",
) -> DataFrame:
    """(track_id where there are tracks, layer_ord, kind, division, record, channel, values) of all layers of a mode.

    samples: (channel, frame, v) of one track of `channels` channels, or with track_id of many; v a 16-bit integer or a
    float. frames: of the one track, or the lengths of many, where they are known. division holds the type token of
    layers other than waves, as the file does. wide: the code with range beyond full scale, for floats.
    """
    check_options(channels, rate, divisions, mode)
    many = "track_id" in samples.columns
    if frames is None and not many:
        frames = samples.agg(F.coalesce(F.max("frame") + 1, F.lit(0))).first()[0]
    known = lengths(samples) if frames is None else extent(samples.sparkSession, frames, channels)
    if dict(samples.dtypes)["v"] == "smallint":
        code = lambda p: wave.coded(p, codes.peak16)
    else:
        code = wave.float_code(codes.wide_code if wide else codes.unit_code)
    make = {
        "wave": lambda: wave_layers(samples, known if many else frames, divisions, code),
        "spectral": lambda: spectral_layers(samples, known, divisions, rate, rule),
        "spectrogram": lambda: spectrogram_layers(samples, divisions),
        "loudness": lambda: loudness_layers(samples, known, divisions, rate),
    }
    out, order = None, 0
    for kind in MODES[mode]:
        for i, layer in enumerate(make[kind]()):
            named = _layer(layer, kind, order, divisions[i] if kind == "wave" else codes.TOKENS[kind])
            out, order = named if out is None else out.unionByName(named), order + 1
    return out


def layer_list(divisions: list[int], mode: str) -> list[tuple[str, int]]:
    """Kind and division of each layer of a mode, in file order; a layer without records is one too."""
    each = {"wave": divisions, "spectral": divisions, "spectrogram": divisions[1:], "loudness": divisions[1:]}
    return [(kind, d) for kind in MODES[mode] for d in each[kind]]


def _version(samples: DataFrame, wide: bool) -> str:
    return "wide" if wide and dict(samples.dtypes)["v"] != "smallint" else "unit"


def build_cache(
    samples: DataFrame, track_id: str, rate: int, divisions: list[int], mode: str = "waveform", channels: int = 1,
    frames: int | None = None, wide: bool = False, stamp: tuple[int, int] = (0, 0), rule: str = "analysis",
) -> DataFrame:
    """(track_id, content): the file of a track. Samples are spread over tasks; only its records meet, to be written."""
    records = cache_records(samples, rate, divisions, mode, channels, frames, wide, rule)
    return cache.encode_tracks(records.select(F.lit(track_id).alias("track_id"), "*"), _version(samples, wide), channels, rate, stamp, layer_list(divisions, mode))


def build_caches(
    samples: DataFrame, rate: int, divisions: list[int], mode: str = "waveform", wide: bool = False, stamps: DataFrame | None = None, rule: str = "analysis",
) -> DataFrame:
    """(track_id, content): the files of all tracks of samples (track_id, channel, frame, v) of one rate.

    stamps: (track_id, mtime_low32, size_low32) of the media; zeros where there is none. A track's channels are
    those it has samples of.
    """
    records = cache_records(samples, rate, divisions, mode, frames=lengths(samples), wide=wide, rule=rule)
    return cache.encode_tracks(records, _version(samples, wide), None, rate, stamps if stamps is not None else (0, 0), layer_list(divisions, mode))


def build_caches_of_waves(files: DataFrame, divisions_of, mode: str = "waveform", wide: bool = False, rule: str = "analysis") -> DataFrame:
    """(track_id, content): the caches of WAVE files (path, content, and for stamps modificationTime and length).

    divisions_of(rate) gives the divisions of a rate. Files are taken rate by rate: there are few rates.
    """
    from sigstrata.sources import wav
    from sigstrata.sources.signals import samples_of

    blocks = wav.wave_blocks(files)
    stamps = None
    if {"modificationTime", "length"} <= set(files.columns):
        stamps = files.select(F.col("path").alias("track_id"), codes.stamp32(F.unix_timestamp("modificationTime")).alias("mtime_low32"), codes.stamp32(F.col("length")).alias("size_low32"))
    out = None
    for (rate,) in sorted(tuple(r) for r in wav.wave_headers(files).select("rate").distinct().collect()):
        made = build_caches(samples_of(blocks.where(F.col("rate") == rate)), rate, divisions_of(rate), mode, wide, stamps, rule)
        out = made if out is None else out.unionByName(made)
    return out if out is not None else files.sparkSession.createDataFrame([], "track_id string, content binary")

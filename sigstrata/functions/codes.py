"""Scalar codes of the summary format as Catalyst expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format.
POWER_SCALE = 88.92179516969081
POWER_BIAS = 4095.5
KNEE = 24576
OCTAVE = 1024
U32 = 4294967296
TOKENS = {"spectral": -115, "spectrogram": -103, "loudness": -114, "legacy": -108}


def peak16(v: Column) -> Column:
    """16-bit extremum to code: negatives stay, others scale by 32767/32768 with half rounding."""
    x = v.cast("int")
    return F.when(x < 0, x).otherwise(((x * 32767 + 16384) / 32768).cast("int")).cast("short")


def _finite(v: Column) -> Column:
    return F.coalesce(v.cast("double"), F.lit(float("nan")))


def unit_code(v: Column) -> Column:
    """[-1, 1] float to code; NaN and null give 0."""
    x = F.least(F.greatest(_finite(v), F.lit(-1.0)), F.lit(1.0))
    up = F.floor(x * 32767.0 + 0.5)
    down = -F.floor(-x * 32768.0 + 0.5)
    return F.when(F.isnan(_finite(v)), 0).when(x >= 0, up).otherwise(down).cast("short")


def wide_code(v: Column) -> Column:
    """Float of any size to code: linear to 1, then 1024 steps an octave. NaN gives 0, infinities saturate."""
    x = _finite(v)
    a = F.abs(x)
    q = F.when(a <= 1.0, a * float(KNEE)).otherwise(float(KNEE) + float(OCTAVE) * F.log2(a))
    up = F.least(F.floor(q + 0.5), F.lit(32767))
    down = -F.least(F.greatest(F.ceil(q - 0.5), F.lit(0)), F.lit(32768))
    code = F.when(F.isnan(x) | (x == 0), 0).when(a == float("inf"), F.when(x > 0, 32767).otherwise(-32768))
    return code.when(x > 0, up).otherwise(down).cast("short")


def from_unit_code(c: Column) -> Column:
    x = c.cast("double")
    return F.when(c < 0, x / 32768.0).otherwise(x / 32767.0).cast("float")


def from_wide_code(c: Column) -> Column:
    m = F.abs(c.cast("int")).cast("double")
    size = F.when(m <= KNEE, m / KNEE).otherwise(F.pow(F.lit(2.0), (m - KNEE) / OCTAVE))
    return F.when(c < 0, -size).otherwise(size).cast("float")


def from_code(encoding: Column, c: Column) -> Column:
    """The value of a code by its encoding, "unit" or "wide"; null for another."""
    return F.when(encoding == "unit", from_unit_code(c)).when(encoding == "wide", from_wide_code(c))


def divisions(rate: Column, peaks_per_second: Column) -> Column:
    """array(fine, mid, coarse): the densest whole division, then nested ones of at most 20 and 1 records a second."""
    r = F.greatest(rate.cast("long"), F.lit(1))
    p = F.greatest(peaks_per_second.cast("long"), F.lit(1))
    up = lambda a, b: _div(a + b - 1, b)
    fine = F.greatest(_div(r, p), F.lit(1))
    mid = fine * F.greatest(up(r, fine * 20), F.lit(1))
    coarse = mid * F.greatest(up(r, mid), F.lit(1))
    top = F.lit(U32 - 1)
    return F.array(F.least(fine, top), F.least(mid, top), F.least(coarse, top))


def _div(a: Column, b: Column) -> Column:
    """Whole-number quotient of non-negative longs."""
    return F.floor((a - a % b) / b).cast("long")


def pack_spectral(frequency: Column, density: Column) -> Column:
    clip = lambda x, n: F.least(F.greatest(x, F.lit(0)), F.lit(n)).cast("long")
    return clip(frequency, 32767) + F.shiftleft(clip(density, 16383), 15)


def unpack_spectral(code: Column) -> tuple[Column, Column]:
    c = code.cast("long")
    return c.bitwiseAND(32767).cast("int"), F.shiftright(c, 15).bitwiseAND(16383).cast("int")


def power_code(p: Column) -> Column:
    raw = F.ln(p) * POWER_SCALE + POWER_BIAS
    return (
        F.when(p.isNull() | F.isnan(p) | (p <= 0) | (p == float("inf")), 0).when(p >= 1, 4095)
        .otherwise(F.greatest(raw, F.lit(0.0)).cast("int"))
    )


def code_to_db(c: Column, gain: float = 0.0) -> Column:
    return (c.cast("double") - POWER_BIAS) * (10.0 / (POWER_SCALE * 2.302585092994046)) + gain


def energy_to_lufs(e: Column) -> Column:
    return -0.691 + 10.0 * F.log10(F.greatest(e.cast("double"), F.lit(1e-20)))


def db_to_gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20.0)


def wrap_phase(x: Column) -> Column:
    """Into (-1, 1], in units of pi."""
    y = x % 2.0
    return F.when(y <= -1.0, y + 2.0).when(y > 1.0, y - 2.0).otherwise(y)


def stamp32(x: Column) -> Column:
    """Whole number modulo 2**32, as the format stores file times and sizes."""
    return F.pmod(x.cast("long"), F.lit(U32))


def u32_at(content: Column, offset: Column) -> Column:
    """Little-endian unsigned 32-bit number at a byte offset of a binary column."""
    byte = lambda i: F.conv(F.hex(F.substring(content, offset + 1 + i, F.lit(1))), 16, 10).cast("long")
    return byte(0) + byte(1) * 256 + byte(2) * 65536 + byte(3) * 16777216


def pack12(bins: Column) -> Column:
    """Hex of 12-bit pairs: high byte of the first, both low nibbles, high byte of the second. A code of more bits is refused."""
    far = F.exists(bins, lambda x: (x < 0) | (x > 4095))
    bins = F.when(far, F.raise_error(F.lit("a code has more than 12 bits")).cast("array<int>")).otherwise(bins)
    pair = lambda i: F.concat(
        F.lpad(F.hex(F.shiftright(F.element_at(bins, 2 * i + 1), 4)), 2, "0"),
        F.lpad(F.hex(F.element_at(bins, 2 * i + 1).bitwiseAND(15) * 16 + F.element_at(bins, 2 * i + 2).bitwiseAND(15)), 2, "0"),
        F.lpad(F.hex(F.shiftright(F.element_at(bins, 2 * i + 2), 4)), 2, "0"),
    )
    return F.array_join(F.transform(F.sequence(F.lit(0), (F.size(bins) / 2 - 1).cast("int")), pair), "")


def unpack12(text: Column) -> Column:
    """12-bit numbers of pack12's hex."""
    number = lambda t: F.conv(t, 16, 10).cast("int")
    group = lambda i: F.substring(text, i * 6 + 1, F.lit(6))
    pairs = F.transform(
        F.sequence(F.lit(0), (F.length(text) / 6 - 1).cast("int")),
        lambda i: F.array(
            number(F.concat(F.substring(group(i), 1, 2), F.substring(group(i), 3, 1))),
            number(F.concat(F.substring(group(i), 5, 2), F.substring(group(i), 4, 1))),
        ),
    )
    return F.flatten(pairs)


def bin_code(frame: Column, i: int) -> Column:
    """One 12-bit number of a packed binary frame."""
    byte = lambda k: F.conv(F.hex(F.substring(frame, i // 2 * 3 + k, 1)), 16, 10).cast("int")
    if i % 2 == 0:
        return byte(1) * 16 + F.shiftright(byte(2), 4)
    return byte(3) * 16 + byte(2).bitwiseAND(15)


#: Fixed values of the display: colours of silence and of loudness bands (threshold, red, green, blue).
NEUTRAL, FADED = (0.43, 0.92, 0.67), (0.58, 0.58, 0.58)
QUIET = (0.18, 0.48, 0.32)
BANDS = (
    (-42, 0.18, 0.72, 0.33), (-36, 0.47, 0.82, 0.24), (-30, 0.92, 0.86, 0.18), (-24, 1.00, 0.62, 0.10),
    (-18, 0.96, 0.24, 0.10), (-12, 0.88, 0.14, 0.34), (-6, 0.34, 0.42, 1.00),
)


def _clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo, F.least(hi, x))


def hue_rgb(hue: Column, saturation: float, value: float) -> Column:
    """array of red, green and blue of a hue in turns: each is value less saturation times a trapezoid of the hue."""
    def channel(shift: float) -> Column:
        k = F.pmod(F.lit(shift) + hue * 6.0, F.lit(6.0))
        return F.lit(value) - F.lit(value * saturation) * _clamp(F.least(k, 4.0 - k), F.lit(0.0), F.lit(1.0))

    return F.array(channel(5.0), channel(3.0), channel(1.0))


def spectral_color(code: Column, low: float = 20.0, high: float = 10000.0, nyquist: float = 24000.0, octaves: bool = False, reverse: bool = False, fade: bool = True) -> Column:
    """array of red, green and blue (0 to 1) of a packed spectral code: hue by log frequency, depth by tonality."""
    low = max(10.0, low)
    high = min(max(low + 1, high), max(low + 1, nyquist))
    frequency, density = unpack_spectral(code)
    octave = F.ln(_clamp(frequency.cast("double"), F.lit(low), F.lit(high)) / low)
    phase = F.pmod(octave / float(math.log(2)), F.lit(1.0)) if octaves else octave / max(1e-9, math.log(high / low))
    hue = hue_rgb((1.0 - phase if reverse else phase) * 0.78, 0.92, 1.0)
    depth = F.pow(density.cast("double") / 16383.0, F.lit(0.65))
    base = NEUTRAL if fade else FADED
    mixed = F.array(*[F.lit(b) + (hue[i] - b) * depth for i, b in enumerate(base)])
    return F.when(frequency > 0, mixed).otherwise(F.array(*map(F.lit, NEUTRAL)))


def loudness_color(level: Column, transition: float = 1.5) -> Column:
    """array of red, green and blue of a level in loudness units: bands fade into each other by smoothsteps."""
    width = max(0.05, transition)
    rgb = [F.lit(c) for c in QUIET]
    for at, *following in BANDS:
        t = _clamp((level - (at - width)) / (2 * width), F.lit(0.0), F.lit(1.0))
        step = t * t * (3.0 - 2.0 * t)
        rgb = [c + (n - c) * step for c, n in zip(rgb, following, strict=True)]
    return F.array(*rgb)


def display_level(code: Column, floor_db: float, ceiling_db: float, contrast: float = 1.0, gain: float = 1.0, gain_db: float = 0.0) -> Column:
    """Brightness (0 to 1) of a spectrogram code."""
    lo = min(floor_db, ceiling_db - 0.001)
    hi = max(ceiling_db, lo + 0.001)
    unit = _clamp((code_to_db(code, gain_db) - lo) / (hi - lo), F.lit(0.0), F.lit(1.0))
    return _clamp(F.pow(unit, F.lit(max(0.05, contrast))) * gain, F.lit(0.0), F.lit(1.0))


def next_power_of_two(x: Column) -> Column:
    """The least power of two that is not below x (1 for less), by integers: the digits of x - 1 in base two."""
    n = F.greatest(x.cast("long"), F.lit(1)) - 1
    return F.when(n == 0, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n))))


def central_name(path: Column, name: Column, extension: str = ".peaks", most: int = 255) -> Column:
    """A stable file name (binary) of a media path: its own name, cut to fit in `most` bytes, and 24 digits of the path's digest."""
    suffix = F.concat(F.lit("."), F.substring(F.sha2(path, 256), 1, 24), F.lit(extension))
    cut = F.substring(name.cast("binary"), 1, max(0, most - 25 - len(extension.encode())))
    return F.concat(F.when(F.octet_length(cut) > 0, cut).otherwise(F.lit("media").cast("binary")), suffix.cast("binary"))


def preview(payload: Column, most: int = 32) -> tuple[Column, Column]:
    """The first bytes of a payload as spaced hex digits, and as ASCII with a dot for what can't be printed."""
    head = F.hex(F.substring(payload, 1, most))
    pairs = F.regexp_replace(F.lower(head), "(..)(?!$)", "$1 ")
    byte = F.transform(F.filter(F.split(pairs, " "), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("int"))
    return pairs, F.array_join(F.transform(byte, lambda b: F.when(b.between(32, 126), F.char(b)).otherwise(".")), "")

"""Min/max levels of sampled signals, derived pyramids, and views over them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigstrata.functions import codes
from sigstrata.sources.signals import lanes

TILE = 4096


def bucket_count(frames: int, division: int, fine: int) -> int:
    """Records of a level: a partial last bucket counts on the finest level, on one that is no multiple of it,
    and where frames do not fill the finest; elsewhere it is dropped."""
    if division == fine or division % fine or frames % fine:
        return -(-frames // division)
    return frames // division


def bucket_count_column(frames: Column, division: Column, fine: Column) -> Column:
    up = F.floor((frames + division - 1) / division)
    return F.when((division == fine) | (division % fine != 0) | (frames % fine != 0), up).otherwise(F.floor(frames / division)).cast("long")


def valid(samples: DataFrame) -> Column:
    """v, null where it is NaN."""
    return F.when(~F.isnan("v"), F.col("v")) if dict(samples.dtypes)["v"] in ("float", "double") else F.col("v")


def extrema(samples: DataFrame, division: int) -> DataFrame:
    """(lane, peak, hi, lo) of each bucket; NaN and null samples do not count, and a bucket of nothing else has null
    extrema. One partial aggregation and one shuffle."""
    v = valid(samples)
    return samples.groupBy(*lanes(samples), F.floor(F.col("frame") / division).alias("peak")).agg(F.max(v).alias("hi"), F.min(v).alias("lo"))


def coded(peaks: DataFrame, code: Callable[[Column], Column]) -> DataFrame:
    """Extrema to codes. Codes are monotone, so they are taken after the extrema, once a bucket."""
    return peaks.select(*lanes(peaks), "peak", code(F.col("hi")).alias("max_code"), code(F.col("lo")).alias("min_code"))


def float_code(quantize: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    """Float extrema start from -1 and 1 before they are coded: a bucket of NaN has these."""

    def run(peaks: DataFrame) -> DataFrame:
        hi, lo = F.greatest("hi", F.lit(-1.0).cast("float")), F.least("lo", F.lit(1.0).cast("float"))
        return peaks.select(*lanes(peaks), "peak", quantize(hi).alias("max_code"), quantize(lo).alias("min_code"))

    return run


def coarser(peaks: DataFrame, factor: int) -> DataFrame:
    """Max of maxima and min of minima of groups of `factor` records (the last may be partial)."""
    return peaks.groupBy(*lanes(peaks), F.floor(F.col("peak") / factor).alias("peak")).agg(
        F.max("max_code").alias("max_code"), F.min("min_code").alias("min_code")
    )


def levels(samples: DataFrame, divisions: list[int], frames: int | DataFrame, code: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(lane, division, peak, max_code, min_code) of all levels; frames: of the one track, or the lengths of many.

    Levels that are multiples of the finest roll up its records, not the samples; the finest is small after one
    aggregation and its exchange is shared. All others come from one more scan, that of their common divisor.
    """
    fine_d = divisions[0]
    fine = code(extrema(samples, fine_d))
    others = [d for d in divisions if d % fine_d]
    if others:
        # extrema of extrema: one scan serves them, in buckets that divide each of them
        step = math.gcd(*others)
        base = extrema(samples, step)
    out = None
    for d in divisions:
        if d % fine_d == 0:
            own = fine if d == fine_d else coarser(fine, d // fine_d)
        else:
            peak = F.floor(F.col("peak") / (d // step)).alias("peak")
            own = code(base.groupBy(*lanes(base), peak).agg(F.max("hi").alias("hi"), F.min("lo").alias("lo")))
        if isinstance(frames, DataFrame):
            count = bucket_count_column(F.col("frames"), F.lit(d), F.lit(fine_d))
            own = own.join(frames.select("track_id", "frames"), "track_id").where(F.col("peak") < count).drop("frames")
        else:
            own = own.where(F.col("peak") < bucket_count(frames, d, fine_d))
        own = own.select(F.lit(d).cast("long").alias("division"), "*")
        out = own if out is None else out.unionByName(own)
    return out


def pyramid(native: list[tuple[int, int]], frames: int, ratio: int = 4) -> list[tuple[int, int, bool, int]]:
    """(division, count, native, factor) of native and derived levels by division; native holds (division, count)."""
    native = sorted(native)
    out = [(d, n, True, 1) for d, n in native]
    if native:
        (fine, count), ratio = native[0], max(ratio, 2)
        factor, have = ratio, {d for d, _ in native}
        while True:
            d, n = fine * factor, -(-count // factor)
            if d not in have:
                out.append((d, n, False, factor))
                have.add(d)
            if n <= 1 or d >= max(frames, 1):
                break
            factor *= ratio
    return sorted(out)


def level_table(spark: SparkSession, made: list[tuple[int, int, bool, int]]) -> DataFrame:
    rows = [(i, *x) for i, x in enumerate(made)]
    return spark.createDataFrame(rows, "level_index int, division long, peak_count long, native boolean, factor long")


def plan_views(views: DataFrame, made: list[tuple[int, int, bool, int]]) -> DataFrame:
    """For each view (start_frame, end_frame, width) the nearest level on a log scale, and its records.

    made is a pyramid: its levels (a logarithm of the signal's length) are constants of the plan.
    """
    per_pixel = (F.col("end_frame") - F.col("start_frame")).cast("double") / F.col("width")
    target = F.greatest(per_pixel / 1.5, F.lit(1.0))
    listed = F.array(*[F.struct(F.lit(i).alias("level_index"), F.lit(x[0]).cast("long").alias("division"), F.lit(x[1]).cast("long").alias("peak_count")) for i, x in enumerate(made)])
    ok = views.where("width > 0 and end_frame > start_frame").withColumn("ls", listed)
    scored = F.transform(
        "ls",
        lambda x: F.struct(F.abs(F.ln(x["division"].cast("double") / target)).alias("score"), x["level_index"].alias("i"), x["division"].alias("d"), x["peak_count"].alias("n")),
    )
    best = ok.withColumn("b", F.array_min(scored))
    d, n = F.col("b.d"), F.col("b.n")
    first = F.least(F.floor(F.col("start_frame") / d), n)
    last = F.greatest(F.least(F.floor((F.col("end_frame") + d - 1) / d), n), first)
    return best.select(
        "view_id", F.col("b.i").alias("level_index"), d.alias("division"), first.cast("long").alias("first_peak"),
        (last - first).cast("long").alias("peak_count"), (per_pixel / d).alias("peaks_per_pixel"),
    )


def read_range(fine: DataFrame, factor: int, first: int, count: int, fill: bool = False) -> DataFrame:
    """Records first to first + count of a level derived by `factor`; the filter on the finest level reaches the scan.

    fill: records of which there are none in `fine` are given as zeros, for every lane of it.
    """
    a, b = first * factor, (first + count) * factor
    part = fine.where((F.col("peak") >= a) & (F.col("peak") < b))
    made = part if factor == 1 else coarser(part, factor)
    if not fill or count < 1:
        return made
    grid = fine.select(*lanes(fine)).distinct().withColumn("peak", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(first + count - 1).cast("long"))))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast(dict(made.dtypes)[c]).alias(c)
    return grid.join(made, [*lanes(fine), "peak"], "left").select(*lanes(fine), "peak", zero("max_code"), zero("min_code"))


def tiles(plans: DataFrame, tile: int = TILE) -> DataFrame:
    """(view_id, level_index, tile_index) that a plan touches."""
    some = plans.where("peak_count > 0")
    last = F.floor((F.col("first_peak") + F.col("peak_count") - 1) / tile)
    return some.select("view_id", "level_index", F.explode(F.sequence(F.floor(F.col("first_peak") / tile), last)).alias("tile_index"))


def tile_page(peaks: DataFrame, tile_index: int, tile: int = TILE) -> DataFrame:
    return peaks.where((F.col("peak") >= tile_index * tile) & (F.col("peak") < (tile_index + 1) * tile))


def nearest_division(views: DataFrame, divisions: list[int]) -> DataFrame:
    """The division of a level that is nearest to `desired` on a log scale, the first of equals in the order given."""
    ds = [F.struct(F.abs(F.ln(F.lit(float(max(1, d))) / F.greatest(F.col("desired").cast("double"), F.lit(1.0)))).alias("off"), F.lit(i).alias("i"), F.lit(d).cast("long").alias("d")) for i, d in enumerate(divisions)]
    return views.select("view_id", F.array_min(F.array(*ds))["d"].alias("division"))


def level_not_above(views: DataFrame, divisions: list[int]) -> DataFrame:
    """The largest division of at most `desired`, else the smallest."""
    ds = F.array(*[F.lit(d).cast("long") for d in sorted(divisions)])
    fit = F.array_max(F.filter(ds, lambda d: d <= F.col("desired")))
    return views.select("view_id", F.coalesce(fit, F.lit(min(divisions)).cast("long")).alias("division"))


def window_envelope(samples: DataFrame, first: int, count: int, division: int) -> DataFrame:
    """Extrema of [first, first + count) by buckets from `first`; non-finite samples count as 0."""
    part = samples.where((F.col("frame") >= first) & (F.col("frame") < first + count))
    v = F.when(F.isnan("v") | (F.abs("v") == float("inf")), F.lit(0.0).cast("float")).otherwise(F.col("v"))
    return part.groupBy(*lanes(part), F.floor((F.col("frame") - first) / division).alias("record")).agg(F.max(v).alias("hi"), F.min(v).alias("lo"))


def overview(peaks: DataFrame, division: int, start: int, end: int, width: int) -> DataFrame:
    """Extrema of each pixel column of frames [start, end): the records its span of frames touches, one at least.

    A record is sent to the few columns it can touch, so that this is one aggregation and no range join.
    """
    span = end - start
    near = lambda frame: F.floor((frame - start) * width / float(span))
    last = F.lit(width - 1)
    cols = F.sequence(F.least(F.greatest(near(F.col("peak") * division) - 1, F.lit(0)), last), F.least(F.greatest(near((F.col("peak") + 1) * division) + 1, F.lit(0)), last))
    each = peaks.withColumn("x", F.explode(cols))
    at = lambda x: (F.lit(float(start)) + F.lit(float(span)) * x / float(width)) / float(division)
    a = F.floor(at(F.col("x")))
    b = F.greatest(F.ceil(at(F.col("x") + 1)), a + 1)
    return each.where((F.col("peak") >= a) & (F.col("peak") < b)).groupBy(*lanes(peaks), "x").agg(F.max("max_code").alias("max_code"), F.min("min_code").alias("min_code"))


#: Why a view reads what it does.
REASONS = {"far": "peak-cache density", "source": "source PCM", "bytes": "source byte budget", "records": "texture record limit"}


def plan_lod(views: DataFrame, enter: float = 1.5, exit_: float = 1.1, max_bytes: int = 16 << 20, page_bytes: int = 1 << 20, max_records: int = 4096) -> DataFrame:
    """Whether a view reads samples, at which division, and the reusable page around it.

    views: view_id, view_start, view_end (double), width, total_frames, channels, fine_division, source_active.

    A view is dense enough for samples when a finest record spans `enter` pixels, and stays so down to `exit_`. Samples
    are reduced by the power of two next to the frames of a pixel, never by more than the finest division. What is
    needed is the view with a guard on either side, in whole records; it must fit in the bytes and the records that
    a page may have. Pages start on a grid of half a page, moved so that they hold what is needed.
    """
    long = lambda c: c.cast("long")
    down = lambda a, b: long((a - a % b) / b)  # noqa: E731  whole quotient of a >= 0
    up = lambda a, b: down(a + b - 1, b)
    col, zero = F.col, F.lit(0).cast("long")
    steps = (
        ("s", lambda: long(F.floor(F.least(F.greatest(F.lit(0.0), col("view_start")), col("total_frames") - 1)))),
        ("e", lambda: long(F.ceil(F.least(F.greatest(col("s") + 1, col("view_end")), col("total_frames"))))),
        ("frames_per_pixel", lambda: F.greatest(F.lit(1), col("e") - col("s")) / col("width")),
        ("pixels_per_peak", lambda: col("fine_division") / col("frames_per_pixel")),
        ("dense", lambda: col("pixels_per_peak") >= F.when(col("source_active"), exit_).otherwise(enter)),
        ("division", lambda: F.least(long(col("fine_division")), codes.next_power_of_two(long(F.ceil(col("frames_per_pixel")))))),
        ("guard", lambda: F.greatest(F.lit(2), col("division") * 2)),
        ("from_", lambda: down(F.greatest(zero, col("s") - col("guard")), col("division")) * col("division")),
        ("to_", lambda: F.least(long(col("total_frames")), up(F.least(long(col("total_frames")), col("e") + col("guard")), col("division")) * col("division"))),
        ("need", lambda: up(col("to_") - col("from_"), col("division"))),
        ("record_bytes", lambda: long(col("channels") * 4 * col("division"))),
        ("by_bytes", lambda: down(F.lit(max_bytes).cast("long"), col("record_bytes"))),
        ("most", lambda: F.least(F.lit(max_records).cast("long"), col("by_bytes"))),
        ("records", lambda: F.greatest(col("need"), F.least(col("most"), F.greatest(F.lit(1), down(F.lit(min(page_bytes, max_bytes)).cast("long"), col("record_bytes")))))),
        ("page", lambda: col("records") * col("division")),
        ("half", lambda: F.greatest(col("division"), down(col("records"), F.lit(2)) * col("division"))),
        ("least", lambda: up(F.greatest(zero, col("to_") - col("page")), col("division")) * col("division")),
        ("first", lambda: F.least(F.greatest(down(col("from_"), col("half")) * col("half"), col("least")), col("from_"))),
        ("fits", lambda: col("dense") & (col("need") <= col("most"))),
    )
    for name, make in steps:
        views = views.withColumn(name, make())
    why = F.when(~col("dense"), REASONS["far"]).when(col("need") <= col("most"), REASONS["source"]).when(col("by_bytes") < col("need"), REASONS["bytes"])
    if_fits = lambda c: F.when(col("fits"), c).otherwise(zero)
    count = F.greatest(zero, F.least(long(col("total_frames")), col("first") + col("page")) - col("first"))
    return views.select(
        "view_id", col("fits").alias("active"), if_fits(col("division")).alias("division"), if_fits(col("first")).alias("first_frame"),
        if_fits(count).alias("frame_count"), "frames_per_pixel", "pixels_per_peak", why.otherwise(REASONS["records"]).alias("reason"),
    )

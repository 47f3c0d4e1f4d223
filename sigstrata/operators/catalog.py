"""Where the cache of a media file is, and whether it is fresh, as joins over listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigstrata.functions import codes

#: Places in the order in which they are tried, and the two spellings of the extension.
PLACES = ("mapped", "sidecar", "subdir", "central")
EXTENSIONS = (".peaks", ".Peaks")


def same_stamp(mtime: Column, size: Column, cache_mtime: Column, cache_size: Column) -> Column:
    """Whether a cache has the stamp of its media: whole seconds and bytes, each modulo 2**32. False where one is unknown."""
    return F.coalesce((codes.stamp32(mtime) == cache_mtime) & (codes.stamp32(size) == cache_size), F.lit(False))


def freshness(media: DataFrame, caches: DataFrame) -> DataFrame:
    """(path, exists, parseable, fresh, reason) of media (path, mtime, size) and the caches found for them
    (path, mtime_low32, size_low32, error): one cache a path at most."""
    found = caches.select(F.col("path").alias("of"), "mtime_low32", "size_low32", "error")
    j = media.join(found, F.col("path") == F.col("of"), "left")
    there = F.col("of").isNotNull()
    sound = there & F.col("error").isNull()
    fresh = sound & same_stamp(F.col("mtime"), F.col("size"), F.col("mtime_low32"), F.col("size_low32"))
    reason = F.when(~there, "missing").when(~sound, F.col("error")).when(fresh, "fresh").otherwise("source metadata mismatch")
    return j.select("path", there.alias("exists"), sound.alias("parseable"), fresh.alias("fresh"), reason.alias("reason"))


def normal(path: Column, fold: bool = False) -> Column:
    """A path with single forward slashes and without a "." step; folded to lower case where names are not case-sensitive."""
    p = F.regexp_replace(F.translate(path, "\\", "/"), "/(\\./)+|/+", "/")
    return F.lower(p) if fold else p


def mapped(media: DataFrame, mapping: DataFrame, for_write: bool = False, fold: bool = False) -> DataFrame:
    """(path, cache) of media (path) by a map (media, read, write): the wanted path of an entry, or else its other one.

    Of several entries of a media file the last (largest in `ord`, where there is one) holds.
    """
    order = F.col("ord") if "ord" in mapping.columns else F.lit(0)
    want, other = ("write", "read") if for_write else ("read", "write")
    empty = lambda c: F.when(F.col(c) != "", F.col(c))
    one = mapping.groupBy(normal(F.col("media"), fold).alias("of")).agg(F.max_by(F.struct(empty(want).alias("a"), empty(other).alias("b")), order).alias("e"))
    j = media.join(one, normal(F.col("path"), fold) == F.col("of"), "left")
    return j.select("path", F.coalesce("e.a", "e.b").alias("cache"))


def candidates(media: DataFrame, mapping: DataFrame | None = None, central: str | None = None, mode: str = "auto") -> DataFrame:
    """(path, prio, place, candidate): where the cache of each media file may be, each path once, at its first place.

    mode: one of PLACES, or "auto" for all in their order.
    """
    if mode != "auto" and mode not in PLACES:
        raise ValueError(f"mode is auto or one of {', '.join(PLACES)}")
    if mode == "central" and central is None or mode == "mapped" and mapping is None:
        raise ValueError(f"mode {mode} needs its folder or map")
    rows = mapped(media, mapping) if mapping is not None else media.select("path", F.lit(None).cast("string").alias("cache"))
    folder, name = F.regexp_extract("path", "^(.*/)?[^/]*$", 1), F.regexp_extract("path", "[^/]*$", 0)
    made = {
        "mapped": [F.col("cache")], "sidecar": [F.concat("path", F.lit(e)) for e in EXTENSIONS],
        "subdir": [F.concat(folder, F.lit("peaks/"), name, F.lit(e)) for e in EXTENSIONS],
        "central": [F.concat(F.lit(central.rstrip("/") + "/"), codes.central_name(F.col("path"), name, e).cast("string")) for e in EXTENSIONS] if central else [],
    }
    every = [F.struct(F.lit(p).alias("place"), normal(c).alias("candidate")) for p in PLACES for c in made[p] if mode in ("auto", p)]
    each = rows.select("path", F.posexplode(F.array(*every)).alias("prio", "c")).select("path", "prio", "c.*").where("candidate is not null")
    w = Window.partitionBy("path", "candidate").orderBy("prio")
    return each.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def resolved(tried: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, place, cache): the first of candidates (path, prio, place, candidate) that a listing of files (file) has."""
    there = tried.join(listing.select(F.col("file").alias("candidate")).distinct(), "candidate", "left_semi")
    return there.groupBy("path").agg(F.min_by(F.struct("place", F.col("candidate").alias("cache")), "prio").alias("c")).select("path", "c.*")


def deduplicated(tried: DataFrame) -> DataFrame:
    """Candidates (path, prio, place, candidate) with each path once, at its first place."""
    first = tried.groupBy("path", "candidate").agg(F.min_by(F.struct("prio", "place"), "prio").alias("c"))
    return first.select("path", "c.prio", "c.place", "candidate")

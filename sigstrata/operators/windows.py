"""Windows of samples for display: pages, envelopes of them with a record of the access, and a bounded store of pages."""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Callable
from concurrent.futures import Future

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigstrata.operators import wave

MAX_BYTES, PAGE_BYTES = 16 << 20, 1 << 20


def raw_pages(requests: DataFrame, max_bytes: int = MAX_BYTES, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """requests (view_id, first, count, channels, total_frames) with the page that holds each: page_first, page_count.

    Pages start on a grid of half a page, moved so that they hold the request and end with the samples. A request
    of more than max_bytes is refused.
    """
    long = lambda c: c.cast("long")
    down = lambda a, b: long((a - a % b) / b)
    frame = F.col("channels") * 4
    size = F.least(down(F.lit(max_bytes).cast("long"), frame), F.greatest(long(F.col("count")), F.greatest(F.lit(1), down(F.lit(page_bytes).cast("long"), frame))))
    r = requests.withColumn("size", size)
    r = r.withColumn("size", F.when(F.col("size") < F.col("count"), F.raise_error(F.lit("a request exceeds the bytes of a window")).cast("long")).otherwise(F.col("size")))
    stride = F.greatest(F.lit(1), down(F.col("size"), F.lit(2)))
    end, total = F.col("first") + F.col("count"), F.greatest(long(F.col("total_frames")), F.lit(0))
    r = r.withColumn("at", down(long(F.col("first")), stride) * stride)
    r = r.withColumn("at", F.when(F.col("at") + F.col("size") < end, end - F.col("size")).otherwise(F.col("at")))
    over = (total >= F.col("size")) & (F.col("at") + F.col("size") > total)
    r = r.withColumn("at", F.when(F.col("total_frames").isNull(), F.col("at")).otherwise(F.least(F.when(over, total - F.col("size")).otherwise(F.col("at")), total)))
    count = F.when(F.col("total_frames").isNull(), F.col("size")).otherwise(F.least(F.col("size"), F.greatest(F.lit(0), total - F.col("at"))))
    return r.withColumn("page_count", F.greatest(F.lit(0), count)).withColumn("page_first", F.greatest(F.lit(0).cast("long"), F.col("at"))).drop("size", "at")


def display_window(samples: DataFrame, first: int, count: int, division: int, channels: int, total_frames: int | None = None, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(records, event) of a request: extrema by buckets from `first`, or the samples themselves where division is 1; and
    a row that says what was asked for and which page it lies in, to append to a log."""
    if count < 1 or division < 1 or first < 0:
        raise ValueError("a request has a frame at least, and a positive division")
    if first % division:
        raise ValueError("a request starts at a multiple of its division")
    if total_frames is not None and first >= total_frames:
        raise ValueError("a request starts before the end of the samples")
    spark = samples.sparkSession
    asked = spark.createDataFrame([(0, first, count, channels, total_frames)], "view_id int, first long, count long, channels int, total_frames long")
    page = raw_pages(asked, max_bytes)
    actual = count if total_frames is None else min(count, total_frames - first)
    event = page.select(
        F.current_timestamp().alias("at"), "first", "count", F.lit(division).alias("division"), "page_first", "page_count", F.lit(first).cast("long").alias("display_first"),
        F.lit(actual).cast("long").alias("display_frames"), F.lit(-(-actual // division)).cast("long").alias("records"), F.lit("samples" if division == 1 else "envelope").alias("mode"),
    )
    return wave.window_envelope(samples, first, actual, division), event


class PageStore:
    """Pages by key on the driver: least recently used ones go where bytes or items are exceeded, requests for a page that is
    being read wait for it, and no more than `pending` of them do."""

    def __init__(self, most_bytes: int = 64 << 20, items: int = 1024, pending: int = 64):
        self.most_bytes, self.items, self.pending = most_bytes, items, pending
        self.pages: OrderedDict[object, tuple[object, int]] = OrderedDict()
        self.reading: dict[object, Future] = {}
        self.bytes = self.waiting = 0
        self.lock = threading.Lock()

    def get(self, key: object, read: Callable[[], object], size: Callable[[object], int] = len) -> tuple[object, str]:
        """(page, "hit", "joined" or "read")."""
        with self.lock:
            if key in self.pages:
                self.pages.move_to_end(key)
                return self.pages[key][0], "hit"
            future = self.reading.get(key)
            mine = future is None
            if mine:
                future = self.reading[key] = Future()
            elif self.waiting >= self.pending:
                raise RuntimeError("too many requests wait for pages")
            else:
                self.waiting += 1
        if not mine:
            try:
                return future.result(), "joined"
            finally:
                with self.lock:
                    self.waiting -= 1
        try:
            page = read()
        except BaseException as e:
            with self.lock:
                del self.reading[key]
            future.set_exception(e)
            raise
        with self.lock:
            del self.reading[key]
            n = size(page)
            if n <= self.most_bytes:
                self.pages[key] = page, n
                self.bytes += n
            while self.bytes > self.most_bytes or len(self.pages) > self.items:
                self.bytes -= self.pages.popitem(last=False)[1][1]
        future.set_result(page)
        return page, "read"

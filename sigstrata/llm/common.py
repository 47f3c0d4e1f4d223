"""Shared plumbing: tables, tables written in the shared folder, Arrow mapping, components."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tables in the shared folder that are not yet deleted, by path.
_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file; it is the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where it is unset, one beside the warehouse, but only on a
    local master: elsewhere executors might not share it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: this cuts the lineage and survives lost executors.

    The table stays until discard, the end of a scratch block around the call, or the end of the process.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_llm_path"] = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a materialized table that no later step reads."""
    path = df.__dict__.get("_llm_path")
    if path:
        _delete(path)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables materialized in the block are deleted at its end, but for those given to the function it yields.

    What the block returns lazily must not read the others: materialize it and keep that.
    """
    before, kept = set(_written), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.__dict__.get("_llm_path"))
        return df

    try:
        yield keep
    finally:
        for path in [p for p in _written if p not in before and p not in kept]:
            _delete(path)


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _discard_all() -> None:
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the session has ended: its folder goes with it
            return


def row(docs: DataFrame) -> DataFrame:
    """docs as one column `row` of structs, beside which own columns can't clash with a caller's names."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


class Cache(dict):
    """Values of short strings, bounded by bytes: what is longer than `longest` is not kept, and a full cache starts anew."""

    def __init__(self, most: int = 48 << 20, longest: int = 96):
        super().__init__()
        self.most, self.longest, self.held = most, longest, 0

    def room(self) -> None:
        """Called between batches, so that what a batch has stored stays while it is read."""
        if self.held > self.most:
            self.clear()
            self.held = 0

    def keep(self, key: str, value: Hashable, size: int = 0) -> None:
        self[key] = value
        self.held += 150 + 2 * len(key) + size

    def split(self, keys: Iterable[str]) -> tuple[list[str], list[str]]:
        """Keys that are not held: those worth keeping, and those too long for it."""
        new = [k for k in keys if k not in self]
        return [k for k in new if len(k) <= self.longest], [k for k in new if len(k) > self.longest]


#: Bounds of what one call of a mapped function holds: rows, and bytes of text (one longer text goes alone).
SLICE_ROWS, SLICE_BYTES = 256, 4 << 20


def slices(sizes: np.ndarray, rows: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of stretches of at most `rows` rows and `most` bytes, of one row at least."""
    out, start, total = [], 0, np.concatenate([[0], np.cumsum(sizes)])
    while start < len(sizes):
        stop = int(np.searchsorted(total, total[start] + most, "right")) - 1
        stop = max(start + 1, min(stop, start + rows, len(sizes)))
        out.append((start, stop - start))
        start = stop
    return out


def map_texts(
    df: DataFrame,
    fn: Callable[[list], list],
    fields: list[T.StructField],
    column: str = "text",
    keep: list[str] | None = None,
    rows: int = SLICE_ROWS,
) -> DataFrame:
    """Append fields computed by fn from slices of one column; fn gets and returns lists (one list a field).

    column: a name, or the path of a field of a struct. keep: the columns of df to carry on (all by default).
    rows and SLICE_BYTES bound what one call holds.
    """
    names = df.columns if keep is None else keep
    schema = T.StructType([df.schema[n] for n in names] + fields)
    top, *inner = column.split(".")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index(top))
            for name in inner:
                texts = pc.struct_field(texts, name)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for start, n in slices(sizes, rows, SLICE_BYTES):
                made = fn(texts.slice(start, n).to_pylist())
                kept = [batch.column(batch.schema.names.index(c)).slice(start, n) for c in names]
                new = [v if isinstance(v, pa.Array) else pa.array(v, type=_arrow(f.dataType)) for v, f in zip(made, fields, strict=True)]
                yield pa.RecordBatch.from_arrays(kept + new, names=[*names, *(f.name for f in fields)])

    return df.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {
        T.LongType: pa.int64(),
        T.IntegerType: pa.int32(),
        T.DoubleType: pa.float64(),
        T.StringType: pa.string(),
        T.BooleanType: pa.bool_(),
        T.BinaryType: pa.binary(),
    }[type(kind)]


def find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    r = parent[x]
    while True:
        up = parent[r]
        if (up == r).all():
            return r
        r = up


def union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; the smallest index of a set is its root."""
    while len(a):
        ra, rb = find(parent, a), find(parent, b)
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long): (id, label), label the smallest id of its component.

    Large-star and small-star rounds until nothing changes. Each round keeps at most as many edges as the
    last, reads and writes tables in the shared folder, and joins (which can be split at hot nodes) where
    it needs a node's minimum, so that no node's neighbours meet in one task.
    """
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u")
        small = materialize(
            pairs.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        state = small.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        discard(now)
        discard(large)
        now = small
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(roots)

"""Sharding by a hierarchical weighted hash tree: region, rack and shard levels.

A document descends the tree. At each node every child draws -ln(u)/weight, u uniform from a hash of the
document's id and the child's name, and the smallest draw wins: child i wins with probability
weight_i / sum of weights. A child's draw depends on the id, its name and its weight alone, so that a
change of weights moves documents only into a child whose weight grew or out of one whose weight shrank,
and only within that subtree below. A new shard is hung in a region of its own: it takes documents into
itself and moves none between the others.

The law is `key`. Null texts have size 1 and the checksum of the empty text. Null ids hash as the string
"null": they land in one shard. Repeated rows get slots of their own. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]


def balanced(shards: int = 16, racks: int = 2, per_rack: int = 4) -> Tree:
    """Regions of `racks` racks of `per_rack` shards of weight 1. A shard beyond whole regions has its own region."""
    tree: Tree = {}
    per_region = racks * per_rack
    for s in range(shards):
        whole = s < shards // per_region * per_region
        region = f"g{s // per_region}" if whole else f"own{s}"
        rack = f"k{s % per_region // per_rack}" if whole else "k0"
        tree.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
    return tree


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """tree with one more shard in a region of its own."""
    s = 1 + max(x for racks in tree.values() for leaves in racks.values() for x in leaves)
    return tree | {f"own{s}": {"k0": {s: weight}}}


def _draw(key: Column, name: str, weight: float) -> Column:
    """-ln(u)/weight with u from 53 bits of a hash of key and the child's path."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double")
    return -F.ln((bits + 0.5) / float(1 << 53)) / weight


def _pick(key: Column, path: str, children: dict, weight, below) -> Column:
    """What `below` gives for the child with the smallest draw."""
    names = list(children)
    if len(names) == 1:
        return below(names[0])
    draws = F.array(*[_draw(key, f"{path}/{n}", weight(n)) for n in names])
    won = F.array_position(draws, F.array_min(draws))
    out = below(names[-1])
    for i in range(len(names) - 1, 0, -1):
        out = F.when(won == i, below(names[i - 1])).otherwise(out)
    return out


def place(key: Column, tree: Tree) -> Column:
    """The shard of a key."""

    def rack(g: str):
        racks = tree[g]
        return lambda k: _pick(key, f"{g}/{k}", racks[k], lambda s: racks[k][s], lambda s: F.lit(s))

    total = lambda leaves: sum(leaves.values())
    return _pick(
        key, "", tree, lambda g: sum(map(total, tree[g].values())),
        lambda g: _pick(key, g, tree[g], lambda k: total(tree[g][k]), rack(g)),
    )


def slots(df: DataFrame, write, shard: str = "shard", order: tuple[str, ...] = ()) -> DataFrame:
    """df with slot: 0, 1, ... within each shard, in the order given.

    Rows are range-partitioned by (shard, order) and written with their place within the partition; then
    the counts per (partition, shard) give each its offset. That table has a row per partition and the
    shards that meet in it, and no shard's rows come together in one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # repeated rows are equal in all of these: a last key of their place in the input lets a range end between them
    cols = [shard, *order, "__salt"]
    salted = df.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id()))
    dealt = salted.repartitionByRange(n, *cols).sortWithinPartitions(*cols).drop("__salt")
    dealt = write(dealt.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33).alias("__part")
    first = dealt.groupBy(part, F.col(shard)).agg(F.count(F.lit(1)).alias("c"), F.min("__id").alias("first")).collect()
    offset: dict[int, int] = {}
    shifts = []
    for r in sorted(first, key=lambda r: (r[shard], r["__part"])):
        shifts.append((r["__part"], r[shard], offset.get(r[shard], 0) - r["first"]))
        offset[r[shard]] = offset.get(r[shard], 0) + r["c"]
    keyed = df.sparkSession.createDataFrame(shifts, f"__p long, __s {dict(df.dtypes)[shard]}, __shift long")
    out = dealt.join(F.broadcast(keyed), (F.shiftright("__id", 33) == F.col("__p")) & (F.col(shard) == F.col("__s")))
    return out.withColumn("slot", F.col("__id") + F.col("__shift")).drop("__p", "__s", "__shift", "__id")


def shard_documents(docs: DataFrame, write, tree: Tree | None = None) -> DataFrame:
    tree = tree or balanced()
    text = F.coalesce("text", F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    sized = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    placed = sized.withColumn("shard", place(key, tree)).withColumn("grown_shard", place(key, grown(tree)))
    out = slots(placed, write, "shard", ("doc_id", "text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

"""SimHash near-duplicates over BK-trees.

A fingerprint has a bit set if more than half of the XXH64 hashes (seed 42) of the text's word shingles have it.
Equal fingerprints collapse first. Two fingerprints that differ in at most RADIUS bits agree on at least one of
RADIUS + 1 bands of bits, so each (band, value) is a shard that misses no link. A shard of more than SHARD
fingerprints is cut again by as many bands of the bits it leaves open, up to DEPTH times; what is still larger is cut
into blocks, each two of which meet. So no task holds more than about twice SHARD fingerprints of a group, whatever
they have in common.

A shard's distinct fingerprints form one BK-tree: children are keyed by their Hamming distance to the parent, and a
query at distance d from a node follows the edges d - RADIUS to d + RADIUS alone. Trees go to the fingerprints of
their own shard by one shuffle and not by broadcast, as the fingerprints of all documents have no size bound. What a
shard gives is a spanning forest of its links (fewer edges than fingerprints), never all pairs; components of the
forests' union are those of all links.

`keep_one` is near-duplicate removal for corpora: texts are linked if the Jaccard similarity of their sets of 5-word
shingles is 4/5 or more, which 64-bit fingerprints alone can't tell. Sets share a shard if one of BANDS groups of
ROWS minima of linear permutations is equal (a pair at similarity 0.8 is missed with chance 5e-5); a BK-tree over
the shard's fingerprints leaves candidates within WIDE bits (missed with chance 3e-5), of which sketches of SKETCH nibbles
of minima leave those that can be similar (missed with chance 1e-5); each is then verified on the sets themselves. That goes
in three rounds, each between sets that the last left in different components: in a shard all sets meet its smallest;
a spanning forest of pairs whose sketches are nearly alike; all other candidates. The commonest component of a shard
does not ask. So a large group of near copies costs about its size and not its square.

Null text counts as empty; a text without words has fingerprint zero (or the empty set) and links like any other. Rows
with a null doc_id count, but a component's id is its smallest non-null doc_id (null if there is none). Repeated
rows share a component; keep_one keeps one row of a component: of its smallest doc_id (null last), and of several
texts or rows under it that of the smallest hash. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigstrata.llm.common import components, discard, find, map_texts, materialize, row, union

RADIUS = 4
WORDS = 4
SEED = 42
SHARD, DEPTH = 2048, 3
#: Near-duplicates by verified similarity: words of a shingle, groups of minima and minima in each, and bits.
SET_WORDS, BANDS, ROWS, WIDE = 5, 25, 5, 22
#: Nibbles of minima in a sketch, and how many agree in pairs that are likely or can be similar (0.8125 at 0.8).
SKETCH, LIKELY, POSSIBLE = 1024, 840, 778
_rng = np.random.default_rng(SEED)
FACTORS = _rng.integers(0, 2**63, (SKETCH, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 2**64, (SKETCH, 1), dtype=np.uint64)


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, repeats included, in stretches that bound the memory of very long texts."""
    import xxhash

    parts = text.encode().lower().split() if text else []  # bytes: lowers A-Z, splits at ASCII white space
    if not parts:
        return
    data = b" ".join(parts)
    ends = list(accumulate((len(p) + 1 for p in parts), initial=0))
    span = min(words, len(parts))
    digest, n = xxhash.xxh64_intdigest, len(parts) - span + 1
    for at in range(0, n, 1 << 14):
        stop = min(n, at + (1 << 14))
        yield np.array([digest(data[a : b - 1], SEED) for a, b in zip(ends[at:stop], ends[at + span : stop + span])], dtype="<u8")


def majority(parts: Iterator[np.ndarray]) -> int:
    """The bits that more than half of the hashes have; zero for none."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for h in parts:
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit fingerprint of a text, unsigned."""
    return majority(shingle_hashes(text, words))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(texts: list) -> list:
    return [[_signed(fingerprint(t)) for t in texts]]


def bands(bits: Sequence[int], n: int) -> list[list[int]]:
    """Bits dealt to n bands of like size."""
    cuts = [round(len(bits) * i / n) for i in range(n + 1)]
    return [list(bits[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Forest:
    """BK-trees of several shards side by side: group[i] is the shard of fps[i], and groups are contiguous, their
    members (which form the tree; what is no member only asks) first.

    The first of a group is its root; the others at distance d from it form the subtree behind edge d,
    whose root is their first, and so on. That is the tree that inserting them in order gives.
    """

    def __init__(self, fps: np.ndarray, group: np.ndarray, member: np.ndarray):
        n = len(fps)
        self.fps = fps
        parent = np.full(n, -1, dtype=np.int64)
        edge = np.zeros(n, dtype=np.int64)
        first = np.searchsorted(group, group)
        self.root = np.where(member[first], first, -1) if n else first
        order = np.flatnonzero(member)
        key = group[order].astype(np.int64)
        above = np.full(n, -1, dtype=np.int64)
        while len(order):
            head = np.concatenate([[True], key[1:] != key[:-1]])
            roots = order[head]
            mine = roots[np.cumsum(head) - 1]
            parent[roots] = above[roots]
            rest = ~head
            order, mine = order[rest], mine[rest]
            d = np.bitwise_count(fps[order] ^ fps[mine]).astype(np.int64)
            edge[order], above[order] = d, mine
            sort = np.lexsort((order, d, mine))
            order = order[sort]
            key = mine[sort] * 65 + d[sort]
        child = np.flatnonzero(parent >= 0)
        keys = parent[child] * 65 + edge[child]
        sort = np.argsort(keys)
        self.children, self.keys = child[sort], keys[sort]

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) pairs with at most `radius` differing bits, node before query, level by level."""
        q, node = queries, self.root[queries]
        q, node = q[node >= 0], node[node >= 0]
        while len(q):
            d = np.bitwise_count(self.fps[q] ^ self.fps[node]).astype(np.int64)
            hit = (d <= radius) & (node < q)
            if hit.any():
                yield q[hit], node[hit]
            lo = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0), "left")
            hi = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right")
            count = hi - lo
            q = np.repeat(q, count)
            node = self.children[np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(len(q))]


#: Part of a row in its shard.
HELD, BOTH, ASKS = 0, 1, 2


def near(fps: np.ndarray, group: np.ndarray, part: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (asking, held) of places in shards within the radius, each once. Rows of a shard come in the order of their parts."""
    forest = Forest(fps, group, part < ASKS)
    asking = np.flatnonzero(part > HELD)
    for at in range(0, len(asking), 512):  # bounds the frontier
        yield from forest.within(asking[at : at + 512], radius)


def roots(parent: np.ndarray) -> np.ndarray:
    low = parent[parent]
    while (low != parent).any():
        parent, low = low, low[low]
    return parent


def shard_links(fps: np.ndarray, group: np.ndarray, part: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (fp, fp of its root) of links within shards."""
    parent = np.arange(len(fps))
    for a, b in near(fps, group, part, radius):
        union(parent, a, b)
    parent = roots(parent)
    linked = np.flatnonzero(parent != np.arange(len(fps)))
    return fps[linked], fps[parent[linked]]


def _columns(column: pa.Array) -> np.ndarray:
    """A column of numbers, or of lists of the same length, as columns of whole numbers."""
    flat = column.flatten() if pa.types.is_list(column.type) else column
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def by_shard(keys: int, made: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]):
    """A function of batches whose first `keys` columns name a shard and come sorted: made gives edges of whole shards.

    A shard that goes on in the next batch is carried over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(parts: list[np.ndarray]) -> pa.RecordBatch:
            a, b = made(np.ascontiguousarray(np.concatenate(parts)))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([_columns(c) for c in batch.columns], axis=1)
            last = (rows[:, :keys] == rows[-1, :keys]).all(axis=1)
            if last.all() and held and (held[-1][-1, :keys] == rows[-1, :keys]).all():
                held.append(rows)
                continue
            if held or not last.all():  # before the last shard of the batch all are whole
                yield out([*held, rows[~last]])
            held = [rows[last]]
        if held:
            yield out(held)

    return run


def shard_numbers(rows: np.ndarray, keys: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum((np.diff(rows[:, :keys], axis=0) != 0).any(axis=1))])


def _forests(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rows: path, value, block, part, fp."""
    return shard_links(rows[:, 4].view(np.uint64), shard_numbers(rows, 3), rows[:, 3])


def in_blocks(rows: DataFrame, hot: DataFrame, keys: list[str], by: str, most: int) -> DataFrame:
    """rows (with a part, HELD or BOTH) of the keys in hot (with their count), dealt to blocks of about `most` by a hash of `by`.

    Block i * n + j holds the parts i and j of n: those of i form its tree, those of j that ask do so.
    """
    n = F.ceil(F.col("count") / most)
    dealt = rows.join(hot, keys).withColumn("of", n).withColumn("home", F.pmod(F.xxhash64(F.col(by), F.lit(1)), F.col("of")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)))
    held = F.struct((F.col("home") * F.col("of") + F.col("other")).alias("block"), F.when(F.col("home") == F.col("other"), F.col("part")).otherwise(HELD).alias("part"))
    asks = F.struct((F.col("other") * F.col("of") + F.col("home")).alias("block"), F.lit(ASKS).alias("part"))
    both = F.when((F.col("home") != F.col("other")) & (F.col("part") == BOTH), F.array(held, asks)).otherwise(F.array(held))
    dealt = dealt.withColumn("dealt", F.explode(both)).drop("part", "of", "home", "other", "count")
    return dealt.withColumn("block", F.col("dealt.block")).withColumn("part", F.col("dealt.part")).drop("dealt")


def link_forest(distinct: DataFrame, radius: int = RADIUS, most: int = SHARD, depth: int = DEPTH) -> DataFrame:
    """Edges (a, b) of a forest whose components are those of all links between distinct fingerprints `fp`."""
    n = radius + 1
    mask = lambda bits: _signed(sum(1 << b for b in bits))
    paths: list[tuple[list[int], list[int]]] = [([], list(range(64)))]  # bits that a shard agrees on, and bits it leaves open
    rows, done, made = distinct.select("fp", F.lit(0).alias("path"), F.lit(0).cast("long").alias("value")), [], []
    for level in range(1, depth + 1):
        below = [[([*agreed, *band], [b for b in rest if b not in band]) for band in bands(rest, n)] for agreed, rest in paths]
        children = F.array(*[
            F.array(*[F.struct(F.lit(i * n + j).alias("path"), F.col("fp").bitwiseAND(F.lit(mask(a)).cast("long")).alias("value")) for j, (a, _) in enumerate(kids)])
            for i, kids in enumerate(below)
        ])
        rows = rows.select("fp", F.explode(children[F.col("path")]).alias("k")).select(F.col("k.path").alias("path"), F.col("k.value").alias("value"), "fp")
        paths = [kid for kids in below for kid in kids]
        hot = materialize(rows.groupBy("path", "value").count().where(F.col("count") > most))
        made.append(hot)
        level_rows = rows.withColumn("path", F.col("path") + sum(n**i for i in range(1, level)))
        cold = lambda df: df.select("path", "value", F.lit(0).cast("long").alias("block"), F.lit(BOTH).alias("part"), "fp")
        if hot.isEmpty():
            done.append(cold(level_rows))
            break
        keys = hot.select((F.col("path") + sum(n**i for i in range(1, level))).alias("path"), "value", "count")
        done.append(cold(level_rows.join(keys, ["path", "value"], "left_anti")))
        if level == depth:
            done.append(in_blocks(level_rows.withColumn("part", F.lit(BOTH)), keys, ["path", "value"], "fp", most).select("path", "value", "block", "part", "fp"))
        else:
            rows = materialize(rows.join(hot, ["path", "value"], "left_semi"))
            made.append(rows)
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    dealt = every.repartition("path", "value", "block").sortWithinPartitions("path", "value", "block", "part", "fp")
    links = materialize(dealt.mapInArrow(by_shard(3, _forests), "a long, b long"))
    for x in made:
        discard(x)
    return links


def component_ids(docs_fp: DataFrame, links: Callable[[DataFrame], DataFrame] = link_forest) -> DataFrame:
    """(fp, low) for each distinct `fp`, from rows (rep, fp): low is the smallest rep of its component.

    links gives the edges between the distinct (fp, rep).
    """
    distinct = materialize(docs_fp.groupBy("fp").agg(F.min("rep").alias("rep")))
    forest = links(distinct)
    labels = materialize(components(forest))
    named = materialize(labels.join(distinct, labels["id"] == distinct["fp"]).select("id", "label", "rep"))
    low = named.groupBy("label").agg(F.min("rep").alias("low"))
    linked = materialize(named.join(low, "label").select("id", "low"))
    out = distinct.join(linked, distinct["fp"] == linked["id"], "left").select(
        "fp", F.when(F.col("id").isNull(), F.col("rep")).otherwise(F.col("low")).alias("low")
    )
    out = materialize(out)
    for x in (forest, labels, named, linked, distinct):
        discard(x)
    return out


def find_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    fps = materialize(map_texts(docs.select(F.col("doc_id").alias("rep"), "text"), _fingerprints, [T.StructField("fp", T.LongType())], keep=["rep"]))
    comp = component_ids(fps).withColumnRenamed("fp", "of")
    return fps.join(comp, fps["fp"] == comp["of"]).select(
        F.col("rep").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("low").alias("component_id")
    )


def shingle_set(text: str | None, words: int = SET_WORDS) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted."""
    parts = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)


def set_key(hashes: np.ndarray) -> int:
    """A hash of the whole set, signed."""
    import xxhash

    return _signed(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))


def minima(hashes: np.ndarray, n: int) -> np.ndarray:
    """The least of each of the first n permutations of a set."""
    low = np.full(n, 2**64 - 1, dtype=np.uint64)
    step = (1 << 19) // n  # bounded memory for very long texts
    for at in range(0, len(hashes), step):
        low = np.minimum(low, (FACTORS[:n] * hashes[at : at + step] + OFFSETS[:n]).min(axis=1))
    return low


def _signatures(texts: list) -> list:
    """The set's key, its size, a key for each group of minima (none for the empty set), its fingerprint."""
    import xxhash

    out: tuple[list, ...] = ([], [], [], [])
    for t in texts:
        s = shingle_set(t)
        low = minima(s, BANDS * ROWS).reshape(BANDS, ROWS)
        keys = [_signed(xxhash.xxh64_intdigest(x.tobytes(), i)) for i, x in enumerate(low)] if len(s) else []
        for column, value in zip(out, (set_key(s), len(s), keys, _signed(majority(iter([s])))), strict=True):
            column.append(value)
    return list(out)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The last four bits of each permutation's least, as words."""
    nibbles = (minima(hashes, SKETCH) & np.uint64(15)).astype(np.uint8)
    return (nibbles[::2] << 4 | nibbles[1::2]).view("<i8")


def sketches(sets: DataFrame) -> DataFrame:
    """(key, sketch) of (key, members)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [sketch(b.column(1)[i].values.to_numpy(zero_copy_only=False).view(np.uint64)) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, type=pa.list_(pa.int64()))], names=["key", "sketch"])

    return sets.select("key", "members").mapInArrow(run, "key long, sketch array<long>")


def _sets(texts: list) -> list:
    sets = [shingle_set(t) for t in texts]
    return [[set_key(s) for s in sets], [s.view(np.int64) for s in sets]]


SIGNATURE = [
    T.StructField("fp", T.LongType()), T.StructField("n", T.LongType()), T.StructField("buckets", T.ArrayType(T.LongType())), T.StructField("sim", T.LongType()),
]


def alike(sizes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether sets of these sizes can have a similarity of 4/5."""
    a, b = sizes
    return 5 * np.minimum(a, b) >= 4 * np.maximum(a, b)


#: Columns of a row in a shard of sets, before those of its sketch.
SET_ROW = ("bucket", "block", "part", "sim", "fp", "n", "label")


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many nibbles of sketches agree."""
    x = a.view(np.uint8) ^ b.view(np.uint8)
    return ((x & 15) == 0).sum(axis=1) + (x < 16).sum(axis=1)


def set_pairs(least: int, forest: bool):
    """Candidates (fp, fp) of shards of sets of different labels whose sketches agree in `least` nibbles; of a forest,
    those that join labels."""

    def run(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = len(SET_ROW)
        fp, n, label, sketch = rows[:, 4], rows[:, 5], rows[:, 6], np.ascontiguousarray(rows[:, k:])
        known, place = np.unique(label, return_inverse=True)
        parent, out_a, out_b = np.arange(len(known)), [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for a, b in near(rows[:, 3].view(np.uint64), shard_numbers(rows, 2), rows[:, 2], WIDE):
            good = (label[a] != label[b]) & alike((n[a], n[b]))
            a, b = a[good], b[good]
            for at in range(0, len(a), 1 << 14):
                p, q = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
                good = agreeing(sketch[p], sketch[q]) >= least
                p, q = p[good], q[good]
                if forest and len(p):
                    # one pair for each two labels that are not yet joined: fewer than labels, as each joins some
                    while len(p):
                        x, y = find(parent, place[p]), find(parent, place[q])
                        apart = x != y
                        p, q, x, y = p[apart], q[apart], x[apart], y[apart]
                        if not len(p):
                            break
                        first = np.unique(np.maximum(x, y), return_index=True)[1]
                        out_a.append(fp[p[first]])
                        out_b.append(fp[q[first]])
                        union(parent, x[first], y[first])
                elif len(p):
                    out_a.append(fp[p])
                    out_b.append(fp[q])
        return np.concatenate(out_a), np.concatenate(out_b)

    return run


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar. Sets move by shuffle, which splits at hot ones, whatever their size."""
    left = sets.select(F.col("key").alias("ka"), F.col("members").alias("sa"))
    right = sets.select(F.col("key").alias("kb"), F.col("members").alias("sb"))
    joined = pairs.join(left.hint("merge"), F.col("a") == F.col("ka")).join(right.hint("merge"), F.col("b") == F.col("kb"))
    both = F.size(F.array_intersect("sa", "sb"))  # both / (a + b - both) >= 4/5
    return joined.where(9 * both >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b")


def meeting(met: DataFrame, labels: DataFrame, drawn: DataFrame, least: int, forest: bool, most: int) -> DataFrame:
    """Candidates (a, b) in shards (bucket, fp) whose sets have different labels: see set_pairs. drawn: (fp, n, sim, sketch)."""
    now = met.join(labels, met["fp"] == labels["id"], "left").select("bucket", met["fp"], F.coalesce("label", "fp").alias("label"))
    now = materialize(now)
    each = now.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("rows"))
    # the commonest label of a bucket, which does not ask, and the bucket's rows
    apart = each.groupBy("bucket").agg(F.max(F.struct("rows", "label")).alias("top"), F.count(F.lit(1)).alias("labels"), F.sum("rows").alias("count"))
    apart = materialize(apart.where("labels > 1").select("bucket", F.col("top.label").alias("common"), "count"))
    rows = now.join(apart.select("bucket", "common"), "bucket").withColumn("part", F.when(F.col("label") == F.col("common"), HELD).otherwise(BOTH)).drop("common")
    few = rows.join(apart.where(F.col("count") <= most).select("bucket"), "bucket", "left_semi").withColumn("block", F.lit(0).cast("long"))
    hot = apart.where(F.col("count") > most).select("bucket", "count")
    names = ["bucket", "block", "part", "fp", "label"]
    dealt = few.select(*names).unionByName(in_blocks(rows, hot, ["bucket"], "fp", most).select(*names))
    dealt = dealt.join(drawn, "fp").select(*SET_ROW, "sketch")
    dealt = dealt.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "part", "sim", "fp")
    pairs = dealt.mapInArrow(by_shard(2, set_pairs(least, forest)), "a long, b long")
    pairs = materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    discard(now)
    discard(apart)
    return pairs


def similar_links(docs: DataFrame, signed: DataFrame, distinct: DataFrame, most: int = SHARD) -> DataFrame:
    """Verified links (a, b) between set keys, whose components are those of all links found.

    docs: (id, h, text); signed: SIGNATURE of each row; distinct: each key as fp, and its smallest (none, id, h) as rep.
    """
    one = materialize(signed.groupBy("fp").agg(*[F.first(f.name).alias(f.name) for f in SIGNATURE[1:]]))
    rows = one.select("fp", F.explode("buckets").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = shared.select(F.col("bucket").alias("of"), "low")
    met = materialize(rows.join(shared.hint("merge"), F.col("bucket") == F.col("of")).select("bucket", "fp", "low"))

    need = met.select(F.col("fp").alias("need")).distinct().join(distinct, F.col("need") == F.col("fp")).select("rep.id", "rep.h")
    need = materialize(need.select(F.col("id").alias("need_id"), F.col("h").alias("need_h")))
    texts = docs.join(need.hint("merge"), docs["id"].eqNullSafe(need["need_id"]) & (docs["h"] == need["need_h"]), "left_semi").select("text")
    fields = [T.StructField("key", T.LongType()), T.StructField("members", T.ArrayType(T.LongType()))]
    sets = materialize(map_texts(texts, _sets, fields, keep=[]).groupBy("key").agg(F.first("members").alias("members")))  # repeated rows give a set again

    size = one.select(F.col("fp").alias("of"), "n")
    first = met.where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()
    first = first.join(size, F.col("a") == F.col("of")).select("a", "b", F.col("n").alias("n2"))
    first = first.join(size, F.col("b") == F.col("of")).where("5 * least(n, n2) >= 4 * greatest(n, n2)").select("a", "b")
    links = materialize(verified(first, sets))
    drawn = materialize(sketches(sets).join(one.select(F.col("fp").alias("key"), "n", "sim"), "key").withColumnRenamed("key", "fp"))
    for least, forest in ((LIKELY, True), (POSSIBLE, False)):
        labels = materialize(components(links))
        pairs = meeting(met, labels, drawn, least, forest, most)
        more = materialize(verified(pairs, sets).unionByName(links))
        for x in (labels, pairs, links):
            discard(x)
        links = more
    for x in (one, met, need, sets, drawn):
        discard(x)
    return links


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each component of similar texts (see above)."""
    rows = row(docs).select("row", F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("h"))
    texts = rows.select("id", "h", F.col("row.text").alias("text"))
    signed = materialize(map_texts(texts, _signatures, SIGNATURE, keep=["id", "h"]))
    rep = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    comp = component_ids(signed.select(rep.alias("rep"), "fp"), lambda distinct: similar_links(texts, signed, distinct))
    keep = materialize(comp.select("low").distinct().select(F.col("low.id").alias("keep_id"), F.col("low.h").alias("keep_h")))
    again = materialize(signed.groupBy("id", "h").count().where("count > 1").select(F.col("id").alias("again_id"), F.col("h").alias("again_h")))
    # always by shuffle, which splits and spills, whatever the tables' sizes: texts move once
    kept = rows.join(keep.hint("merge"), rows["id"].eqNullSafe(keep["keep_id"]) & (rows["h"] == keep["keep_h"]), "left_semi")
    # rows repeated with one id and text are numbered, where there are any: a rare and small table
    is_again = rows["id"].eqNullSafe(again["again_id"]) & (rows["h"] == again["again_h"])
    rest = F.to_json(F.struct(*[F.col(f"row.`{c}`") for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("_")))
    w = Window.partitionBy("id", "h").orderBy(F.xxhash64(rest), rest)
    first = kept.join(again, is_again, "left_semi").withColumn("number", F.row_number().over(w)).where("number = 1").select("row")
    single = kept.join(again, is_again, "left_anti").select("row")
    for x in (signed, comp):
        discard(x)
    return single.unionByName(first).select("row.*")

"""SimHash near-duplicates: fingerprints, exact pairs from vantage-point trees, and their components.

The forest. Cut 64 bits into ``radius + 1`` blocks. Fingerprints within ``radius`` bits differ in at most one
bit on the two blocks where they differ least, so for each pair of blocks there is a tree over the
Hamming distance on those bits, and every wanted pair lies within distance 1 in some tree.

A tree's vantage points. All 64 bits are too many to shard by: distances to a vantage point concentrate
around 32 with a deviation of 4, which is the radius, so a triangle bound there prunes less than half. On a
tree's bits the bound is sharp. They are cut into groups of ``GROUP`` bits, and the vantage point of a group
is the zero word on it: d1, d2, ... are a fingerprint's distances to them. The metric is the sum of the
groups' metrics, so by the triangle inequality, |d1 - e1| + |d2 - e2| + ... <= 1 for every wanted pair.

Shards. A shard is a vector of distances, that is an intersection of rings around the vantage points.
Each fingerprint lives in its home shard. A pair that the bound lets pass has equal vectors, or vectors that
differ by one in one place: then the pair lies across a ring's boundary, and the fingerprint on
its inner side is sent as a query over each boundary to the shard outside, so each pair meets once.

Inside a shard a vantage-point tree over all 64 bits finds the exact pairs: it splits by distance to a
fingerprint and prunes branches whose distances differ by over ``radius``. A shard with more than ``most``
homes is dealt in chunks, and every chunk meets the shard's fingerprints chunk by chunk, so no task sees
an unbounded group. Pairs are joined to a spanning forest as they are found; no list of them is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cleared, durable, map_rows, named
from .components import attach, components

SHINGLE = 4
RADIUS = 4
SEED = 42
MOST_IN_SHARD = 4096
GROUP = 2


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of the shingles of a whole text, one for each place; of all its words if they are fewer, none without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The bits that most of the hashes have, as a signed number."""
    totals = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        totals += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * totals > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a whole text, as a signed number; zero without words."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without its text, with ``fp``; a null text counts as empty."""
    return map_rows(docs, ["text"], "fp long", lambda texts: [[fingerprint(t, shingle) for t in texts]], drop=["text"])


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def vantage_groups(radius: int, group: int = GROUP) -> list[list[int]]:
    """For each tree, the masks of the bit groups around whose zero words its rings lie."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    blocks = [list(range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    if len(blocks) == 1:
        return []
    trees = [x + y for x, y in combinations(blocks, 2)]
    return [[_signed(sum(1 << b for b in bits[k : k + group])) for k in range(0, len(bits), group)] for bits in trees]


def rings(masks: list[int], fp: Column) -> Column:
    """A fingerprint's distances to a tree's vantage points."""
    return F.array(*(F.bit_count(fp.bitwiseAND(F.lit(m))).cast("byte") for m in masks))


def shards(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows of ``fp`` by ``shard``: one at home in each tree (``guest`` false), and one over each outer boundary that a pair may cross."""
    sent = []
    for t, masks in enumerate(vantage_groups(radius)):
        # a vector of distances is one number, in a base above the largest distance
        place = [F.lit((GROUP + 1) ** k).cast("long") for k in range(len(masks))]
        at = [F.bit_count(F.col("fp").bitwiseAND(F.lit(m))).cast("long") for m in masks]
        home = sum((d * p for d, p in zip(at, place, strict=True)), F.lit(t * (GROUP + 1) ** len(masks)).cast("long"))
        most = [bin(m % (1 << 64)).count("1") for m in masks]
        over = [F.when(d < n, F.col("home") + p) for d, p, n in zip(at, place, most, strict=True)]
        homes = fps.select("fp", home.alias("home"))
        both = F.concat(F.array(F.struct(F.col("home").alias("shard"), F.lit(False).alias("guest"))), F.transform(F.filter(F.array(*over), lambda s: s.isNotNull()), lambda s: F.struct(s.alias("shard"), F.lit(True).alias("guest"))))
        sent.append(homes.select("fp", F.explode(both).alias("s")).select("fp", "s.shard", "s.guest"))
    out = sent[0] if sent else fps.select("fp", F.lit(0).cast("long").alias("shard"), F.lit(False).alias("guest")).limit(0)
    for more in sent[1:]:
        out = out.union(more)
    return out


SCANNED = 1 << 16


def tree_pairs(a: np.ndarray, b: np.ndarray, radius: int, depth: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in ``a`` and ``b`` of all pairs within ``radius`` bits, found down a vantage-point tree, some at a time."""
    if not len(a) or not len(b):
        return
    if len(a) * len(b) <= SCANNED or depth == 8:
        step = max(1, (1 << 20) // len(b))
        for k in range(0, len(a), step):
            x, y = np.nonzero(np.bitwise_count(a[k : k + step, None] ^ b[None, :]) <= radius)
            yield x + k, y
        return
    vantage = a[len(a) // 2]
    da, db = np.bitwise_count(a ^ vantage).astype(int), np.bitwise_count(b ^ vantage).astype(int)
    for g in np.unique(da):
        mine, near = np.flatnonzero(da == g), np.flatnonzero(np.abs(db - g) <= radius)
        for x, y in tree_pairs(a[mine], b[near], radius, depth + 1):
            yield mine[x], near[y]


class Forest:
    """Least positions joined by pairs, as pairs come."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[x], label[y]
            open_ = a != b
            if not open_.any():
                return
            x, y, a, b = x[open_], y[open_], a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                after = label[label]
                if (after == label).all():
                    break
                label[:] = after


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least position each of ``n`` positions is joined to by the pairs."""
    out = Forest(n)
    out.join(x, y)
    return out.label


def unit_edges(keys: np.ndarray, fps: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the pairs within ``radius`` bits in each run of equal ``keys``, of which one at least is ``home``.

    Runs of up to 64 are compared all at once, by distance along the run; larger ones each through a tree.
    """
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(starts, append=len(keys))
    found = Forest(len(fps))
    small = np.repeat(sizes <= 64, sizes)
    for s in range(1, int(min(64, sizes.max()))):
        x = np.flatnonzero((keys[s:] == keys[:-s]) & small[s:] & (home[s:] | home[:-s]))
        x = x[np.bitwise_count(fps[x] ^ fps[x + s]) <= radius]
        found.join(x, x + s)
    for start, size in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
        own = np.arange(start, start + size)
        homes = own[home[start : start + size]]
        for x, y in tree_pairs(fps[homes], fps[own], radius):
            found.join(homes[x], own[y])
    linked = np.flatnonzero(found.label != np.arange(len(fps)))
    return fps[linked], fps[found.label[linked]]


def links(fps: DataFrame, radius: int = RADIUS, most: int = MOST_IN_SHARD) -> DataFrame:
    """Edges ``a``, ``b`` that join exactly the distinct fingerprints of column ``fp`` that pairs within ``radius`` join."""
    sent = shards(fps, radius)
    heavy = sent.where("not guest").groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > most)
    heavy = durable(heavy.select("shard", F.ceil(F.col("n") / most).cast("int").alias("chunks")), "heavy-shards")
    # chunks of a heavy shard meet two by two: homes of one chunk as homes, all others as guests
    dealt = sent.join(F.broadcast(heavy) if heavy.count() <= 10_000 else heavy, "shard", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine = F.pmod(F.xxhash64(F.lit(3), "fp"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    units = dealt.select("fp", "shard", "guest", "chunks", mine.alias("mine"), other.alias("other"))
    # a home meets the guests and the homes of later chunks where it is at home
    met = units.where("guest or mine >= other")
    units = met.select("fp", F.xxhash64("shard", "other", F.when(F.col("chunks") > 1, F.col("mine"))).alias("unit"), (~F.col("guest") & (F.col("mine") == F.col("other"))).alias("home"))
    lone = F.when(F.col("chunks") > 1, F.col("mine"))
    ahead = dealt.where("chunks > 1 and not guest").select("fp", "shard", "chunks", mine.alias("other"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("mine"))
    ahead = ahead.where("mine <> other").select("fp", F.xxhash64("shard", "other", lone).alias("unit"), F.lit(True).alias("home"))
    units = units.union(ahead)

    def run(batches):
        import pyarrow as pa

        keys, fps, home = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)

        def edges(upto):
            a, b = unit_edges(keys[:upto], fps[:upto], home[:upto], radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, np.asarray(batch.column("unit"))])
            fps = np.concatenate([fps, np.asarray(batch.column("fp")).view(np.uint64)])
            home = np.concatenate([home, batch.column("home").to_numpy(zero_copy_only=False)])
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if whole:
                yield from edges(whole)
                keys, fps, home = keys[whole:], fps[whole:], home[whole:]
        if len(keys):
            yield from edges(len(keys))

    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, ``fp`` and ``component_id`` of every row of ``docs``, which needs doc_id and text.

    Other columns are left out. A component's id is its least doc_id; null ids are ignored for it, and a
    component of null ids alone has a null id. Equal texts and repeated rows share a fingerprint; null,
    empty and wordless texts have fingerprint zero. Whole texts of any length count. An empty table
    gives no row.
    """
    with cleared() as keep:
        found = durable(fingerprints(docs.select("doc_id", "text"), shingle), "fingerprints")
        distinct = durable(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
        out = durable(assign(found, distinct, links(distinct, radius), "fp").select("doc_id", "fp", "component_id"), "near-duplicates")
        keep(out)
    return out


def assign(found: DataFrame, distinct: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """``found`` with ``component_id``: the ``least`` of all keys that ``edges`` join to a row's ``key``; ``distinct`` has one row a key."""
    stars = durable(components(durable(edges, "links")), "stars")
    roots = stars.join(distinct, stars["node"] == distinct[key]).groupBy("root").agg(F.min("least").alias("component"))
    joined = attach(stars, "root", durable(roots, "roots"), F.xxhash64("node")).select("node", "component")
    by = distinct.join(joined, distinct[key] == joined["node"], "left").select(key, F.coalesce("component", "least").alias("component_id"))
    return attach(found, key, durable(by, "component-of-fingerprint"), F.xxhash64("doc_id"))


def keep_one(docs: DataFrame, find=near_duplicates, **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: its least doc_id, and of rows with that id the first by the other columns, as JSON.

    ``find`` gives doc_id and ``component_id``. A row with a null id stays: nothing tells it from other
    rows. Columns of ``docs``, of any names and types, are kept as they are; an empty table gives no row.
    """
    found = find(docs, **options)
    least = found.where("doc_id = component_id").select("doc_id").distinct().withColumnRenamed("doc_id", "kept_id")
    whole = F.struct(*(named(c).alias(f"c{n}") for n, c in enumerate(docs.columns)))
    rows = docs.select("doc_id", whole.alias("row"))
    kept = rows.join(least, rows["doc_id"] == least["kept_id"], "left_semi")
    order = Window.partitionBy("doc_id").orderBy(F.to_json("row"))
    kept = kept.withColumn("keep_rank", F.row_number().over(order)).where("keep_rank = 1").union(rows.where("doc_id is null").withColumn("keep_rank", F.lit(1)))
    return kept.select(*(F.col("row")[f"c{n}"].alias(c) for n, c in enumerate(docs.columns)))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

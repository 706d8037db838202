"""Near-duplicates by exact Jaccard similarity of shingle sets, over candidates from a vantage-point forest on SimHashes.

Texts with equal shingle sets share a key and are one node, with a SimHash of 64 bits and a longer one of ``TREES``
words of ``BITS`` bits. At a similarity of 0.8 about 10 of 64 bits differ, too many for op9's trees on pairs of blocks; so
each tree here has bits of its own, those of one word of the longer SimHash.

The forest. A tree's vantage points are the zero words on each of its bits, a shard is a vector of distances to
them, and the metric is the sum over bits. Each node lives in its home shard and is sent as a query over each outer
boundary that a node within distance 1 may lie behind, so all pairs within distance 1 on a tree's bits meet, once.
Two texts at 0.8 differ in 15 % of the bits and are within 1 in 28 % of the trees, so 28 trees leave out 1 pair in 10,000,
and fewer of more alike ones. Of two alike sets with at most ``SMALL`` shingles in all one has a shingle more than the
other; SimHashes of so few are coarse, and such pairs are found exactly, by the sets that a shingle less leaves.

Inside a shard a vantage-point tree over the 64 bits finds the pairs within ``RADIUS`` bits, which leaves out under 1 in
1,000 at 0.8. Pairs that differ in more than ``FAR`` bits of the longer SimHash go; a pair at 0.8 differs in 68 of 448 with
a deviation of 8, unlike ones in 224 with one of 11. Every other candidate pair is decided on the shingle sets.

Pairs are tried in two steps, so that a group of copies costs no square of its size: first
neighbours in each home shard's order of fingerprints, then every pair whose ends the first step has not joined.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cleared, durable, forget, released
from .components import components
from .simhash import assign, majority, shingle_hashes, tree_pairs

SHINGLE = 5
LEAST = 0.8
TREES, BITS = 28, 16
RADIUS = 20
SMALL = 9
FAR = 125
MOST_IN_UNIT = 1024
TREES_AT_ONCE = 7  # so that shuffles of one part are on disk at a time
_MULTIPLY = np.random.default_rng(11).integers(0, 1 << 63, TREES * BITS // 64, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(12).integers(0, 1 << 63, TREES * BITS // 64, np.uint64)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def _key(own: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).view(np.int64))


def long_simhash(own: np.ndarray) -> np.ndarray:
    """The SimHash of a shingle set in ``TREES * BITS`` bits, as signed numbers; zeros for an empty set."""
    totals = np.zeros(TREES * BITS, np.int64)
    for k in range(0, len(own), 255):  # as many ones as a byte counts
        mixed = own[k : k + 255, None] * _MULTIPLY + _ADD
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        totals += np.add.reduce(np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * totals > len(own), bitorder="little").view(np.int64)


def without_one(own: np.ndarray) -> list[int]:
    """Keys of the sets that a small shingle set leaves without one of its shingles; none for a larger one, or if they are too unlike it."""
    return [_key(np.delete(own, k)) for k in range(len(own))] if len(own) <= SMALL and len(own) - 1 >= LEAST * len(own) else []


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of two shingle sets; 1 for two empty ones."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - shared
    return shared / union if union else 1.0


def _signed(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        forget()
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch, rows = whole.slice(k, 512), []
                for text in batch.column("text").to_pylist():
                    own = shingle_set(text, shingle)
                    rows.append((_key(own), majority(own), long_simhash(own), without_one(own)))
                key, fp, sig, less = zip(*rows, strict=True)
                arrays = [pa.array(key, pa.int64()), pa.array(fp, pa.int64()), pa.array(sig, pa.list_(pa.int64())), pa.array(less, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), *arrays], names=["doc_id", "text", "key", "fp", "sig", "less"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda batches: released(run(batches)), f"doc_id {id_type}, text string, key long, fp long, sig array<long>, less array<long>")


def _home(tree: int) -> Column:
    """A node's home shard in a tree: the vector of its distances to the tree's vantage points, one bit each."""
    at = BITS * tree
    return F.shiftrightunsigned(F.col("sig")[at // 64], at % 64).bitwiseAND(F.lit((1 << BITS) - 1)) + F.lit(tree << BITS).cast("long")


def homes(nodes: DataFrame, trees: range = range(TREES)) -> DataFrame:
    """``nodes`` without ``sig``, once for each tree, with their ``home`` shards."""
    return nodes.select(*(c for c in nodes.columns if c != "sig"), F.explode(F.array(*map(_home, trees))).alias("home"))


def shards(nodes: DataFrame, trees: range = range(TREES)) -> DataFrame:
    """Rows of ``nodes`` by ``shard``: one at home in each tree, and one, a guest, over each outer boundary that a pair may cross."""
    over = [F.when(F.col("home").bitwiseAND(F.lit(1 << k)) == 0, F.col("home") + F.lit(1 << k)) for k in range(BITS)]
    sent = homes(nodes, trees).select("*", F.explode(F.array("home", *over)).alias("shard")).where("shard is not null")
    return sent.withColumn("at_home", F.col("shard") == F.col("home")).drop("home")


def heavy_shards(nodes: DataFrame) -> DataFrame:
    """Shards with more than ``MOST_IN_UNIT`` homes, and the number of chunks they are dealt in."""
    per = homes(nodes.select("sig")).groupBy(F.col("home").alias("heavy_shard")).agg(F.count("*").alias("n")).where(F.col("n") > MOST_IN_UNIT)
    return per.select("heavy_shard", F.ceil(F.col("n") / MOST_IN_UNIT).cast("int").alias("chunks"))


def _dealt(rows: DataFrame, shard: str, heavy: DataFrame) -> DataFrame:
    """``rows`` with the number of ``chunks`` of their shard, and the chunk that is ``mine``."""
    few = F.broadcast(heavy) if heavy.count() <= 10_000 else heavy
    known = rows.join(few, rows[shard] == heavy["heavy_shard"], "left").drop("heavy_shard").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    return known.withColumn("mine", F.pmod(F.xxhash64(F.lit(3), "key"), F.col("chunks")).cast("int"))


def neighbours(nodes: DataFrame, heavy: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Candidates ``a``, ``b`` that follow one another in a home shard's order of fingerprints, which each tree reads from another bit on."""
    turn = (F.shiftright("home", BITS) * F.lit(64 // TREES)).cast("int")
    turned = F.expr("shiftleft(fp, turn) | shiftrightunsigned(fp, 64 - turn)")
    sent = _dealt(homes(nodes.select("key", "fp", "sig")), "home", heavy).withColumn("turn", turn)
    order = Window.partitionBy("home", "mine").orderBy(turned, "key")
    pairs = sent.select(F.col("key").alias("a"), F.lead("key").over(order).alias("b"), F.bit_count(F.col("fp").bitwiseXOR(F.lead("fp").over(order))).alias("bits"))
    return pairs.where(F.col("bits") <= radius).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def small_pairs(nodes: DataFrame) -> DataFrame:
    """Candidates ``a``, ``b`` among small sets: one is the other without a shingle."""
    less = nodes.select(F.col("key").alias("whole"), F.explode("less").alias("part")).join(nodes.select(F.col("key").alias("part")), "part")
    return less.select(F.greatest("whole", "part").alias("a"), F.least("whole", "part").alias("b"))


def _unit_pairs(unit: np.ndarray, key: np.ndarray, fp: np.ndarray, part: np.ndarray, home: np.ndarray, radius: int):
    """Keys of all pairs within ``radius`` bits in each run of equal ``unit``, of different parts, of which one at least is ``home``.

    Runs of up to 64 are compared all at once, by distance along the run; larger ones each through a tree.
    """
    starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    sizes = np.diff(starts, append=len(unit))
    small = np.repeat(sizes <= 64, sizes)

    def wanted(x, y):
        keep = (part[x] != part[y]) & (home[x] | home[y])
        a, b = key[x[keep]], key[y[keep]]
        return np.maximum(a, b), np.minimum(a, b)

    for s in range(1, int(min(64, sizes.max()))):
        x = np.flatnonzero((np.bitwise_count(fp[s:] ^ fp[:-s]) <= radius) & (unit[s:] == unit[:-s]) & small[s:])
        yield wanted(x, x + s)
    for start, size in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
        own = np.arange(start, start + size)
        at_home = own[home[start : start + size]]
        if len(at_home) and (part[own] != part[at_home[0]]).any():
            for x, y in tree_pairs(fp[at_home], fp[own], radius):
                yield wanted(at_home[x], own[y])


def _crossing(nodes: DataFrame, heavy: DataFrame, trees: range, radius: int) -> DataFrame:
    dealt = _dealt(shards(nodes.select("key", "fp", "component", "sig"), trees), "shard", heavy)
    # a chunk of a heavy shard's homes meets all guests, and the homes of later chunks
    units = F.expr("""CASE WHEN chunks = 1 THEN array(struct(shard AS unit, at_home AS home)) WHEN at_home THEN concat(
        transform(sequence(0, chunks - 1), j -> struct(xxhash64(shard, mine, j) AS unit, true AS home)),
        transform(filter(sequence(0, chunks - 1), i -> i < mine), i -> struct(xxhash64(shard, i, mine) AS unit, false AS home)))
        ELSE transform(sequence(0, chunks - 1), i -> struct(xxhash64(shard, i, mine) AS unit, false AS home)) END""")
    if heavy.isEmpty():
        units = dealt.select(F.col("shard").alias("unit"), "key", "fp", "component", F.col("at_home").alias("home"))
    else:
        units = dealt.select("key", "fp", "component", F.explode(units).alias("u")).select("u.unit", "key", "fp", "component", "u.home")

    def run(batches):
        import pyarrow as pa

        held = [np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64, bool)]

        def pairs(rows):
            for a, b in _unit_pairs(*rows, radius):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            fresh = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "key", "fp", "component", "home")]
            fresh[2] = fresh[2].view(np.uint64)
            held = [np.concatenate(p) for p in zip(held, fresh, strict=True)]
            whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if whole:
                yield from pairs([h[:whole] for h in held])
                held = [h[whole:] for h in held]
        if len(held[0]):
            yield from pairs(held)

    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(lambda batches: released(run(batches)), "a long, b long").distinct()


def crossing(nodes: DataFrame, heavy: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All candidates ``a``, ``b`` whose components differ: pairs that meet in a shard of some tree."""
    parts = [durable(_crossing(nodes, heavy, range(k, min(TREES, k + TREES_AT_ONCE)), radius), "crossing-part") for k in range(0, TREES, TREES_AT_ONCE)]
    found = parts[0]
    for more in parts[1:]:
        found = found.union(more)
    return found.distinct()


def nearer(pairs: DataFrame, nodes: DataFrame, far: int = FAR) -> DataFrame:
    """The pairs whose longer SimHashes differ in at most ``far`` bits."""
    both = pairs.join(nodes.select(F.col("key").alias("a"), F.col("sig").alias("sig_a")), "a").join(nodes.select(F.col("key").alias("b"), F.col("sig").alias("sig_b")), "b")
    bits = sum((F.bit_count(F.col("sig_a")[k].bitwiseXOR(F.col("sig_b")[k])) for k in range(TREES * BITS // 64)), F.lit(0))
    return both.where(bits <= far).select("a", "b")


def similar(pairs: DataFrame, found: DataFrame, least: float = LEAST, shingle: int = SHINGLE) -> DataFrame:
    """The pairs whose shingle sets are alike by ``least`` or more; each key's text comes from ``found``."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    texts = durable(found.select("key", "text").join(wanted, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")), "candidate-texts")
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                sides = zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True)
                yield batch.select(["a", "b"]).filter(pa.array([jaccard(shingle_set(x, shingle), shingle_set(y, shingle)) >= least for x, y in sides], pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(lambda batches: released(run(batches)), "a long, b long")


def near_duplicates(docs: DataFrame, least: float = LEAST, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and ``component_id`` of every row of ``docs``: components of texts alike by ``least`` or more.

    A component's id is its least doc_id; null ids are ignored for it. Texts without words are all alike.
    Repeated rows share a key; an empty table gives no row.
    """
    with cleared() as keep:
        out = durable(_near_duplicates(docs, least, shingle), "near-duplicates")
        keep(out)
    return out


def _near_duplicates(docs: DataFrame, least: float, shingle: int) -> DataFrame:
    found = durable(_signed(docs, shingle), "signatures")
    nodes = durable(found.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("sig").alias("sig"), F.first("less").alias("less")), "nodes")
    heavy = durable(heavy_shards(nodes), "heavy-shards")
    tried = durable(nearer(neighbours(nodes, heavy), nodes).union(small_pairs(nodes)).distinct(), "neighbours")
    first = durable(similar(tried, found, least, shingle), "similar-neighbours")
    stars = durable(components(first), "first-stars")
    met = nodes.join(stars, nodes["key"] == stars["node"], "left").select("key", "fp", "sig", F.coalesce("root", "key").alias("component"))
    met = durable(met, "met")
    rest = durable(similar(durable(nearer(crossing(met, heavy), nodes), "crossing"), found, least, shingle), "similar-crossing")
    return assign(found.select("doc_id", "key"), nodes, first.union(rest), "key").select("doc_id", "component_id")

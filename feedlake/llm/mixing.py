"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source has an exact quota of words beyond whole repeats. Its documents lie in blocks, by a hash of
their ids. A splitting tree halves the blocks again and again and draws how much of a node's quota its
left half gets, hypergeometrically: just as if the quota's words had been drawn without replacement
from all the source's words. Leaves are exact block quotas that sum to the source's. Within a block,
documents come in permuted order and are taken while they fit; then one more is, if that comes nearer to
the quota. What a block leaves or takes too much is carried on to the next block of its run of
``RUN_BLOCKS``, so a source's words end as near its target as one of its documents allows. The tree's
upper part, over a source's runs, is computed in a task of each source's own; the lower part, within
a run, where the run's documents are.

Output shards are filled the same way: a tree over shards splits every source's block counts
(multivariate hypergeometric over the sources), and each shard gets the next disjoint run of each
source's permuted blocks. Each repeat of a source, a layer, is dealt on its own, so the copies of one
document mostly lie in different shards. ``position`` is a document's place in its shard's shuffled order.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_unit, named, released

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 2.0
SHARE = 1.5
BLOCK_DOCS = 128
RUN_BLOCKS = 16
SHARDS = 16
MOST_SOURCES = 1_000_000  # a limit: sources are the mixture's components, and more of them are an error
_EXACT = 900_000_000  # numpy draws exactly below this; larger nodes are drawn in units of their words, see _hypergeometric


def word_count(text: str = "text"):
    """Runs of characters other than space, tab and line ends; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sizes: np.ndarray, weights: np.ndarray, total: float, most_repeats: float = MOST_REPEATS) -> np.ndarray:
    """Shares of ``total`` by weight, none above ``most_repeats`` times its size; what a capped one leaves is shared anew."""
    target, capped = np.zeros(len(sizes)), np.zeros(len(sizes), bool)
    limit = most_repeats * sizes
    total = min(total, limit.sum())
    while not capped.all():
        free = total - limit[capped].sum()
        target[~capped] = weights[~capped] / weights[~capped].sum() * free
        over = ~capped & (target > limit)
        if not over.any():
            break
        capped |= over
    target[capped] = limit[capped]
    return target


def _rng(*key: object) -> np.random.Generator:
    return np.random.default_rng(zlib.crc32(repr(key).encode("utf-8", "surrogatepass")))


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` units fall among ``good`` ones, without replacement.

    numpy draws populations below ``_EXACT``. A larger one is drawn in halves of the sample: each half is a
    beta-distributed share of what is left to draw, which is the law of order statistics of a
    permuted population, so that no size takes a normal curve for the distribution.
    """
    low, high = max(0, drawn - bad), min(good, drawn)
    if low >= high:
        return low
    if good + bad < _EXACT:
        return int(rng.hypergeometric(good, bad, drawn))
    # the place, among good + bad + 1 gaps, of the middle good unit in a random order of all
    middle = (good + 1) // 2
    place = middle + _beta_binomial(rng, bad, middle, good + 1 - middle)
    if place > drawn:  # fewer than ``middle`` good ones are drawn: they lie before its place
        return _hypergeometric(rng, middle - 1, place - middle, drawn)
    return middle + _hypergeometric(rng, good - middle, good + bad - place - (good - middle), drawn - place)


def _beta_binomial(rng: np.random.Generator, n: int, a: int, b: int) -> int:
    """How many of ``n`` bad units come before the ``a``-th of ``a + b - 1`` good ones in a random order."""
    return int(rng.binomial(n, rng.beta(a, b)))


def split_quota(amounts: list[int], quota: int, *key: object) -> list[int]:
    """``quota`` of the units in ``amounts``, split over them by a tree of hypergeometric draws; sums to ``quota``."""
    before = np.concatenate([[0], np.cumsum(np.array(amounts, dtype=object))])
    out, todo = [0] * len(amounts), [(0, len(amounts), quota)]
    while todo:
        lo, hi, q = todo.pop()
        if hi - lo == 1:
            out[lo] = q
        elif hi > lo:
            mid = (lo + hi) // 2
            left = _hypergeometric(_rng(*key, lo, hi), int(before[mid] - before[lo]), int(before[hi] - before[mid]), q)
            todo += [(lo, mid, left), (mid, hi, q - left)]
    return out


def split_sources(counts: list[int], shards: int, *key: object) -> list[list[int]]:
    """How many units of each source each shard gets; shards' totals differ by one at most."""
    total = sum(counts)
    room = [total * (k + 1) // shards - total * k // shards for k in range(shards)]
    out: list[list[int]] = [[] for _ in range(shards)]
    todo = [(0, shards, list(counts))]
    while todo:
        lo, hi, have = todo.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid = (lo + hi) // 2
        left, drawn, rest = [], sum(room[lo:mid]), sum(have)
        for s, n in enumerate(have):  # one source after another: a multivariate draw from hypergeometric ones
            rest -= n
            got = _hypergeometric(_rng(*key, lo, hi, s), n, rest, drawn)
            left.append(got)
            drawn -= got
        todo += [(lo, mid, left), (mid, hi, [a - b for a, b in zip(have, left, strict=True)])]
    return out


def _code_points(name: str | None) -> tuple:
    return (1,) if name is None else (0, [ord(c) for c in name])


def take_block(sizes: np.ndarray, quota: int) -> np.ndarray:
    """Which documents of a block, in permuted order, are taken: those that fit, and one more or one less where that comes nearer to ``quota``."""
    taken, room = np.zeros(len(sizes), bool), quota
    for n, size in enumerate(sizes):
        if 0 < size <= room:
            taken[n] = True
            room -= size
    rest = np.flatnonzero(~taken & (sizes > 0))
    if room > 0 and len(rest):
        best = rest[np.argmin(np.abs(sizes[rest] - room))]
        taken[best] = abs(int(sizes[best]) - room) < room
    elif room < 0 and taken.any():
        own = np.flatnonzero(taken)
        best = own[np.argmin(np.abs(sizes[own] + room))]
        taken[best] = not abs(int(sizes[best]) + room) < -room
    return taken


def _split_runs(amounts: list[int], quota: int, per_shard: list[list[int]], seed: int, number: int) -> tuple[list[int], list[list[list[int]]]]:
    """A source's quota and its blocks' numbers by shard, split over its runs: quotas, and for each run and layer a number for each shard."""
    quotas = split_quota(amounts, quota, seed, number)
    dealt: list[list[list[int]]] = [[] for _ in amounts]
    for layer, counts in enumerate(per_shard):
        rng, left = _rng(seed, "blocks", number, layer), np.array(counts, np.int64)
        for k in range(len(amounts)):
            own = rng.multivariate_hypergeometric(left, RUN_BLOCKS) if k + 1 < len(amounts) else left
            left = left - own
            dealt[k].append(own.tolist())
    return quotas, dealt


def _take_run(block: np.ndarray, sizes: np.ndarray, quota: int, per_shard: list[list[int]], *key: object) -> tuple[np.ndarray, np.ndarray]:
    """Which documents of a run are taken once more, and the shard of each in each layer; rows come by block in permuted order."""
    amounts = np.bincount(block, sizes, RUN_BLOCKS).astype(np.int64)
    quotas = split_quota(amounts.tolist(), quota, *key)
    edges, extra, carry = np.searchsorted(block, np.arange(RUN_BLOCKS + 1)), np.zeros(len(block), bool), 0
    for b in range(RUN_BLOCKS):
        lo, hi = edges[b], edges[b + 1]
        asked = quotas[b] + carry
        extra[lo:hi] = take_block(sizes[lo:hi], asked)
        carry = asked - int(sizes[lo:hi][extra[lo:hi]].sum())
    if carry > 0:  # the run as a whole may still come nearer by one document
        rest = np.flatnonzero(~extra & (sizes > 0))
        if len(rest) and abs(int(sizes[best := rest[np.argmin(np.abs(sizes[rest] - carry))]]) - carry) < carry:
            extra[best] = True
    shards = np.empty((len(block), len(per_shard)), np.int32)
    for layer, counts in enumerate(per_shard):
        own = np.repeat(np.arange(len(counts)), counts)
        shards[:, layer] = _rng(*key, "places", layer).permutation(own)[block]
    return extra, shards


def _local(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """``rows`` as a table, through Arrow: from a plain list Spark would read them in Python, in workers of a second pool that idle on for a minute."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    schema = T.StructType.fromDDL(ddl)
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    arrays = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=schema.names), schema)


def _decided(docs: DataFrame, row: Column | None, share: float, weights: tuple[float, ...], most_repeats: float, seed: int, shards: int) -> DataFrame:
    """Every row with its size, target, ``full`` and ``extra`` copies and ``layers`` of shards, and ``row`` as given."""
    spark = docs.sparkSession
    columns = [F.col("doc_id"), F.col("source"), word_count().alias("size")]
    per = docs.select(*columns).groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(per) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources to mix")
    per.sort(key=lambda r: _code_points(r["source"]))
    sizes = np.array([float(r["words"]) for r in per])
    cycle = np.array([weights[k % len(weights)] for k in range(len(per))])
    target = water_fill(sizes, cycle, share * sizes.sum(), most_repeats) if len(per) else np.zeros(0)
    plan = []
    for k, r in enumerate(per):
        ratio = min(target[k] / sizes[k], most_repeats) if sizes[k] else 0.0
        full = int(ratio + 1e-12)
        runs = max(1, -(-r["n"] // (BLOCK_DOCS * RUN_BLOCKS)))  # a hot source has more runs, not larger ones
        plan.append([k, r["source"], int(r["words"]), float(target[k]), runs, full, max(0, round(target[k] - full * sizes[k]))])
    layers = max((p[5] + 1 for p in plan), default=1)
    dealt = [split_sources([p[4] * RUN_BLOCKS for p in plan], shards, seed, "shards", layer) for layer in range(layers)]
    rows = [(*p, [[int(q[k]) for q in layer] for layer in dealt[: p[5] + 1]]) for k, p in enumerate(plan)]
    told = _local(spark, rows, "number int, p_source string, source_size long, target double, runs int, full int, quota long, per_shard array<array<int>>")
    small = len(rows) <= 10_000

    def known(rows: DataFrame, *wanted: str) -> DataFrame:
        right = told.select("p_source", *wanted)
        return rows.join(F.broadcast(right) if small else right, rows["source"].eqNullSafe(right["p_source"])).drop("p_source")

    spot = F.floor(hash_unit("doc_id", seed=seed) * F.col("runs") * RUN_BLOCKS)
    placed = [F.floor(spot / RUN_BLOCKS).cast("int").alias("run"), (spot % RUN_BLOCKS).cast("int").alias("block")]
    narrow = known(docs.select(*columns), "number", "runs", "quota", "per_shard").select("number", "runs", "quota", "per_shard", "size", *placed)
    amounts = narrow.groupBy("number", "run").agg(F.sum("size").alias("words"), *(F.any_value(c).alias(c) for c in ("runs", "quota", "per_shard")))

    def split(key, table):
        import pyarrow as pa

        number, of = key[0].as_py(), {c: table.column(c)[0].as_py() for c in ("runs", "quota", "per_shard")}
        words = [0] * of["runs"]
        for r, w in zip(table.column("run").to_pylist(), table.column("words").to_pylist(), strict=True):
            words[r] = w
        quotas, per_shard = _split_runs(words, of["quota"], of["per_shard"], seed, number)
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.list_(pa.int32())))
        return pa.table([pa.array(c, t) for c, t in zip(([number] * len(words), list(range(len(words))), quotas, per_shard), kinds, strict=True)], names=["number", "run", "run_quota", "run_shards"])

    quotas = amounts.groupBy("number").applyInArrow(split, "number int, run int, run_quota long, run_shards array<array<int>>")
    wide = known(docs.select(*columns, *([row.alias("row")] if row is not None else [])), "number", "runs", "source_size", "target", "full").withColumns({"run": placed[0], "block": placed[1]})
    # a run's quota goes before its documents, so that one shuffle brings both together
    every = wide.drop("runs").unionByName(quotas.withColumn("block", F.lit(-1)), allowMissingColumns=True)
    ordered = every.repartition("number", "run").sortWithinPartitions("number", "run", "block", F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size")
    names = ["doc_id", "source", "size", "source_size", "target", "full", *(["row"] if row is not None else [])]
    ordered = ordered.select("number", "run", "block", "run_quota", "run_shards", *names)
    schema = T.StructType([*(ordered.schema[n] for n in names), T.StructField("extra", T.BooleanType()), T.StructField("layers", T.ArrayType(T.IntegerType()))])

    def flush(parts):
        import pyarrow as pa

        head = parts[0]
        number, run, quota, per_shard = (head.column(c)[0].as_py() for c in ("number", "run", "run_quota", "run_shards"))
        parts = [parts[0].slice(1), *parts[1:]]
        block, sizes = (np.concatenate([np.asarray(p.column(c)) for p in parts]) for c in ("block", "size"))
        extra, places = _take_run(block.astype(np.int64), sizes.astype(np.int64), quota, per_shard, seed, number, run)
        at = 0
        for p in parts:
            own = slice(at, at + p.num_rows)
            if p.num_rows:
                yield pa.RecordBatch.from_arrays([*(p.column(c) for c in names), pa.array(extra[own]), pa.array(list(places[own]), pa.list_(pa.int32()))], names=[*names, "extra", "layers"])
            at += p.num_rows

    def run(batches):
        pending = []
        for batch in batches:
            starts = np.flatnonzero(np.asarray(batch.column("block")) == -1).tolist()
            for a, b in zip([0, *starts], [*starts, batch.num_rows], strict=True):
                if a in starts and pending:
                    yield from flush(pending)
                    pending = []
                if b > a:
                    pending.append(batch.slice(a, b - a))
        if pending:
            yield from flush(pending)

    return ordered.mapInArrow(lambda batches: released(run(batches)), schema)


_COPIES = "CASE WHEN size > 0 THEN full + CAST(extra AS INT) ELSE 0 END"


def mix_sizes(docs: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, most_repeats: float = MOST_REPEATS, seed: int = 7, shards: int = SHARDS) -> DataFrame:
    """How often each row of ``docs`` is taken and where to: doc_id, source, ``size``, ``source_size``, ``target``, ``taken``, ``copies``, ``shards``, ``positions``.

    ``docs`` needs doc_id, text and source; other columns are left out, texts too. Documents are taken
    whole: ``taken`` is ``copies`` times ``size``, and ``shards`` and ``positions`` have an entry for each
    copy. A null source is a source of its own, sorted last. Sizes 0 (null or blank texts) take nothing.
    Rows with equal ids share a block and are still told apart; of equal rows any is taken first. A
    text's length is no matter; an empty table gives no row. Sources are the mixture's components: a
    row for each goes to the driver, and over ``MOST_SOURCES`` of them is an error; runs and blocks,
    whose number grows with the documents, stay in tables.
    """
    found = _decided(docs, None, share, weights, most_repeats, seed, shards)
    copies, every = F.expr(_COPIES), F.slice("layers", F.lit(1), F.expr(f"least({_COPIES}, full)"))
    # the last layer is the extra copy's
    spots = F.when(F.col("size") <= 0, F.array().cast("array<int>")).when(F.col("extra"), F.slice("layers", F.lit(1), F.col("full") + 1)).otherwise(every)
    out = found.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.alias("copies"), spots.alias("shards"))
    return out.withColumn("positions", F.transform("shards", lambda s, n: F.xxhash64(F.lit(seed + 2), n, F.col("doc_id"))))


def mix(docs: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, most_repeats: float = MOST_REPEATS, seed: int = 7, shards: int = SHARDS) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with ``copy``, ``shard`` and ``position``, in shuffled order within each shard.

    Columns of ``docs`` by those three names are replaced; others, of any names and types, pass through.
    Decisions are those of ``mix_sizes``; a row that is not taken, a null or blank text, goes. Rows lie by
    shard and by equal ranges of ``position`` and are sorted by it, so a shard read in file order is shuffled.
    """
    own = ("copy", "shard", "position")
    kept = [f.name for f in docs.schema.fields if f.name.lower() not in own]
    row = F.struct(*(named(c).alias(f"c{n}") for n, c in enumerate(kept)))
    found = _decided(docs, row, share, weights, most_repeats, seed, shards).where(f"{_COPIES} > 0")
    copies = F.explode(F.sequence(F.lit(0), F.expr(_COPIES) - 1)).alias("copy")
    taken = found.select("row", "doc_id", "layers", copies).withColumn("shard", F.get("layers", F.col("copy")))
    taken = taken.withColumn("position", F.xxhash64(F.lit(seed + 2), "copy", "doc_id"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, tasks // shards)
    part = F.shiftrightunsigned(F.col("position"), 33) % ranges
    dealt = taken.repartition("shard", part).sortWithinPartitions("shard", part, "position")
    return dealt.select(*(F.col("row")[f"c{n}"].alias(c) for n, c in enumerate(kept)), "copy", "shard", "position")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed; the texts themselves are measured and stay behind. ``shards`` has each copy's output shard."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sizes(docs).select("doc_id", "size", "source_size", "target", "taken", "shards", "positions")

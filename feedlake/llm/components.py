"""Connected components of an edge table by alternating large and small stars, with hubs split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_durable, durable

MOST_HEAVY = 10_000


def attach(rows: DataFrame, key: str, table: DataFrame, by: Column, least: int = 256) -> DataFrame:
    """``rows`` with the columns of ``table``, which has at most one row for each ``key``; rows without one go.

    A key with more than a ten-thousandth of all rows (and ``least``) is heavy: its rows are dealt by
    ``by`` into parts of that size, and its row of ``table`` goes to each. So no task gets all rows of a hot key,
    and the list of heavy keys, which is broadcast, has at most ``MOST_HEAVY`` entries at any size.
    """
    n = rows.count()
    most = max(least, -(-n // MOST_HEAVY))
    heavy = rows.groupBy(F.col(key).alias("heavy_key")).agg(F.count("*").alias("n")).where(F.col("n") > most)
    heavy = durable(heavy.select("heavy_key", F.ceil(F.col("n") / most).cast("int").alias("heavy_parts")), "heavy-keys")
    few = F.broadcast(heavy)
    parts = F.coalesce("heavy_parts", F.lit(1))
    dealt = rows.join(few, rows[key] == heavy["heavy_key"], "left").withColumn("heavy_slot", F.pmod(by, parts).cast("int")).drop("heavy_key", "heavy_parts")
    sent = table.join(few, table[key] == heavy["heavy_key"], "left").withColumn("heavy_slot", F.explode(F.sequence(F.lit(0), parts - 1))).drop("heavy_key", "heavy_parts")
    return dealt.join(sent, [key, "heavy_slot"]).drop("heavy_slot")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # only edges to a larger end are rewritten: the others need no least
    return attach(both.where("b > a"), "a", least, F.xxhash64("b")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    met = attach(edges, "a", least, F.xxhash64("b")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return met.union(least.select("a", "m")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that ``edges``, a table of longs ``a`` and ``b``, mentions; root is its component's least node.

    Each round is written to the shared folder, so lost executors cost one round at most. The last one
    stays for the result to read.
    """
    oriented = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = durable(oriented, "edges")
    state = _state(now)
    for _ in range(most_rounds):
        wide = durable(_large_star(now), "large-star")
        after = durable(_small_star(wide), "small-star")
        drop_durable(wide)
        drop_durable(now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())

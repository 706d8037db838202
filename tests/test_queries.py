"""Queries that write stores of their own write the whole table."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from feedlake.operators.filters import And
from feedlake.plans import fixtures, queries
from feedlake.plans.store import Store


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("orders")
    rows = spark.range(48).select(
        F.when(F.col("id") < 45, F.col("id")).alias("o_orderkey"),
        (F.col("id") % 7).alias("o_custkey"),
        F.lit("O").alias("o_orderstatus"),
        F.lit(1.5).alias("o_totalprice"),
        F.to_timestamp_ntz(F.when(F.col("id") % 3 == 0, F.lit("1996-03-05")).otherwise(F.lit("1997-01-01"))).alias("o_orderdate"),
        F.lit("5-LOW").alias("o_orderpriority"),
    )
    rows.write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def keys(found):
    return Counter(r[0] for r in found.select("o_orderkey").collect())


@pytest.mark.parametrize(
    ("query", "store"),
    [("q20_token_retry", ("or_raw_retry", 1, None)), ("q21_token_of", ("or_raw_each", 1, None)), ("q24_rollback_invisible", ("or_raw_rollback", 1, None)), ("q37_gc_reclaims", ("or_raw_gc", 4, None)), ("q30_poll_unsequenced_hidden", ("or_raw_hidden",))],
)
def test_whole_table_is_written(spark, orders, query, store):
    queries.QUERIES[query](spark, orders).collect()
    s = fixtures.store(spark, orders, *store, sequenced=20) if len(store) == 1 else fixtures.store(spark, orders, *store)
    assert keys(s.read(And())) == keys(spark.read.parquet(f"{orders}/orders.parquet"))


def test_occ_writes_the_whole_table(spark, orders):
    assert [tuple(r) for r in queries.q19_occ_chain(spark, orders).collect()] == [("order_month=1996-03/priority=5-LOW", 4)]
    counts = keys(fixtures.store(spark, orders, "or_raw_occ", 1, None).read(And()))
    assert all(counts[k] == 3 + (k is not None and k % 4 == 0) for k in range(45)) and counts[None] == 9


def test_partitions_come_to_the_driver_without_records(spark, orders, monkeypatch):
    """q44 takes each partition's aggregates, whatever the number of its records."""
    taken, partitions = [], Store.partitions
    monkeypatch.setattr(Store, "partitions", lambda self, *a, **k: taken.append(partitions(self, *a, **k)) or taken[-1])
    found = {r["partition_key"]: (r["n_records"], r["keys"]) for r in queries.q44_read_partition_iter(spark, orders).collect()}
    assert taken[0].columns == ["partition_key", "version", "files", "n_records", "keys"]
    want = {}
    for r in spark.read.parquet(f"{orders}/orders.parquet").collect():
        key = f"order_month={r['o_orderdate']:%Y-%m}/priority={r['o_orderpriority']}"
        n, total = want.get(key, (0, 0))
        want[key] = n + 1, total + (r["o_orderkey"] or 0)
    assert found == want
    whole = fixtures.store(spark, orders, "or_raw").read_partition_iter(And())
    assert {r["partition_key"]: len(r["records"]) for r in whole} == {k: n for k, (n, _) in want.items()}

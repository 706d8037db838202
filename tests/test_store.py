import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake.config import ExtensionColumn, MaterializedView, ReadOptions, StoreConfig
from feedlake.errors import ForeignFile, InvalidConfig, LockLost, LockNotInTransaction, LockTimeout, MetadataTooLarge, NoSession, SchemaMismatch, VersionConflict
from feedlake.functions import keys, values
from feedlake.operators.filters import And, Between, Eq, In, Or, Prefix
from feedlake.plans.admin import collect_garbage, pending_depth, rebuild, sweep
from feedlake.plans.lock import PartitionLock
from feedlake.plans.store import Store
from feedlake.sources.catalog import ArrowFiles, Log, files_for
from feedlake.streaming.feed import stream_records

SCHEMA = T.StructType([T.StructField(n, t) for n, t in zip(("customer", "sku", "period", "cost", "version"), (T.StringType(), T.StringType(), T.StringType(), T.DoubleType(), T.LongType()), strict=True)])


@pytest.fixture
def store(spark, tmp_path):
    view = MaterializedView("skus", ("customer", "sku"), F.array(F.struct("customer", "sku")))
    config = StoreConfig(str(tmp_path / "s"), SCHEMA, [("period", F.col("period")), ("customer", F.col("customer"))], F.concat_ws("|", "customer", "sku"), F.col("version"), [ExtensionColumn("job_id", "TEXT")], [view])
    out = Store(spark, config)
    out.init()
    return out


def rows(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def test_latest_and_history(spark, store):
    store.write(rows(spark, ("a", "x", "p1", 1.0, 1), ("b", "x", "p1", 5.0, 1)))
    store.write(rows(spark, ("a", "x", "p1", 99.0, 2)))
    assert sorted(r["cost"] for r in store.read(And()).collect()) == [5.0, 99.0]
    assert store.read(And(), with_history=True).count() == 3
    assert store.read().count() == 0
    found = {r["partition_key"]: (r["version"], len(r["records"])) for r in store.read_partitions(And()).collect()}
    assert found == {"period=p1/customer=a": (2, 1), "period=p1/customer=b": (1, 1)}
    assert store.at_version("period=p1/customer=a", 1).first()["cost"] == 1.0
    assert [r["sku"] for r in store.lookup("skus", Eq("customer", "a")).collect()] == ["x"]


def test_ties_take_the_later_row(spark, store):
    store.write(rows(spark, ("a", "x", "p", 1.0, 1), ("a", "x", "p", 2.0, 1), ("a", "x", "p", 3.0, 1)).coalesce(1))
    assert store.read(And()).first()["cost"] == 3.0
    store.write(rows(spark, ("a", "x", "p", 4.0, 1)))
    assert store.read(And()).first()["cost"] == 4.0


def test_versions_tokens_and_metadata(spark, store):
    key, one = "period=p/customer=a", rows(spark, ("a", "x", "p", 1.0, 1))
    first = store.write(one, expected_version=0, token="t", metadata={"job_id": "j"})
    assert store.write(one, expected_version=0, token="t")[0]["file_id"] == first[0]["file_id"]
    with pytest.raises(VersionConflict):
        store.write(one, expected_version=0)
    assert store.lookup_token(key, "t").first()["ext_job_id"] == "j"
    with pytest.raises(ValueError):
        store.write(one, metadata={"nope": 1})
    with pytest.raises(ValueError):
        store.write_with_key(key, rows(spark))
    with pytest.raises(ForeignFile):
        store.scan(store.files().withColumn("s3_key", F.lit("/elsewhere/x.parquet")))


def test_contended_versions(spark, store):
    one = rows(spark, ("a", "x", "p", 1.0, 1))
    stores = [Store(spark, store.config) for _ in range(4)]

    def attempt(s):
        try:
            return len(s.write(one, expected_version=0))
        except VersionConflict:
            return 0

    with ThreadPoolExecutor(4) as pool:
        assert sum(pool.map(attempt, stores)) == 1
    assert store.resolve(And()).count() == 1


def test_transaction_and_locks(spark, store):
    one = rows(spark, ("a", "x", "p", 1.0, 1))
    with pytest.raises(LockNotInTransaction):
        store.lock_partition("period=p/customer=a", 1)
    with pytest.raises(KeyError), store.transaction():
        store.write(one)
        raise KeyError
    assert store.files().count() == 0 and pending_depth(store).first()[0] == 1
    assert not [p for p, _, _ in store.fs.walk(f"{store.root}/_staging")]
    with store.transaction():
        store.lock_partition("period=p/customer=a", 1)
        other = PartitionLock(store.fs, store.root, "period=p/customer=a")
        with pytest.raises(LockTimeout):
            other.acquire(0.05)
        store.write(one)
        store.write(one)
    other.acquire(0.05)
    other.release()
    assert [r["version"] for r in store.resolve(And()).orderBy("version").collect()] == [1, 2]


def test_feed(spark, store, tmp_path):
    for n in range(3):
        store.write(rows(spark, ("a", "x", "p", float(n), n)))
    assert store.poll(1, 10)[0].count() == 0 and store.offset_latest().first()[0] == 1
    at = datetime(2024, 1, 1, tzinfo=UTC)
    assert store.sequence(2, at) == 2 and store.drain(2, at + timedelta(hours=1)) == 1
    refs, after = store.poll(1, 3)
    assert [r["feed_seq"] for r in refs.collect()] == [1, 2] and after == 3
    assert store.poll(7, 9)[1] == 7 and store.poll(2, 2)[1] == 2
    with pytest.raises(ValueError):
        store.poll(3, 1)
    assert store.offset_at(at + timedelta(minutes=1)).first()[0] == 3
    assert [r["cost"] for r in store.poll_records(1, 4).collect()] == [0.0, 1.0, 2.0]
    seen = []
    for _ in range(2):  # the second run finds nothing new behind the checkpoint
        stream_records(store, lambda df, n: seen.extend(r["cost"] for r in df.collect()), str(tmp_path / "c"), available_now=True).awaitTermination()
    assert seen == [0.0, 1.0, 2.0]


def test_rebuild(spark, store):
    store.write(rows(spark, ("a", "x", "p", 1.0, 1), ("b", "x", "p", 1.0, 1)), metadata={"job_id": "j"})
    store.fs.delete(f"{store.root}/_catalog/log")
    again = Store(spark, store.config)
    assert rebuild(again) == (2, 2) and rebuild(again) == (0, 0)
    assert {r["ext_job_id"] for r in again.files().collect()} == {"j"}


def test_filters_config_and_keys(spark):
    find = lambda name: F.col(name)
    with pytest.raises(ValueError):
        Between("a", "z", "a").to_column(find)
    assert "false" in str(In("a").to_column(find)).lower() and "false" in str(Or().to_column(find)).lower()
    with pytest.raises(InvalidConfig, match="root is empty.*entity and version"):
        StoreConfig("", SCHEMA, [("p", F.lit("1"))], entity=F.lit("e")).validate()
    for bad, parts in (("", ["a"]), ("a=1/b=2", ["a"]), ("a", ["a"]), ("x=1/b=2", ["a", "b"]), ("a=", ["a"]), ("=v", ["a"])):
        with pytest.raises(ValueError):
            keys.parse_key(bad, parts)
    assert keys.parse_key("a=1=2", ["a"]) == ["1=2"]
    made = [keys.uuid7() for _ in range(5000)]
    assert made == sorted(set(made))
    for kind, text in (("UUID", "not-a-uuid"), ("TIMESTAMPTZ", "yesterday"), ("BIGINT", "abc"), ("BOOLEAN", "yes")):
        with pytest.raises(ValueError):
            values.from_text(kind, text)
    assert values.from_text("NUMERIC", values.to_text("NUMERIC", values.check("NUMERIC", "1.50"))) == values.check("NUMERIC", 1.5)


def test_a_lock_has_one_holder(store):
    key = "period=p/customer=a"
    a, b, c = (PartitionLock(store.fs, store.root, key, lease) for lease in (0.15, 60, 60))
    a.acquire(1)
    a._stop.set()  # as if its process had died
    time.sleep(0.2)
    b.acquire(1)
    assert b.held() and not a.held() and not a.renew()
    a.release()
    with pytest.raises(LockTimeout):
        c.acquire(0.1)
    b.release()
    c.acquire(0.1)
    c.release()


def test_a_held_lock_is_renewed(store):
    a, b = (PartitionLock(store.fs, store.root, "k", 0.3) for _ in range(2))
    a.acquire(1)
    with pytest.raises(LockTimeout):
        b.acquire(0.9)
    assert a.held()
    a.release()


def test_lapsed_waiters_do_not_both_win(store):
    key = "period=p/customer=a"
    for _ in range(5):
        dead = PartitionLock(store.fs, store.root, key, 0.01)
        dead.acquire(1)
        dead._stop.set()
        time.sleep(0.05)
        locks = [PartitionLock(store.fs, store.root, key) for _ in range(6)]

        def attempt(lock):
            try:
                lock.acquire(0.05)
                return lock
            except LockTimeout:
                return None

        with ThreadPoolExecutor(6) as pool:
            won = [x for x in pool.map(attempt, locks) if x]
        assert len(won) == 1
        won[0].release()


def test_a_lost_lock_fails_its_transaction(spark, store):
    with pytest.raises(LockLost), store.transaction():
        store.lock_partition("period=p/customer=a", 1)
        store.write(rows(spark, ("a", "x", "p", 1.0, 1)))
        other = PartitionLock(store.fs, store.root, "period=p/customer=a")
        other._write(store._locks[0].generation + 1, 0, time.time() + 60)
    assert store.files().count() == 0


def test_retries_leave_nothing_behind(spark, store):
    def on_disk():
        return sorted(p for f in ("data", "_staging") for p, _, _ in store.fs.walk(f"{store.root}/{f}"))

    both = rows(spark, ("a", "x", "p", 1.0, 1), ("b", "x", "p", 1.0, 1))
    store.write(rows(spark, ("a", "x", "p", 1.0, 1)), token="t")
    first = store.write(both, token="t")
    before = on_disk()
    assert len(first) == 2 and len(before) == 2
    assert [f["file_id"] for f in store.write(both, token="t")] == [f["file_id"] for f in first]
    assert on_disk() == before and pending_depth(store).first()[0] == 0
    with pytest.raises(KeyError), store.transaction():
        store.write(both)
        raise KeyError
    later = datetime.now(UTC) + timedelta(days=3)
    assert collect_garbage(store, later) == 2 and sweep(store, later) >= 1 and on_disk() == before
    assert sweep(store, later) == 0 and [r["sku"] for r in store.lookup("skus").collect()] == ["x", "x"]


def test_transactions_rebase_and_detach(spark, store):
    one = rows(spark, ("a", "x", "p", 1.0, 1))
    other = Store(spark, store.config)
    with store.transaction():
        store.write(one)
        other.write(one)
        with store.detached():
            store.write(one, metadata={"job_id": "kept"})
    assert sorted(r["version"] for r in store.resolve(And()).collect()) == [1, 2, 3]
    with pytest.raises(VersionConflict), store.transaction():
        store.write(one, expected_version=3)
        other.write(one)
    assert store.run_in_transaction(lambda s: len(s.write(one))) == 1
    assert store.resolve(And()).count() == 5


def test_prefix_with_a_backslash(spark):
    values_ = ["ab", "a\\b", "a%b", "axb", "a\\"]
    table = spark.createDataFrame([(v,) for v in values_], "p string")

    def found(prefix):
        return [r["p"] for r in table.where(Prefix("p", prefix).to_column(F.col)).collect()]

    assert found("a\\b") == ["ab"] and found("a\\%") == ["a%b"] and found("a\\\\") == ["a\\b", "a\\"] and found("a_b") == ["a\\b", "a%b", "axb"]
    assert found("a\\") == []  # it makes the sign behind it plain


def test_limits_and_remote_logs(spark, store, tmp_path):
    for n in range(5):
        store.write(rows(spark, ("a", "x", "p", float(n), n)))
    store.drain()
    assert [len(x) for x in store.slices(store.poll(1, 6)[0], ReadOptions(decode_ahead_files=2))] == [2, 2, 1]
    assert [len(x) for x in store.slices(store.poll(1, 6)[0], ReadOptions(decode_ahead_bytes=1))] == [1] * 5
    seen = []
    limits = ReadOptions(decode_ahead_files=2, decode_workers=3)
    stream_records(store, lambda df, n: seen.append((n, df.count())), str(tmp_path / "c"), available_now=True, limits=limits).awaitTermination()
    assert seen == [(1, 2), (3, 2), (5, 1)]
    root = f"file://{store.root}"
    assert Log(ArrowFiles(root), root).refresh().last_seq == 5
    with pytest.raises(InvalidConfig, match="atomic"):
        files_for(spark, "s3a://bucket/x")
    with pytest.raises(InvalidConfig):
        ReadOptions(decode_workers=-1)


def test_layout(spark, store):
    store.init()
    store.validate()
    with pytest.raises(SchemaMismatch, match="extension 'more'"):
        Store(spark, replace(store.config, extensions=[*store.config.extensions, ExtensionColumn("more", "INT")])).init()
    with pytest.raises(MetadataTooLarge):
        store.write(rows(spark, ("a", "x", "p", 1.0, 1)), metadata={"job_id": "j" * 3000})
    with pytest.raises(NoSession):
        Store(None, store.config)
    assert keys.fnv32a("") == 0x811C9DC5 and keys.fnv32a("a") == 0xE40C292C and keys.fnv64a("a") == 0xAF63DC4C8601EC8C
    store.drop()
    assert not store.fs.exists(store.root)


def test_views_are_staged_by_many_tasks(spark, tmp_path):
    """The tuples of a write are made, compared and written in as many tasks as the shuffle has, not in one."""
    view = MaterializedView("pairs", ("sku", "period"), F.array(F.struct("sku", "period")))
    s = Store(spark, StoreConfig(str(tmp_path / "v"), SCHEMA, [("period", F.col("period"))], views=[view]))
    s.init()
    data = spark.range(40_000).select(F.lit("c").alias("customer"), F.sha2(F.col("id").cast("string"), 256).alias("sku"), F.lit("p").alias("period"), F.lit(1.0).alias("cost"), F.lit(1).cast("long").alias("version"))
    for n in range(2):
        s.write(data.where(F.col("version") + n > 0).unionAll(rows(spark, ("c", f"new{n}", "p", 1.0, 1))))
        path = s.log.refresh().views["pairs"][n]
        files = [p for p, size, _ in s.fs.walk(path) if p.endswith(".parquet")]
        assert spark.read.parquet(path).count() == (40_001 if n == 0 else 1)
        assert n or len(files) > 1
    assert s.lookup("pairs").count() == 40_002


@pytest.mark.parametrize("ordered", [False, True])
def test_a_hot_partition_is_written_by_many_tasks(spark, tmp_path, ordered):
    """No task writes a whole hot partition; its one file has all rows, in order, with every type as it was."""
    kinds = "id bigint, at timestamp, ntz timestamp_ntz, day date, price decimal(12,2), big decimal(38,6), raw binary, small tinyint, tags array<string>, deep struct<a:int,t:timestamp>, m map<string,int>, text string, p string"
    schema = T._parse_datatype_string(kinds)
    schema["id"].nullable, schema["tags"].dataType.containsNull = False, False
    data = spark.range(60_000, numPartitions=8).selectExpr(
        "id", "timestamp_micros(id * 1000003 - 5000000000) at", "cast(timestamp_micros(id) as timestamp_ntz) ntz", "date_add(date'1900-01-01', cast(id % 90000 as int)) day", "cast(id as decimal(12,2)) / 100 price",
        "cast(id as decimal(38,6)) big", "cast(cast(id as string) as binary) raw", "cast(id % 100 as tinyint) small", "array(cast(id as string)) tags", "struct(cast(id as int) a, timestamp_micros(id) t) deep", "map('k', cast(id as int)) m",
        "if(id % 7 = 0, null, sha2(cast(id as string), 256)) text", "if(id = 5, 'cold', 'hot') p",
    )
    data = data.select(*(F.col(f.name).cast(f.dataType) for f in schema))
    s = Store(spark, StoreConfig(str(tmp_path / "h"), schema, [("p", F.col("p"))]))
    s.init()
    joined = []
    s._join = lambda split, *rest: (joined.append({k: len(v) for k, v in split.items()}), Store._join(s, split, *rest))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        s.write(data, order_by=[F.col("small").desc(), F.col("text").desc()] if ordered else [])
        assert joined and joined[0]["p=hot"] > 3
        files = {r["partition_key"]: r["record_count"] for r in s.files().collect()}
        assert files == {"p=cold": 1, "p=hot": 59_999} and spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"
        assert not [p for p, _, _ in s.fs.walk(f"{s.root}/_staging")]
        whole = s.read(And()).select(*schema.names, "_row", "_partition_key")
        assert whole.drop("_row", "_partition_key", "m").exceptAll(data.drop("m")).count() == 0 and whole.where("m['k'] = id").count() == 60_000
        found = whole.where("p = 'hot'").orderBy("_row").select("id", "small", "text").collect()
        if ordered:
            assert [(r[1], r[2] or "") for r in found] == sorted(((r[1], r[2] or "") for r in found), reverse=True)
        else:
            assert [r[0] for r in found] == sorted(r[0] for r in found)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_large_reads_are_dealt_before_they_are_sorted(spark, store, monkeypatch):
    """Tasks that deduplicate grow with the records, and no split is sorted whole; the rows stay the same."""
    store.write(rows(spark, *(("a", f"s{n % 60}", "p", float(n), n % 3) for n in range(240))))
    few = {history: sorted(map(tuple, store.read(And(), with_history=history).drop("_row").collect())) for history in (False, True)}
    monkeypatch.setattr("feedlake.plans.store.SORTED_RECORDS", 10)
    for history, want in few.items():
        found = store.read(And(), with_history=history)
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "25" in plan.split("REPARTITION_BY_NUM")[0].rsplit("hashpartitioning", 1)[1]
        assert sorted(map(tuple, found.drop("_row").collect())) == want
        done = found._jdf.queryExecution().executedPlan().toString()
        assert done.index("Sort") < done.index("REPARTITION_BY_NUM") and "Sort" not in done[done.rindex("REPARTITION_BY_NUM"):]

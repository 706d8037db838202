"""Stores over the driver's tables, each built once per process and table folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from datetime import UTC, datetime, timedelta
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ExtensionColumn, MaterializedView, StoreConfig
from ..sources.catalog import mounted
from .store import Store

EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
SEQUENCED = datetime(2024, 1, 2, tzinfo=UTC)
BATCHES = 4


class Clock:
    """A clock that is set by hand."""

    def __init__(self) -> None:
        self.now = EPOCH

    def __call__(self) -> datetime:
        return self.now


@cache
def _folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder for this process's stores: where ``spark.checkpoint.dir`` is, which all machines share; a temporary one only where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        found = tempfile.mkdtemp(prefix="feedlake-fixture-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        return found
    return f"{mounted(shared.rstrip('/'))}/feedlake-fixture-{uuid.uuid4().hex}"


def folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A fresh folder beside the stores."""
    return f"{_folder(spark, sf_dir)}/{name}-{uuid.uuid4().hex}"


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _describe(spark: SparkSession, sf_dir: str, name: str, root: str) -> tuple[StoreConfig, DataFrame, Column, str]:
    source = {"ev": "events", "li": "lineitem"}.get(name.split("_")[0], "orders")
    rows = table(spark, sf_dir, source)
    clock = Clock()
    if source == "events":
        pair = lambda kind: F.struct(F.col("user_id").cast("string").alias("user_id"), kind.alias("event_type"))
        views = [
            MaterializedView("user_events", ("user_id", "event_type"), F.array(pair(F.col("event_type"))), lambda user_id, event_type: f"{user_id}:{event_type}"),
            MaterializedView("user_labels", ("user_id", "label"), F.array(pair(F.col("event_type")), pair(F.lit("any")))),
        ]
        parts = [("event_day", F.date_format("ts", "yyyy-MM-dd")), ("event_type", F.col("event_type"))]
        config = StoreConfig(root, rows.schema, parts, F.col("user_id").cast("string"), _micros("ts"), views=views, clock=clock)
        return config, rows, F.col("event_id"), "event_id"
    if source == "lineitem":
        parts = [("ship_year", F.date_format("l_shipdate", "yyyy")), ("returnflag", F.col("l_returnflag"))]
        entity = F.concat_ws("|", "l_orderkey", "l_linenumber")
        return StoreConfig(root, rows.schema, parts, entity, _micros("l_shipdate"), clock=clock), rows, F.col("l_orderkey"), "l_partkey"
    parts = [("order_month", F.date_format("o_orderdate", "yyyy-MM")), ("priority", F.col("o_orderpriority"))]
    keyed = (F.col("o_custkey").cast("string"), _micros("o_orderdate")) if name == "or" else (None, None)
    view = MaterializedView("cust_month", ("o_custkey", "order_month"), F.array(F.struct(F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM"))))
    extensions = [ExtensionColumn("job_id", "TEXT"), ExtensionColumn("attempt", "INT")]
    return StoreConfig(root, rows.schema, parts, *keyed, extensions=extensions, views=[view] if name == "or" else [], clock=clock), rows, F.col("o_orderkey"), "o_orderkey"


@cache
def store(spark: SparkSession, sf_dir: str, name: str, batches: int = BATCHES, sequenced: int | None = -1) -> Store:
    """A fixture store: ``ev``, ``or``, ``or_raw`` or ``li``, optionally with a suffix for a copy of its own.

    Batches are written one after another, an hour apart, and after all of them rows with a null key, if there are any; then ``sequenced`` files are given offsets, all if negative.
    """
    config, rows, key, order = _describe(spark, sf_dir, name, f"{_folder(spark, sf_dir)}/{name}-{batches}")
    out = Store(spark, config)
    out.init()
    for b in range(batches):
        config.clock.now = EPOCH + timedelta(hours=b)
        metadata = {"job_id": f"job-{b}", "attempt": b} if config.extensions else None
        out.write(rows.where(key % BATCHES == b), metadata=metadata, order_by=[F.col(order)])
    if batches == BATCHES and not rows.where(key.isNull()).isEmpty():
        config.clock.now = EPOCH + timedelta(hours=batches)
        out.write(rows.where(key.isNull()), metadata={"job_id": f"job-{batches}", "attempt": batches} if config.extensions else None, order_by=[F.col(order)])
    if sequenced is not None:
        if sequenced < 0:
            out.drain(10_000, SEQUENCED)
        else:
            out.sequence(sequenced, SEQUENCED)
    return out

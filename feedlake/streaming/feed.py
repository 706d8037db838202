"""The change feed as a stream: a Python source of file references, records in each micro-batch by the Parquet reader."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ..config import ReadOptions
from ..plans.store import Store
from ..sources.catalog import Log, parse_time, readable

REFS = "feed_seq long, s3_key string, partition_key string, version long"


class Refs(InputPartition):
    """References that one task hands on."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows


class FeedReader(DataSourceStreamReader):
    """Offsets are feed offsets; the driver alone reads the log."""

    def __init__(self, options: dict):
        self.log = Log(readable(options["root"]), options["root"])
        self.start = int(options.get("startingoffset", "1"))
        if at := options.get("startingtimestamp"):
            files = self.log.refresh().files.values()
            later = [f["feed_seq"] for f in files if f.get("feed_seq") and parse_time(f["feed_seq_at"]) >= parse_time(at)]
            self.start = min(later, default=self.log.refresh().last_seq + 1)
        self.page = int(options.get("filesperpartition", "10000"))

    def initialOffset(self) -> dict:
        return {"offset": self.start}

    def latestOffset(self) -> dict:
        return {"offset": max(self.start, self.log.refresh().last_seq + 1)}

    def partitions(self, start: dict, end: dict) -> list[Refs]:
        files = sorted((f["feed_seq"], f["s3_key"], f["partition_key"], f["version"]) for f in self.log.refresh().files.values() if f.get("feed_seq") is not None)
        chosen = [f for f in files if start["offset"] <= f[0] < end["offset"]]
        return [Refs(chosen[k : k + self.page]) for k in range(0, len(chosen), self.page)]

    def read(self, partition: Refs) -> Iterator[tuple]:
        return iter(partition.rows)

    def commit(self, end: dict) -> None:
        pass


class FeedSource(DataSource):
    """``spark.readStream.format("store_feed").option("root", ...)``; options startingOffset, startingTimestamp and filesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "store_feed"

    def schema(self) -> str:
        return REFS

    def streamReader(self, schema) -> FeedReader:
        return FeedReader(self.options)


def stream_refs(store: Store, starting_offset: int = 1, files_per_partition: int = 10_000, starting_at: datetime | None = None) -> DataFrame:
    """A streaming DataFrame of the feed's file references, from an offset or from the first one assigned at ``starting_at`` or later."""
    store.spark.dataSource.register(FeedSource)
    reader = store.spark.readStream.format("store_feed").option("root", store.root)
    if starting_at is not None:
        reader = reader.option("startingTimestamp", starting_at.isoformat())
    return reader.option("startingOffset", starting_offset).option("filesPerPartition", files_per_partition).load()


def stream_records(store: Store, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False, interval: str = "1 second", limits: ReadOptions | None = None, **options) -> StreamingQuery:
    """Call ``handle`` with each micro-batch's records, raw, with ``_offset``, in no order; the checkpoint holds where to go on.

    ``limits`` bounds the files and uncompressed bytes of a call: then a micro-batch, which may be a whole
    backlog, is handed on in runs of files, and the number that ``handle`` gets is a run's first
    offset instead of the micro-batch's. A micro-batch that is repeated makes the same runs.
    """

    def batch(refs: DataFrame, number: int) -> None:
        seqs = refs.selectExpr("min(feed_seq)", "max(feed_seq)").first()
        if seqs[0] is None:
            return
        if limits is None:
            handle(store.poll_records(seqs[0], seqs[1] + 1, ordered=False), number)
            return
        for run in store.slices(store.poll(seqs[0], seqs[1] + 1)[0], limits):
            handle(store.poll_records(run[0]["offset"], run[-1]["offset"] + 1, ordered=False), run[0]["offset"])

    writer = stream_refs(store, **options).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def tail(store: Store, since: int, page: int = 10_000, base: float = 0.1, most: float = 2.0, stop: Callable[[], bool] = lambda: False) -> Iterator[Row]:
    """References in feed order for ever: at once after a page with any, else after a growing pause."""
    most, idle = max(base, most), 0
    while not stop():
        refs, after = store.poll(since, since + page)
        if after > since:
            idle = 0
            yield from refs.toLocalIterator()
            since = after
        else:
            time.sleep(min(most, base * 2**idle))
            idle = min(idle + 1, 30)


def tail_records(store: Store, since: int, **options) -> Iterator[Row]:
    """Records of tailed files, file by file."""
    for ref in tail(store, since, **options):
        yield from store.poll_records(ref["feed_seq"], ref["feed_seq"] + 1).toLocalIterator()


def run_sequencer(store: Store, interval: float = 1.0, batch: int = 1000, stop: Callable[[], bool] = lambda: False) -> None:
    """Drain, then again at each interval, or at once after a commit of this process, until told to stop."""
    while not stop():
        store.woken.clear()
        store.drain(batch)
        store.woken.wait(interval)

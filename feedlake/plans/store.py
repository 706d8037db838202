"""The store: partitioned, versioned Parquet records with a change feed, as lazy DataFrames over a commit log."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from datetime import datetime
from itertools import groupby
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ReadOptions, StoreConfig
from ..errors import ForeignFile, IntegrityError, LockLost, LockNotInTransaction, MetadataTooLarge, NoSession, SchemaMismatch, VersionConflict
from ..functions import values
from ..functions.keys import format_key, parse_key, uuid7
from ..operators import dedup
from ..operators.filters import Filter, compile_filters, resolver
from ..sources.catalog import Log, State, files_for, files_frame, mounted
from .lock import PartitionLock

def _footer(path: str) -> tuple[int, int]:
    """Records and uncompressed bytes of a Parquet file, by its footer."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    found = pq.read_metadata(inside, filesystem=system)
    return found.num_rows, sum(found.row_group(g).column(c).total_uncompressed_size for g in range(found.num_row_groups) for c in range(found.num_columns))


def _joiner(schema: T.StructType, codec: str) -> Callable:
    """A function of Arrow batches with ``key`` and ``paths``: it joins each key's Parquet files in that order to one beside the ``into`` path, a few MB at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target, most = to_arrow_schema(schema), GROUP_BYTES  # a worker may lack this module, so it takes values alone

    def join(batches):
        import uuid

        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        def at(path):
            return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

        for batch in batches:
            done = []
            for into, paths in zip(batch.column("into").to_pylist(), batch.column("paths").to_pylist(), strict=True):
                out, writer, held, size = f"{into}/_{uuid.uuid4().hex}.parquet", None, [], 0
                for path in paths:
                    system, inside = at(path)
                    with system.open_input_file(inside) as f:
                        source = pq.ParquetFile(f, coerce_int96_timestamp_unit="us")
                        told = {k: v for k, v in (source.schema_arrow.metadata or {}).items() if k != b"ARROW:schema"}
                        if writer is None:
                            wanted = target.with_metadata(told)
                            system, inside = at(out)
                            writer = pq.ParquetWriter(inside, wanted, filesystem=system, compression="none" if codec == "uncompressed" else codec, store_decimal_as_integer=True)
                        groups = [source.metadata.row_group(g) for g in range(source.metadata.num_row_groups)]
                        width = sum(g.total_byte_size for g in groups) // max(1, source.metadata.num_rows)
                        for part in source.iter_batches(max(1, min(1 << 16, (1 << 22) // max(1, width)))):
                            held.append(part)
                            size += part.nbytes
                            if size >= most:
                                writer.write_table(pa.Table.from_batches(held).cast(wanted))
                                held, size = [], 0
                if held:
                    writer.write_table(pa.Table.from_batches(held).cast(wanted))
                writer.close()
                done.append(out)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(done, pa.string())], names=["key", "path"])

    return join


OFFSET_NONE, OFFSET_EARLIEST = 0, 1
SORTED_RECORDS, SORTED_BYTES = 500_000, 256 << 20  # what one task of a read sorts, about; bytes are uncompressed
RUN_BYTES, GROUP_BYTES = 16 << 20, 64 << 20  # of a hot partition's files, what one task puts in order; in memory, a row group of joined files
BROADCAST_FILES = 50_000
_ZERO = {T.StringType: "", T.BinaryType: b"", T.BooleanType: False}


_guard = threading.Lock()
_held: dict[tuple[int, str], list] = {}  # settings in use: by how many, and the value before


@contextmanager
def _setting(spark: SparkSession, name: str, value: object):
    """A session setting for a while; threads that need it at once share it, and the last one restores what was."""
    with _guard:
        held = _held.setdefault((id(spark), name), [0, spark.conf.get(name)])
        held[0] += 1
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        with _guard:
            held[0] -= 1
            if not held[0]:
                spark.conf.set(name, held[1])
                del _held[id(spark), name]


class Store:
    """A store of one ``StoreConfig``. Reads are lazy; a write is one commit, whole or not at all."""

    def __init__(self, spark: SparkSession, config: StoreConfig):
        if spark is None:
            raise NoSession("a store needs a session")
        config.validate()
        self.spark, self.config = spark, config
        self.root = mounted(config.root.rstrip("/"))
        self.data = f"{self.root}/data"
        self.fs = files_for(spark, self.root)
        self.log = Log(self.fs, self.root)
        self._pending: list[dict] | None = None
        self._markers: list[str] = []
        self._locks: list[PartitionLock] = []
        self.woken = threading.Event()  # set by each commit of this process, for a sequencer that waits

    # -- layout ---------------------------------------------------------------------------------

    def _fingerprint(self) -> dict:
        c = self.config
        return {"schema": json.loads(c.schema.json()), "parts": c.part_names, "extensions": [[e.name, e.kind.upper()] for e in c.extensions], "views": {v.name: list(v.columns) for v in c.views}}

    def init(self) -> None:
        """Create the layout; a second call changes nothing."""
        if not self.fs.create(f"{self.root}/_catalog/store.json", json.dumps(self._fingerprint())):
            self.validate()

    def validate(self) -> None:
        """Raise SchemaMismatch with everything that the layout on disk lacks."""
        path = f"{self.root}/_catalog/store.json"
        if not self.fs.exists(path):
            raise SchemaMismatch(f"{path} is missing")
        found, wanted = json.loads(self.fs.read(path)), self._fingerprint()
        missing = [f"part {p!r}" for p in wanted["parts"] if p not in found["parts"]]
        missing += [f"extension {n!r} of type {k}" for n, k in wanted["extensions"] if [n, k] not in found["extensions"]]
        missing += [f"view {n!r} with {c}" for n, c in wanted["views"].items() if found["views"].get(n) != c]
        if found["parts"] != wanted["parts"] and not missing:
            missing.append(f"parts {wanted['parts']}, in this order and alone")
        if missing:
            raise SchemaMismatch("missing: " + "; ".join(missing))

    def drop(self) -> None:
        """Delete the store with its data."""
        self.fs.delete(self.root)

    # -- catalog --------------------------------------------------------------------------------

    def files(self) -> DataFrame:
        """The files table: all committed files."""
        return files_frame(self.spark, self.config, self.log.refresh())

    def _refs(self, files: DataFrame) -> DataFrame:
        return files.withColumn("offset", F.coalesce("feed_seq", F.lit(OFFSET_NONE)))

    def _condition(self, filters: Sequence[Filter]) -> Column:
        return compile_filters(filters, resolver({n: f"part_{n}" for n in self.config.part_names}))

    def resolve(self, *filters: Filter) -> DataFrame:
        """File references of partitions that hold all filters, in key order; without a filter, none."""
        chosen = self._condition(filters) if filters else F.lit(False)
        return self._refs(self.files().where(chosen)).orderBy("partition_key", "s3_key")

    def resolve_range(self, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
        """References of files written from ``since`` to before ``until``, sequenced or not; None is no bound."""
        at = F.col("written_at")
        chosen = (at >= F.lit(since) if since else F.lit(True)) & (at < F.lit(until) if until else F.lit(True))
        return self._refs(self.files().where(chosen)).orderBy("partition_key", "s3_key")

    def lookup_token(self, key: str, token: str) -> DataFrame:
        """The reference that a token stands for in a partition; no row if none."""
        if not key or not token:
            raise ValueError("a partition key and a token are needed")
        parse_key(key, self.config.part_names)
        return self._refs(self.files().where((F.col("partition_key") == key) & (F.col("idempotency_token") == token)))

    # -- reads ----------------------------------------------------------------------------------

    def _many_paths(self):
        """Many explicit paths are looked up by a few tasks, not by one task each."""
        return _setting(self.spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", 4 * self.spark.sparkContext.defaultParallelism)

    def scan(self, refs: DataFrame) -> DataFrame:
        """Records of the references' files, raw, with ``_partition_key``, ``_file``, ``_row``, ``_file_id``, ``_offset`` and ``_file_version``.

        Files are opened by path: nothing is listed, and a missing one is an error.
        """
        return self._scan(refs)[0]

    def _scan(self, refs: DataFrame) -> tuple[DataFrame, int]:
        """``scan``, and how many tasks its records need to be sorted in runs of bounded memory; 0 if few enough for any."""
        sizes = [c for c in ("record_count", "uncompressed_size") if c in refs.columns]
        listed = refs.select("s3_key", *sizes).collect()
        paths = [r["s3_key"] for r in listed]
        records, size = (sum(r[c] or 0 for r in listed) if c in sizes else 0 for c in ("record_count", "uncompressed_size"))
        tasks = 0 if records < SORTED_RECORDS and size < SORTED_BYTES else 1 + max(records // SORTED_RECORDS, size // SORTED_BYTES)
        if foreign := [p for p in paths if not p.startswith(self.data + "/")]:
            raise ForeignFile(f"not under {self.data}: {foreign[:5]}")
        schema = self.config.schema
        told = refs.select(F.substring_index("s3_key", "/", -1).alias("_file"), F.col("partition_key").alias("_partition_key"), F.col("file_id").alias("_file_id"), F.coalesce("feed_seq", F.lit(0)).alias("_offset"), F.col("version").alias("_file_version"))
        if not paths:
            empty = self.spark.createDataFrame([], schema).withColumns({"_file": F.lit(""), "_row": F.lit(0).cast("long")})
            return empty.join(told, "_file"), 0
        with self._many_paths():
            opened = self.spark.read.schema(schema).parquet(*paths)
        rows = opened.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        if self.config.missing_as_zero:
            rows = rows.withColumns({f.name: F.coalesce(f.name, F.lit(_ZERO.get(type(f.dataType), 0)).cast(f.dataType)) for f in schema.fields if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))})
        return rows.join(F.broadcast(told) if len(paths) <= BROADCAST_FILES else told, "_file"), tasks

    def _deduplicated(self, rows: DataFrame, with_history: bool, tasks: int) -> DataFrame:
        c = self.config
        if c.entity is None:
            return rows
        keyed = rows.withColumns({"_entity": c.entity.cast("string"), "_version": c.version.cast("long")})
        if tasks > 1:
            # a group limit before the exchange would sort all records of a split, which holds more the fewer columns are read
            keyed = keyed.repartition(max(tasks, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "_partition_key", "_entity")
        return dedup.history(keyed) if with_history else dedup.latest(keyed)

    def read_refs(self, refs: DataFrame, with_history: bool = False) -> DataFrame:
        """Records of resolved references: the latest version of each entity in each partition, or its history."""
        rows, tasks = self._scan(refs)
        return self._deduplicated(rows, with_history, tasks)

    def read(self, *filters: Filter, with_history: bool = False) -> DataFrame:
        """Records of partitions that hold all filters; without a filter, none. Call ``ordered`` for a stable order."""
        return self.read_refs(self.resolve(*filters), with_history)

    def read_range(self, since: datetime | None = None, until: datetime | None = None, with_history: bool = False) -> DataFrame:
        """Records of files written in a time range; versions compete among those files only."""
        return self.read_refs(self.resolve_range(since, until), with_history)

    def partitions(self, refs: DataFrame, with_history: bool = False, of: dict[str, Column] | None = None) -> DataFrame:
        """A row for each partition: its key, version, file references and records, the latter as arrays; with ``of``, these aggregates in place of the records."""
        summary = refs.groupBy("partition_key").agg(F.max("version").alias("version"), F.sort_array(F.collect_list(F.struct("s3_key", "file_id", "version", "offset"))).alias("files"))
        rows = self.read_refs(refs, with_history)
        if of:
            made = rows.groupBy(F.col("_partition_key").alias("partition_key")).agg(*(c.alias(n) for n, c in of.items()))
            return summary.join(made, "partition_key", "left")
        fields = F.struct("_file", "_row", F.struct(*self.config.schema.names).alias("r"))
        order = F.struct("_entity", "_version", "_file", "_row", fields.alias("f")) if "_entity" in rows.columns else F.struct("_file", "_row", fields.alias("f"))
        records = rows.groupBy(F.col("_partition_key").alias("partition_key")).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["f"]["r"]).alias("records"))
        return summary.join(records, "partition_key", "left")

    def read_partitions(self, *filters: Filter, with_history: bool = False, of: dict[str, Column] | None = None) -> DataFrame:
        return self.partitions(self.resolve(*filters), with_history, of)

    def ordered(self, rows: DataFrame) -> DataFrame:
        """Partitions in key order, then entities and versions, or files and rows where there are none."""
        inner = ["_entity", "_version"] if "_entity" in rows.columns else []
        return rows.orderBy("_partition_key", *inner, "_file", "_row")

    def read_iter(self, *filters: Filter, with_history: bool = False) -> Iterator[Row]:
        """Records one by one, a partition of the plan at a time in memory."""
        return self.ordered(self.read(*filters, with_history=with_history)).toLocalIterator(prefetchPartitions=True)

    def read_partition_iter(self, *filters: Filter, with_history: bool = False, of: dict[str, Column] | None = None) -> Iterator[Row]:
        """Partitions in key order. All records of a partition come to the driver with it; with ``of``, only these aggregates of them, by name, do."""
        return self.read_partitions(*filters, with_history=with_history, of=of).orderBy("partition_key").toLocalIterator()

    def read_partition_refs_iter(self, refs: DataFrame, with_history: bool = False) -> Iterator[tuple[str, int, list[Row], Callable[[], DataFrame]]]:
        """For each partition of resolved references, in key order: its key, version, references, and a function that gives its records, in order.

        Only references come to the driver, in one job; a partition of any size stays a table until its reader wants it.
        """
        for key, own in groupby(refs.orderBy("partition_key", "s3_key").toLocalIterator(), lambda r: r["partition_key"]):
            rows = list(own)

            def records(rows: list[Row] = rows) -> DataFrame:
                return self.ordered(self.read_refs(self.spark.createDataFrame(rows, refs.schema), with_history))

            yield key, max(r["version"] for r in rows), rows, records

    def read_partition_range_iter(self, since: datetime | None = None, until: datetime | None = None, with_history: bool = False) -> Iterator[tuple[str, int, list[Row], Callable[[], DataFrame]]]:
        """``read_partition_refs_iter`` of the files written in a time range."""
        return self.read_partition_refs_iter(self.resolve_range(since, until), with_history)

    def slices(self, refs: DataFrame, options: ReadOptions) -> Iterator[list[Row]]:
        """References in feed order (else by key), in runs of as many files and uncompressed bytes as the options allow, one file at least."""
        held, size = [], 0
        for r in refs.orderBy("offset", "partition_key", "s3_key").toLocalIterator():
            full = 0 < options.decode_ahead_files <= len(held) or 0 < options.decode_ahead_bytes < size + (r["uncompressed_size"] or 0)
            if held and full:
                yield held
                held, size = [], 0
            held.append(r)
            size += r["uncompressed_size"] or 0
        if held:
            yield held

    def file_ref_stats(self, refs: DataFrame) -> DataFrame:
        """How many files, records and uncompressed bytes references stand for."""
        return refs.agg(F.count("*").alias("files"), F.coalesce(F.sum("record_count"), F.lit(0)).alias("records"), F.coalesce(F.sum("uncompressed_size"), F.lit(0)).alias("uncompressed_bytes"))

    def at_version(self, key: str, version: int, with_history: bool = False) -> DataFrame:
        """A partition's records as of one of its versions."""
        parse_key(key, self.config.part_names)
        return self.read_refs(self._refs(self.files().where((F.col("partition_key") == key) & (F.col("version") <= version))), with_history)

    def at_offset(self, offset: int, with_history: bool = False) -> DataFrame:
        """All records as of a feed offset, inclusive."""
        return self.read_refs(self._refs(self.files().where(F.col("feed_seq") <= offset)), with_history)

    # -- feed -----------------------------------------------------------------------------------

    def poll(self, since: int, until: int) -> tuple[DataFrame, int]:
        """References with offsets from ``since`` to before ``until`` in feed order, and the offset to go on from."""
        if since > until:
            raise ValueError(f"offset range is inverted: {since} > {until}")
        found = self._refs(self.files().where((F.col("feed_seq") >= since) & (F.col("feed_seq") < until)))
        last = found.agg(F.max("feed_seq")).first()[0] if since < until else None
        return found.orderBy("feed_seq"), since if last is None else last + 1

    def poll_records(self, since: int, until: int, ordered: bool = True) -> DataFrame:
        """Records of polled files, raw, in feed order, or in none, which needs no sort."""
        rows = self.scan(self.poll(since, until)[0])
        return rows.orderBy("_offset", "_row") if ordered else rows

    def poll_iter(self, since: int, until: int | None = None, page: int = 10_000) -> Iterator[Row]:
        """References in feed order, page by page, to the first empty page or ``until``."""
        while until is None or since < until:
            refs, after = self.poll(since, min(since + page, until) if until is not None else since + page)
            if after == since:
                return
            yield from refs.toLocalIterator()
            since = after

    def poll_records_iter(self, since: int, until: int) -> Iterator[Row]:
        return self.poll_records(since, until).toLocalIterator(prefetchPartitions=True) if since < until else iter(())

    def offset_latest(self) -> DataFrame:
        """One past the last offset: 1 for an empty feed."""
        return self.files().agg((F.coalesce(F.max("feed_seq"), F.lit(0)) + 1).alias("offset"))

    def offset_at(self, at: datetime) -> DataFrame:
        """First offset assigned at ``at`` or later; 0 if there is none."""
        return self.files().where(F.col("feed_seq_at") >= F.lit(at)).agg(F.coalesce(F.min("feed_seq"), F.lit(0)).alias("offset"))

    def feed_lag(self) -> DataFrame:
        """Seconds since the feed's last file was sequenced; no row for an empty feed."""
        last = self.files().where("feed_seq is not null").agg(F.max_by("feed_seq_at", "feed_seq").alias("at")).where("at is not null")
        return last.select(((F.unix_micros(F.lit(self.config.clock())) - F.unix_micros("at")) / 1e6).alias("lag_seconds"))

    def unsequenced(self) -> DataFrame:
        return self.files().where("feed_seq is null").agg(F.count("*").alias("files"))

    def sequence(self, batch: int = 1000, at: datetime | None = None) -> int:
        """Give the next ``batch`` files by time of writing, then id, the next offsets; how many there were."""

        def assign(state: State) -> list[dict]:
            waiting = sorted((f["written_at"], f["file_id"]) for f in state.files.values() if f.get("feed_seq") is None)[:batch]
            seqs = [[file_id, state.last_seq + n] for n, (_, file_id) in enumerate(waiting, 1)]
            return [{"action": "assign_seq", "seqs": seqs, "at": (at or self.config.clock()).isoformat()}] if seqs else []

        done = self.log.commit(assign)
        return len(done[0]["seqs"]) if done else 0

    def drain(self, batch: int = 1000, at: datetime | None = None) -> int:
        """Sequence until a batch is short."""
        total = 0
        while True:
            n = self.sequence(batch, at)
            total += n
            if n < batch:
                return total

    # -- writes ---------------------------------------------------------------------------------

    def write(self, records: DataFrame, *, token: str | None = None, token_of: Column | None = None, expected_version: int | None = None, metadata: dict | None = None, order_by: Sequence[Column] = ()) -> list[dict]:
        """Append records, one file for each partition, in one commit; the new (or, by token, the old) references in key order.

        ``token`` makes a retry return what the first call wrote; ``token_of``, an aggregate of a partition's
        records, does so for each partition. ``expected_version`` must be every touched partition's. Row
        order within a file is the input's, or ``order_by``.
        """
        if token and token_of is not None:
            raise ValueError("token and token_of exclude each other")
        ext = self._metadata(metadata or {})
        parts = {f"part_{n}": F.when(c.isNull() | (c.cast("string") == ""), F.raise_error(F.lit(f"part {n} has no value"))).otherwise(c.cast("string")) for n, c in self.config.parts}
        tagged = records.select(*self.config.schema.names).withColumns(parts)
        return self._append(tagged, token, token_of, expected_version, ext, order_by)

    def write_with_key(self, key: str, records: DataFrame, **options) -> list[dict]:
        """Append records to one partition, whatever their own parts are; empty records are an error."""
        found = parse_key(key, self.config.part_names)
        if records.isEmpty():
            raise ValueError("no records to write")
        ext = self._metadata(options.get("metadata") or {})
        tagged = records.select(*self.config.schema.names).withColumns({f"part_{n}": F.lit(v) for n, v in zip(self.config.part_names, found, strict=True)})
        return self._append(tagged, options.get("token"), options.get("token_of"), options.get("expected_version"), ext, options.get("order_by", ()))

    def _metadata(self, metadata: dict) -> dict[str, str | None]:
        kinds = {e.name: e.kind for e in self.config.extensions}
        if unknown := set(metadata) - set(kinds):
            raise ValueError(f"unknown metadata {sorted(unknown)}")
        return {n: values.to_text(kinds[n], values.check(kinds[n], v)) for n, v in metadata.items()}

    def _append(self, tagged: DataFrame, token: str | None, token_of: Column | None, expected: int | None, ext: dict, order_by: Sequence[Column]) -> list[dict]:
        names = self.config.part_names
        columns = [f"part_{n}" for n in names]
        known: dict[str, dict] = {}
        state = self.log.refresh()
        if token and any(t == token for _, t in state.tokens):  # a retry: what the first call wrote is not staged again
            keys = [format_key(names, r) for r in tagged.select(*columns).distinct().collect()]
            known = {k: state.files[state.tokens[k, token]] for k in keys if (k, token) in state.tokens}
            if len(known) == len(keys):
                return [known[k] for k in sorted(known)]
            key_of = F.concat_ws("/", *(F.concat(F.lit(f"{n}="), F.col(c)) for n, c in zip(names, columns, strict=True)))
            tagged = tagged.where(~key_of.isin(*known)) if known else tagged
        folder = f"{self.root}/_staging/{uuid.uuid4().hex}"
        try:
            staged = self._stage(tagged, folder, columns, order_by)
            if not staged:
                return [known[k] for k in sorted(known)]
            # the input is read once: tokens and views come from what was staged
            written = self.spark.read.schema(T.StructType([*self.config.schema.fields, *(T.StructField(c, T.StringType()) for c in columns)])).parquet(folder)
            tokens: dict[str, str] = {}
            if token_of is not None:
                tokens = {format_key(names, r[:-1]): r[-1] for r in written.groupBy(*columns).agg(token_of.alias("t")).collect() if r[-1]}
            of = {key: tokens.get(key, token) or None for key in staged}
            return self._commit(staged, of, expected, ext, self._stage_views(written), known)
        finally:
            self.fs.delete(folder)

    def _commit(self, staged: dict[str, tuple[str, int]], of: dict[str, str | None], expected: int | None, ext: dict, views: list[tuple[str, str]], known: dict[str, dict]) -> list[dict]:
        written_at = self.config.clock().isoformat()
        moved: dict[str, dict] = {}
        markers: list[str] = []

        def actions(state: State) -> list[dict]:
            out, file_id = [], state.next_file_id + sum(a["action"] == "add_file" for a in self._pending or [])
            fresh = [k for k in sorted(staged) if (k, of[k]) not in state.tokens]
            before = {k: state.partitions.get(k, 0) + sum(a["action"] == "add_file" and a["file"]["partition_key"] == k for a in self._pending or []) for k in fresh}
            if expected is not None and (wrong := [k for k in fresh if before[k] != expected]):
                raise VersionConflict(f"{wrong[0]} is at version {before[wrong[0]]}, not {expected}")
            if missing := [k for k in fresh if k not in moved]:
                entries, marker = self._publish({k: staged[k] for k in missing}, of, ext)
                moved.update(entries)
                markers.append(marker)
            for key in fresh:
                out.append({"action": "add_file", "expected": expected, "file": moved[key] | {"file_id": file_id, "version": before[key] + 1, "written_at": written_at}})
                file_id += 1
            return out + [{"action": "add_tuples", "view": v, "path": p} for v, p in views] if out else []

        if self._pending is not None:
            added = actions(self.log.refresh())
            self._pending += added
            self._markers += markers
        else:
            added = self.log.commit(actions)
            for m in markers:
                self.fs.delete(m)
            self.woken.set()
        state = self.log.refresh()
        fresh = {a["file"]["partition_key"]: a["file"] for a in added if a["action"] == "add_file"} | known
        return [fresh[k] if k in fresh else state.files[state.tokens[k, of[k]]] for k in sorted({*staged, *known})]

    def _stage(self, tagged: DataFrame, folder: str, columns: list[str], order_by: Sequence[Column]) -> dict[str, tuple[str, int]]:
        """Write one file per partition aside; key to (path, bytes).

        A partition too large for one task is dealt to several by runs of the input's tasks, whose
        files are then joined; where rows have an order of their own, they are dealt again by its ranges.
        """
        order = list(order_by) or [F.col("_input_row")]
        placed = tagged.withColumn("_input_row", F.monotonically_increasing_id())
        # a fixed number of tasks: adaptive merging would write the small partitions' files one after another
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism)
        adaptive = self.spark.conf.get("spark.sql.adaptive.enabled") == "true"
        placed = placed.hint("rebalance", tasks, *columns) if adaptive else placed.repartition(tasks, *columns)
        with _setting(self.spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
            self._write_pieces(placed.sortWithinPartitions(*columns, *order).drop("_input_row"), folder, columns)
        pieces = self._pieces(folder, columns)
        split = {k: found for k, found in pieces.items() if len(found) > 1}
        if split:
            self._join(split, folder, columns, order_by)
            pieces |= {k: found for k, found in self._pieces(folder, columns).items() if k in split}
        return {k: found[0] for k, found in pieces.items()}

    def _write_pieces(self, rows: DataFrame, folder: str, columns: list[str]) -> None:
        rows.write.option("compression", self.config.codec).option("maxRecordsPerFile", 0).partitionBy(*columns).parquet(folder)

    def _pieces(self, folder: str, columns: list[str]) -> dict[str, list[tuple[str, int]]]:
        """(path, bytes) of each partition's files in the order of the tasks that wrote them."""
        found: dict[str, list[tuple[str, int]]] = {}
        for path, size, _ in self.fs.walk(folder):
            *folders, name = path.split("/")[-1 - len(columns) :]
            if name.endswith(".parquet") and name[0] not in "._":
                key = format_key(self.config.part_names, [unquote(f.split("=", 1)[1]) for f in folders])
                parse_key(key, self.config.part_names)
                found.setdefault(key, []).append((path, size))
        return {k: sorted(files, key=lambda f: int(f[0].rsplit("/", 1)[1].split("-")[1])) if len(files) > 1 else files for k, files in found.items()}

    def _join(self, split: dict[str, list[tuple[str, int]]], folder: str, columns: list[str], order_by: Sequence[Column]) -> None:
        """Put one file in the place of each partition's several."""
        pieces, aside = split, f"{folder}-ordered"
        try:
            if order_by:
                schema = T.StructType([*self.config.schema.fields, *(T.StructField(c, T.StringType()) for c in columns)])
                paths = [path for found in split.values() for path, _ in found]
                with self._many_paths():
                    rows = self.spark.read.schema(schema).option("basePath", folder).parquet(*paths)
                # equal rows, too, are dealt to several tasks
                placed = rows.withColumns({"_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")})
                by = [*columns, *order_by, "_file", "_row"]
                tasks = max(1 + sum(size for found in split.values() for _, size in found) // RUN_BYTES, self.spark.sparkContext.defaultParallelism)
                self._write_pieces(placed.repartitionByRange(tasks, *by).sortWithinPartitions(*by).drop("_file", "_row"), aside, columns)
                pieces = self._pieces(aside, columns)
            places = {k: found[0][0].rsplit("/", 1)[0] for k, found in split.items()}
            listed = self.spark.createDataFrame([(k, places[k], [path for path, _ in found]) for k, found in pieces.items()], "key string, into string, paths array<string>")
            nullable = self.spark.read.schema(self.config.schema).parquet(next(iter(split.values()))[0][0]).schema
            joined = listed.repartition(len(pieces)).mapInArrow(_joiner(nullable, self.config.codec), "key string, path string").collect()
            for r in joined:
                self.fs.move(r["path"], f"{places[r['key']]}/{r['path'].rsplit('/_', 1)[1]}")
            for path in (path for found in split.values() for path, _ in found):
                self.fs.delete(path)
        finally:
            self.fs.delete(aside)

    def _marker(self, path: str) -> str:
        return f"{self.root}/_catalog/pending/{path.rsplit('/', 1)[1]}.json"

    def _publish(self, staged: dict[str, tuple[str, int]], of: dict[str, str | None], ext: dict) -> tuple[dict[str, dict], str]:
        """Move staged files to their places, behind one marker for the clean-up of orphans; their catalog entries, and the marker.

        Footers are read and files moved by many threads; a write has one marker and one sidecar, however many files it has.
        """
        footers, write = self._footers({k: path for k, (path, _) in staged.items()}), uuid7()
        entries, sides = {}, {}
        for key, (path, size) in staged.items():
            name, token = f"{uuid7()}.parquet", of[key]
            records, uncompressed = footers[key]
            place = f"{self.data}/{'/'.join(path.split('/')[-1 - len(self.config.parts) : -1])}/{name}"
            entry = {"s3_key": place, "partition_key": key, "parts": parse_key(key, self.config.part_names), "file_size": size, "uncompressed_size": uncompressed, "record_count": records, "idempotency_token": token, "feed_seq": None, "feed_seq_at": None, "ext": ext}
            side = {k: entry[k] for k in ("partition_key", "record_count", "uncompressed_size", "idempotency_token", "ext")}
            if (long := len(json.dumps(side).encode())) > values.SIDECAR_BYTES:
                raise MetadataTooLarge(f"{long} bytes of metadata; {values.SIDECAR_BYTES} fit")
            if not all(" " <= c <= "~" or c == "\t" for c in f"{token or ''}{''.join(v or '' for v in ext.values())}"):
                raise ValueError("tokens and metadata take printable ASCII characters, spaces and tabs")
            entries[key], sides[name] = entry, side
        marker, sidecar = f"{self.root}/_catalog/pending/{write}.json", f"{self.root}/_sidecar/{write}.json"
        self.fs.create(marker, json.dumps({"s3_keys": [e["s3_key"] for e in entries.values()], "sidecar": sidecar, "intended_at": self.config.clock().isoformat()}))
        self.fs.create(sidecar, json.dumps(sides))

        def move(key: str) -> None:
            path, size = staged[key]
            self.fs.move(path, entries[key]["s3_key"])
            if (found := self.fs.size(entries[key]["s3_key"])) != size:
                raise IntegrityError(f"{entries[key]['s3_key']} has {found} bytes, not {size}")

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(move, entries))
        return entries, marker

    def _footers(self, paths: dict[str, str]) -> dict[str, tuple[int, int]]:
        """Records and uncompressed bytes of each file: read here where files are mounted, else in tasks."""
        if "://" not in self.root:
            with ThreadPoolExecutor(16) as pool:
                return dict(zip(paths, pool.map(_footer, paths.values()), strict=True))
        rows = self.spark.createDataFrame(list(paths.items()), "key string, path string").repartition(min(len(paths), 64))

        def read(batches):
            import pyarrow as pa

            for batch in batches:
                found = [_footer(p) for p in batch.column("path").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["key", "records", "size"])

        return {r["key"]: (r["records"], r["size"]) for r in rows.mapInArrow(read, "key string, records long, size long").collect()}

    # -- transactions and locks -----------------------------------------------------------------

    @contextmanager
    def transaction(self):
        """Writes inside become one commit at the end; an exception leaves nothing visible. Locks last as long. One inside another joins it.

        A write with an expected version conflicts with any commit to its partitions meanwhile; others
        take the next versions. Where a token has been used meanwhile, its first file stands.
        """
        if self._pending is not None:
            yield self
            return
        self._pending, self._markers = [], []
        self.log.refresh()
        try:
            yield self
            mine = self._pending

            def actions(state: State) -> list[dict]:
                if lost := [lock.key for lock in self._locks if not lock.held()]:
                    raise LockLost(f"locks lapsed: {lost}")
                out, versions, file_id = [], {}, state.next_file_id
                for a in mine:
                    if a["action"] != "add_file":
                        out.append(a)
                        continue
                    key, token = a["file"]["partition_key"], a["file"]["idempotency_token"]
                    now = versions.get(key, state.partitions.get(key, 0))
                    if token and (key, token) in state.tokens:
                        continue
                    if a["expected"] is not None and a["file"]["version"] != now + 1:
                        raise VersionConflict(f"{key} changed meanwhile: it is at version {now}")
                    versions[key] = now + 1
                    out.append(a | {"file": a["file"] | {"file_id": file_id, "version": now + 1}})
                    file_id += 1
                return out if any(a["action"] == "add_file" for a in out) else []

            self.log.commit(actions)
            live = {f["s3_key"] for f in self.log.refresh().files.values()}
            for m in self._markers:
                if all(k in live for k in json.loads(self.fs.read(m))["s3_keys"]):
                    self.fs.delete(m)  # a marker with a file that lost a race stays for the clean-up
            self.woken.set()
        finally:
            self._pending = None
            for lock in self._locks:
                lock.release()
            self._locks = []

    def run_in_transaction(self, work: Callable[[Store], object]) -> object:
        """What ``work`` returns, its writes being one commit; it joins a transaction that is open."""
        with self.transaction():
            return work(self)

    @contextmanager
    def detached(self):
        """Writes inside commit at once and stay, whatever becomes of the transaction around them."""
        outer, self._pending = self._pending, None
        try:
            yield self
        finally:
            self._pending = outer

    def lock_partition(self, key: str, timeout: float) -> None:
        """Hold a partition's advisory lock until the transaction ends, or raise LockTimeout."""
        if self._pending is None:
            raise LockNotInTransaction("a partition lock needs a transaction")
        parse_key(key, self.config.part_names)
        if all(lock.key != key for lock in self._locks):
            lock = PartitionLock(self.fs, self.root, key)
            lock.acquire(max(timeout, 0.001))
            self._locks.append(lock)

    # -- views ----------------------------------------------------------------------------------

    def _tuples(self, records: DataFrame, view) -> DataFrame:
        rows = records.select(F.inline(view.of)).toDF(*view.columns).select(*(F.col(c).cast("string") for c in view.columns))
        return rows.dropna().dropDuplicates()

    def _stage_views(self, written: DataFrame) -> list[tuple[str, str]]:
        out = []
        for v in self.config.views:
            new = self._tuples(written, v)
            if self.log.refresh().views.get(v.name):
                new = new.join(self.view(v.name), list(v.columns), "left_anti")
            path = f"{self.root}/_catalog/mv/{v.name}/{uuid.uuid4().hex}"
            new.write.parquet(path)
            out.append((v.name, path))
        return out

    def view(self, name: str) -> DataFrame:
        """All tuples of a declared view."""
        found = [v for v in self.config.views if v.name == name]
        if not found:
            raise ValueError(f"view {name!r} is not declared")
        schema = T.StructType([T.StructField(c, T.StringType()) for c in found[0].columns])
        paths = self.log.refresh().views.get(name, [])
        return self.spark.read.schema(schema).parquet(*paths).dropDuplicates() if paths else self.spark.createDataFrame([], schema)

    def lookup(self, name: str, *filters: Filter) -> DataFrame:
        """Tuples of a view that hold all filters, in order; without a filter, all."""
        rows = self.view(name)
        return rows.where(compile_filters(filters, resolver({c: c for c in rows.columns}))).orderBy(*rows.columns)

    def lookup_values(self, name: str, *filters: Filter) -> Iterator[object]:
        """What the view's ``into`` makes of each tuple that holds all filters, in order; the tuple as a dict without one."""
        into = next((v.into for v in self.config.views if v.name == name), None)
        for row in self.lookup(name, *filters).toLocalIterator():
            yield into(**row.asDict()) if into else row.asDict()

    # -- compaction -----------------------------------------------------------------------------

    def compact_rows(self, *filters: Filter) -> DataFrame:
        """What a compacted copy of the partitions would hold: a table like a read's, with one row per live entity."""
        return self.read(*filters).select(*self.config.schema.names)

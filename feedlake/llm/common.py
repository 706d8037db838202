"""Helpers shared by the training-data operators: durable intermediates, columns that pass through, sampling and text splitting."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="feedlake-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage is cut and the rows outlive executors.

    Shuffles of the write are deleted when it ends, since nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    for made in _SCOPES[-1:]:
        made.append(out)
    return out


_SCOPES: list[list[DataFrame]] = []


@contextmanager
def cleared():
    """Delete, at the end, what ``durable`` wrote inside, but for what ``keep`` (the function given) was told to keep.

    Results outlive the block only if they read kept tables alone. Tables go too when the block fails.
    """
    _SCOPES.append([])
    kept: list[DataFrame] = []
    try:
        yield kept.append
    finally:
        made = _SCOPES.pop()
        for df in made:
            if all(df is not k for k in kept):
                drop_durable(df)
        for outer in _SCOPES[-1:]:
            outer.extend(k for k in kept if hasattr(k, "durable_path"))


def drop_durable(df: DataFrame) -> None:
    """Delete what ``durable`` wrote for ``df``, once nothing reads it any more."""
    path = df.durable_path
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def id_crc(column: str) -> Column:
    """CRC-32 of an id written as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def hash_unit(*columns: str, seed: int = 0) -> Column:
    """A reproducible number in [0, 1) from the given columns, for sampling and permuting."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)) / F.lit(float(1 << 53))


def named(column: str) -> Column:
    """A top-level column by its whole name, dots and backticks included."""
    return F.col(f"`{column.replace('`', '``')}`")


def fields_of(ddl: str) -> list[T.StructField]:
    """Fields of a schema written as ``name type, name type``."""
    return T.StructType.fromDDL(ddl).fields


def folded(df: DataFrame, *own: str) -> DataFrame:
    """``df`` with one struct ``row`` of its columns under numbers, but for those named ``own``: no name inside can clash."""
    rest = [f.name for f in df.schema.fields if f.name not in own]
    return df.select(F.struct(*(named(c).alias(f"c{n}") for n, c in enumerate(rest)), F.lit(True).alias("told")).alias("row"))


def unfolded(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """The columns that ``folded`` put in ``row``, by their names again."""
    return [F.col("row")[f"c{n}"].alias(c) for n, c in enumerate(columns)]


def map_rows(docs: DataFrame, inputs: Sequence[str], outputs: str, make: Callable[..., Iterator | Sequence], drop: Sequence[str] = ()) -> DataFrame:
    """``docs`` with new columns ``outputs`` (a schema as text), from Arrow batches of the ``inputs``, in one pass.

    ``make`` gets the batches' input columns as lists and returns one list for each output, or an index of
    source rows and then the lists, if a row becomes several or none (its first output is then named
    ``_from``). Columns of ``docs`` may have any names and types; those named like an output, or in
    ``drop``, are left out.
    """
    new = fields_of(outputs)
    several = new[0].name == "_from"
    made = [f for f in new if f.name != "_from"]
    out_names = {f.name.lower() for f in made} | {c.lower() for c in drop}
    rest = [f.name for f in docs.schema.fields if f.name.lower() not in out_names]
    row = F.struct(*(named(c).alias(f"c{n}") for n, c in enumerate(rest)), F.lit(True).alias("told"))
    extra = [c for c in inputs if c not in rest]  # read, though they do not pass through
    packed = docs.select(row.alias("row"), *(named(c).alias(f"in{n}") for n, c in enumerate(extra)))
    schema = T.StructType([packed.schema["row"], *(T.StructField(f"out{n}", f.dataType) for n, f in enumerate(made))])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in made]
        for batch in batches:
            rows = batch.column(0)
            lists = [(batch.column(1 + extra.index(c)) if c in extra else rows.field(rest.index(c))).to_pylist() for c in inputs]
            found = list(make(*lists))
            if several:
                rows, found = rows.take(pa.array(found[0], pa.int64())), found[1:]
            arrays = [pa.array(c, k) for c, k in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([rows, *arrays], names=["row", *(f"out{n}" for n in range(len(made)))])

    out = packed.mapInArrow(lambda batches: released(run(batches)), schema)
    return out.select(*(F.col("row")[f"c{n}"].alias(c) for n, c in enumerate(rest)), *(F.col(f"out{n}").alias(f.name) for n, f in enumerate(made)))


BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From now on this session's Arrow batches end at ``BATCH_BYTES``, not at 64 MB: a task holds several, in the JVM and in Python."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def released(batches: Iterator) -> Iterator:
    """``batches``; at their end the memory that this worker has freed goes back to the system, as a worker idles on between stages."""
    import pyarrow as pa

    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
        if trim:
            trim(0)


_HELD: dict[object, object] = {}


def held(key: object, make: Callable[[], object]):
    """What ``make`` gives for ``key``, kept by this worker until it needs another: one table at a time, over all operators."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


_SEGMENT = 8_192
_BLOCK = 65_536


def forget() -> None:
    """Drop what ``held`` keeps in this worker; called by operators that hold no table, so that an earlier one's goes."""
    _HELD.clear()


class WordTable:
    """Rows of numbers by word, made once per worker and summed over each text's words.

    ``make`` gives the rows of new words. The table starts afresh once it holds more than
    ``most_rows`` words or ``most_chars`` characters, so its memory is bounded; words are summed in
    blocks, so texts of any length need no more.
    """

    def __init__(self, width: int, make: Callable[[list[str]], np.ndarray], most_rows: int = 500_000, most_chars: int = 16_000_000):
        self.width, self.make, self.most_rows, self.most_chars = width, make, most_rows, most_chars
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, self.width), np.float32)
        self.chars = 0

    def sums(self, split: list[list[str]]) -> np.ndarray:
        """One row for each list of words: the sum of its words' rows."""
        if len(self.index) > self.most_rows or self.chars > self.most_chars:
            self._clear()
        fresh = [w for w in set().union(*split) if w not in self.index]
        if fresh:
            fresh.sort()
            have = len(self.index)
            need = have + len(fresh)
            if need > len(self.rows):
                grown = np.zeros((max(need, 2 * len(self.rows)), self.width), np.float32)
                grown[:have] = self.rows[:have]
                self.rows = grown
            for k in range(0, len(fresh), 20_000):
                part = fresh[k : k + 20_000]
                self.rows[have + k : have + k + len(part)] = self.make(part)
            self.index.update(zip(fresh, range(have, need), strict=True))
            self.chars += sum(map(len, fresh))
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        out = np.zeros((len(split), self.width))
        if sizes.sum():
            ids = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
            # segments start anew with each text, so a text's sum does not depend on its neighbours
            each = -(-sizes // _SEGMENT)
            owner = np.repeat(np.arange(len(split)), each)
            first = np.repeat(np.cumsum(sizes) - sizes, each) + _SEGMENT * (np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each))
            blocks = [0, *(np.flatnonzero(np.diff(first // _BLOCK)) + 1).tolist(), len(first)]
            for a, b in zip(blocks, blocks[1:], strict=False):
                lo, hi = first[a], first[b] if b < len(first) else len(ids)
                np.add.at(out, owner[a:b], np.add.reduceat(self.rows[ids[lo:hi]], first[a:b] - lo, axis=0, dtype=np.float64))
        return out

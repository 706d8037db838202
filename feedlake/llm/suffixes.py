"""Exact substring deduplication by a logarithmic family of counts by minimiser, which replace sorted suffix arrays.

No suffix is sorted or stored; a "sparse array" below is the table of runs under their anchors, and
the merge scan groups and joins by anchor once all batches are in.

A window is a string of ``length`` bytes. Its anchor is the least hash among the ``ANCHOR``-byte
strings in it, so equal windows have equal anchors wherever they stand. Neighbouring windows
mostly share one anchor, the leftmost if it repeats; such a run is one suffix of the sparse array, filed under its anchor and
named by its content, the ``length`` + run - 1 bytes that it spans. Windows are equal only if
their anchors are, so a merge scan by anchor meets every match; a content has one anchor.

Batches of documents enter as arrays of their own, and levels of one size merge into the next, so
an entry is rewritten as often as the logarithm of the number of batches. An entry keeps how often
its anchor occurs and whether always in one content. Matches are drawn from the levels' merge scan:

* an anchor that occurs once matches nothing;
* where all occurrences have one content, all their windows match;
* else each different content is opened into its windows once, and a window matches if it occurs
  in two contents or in one that occurs twice.

Counting replaces pairing throughout, so a passage in a third of all documents costs no more per
occurrence than any other.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_durable, durable

LENGTH = 200
ANCHOR = 64
BATCHES = 2
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_BYTES = np.frombuffer(b"".join(hashlib.sha256(bytes([b])).digest()[:8] for b in range(256)), np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, from 0 to ``n`` - 1 at least."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 17)
        for name, base in (("up", _MULTIPLIER), ("down", _INVERSE)):
            row = np.full(size, np.uint64(base))
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["up"], _POWERS["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)


class Hashed:
    """Hashes of all substrings of a byte string, from one pass over it."""

    def __init__(self, data: bytes):
        self.n = len(data)
        up, self.down = _powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_BYTES[np.frombuffer(data, np.uint8)] * up[: self.n], out=self.sums[1:])

    def at(self, starts: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return _mix((self.sums[starts + length] - self.sums[starts]) * self.down[starts] + np.asarray(length).astype(np.uint64))

    def every(self, length: int) -> np.ndarray:
        return _mix((self.sums[length:] - self.sums[: self.n + 1 - length]) * self.down[: self.n + 1 - length] + np.uint64(length))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least element of each ``width`` neighbours."""
    n = len(x)
    blocks = -(-n // width)
    grid = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = x
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    last = n - width + 1
    return np.minimum(behind[:last], ahead[width - 1 : width - 1 + last])


def sparse_suffixes(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, content, first window and windows of each run in a byte string."""
    if len(data) < length:
        empty = np.zeros(0, np.int64)
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty
    anchor = min(ANCHOR, length)
    hashed = Hashed(data)
    each = hashed.every(anchor)
    least = _least(each, length - anchor + 1)
    # a run ends where its anchor leaves, even for another of the same hash: no window repeats within a run
    starts = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (each[: len(least) - 1] == least[:-1])]))
    runs = np.diff(starts, append=len(least))
    return least[starts], hashed.at(starts, runs + length - 1), starts, runs


def _data(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


_SUFFIX = "doc_id long, mark long, anchor long, content long, start int, run int"


def _table(columns: list, schema: str):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    named = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, named, strict=True)], names=[n for n, _ in named])


def suffix_array(docs: DataFrame, length: int) -> DataFrame:
    """Sparse suffixes of each text; a row is told by its doc_id and ``mark``, a hash of its text."""

    def run(batches):
        for batch in batches:
            ids, marks, texts = (batch.column(c).to_pylist() for c in ("doc_id", "mark", "text"))
            for k in range(0, len(texts), 256):
                parts, counts = [], []
                for text in texts[k : k + 256]:
                    parts.append(sparse_suffixes(_data(text), length))
                    counts.append(len(parts[-1][0]))
                anchor, content, start, runs = (np.concatenate(c) for c in zip(*parts, strict=True))
                own = [x for x, n in zip(ids[k : k + 256], counts, strict=True) for _ in range(n)]
                yield _table([own, np.repeat(np.array(marks[k : k + 256], np.int64), counts), anchor.view(np.int64), content.view(np.int64), start, runs], _SUFFIX)

    return docs.select("doc_id", "mark", "text").mapInArrow(run, _SUFFIX)


class SuffixIndex:
    """The family of levels over (doc_id, mark, text) rows."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, docs: DataFrame) -> None:
        """Index a batch; equal levels merge into the next."""
        found = suffix_array(docs, self.length).select("anchor", "content")
        size, level = 1, durable(found.groupBy("anchor").agg(F.count("*").alias("times"), F.min("content").alias("low"), F.max("content").alias("high")), "level")
        while self.levels and self.levels[-1][0] == size:
            _, other = self.levels.pop()
            merged = durable(self._merged([other, level]), "level")
            drop_durable(other)
            drop_durable(level)
            size, level = 2 * size, merged
        self.levels.append((size, level))

    def _merged(self, levels: list[DataFrame]) -> DataFrame:
        every = reduce(DataFrame.union, levels)
        return every if len(levels) == 1 else every.groupBy("anchor").agg(F.sum("times").alias("times"), F.min("low").alias("low"), F.max("high").alias("high"))

    def repeated(self) -> DataFrame:
        """Anchors that occur twice or more in all batches, and whether in one content."""
        scanned = self._merged([level for _, level in self.levels])
        return scanned.where("times > 1").select(F.col("anchor").alias("again"), (F.col("low") == F.col("high")).alias("same"))

    def matches(self, docs: DataFrame) -> DataFrame:
        """doc_id, mark, ``start``, ``run`` and ``at`` of each run with a match: which of its windows match, null for all.

        ``docs`` are all rows that were added. The index is used up: its levels are deleted once scanned.
        """
        hits = suffix_array(docs, self.length).join(self.repeated(), F.col("anchor") == F.col("again")).drop("again")
        hits = durable(hits, "hits")
        for _, level in self.levels:
            drop_durable(level)
        self.levels = []
        alike = hits.where("same").select("doc_id", "mark", "start", "run", F.lit(None).cast("array<int>").alias("at"))
        mixed = hits.where("not same")
        contents = mixed.groupBy("content").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "mark", "start", "run")).alias("one"))
        contents = durable(contents.select("content", "times", "one.*"), "contents")
        windows = durable(self._open(docs, contents), "windows")
        twice = durable(windows.groupBy("window").agg(F.sum("times").alias("total")).where("total > 1").select(F.col("window").alias("shared")), "shared-windows")
        shared = windows.where("times = 1").join(twice, F.col("window") == F.col("shared"))
        partly = shared.groupBy("content").agg(F.sort_array(F.collect_list("offset")).alias("at"))
        whole = contents.where("times > 1").select("content", F.lit(None).cast("array<int>").alias("at"))
        kept = durable(partly.union(whole), "covers")
        for done in (windows, twice, contents):
            drop_durable(done)
        covers = kept.select(F.col("content").alias("c"), "at")
        opened = mixed.join(covers, F.col("content") == F.col("c")).select("doc_id", "mark", "start", "run", "at")
        return alike.union(opened)

    def _open(self, docs: DataFrame, contents: DataFrame) -> DataFrame:
        """Hashes of every window of every content, from the text of the one run that stands for it."""
        length = self.length
        lists = contents.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("content", "start", "run", F.least("times", F.lit(2)).alias("times"))).alias("runs"))
        told = lists.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "runs")
        met = docs.join(told, docs["doc_id"].eqNullSafe(told["d"]) & (docs["mark"] == told["m"])).select("text", "runs")
        schema = "window long, content long, offset int, times int"

        def run(batches):
            for batch in batches:
                for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                    hashed = Hashed(_data(text))
                    sizes = np.array([r["run"] for r in runs])
                    offset = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    starts = np.repeat(np.array([r["start"] for r in runs]), sizes) + offset
                    content, times = (np.repeat(np.array([r[c] for r in runs], np.int64), sizes) for c in ("content", "times"))
                    yield _table([hashed.at(starts, length).view(np.int64), content, offset, times], schema)

        opened = met.mapInArrow(run, schema)
        return opened


def removed_spans(runs: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal byte spans that the matching windows of the runs cover."""
    parts = []
    for r in runs or ():
        at = np.arange(r["run"]) if r["at"] is None else np.array(r["at"], np.int64)
        cut = np.flatnonzero(np.diff(at) > length) + 1 if len(at) else []
        parts += [(r["start"] + p[0], r["start"] + p[-1] + length) for p in np.split(at, cut) if len(p)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], int(b)))
        else:
            out.append((int(a), int(b)))
    return out


def _dedup(docs: DataFrame, schema: str, finish, length: int, batches: int) -> DataFrame:
    base = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    index = SuffixIndex(length)
    for b in range(batches):
        index.add(base.where(F.pmod(F.xxhash64(F.lit(1), "mark"), F.lit(batches)) == b))
    found = index.matches(base).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "run", "at")).alias("runs"))
    told = found.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "runs")
    joined = base.join(told, base["doc_id"].eqNullSafe(told["d"]) & (base["mark"] == told["m"]), "left").select("doc_id", "text", "runs")

    def run(batches):
        for batch in batches:
            ids, texts, runs = (batch.column(c).to_pylist() for c in ("doc_id", "text", "runs"))
            rows = [(i, *finish(_data(t), removed_spans(r, length))) for i, t, r in zip(ids, texts, runs, strict=True)]
            if rows:
                yield _table(list(zip(*rows, strict=True)), schema)

    return joined.mapInArrow(run, schema)


def _kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def deduplicate(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """doc_id, ``text`` without repeated bytes, and the removed spans as ``start:end`` of bytes, comma-joined.

    ``docs`` needs doc_id and text; other columns are left out. A null text counts as empty. Bytes cut
    from within a character leave a replacement sign. Repeated rows remove each other's text.
    """
    schema = "doc_id long, text string, spans string"
    return _dedup(docs, schema, lambda data, spans: (_kept(data, spans).decode("utf-8", "replace"), ",".join(f"{a}:{b}" for a, b in spans)), length, batches)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without bytes in repeated 200-byte strings."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def finish(data: bytes, spans: list[tuple[int, int]]) -> tuple:
        return len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_kept(data, spans)).hexdigest()

    return _dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), schema, finish, LENGTH, BATCHES)

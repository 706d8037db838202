"""Packing tokenised documents into fixed-length sequences: Martello-Toth reduction, then best fit.

Pieces are told apart only by length, so the instance is a histogram of at most ``capacity``
sizes however many documents there are. The driver packs that histogram: the reduction fixes
bins that provably dominate every alternative for their largest piece, best fit decreasing packs
what remains, and both work on counts, not on pieces. The plan lists, per length, which ranks go
to which sequences at which offset; pieces look their place up by length and rank.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right
from collections import defaultdict
from functools import cached_property

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, forget, held, released

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
CAPACITY = 1024
_ODD_SPACE = re.compile(r"[\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] \s")


class Tokens:
    """Token ids, as little-endian bytes, of a text's space-separated chunks; kept until large.

    The tokeniser starts a new word at each space between two other characters, so chunks tokenise
    apart. Texts where a space has white space on both sides are tokenised whole.
    """

    def __init__(self, path: str, most: int = 250_000):
        self.path = path
        self.most = most
        self.known: dict[str, bytes] = {}
        self.fast, self.size = _ranked(path)

    @cached_property
    def encode(self):
        """The tokeniser itself; it takes more memory than all else here, so it is read when a text first needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path).encode

    def whole(self, text: str) -> bytes:
        ids = self.fast(text) if self.fast and "<|" not in text else self.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _learn(self, chunks: list[str]) -> None:
        """Ids of chunks that follow a space. Ordinary ones are encoded in one go and told apart by their tokens' bytes."""
        plain = [c for c in chunks if c and not c[0].isspace() and not c[-1].isspace() and "<|" not in c] if self.fast else []
        for k in range(0, len(plain), 20_000):
            part = plain[k : k + 20_000]
            ids = np.array(self.fast(" " + " ".join(part)), "<u4")
            ends = np.cumsum([1 + len(c.encode()) for c in part])
            at = 4 * np.searchsorted(np.cumsum(self.size[ids]), ends, side="left") + 4
            data = ids.tobytes()
            for c, lo, hi in zip(part, [0, *at[:-1].tolist()], at.tolist(), strict=True):
                self.known[c] = data[lo:hi]
        for c in set(chunks).difference(plain):
            self.known[c] = self.whole(" " + c)

    def of(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes; nothing for a null or empty one."""
        if len(self.known) > self.most:
            self.known = {}
        split = [None if not t or "  " in t or _ODD_SPACE.search(t) else t.split(" ") for t in texts]
        heads = [s and s.pop(0) for s in split]
        found = [s and list(map(self.known.get, s)) for s in split]
        gaps = [(k, [n for n, v in enumerate(f) if v is None]) for k, f in enumerate(found) if f and None in f]
        fresh = list({split[k][n] for k, at in gaps for n in at})
        self._learn(fresh)
        for k, at in gaps:
            for n in at:
                found[k][n] = self.known[split[k][n]]
        for c in fresh:
            if len(c) > 60:
                del self.known[c]
        return [(self.whole(t) if t else b"") if f is None else b"".join([self.whole(h), *f]) for t, h, f in zip(texts, heads, found, strict=True)]


def _ranked(path: str):
    """An encoder over the same vocabulary kept as ranks beside ``path``, if there is one; same ids, less time."""
    import base64
    import importlib.util
    import os

    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks) or importlib.util.find_spec("tiktoken") is None:
        return None, None
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    size = np.zeros(max(table.values()) + 1, np.int64)
    for token, rank in table.items():
        size[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary, size


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one if it fits, else full ones after a possibly shorter first."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


PIECES = "piece int, start long, length long, ids_crc32 long, part int, part_rank long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenised pieces of each document: its columns but ``text``, and those of ``PIECES`` (and ``ids``).

    ``part`` is the task that made the piece and ``part_rank`` its number there among pieces of its
    length. A null or empty text is the end id alone.
    """
    rest = [c for c in docs.columns if c != "text"]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name != "text")
    schema = fields + PIECES + (", ids array<int>" if with_ids else "")

    def run(batches):
        import pyarrow as pa

        tokens, part = held(tokenizer, lambda: Tokens(tokenizer)), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, owners, ids = [], [], []
            texts = batch.column("text").to_pylist()
            for k, encoded in enumerate(x for lo in range(0, len(texts), 8) for x in tokens.of(texts[lo : lo + 8])):
                data = memoryview(encoded + end)
                for n, (start, length) in enumerate(cuts(len(data) // 4, capacity)):
                    own = data[4 * start : 4 * (start + length)]
                    rows.append((n, start, length, zlib.crc32(own), part, seen[length]))
                    owners.append(k)
                    seen[length] += 1
                    if with_ids:
                        ids.append(np.frombuffer(own, "<i4"))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            taken = batch.select(rest).take(pa.array(owners, pa.int64())).columns if rest else []
            arrays = taken + [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            names = rest + [c.split()[0] for c in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names=names + ["ids"] * with_ids)

    return docs.mapInArrow(lambda batches: released(run(batches)), schema)


class Plan:
    """Bins of equal content, and where the pieces of each length go by rank."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.bins: list[tuple[list[tuple[int, int]], int]] = []
        self.capacity = capacity
        left = {size: n for size, n in histogram.items() if n}
        if any(not 0 < size <= capacity for size in left):
            raise ValueError(f"piece lengths must lie in 1..{capacity}")
        self.reduced = self._reduce(left)
        self._best_fit(left)
        self._number()

    def _take(self, left: dict[int, int], content: list[tuple[int, int]], times: int) -> None:
        for size, n in content:
            left[size] -= n * times
            if not left[size]:
                del left[size]
        self.bins.append((content, times))

    def _reduce(self, left: dict[int, int]) -> int:
        """Fix bins that dominate all other ways to place their first piece; the number of fixed bins."""
        before, changed = sum(n for _, n in self.bins), True
        while changed:
            changed = False
            for size in sorted(left, reverse=True):
                while size in left and (found := self._dominating(left, size)):
                    self._take(left, *found)
                    changed = True
        return sum(n for _, n in self.bins) - before

    def _dominating(self, left: dict[int, int], size: int) -> tuple[list[tuple[int, int]], int] | None:
        """A content for ``size`` and up to two more pieces no worse than any other, and how often it can be fixed."""
        room = self.capacity - size
        if room in left and (room != size or left[size] > 1):  # an exact pair
            return ([(size, 2)], left[size] // 2) if room == size else ([(size, 1), (room, 1)], min(left[size], left[room]))
        others = sorted(s for s, n in left.items() if s <= room and (s != size or n > 1))
        if not others:
            return [(size, 1)], left[size]

        def available(s: int) -> int:
            return left[s] - (s == size)

        smallest = [s for s in others[:3] for _ in range(min(3, available(s)))][:3]
        largest = others[-1]
        if len(smallest) < 2 or smallest[0] + smallest[1] > room:  # one more fits at most
            return ([(size, 2)], left[size] // 2) if largest == size else ([(size, 1), (largest, 1)], min(left[size], left[largest]))
        if len(smallest) > 2 and sum(smallest) <= room or size in others:
            return None
        widest, lower = 0, 0  # of all pairs that fit: the largest sum, and the largest smaller member
        for k, s in enumerate(others):
            j = bisect_right(others, room - s) - 1
            if j == k and available(s) < 2:
                j -= 1
            if j >= k:
                widest, lower = max(widest, s + others[j]), max(lower, s)
        if widest <= largest:
            return [(size, 1), (largest, 1)], min(left[size], left[largest])
        j = bisect_right(others, room - largest) - 1
        if j >= 0 and others[j] == largest and available(largest) < 2:
            j -= 1
        if j >= 0 and lower <= others[j]:
            if others[j] == largest:
                return [(size, 1), (largest, 2)], min(left[size], left[largest] // 2)
            return [(size, 1), (largest, 1), (others[j], 1)], min(left[size], left[largest], left[others[j]])
        return None

    def _best_fit(self, left: dict[int, int]) -> None:
        """Best fit decreasing over counts: equal bins are filled together."""
        open_bins: dict[int, list[tuple[list[tuple[int, int]], int]]] = defaultdict(list)
        rooms: list[int] = []

        def put(content: list[tuple[int, int]], times: int) -> None:
            if not times:
                return
            room = self.capacity - sum(s * n for s, n in content)
            if room == 0:
                self.bins.append((content, times))
                return
            if room not in open_bins or not open_bins[room]:
                k = bisect_right(rooms, room)
                if not k or rooms[k - 1] != room:
                    rooms.insert(k, room)
            open_bins[room].append((content, times))

        for size in sorted(left, reverse=True):
            count = left[size]
            while count:
                k = bisect_right(rooms, size - 1)
                if k == len(rooms):
                    fit = self.capacity // size
                    put([(size, fit)], count // fit)
                    put([(size, count % fit)] if count % fit else [], 1 if count % fit else 0)
                    break
                room = rooms[k]
                content, times = open_bins[room].pop()
                if not open_bins[room]:
                    del rooms[k]
                fit = room // size
                full = min(times, count // fit)
                rest = min(count - full * fit, fit) if full < times else 0
                put([*content, (size, fit)], full)
                if rest:
                    put([*content, (size, rest)], 1)
                put(content, times - full - bool(rest))
                count -= full * fit + rest
        self.bins += [b for bins in open_bins.values() for b in bins]

    def _number(self) -> None:
        sequence, ranks, rows = 0, defaultdict(int), []
        for content, times in self.bins:
            offset = 0
            for size, n in content:
                rows.append((size, ranks[size], n, sequence, offset))
                ranks[size] += n * times
                offset += size * n
            sequence += times
        self.sequences = sequence
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.lengths, self.first_rank, self.each, self.sequence, self.offset = table.T.copy()
        self.begin = np.searchsorted(self.lengths, np.arange(self.capacity + 2))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these lengths and ranks."""
        row = np.empty(len(length), np.int64)
        for size in np.unique(length):
            at, lo, hi = length == size, self.begin[size], self.begin[size + 1]
            row[at] = lo + np.searchsorted(self.first_rank[lo:hi], rank[at], side="right") - 1
        local = rank - self.first_rank[row]
        return self.sequence[row] + local // self.each[row], self.offset[row] + local % self.each[row] * length


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece of ``docs`` with its ``sequence_id`` and ``offset``.

    ``docs`` has a text column; others pass through, but for names of this operator's own, which are
    replaced. Repeated rows are packed as often as they occur. An empty table packs to no row.
    """
    own = [c.split()[0] for c in PIECES.split(", ")] + ["ids", "sequence_id", "offset"]
    made = durable(pieces(docs.drop(*own), tokenizer, capacity, end_id, with_ids), "pieces")
    counts = durable(made.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = made.sparkSession.sparkContext.broadcast(Plan(histogram, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = made.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("part_rank")).select(*(c for c in made.columns if c not in ("part", "part_rank")), "rank")
    names = [c for c in ranked.columns if c != "rank"]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in ranked.schema.fields if f.name != "rank") + "sequence_id long, offset long"

    def run(batches):
        import pyarrow as pa

        forget()  # the token table is not needed to place pieces
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            sequence, offset = plan.value.place(length, rank)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(lambda batches: released(run(batches)), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids of each sequence, from pieces packed with their ids."""
    content = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda s: s["ids"]))
    return packed.groupBy("sequence_id").agg(content.alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), default_tokenizer())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

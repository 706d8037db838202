"""Quality scores: random-indexing word vectors pooled per document, and a two-layer network.

A white-space chunk breaks into units: its letters in lower case, its marks, and its shape. Each
unit has an index vector, sparse and ternary, drawn from a hash of its name. A unit met in
training also has a context vector, the sum of its neighbours' index vectors; the two, weighted,
are its word vector, and unmet units fall back on the index vector. A document is the mean of its
units' vectors, with the share of chunks that repeat the one before. A network of one hidden layer, trained in numpy, gives a logit; a temperature
fitted on labelled rows that the training has not seen makes it a probability.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from dataclasses import dataclass, field
from itertools import islice
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordTable, hash_unit, held, id_crc, map_rows

_UNIT = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_NONZERO = 6


def units(chunk: str) -> list[str]:
    """Names of a chunk's parts and of its shape."""
    out = []
    for part in _UNIT.findall(chunk):
        if part[0].isalpha():
            out.append("w" + part.lower())
            if part.isupper() and len(part) > 1:
                out.append("s:upper")
        elif part[0].isdigit():
            out.append(f"s:digits{min(len(part), 5)}")
        else:
            out.append("m" + part[:3])
    return out


def _index_vectors(names: list[str], width: int) -> np.ndarray:
    """Sparse ternary vectors from hashes of the names."""
    out = np.zeros((len(names), width), np.float32)
    seeds = np.fromiter((zlib.crc32(n.encode("utf-8", "surrogatepass")) for n in names), np.uint64, len(names))
    for k in range(_NONZERO):
        seeds = (seeds ^ (seeds >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(k + 1)
        place = (seeds >> np.uint64(33)) % np.uint64(width)
        np.add.at(out, (np.arange(len(names)), place.astype(np.int64)), np.where(seeds >> np.uint64(63), 1.0, -1.0).astype(np.float32))
    return out


@dataclass
class QualityModel:
    """Word vectors, the network's weights and the temperature."""

    width: int = 64
    hidden: int = 32
    window: int = 2
    most_words: int = 30_000
    temperature: float = 1.0
    token: str = field(default_factory=lambda: uuid.uuid4().hex)
    weights: list | None = None

    def fit(self, texts: list[str], labels: np.ndarray, seed: int = 5, epochs: int = 60) -> QualityModel:
        """Learn word vectors on all ``texts``, the network on four fifths of them and the temperature on the rest; nothing without texts."""
        if not len(texts):
            return self
        self._fit_words(texts)
        x = self.pool(texts)
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(texts))
        held, train = order[: max(1, len(order) // 5)], order[len(order) // 5 :] if len(order) > 4 else order
        self.centre, self.scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-6
        z, y = (x - self.centre) / self.scale, labels.astype(float)
        d = z.shape[1]
        p = [rng.normal(0, np.sqrt(2 / d), (d, self.hidden)), np.zeros(self.hidden), rng.normal(0, np.sqrt(1 / self.hidden), self.hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(train), max(1, len(train) // 128)):
                xb, yb = z[batch], y[batch]
                h = np.maximum(xb @ p[0] + p[1], 0)
                g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - yb) / len(batch)
                gh = np.outer(g, p[2]) * (h > 0)
                grads = [xb.T @ gh + 1e-4 * p[0], gh.sum(axis=0), h.T @ g + 1e-4 * p[2], g.sum(keepdims=True)]
                step += 1
                for a, b, c, q in zip(p, m, v, grads, strict=True):
                    b += 0.1 * (q - b)
                    c += 0.001 * (q * q - c)
                    a -= 2e-3 * (b / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.999**step)) + 1e-8)
        self.weights = p
        logit, gold = self._logits(x[held]), y[held]
        grid = np.geomspace(0.3, 10, 80)
        loss = [np.mean(np.logaddexp(0, logit / t) - gold * logit / t) for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def _fit_words(self, texts: list[str]) -> None:
        counts = Counter(u for t in texts for c in t.split() for u in units(c))
        words = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: self.most_words]]
        self.words = {w: n for n, w in enumerate(words)}
        index = _index_vectors([*words, ""], self.width)
        gap = len(words)  # stands for units outside the vocabulary, and parts documents
        index[gap] = 0
        context = np.zeros((len(words) + 1, self.width), np.float32)
        parts = (self.words.get(u, gap) for t in texts for c in [*t.split(), None] for u in (units(c) if c else [""] * self.window))
        flat = np.fromiter(parts, np.int64)  # names are made twice rather than kept
        for offset in range(1, self.window + 1):
            pair, n = np.unique(np.concatenate([flat[:-offset] * (gap + 1) + flat[offset:], flat[offset:] * (gap + 1) + flat[:-offset]]), return_counts=True)
            for lo in range(0, len(pair), 50_000):
                part, times = pair[lo : lo + 50_000], n[lo : lo + 50_000].astype(np.float32)
                owner, first = np.unique(part // (gap + 1), return_index=True)
                context[owner] += np.add.reduceat(index[part % (gap + 1)] * times[:, None], first, axis=0)
        length = np.linalg.norm(context, axis=1, keepdims=True)
        own = index / np.maximum(np.linalg.norm(index, axis=1, keepdims=True), 1e-9)
        self.vectors = (own + context / np.maximum(length, 1e-9)).astype(np.float32)

    def _rows(self, chunks: list[str]) -> np.ndarray:
        """Summed unit vectors of each chunk, and its units."""
        named = [units(c) for c in chunks]
        flat = [u for names in named for u in names]
        out = np.zeros((len(chunks), self.width + 1), np.float32)
        if flat:
            known = np.fromiter((self.words.get(u, -1) for u in flat), np.int64, len(flat))
            vectors = np.empty((len(flat), self.width), np.float32)
            vectors[known >= 0] = self.vectors[known[known >= 0]]
            unmet = np.flatnonzero(known < 0)
            if len(unmet):
                fresh = _index_vectors([flat[k] for k in unmet], self.width)
                vectors[unmet] = fresh / np.maximum(np.linalg.norm(fresh, axis=1, keepdims=True), 1e-9)
            sizes = np.fromiter(map(len, named), np.int64, len(named))
            full = np.flatnonzero(sizes)
            out[full, :-1] = np.add.reduceat(vectors, (np.cumsum(sizes) - sizes)[full], axis=0)
            out[:, -1] = sizes
        return out

    def table(self) -> WordTable:
        return WordTable(self.width + 1, self._rows, most_rows=400_000)

    def pool(self, texts: list[str | None], table: WordTable | None = None) -> np.ndarray:
        """Mean unit vector of each whole text and its share of chunks that repeat the one before; zero without units."""
        split = [(t or "").split() for t in texts]
        sums = (table or self.table()).sums(split)
        again = [sum(map(eq, s, islice(s, 1, None))) / max(1, len(s)) for s in split]
        return np.column_stack([sums[:, :-1] / np.maximum(sums[:, -1:], 1), again])

    def _logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.maximum((x - self.centre) / self.scale @ a + b, 0) @ c + d[0]

    def score(self, texts: list[str | None], table: WordTable | None = None) -> np.ndarray:
        """Probability of label 1 for each whole text; one half where nothing was learnt."""
        if self.weights is None:
            return np.full(len(texts), 0.5)
        return 1 / (1 + np.exp(-np.clip(self._logits(self.pool(texts, table)) / self.temperature, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, modulus: int, remainder: int, most_rows: int = 4_000) -> QualityModel:
    """Fit on the first ``most_rows`` labelled texts, by a hash of the id, of those whose id's CRC-32 leaves another remainder.

    The bound holds for any labels: it is a top-k of them, small enough to broadcast, so texts are filtered where they
    lie. Repeated labels count once; of rows with one id and label, the least text does. Without any
    labelled text the model knows nothing and gives every text one half.
    """
    chosen = labels.where(F.coalesce(id_crc("doc_id") % modulus != remainder, F.lit(False)) & F.col("quality").isNotNull())
    chosen = chosen.select("doc_id", "quality").distinct().orderBy(hash_unit("doc_id", seed=21), "doc_id", "quality").limit(most_rows)
    labelled = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    rows = labelled.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("text", "quality").collect()
    rows.sort(key=lambda r: (r["text"], r["quality"]))
    return QualityModel().fit([r["text"] for r in rows], np.array([r["quality"] for r in rows]))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; whole texts of any length, one pass, no shuffle.

    A null text scores as an empty one, whose vector is zero. A score of exactly one half predicts 1.
    Repeated rows score alike; an empty table gives no row. Columns of ``docs`` by those two names are
    replaced; all others pass through as they are.
    """
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts):
        model = handle.value
        found = np.concatenate([model.score(texts[k : k + 64], held(model.token, model.table)) for k in range(0, len(texts), 64)] or [np.zeros(0)])
        return found, (found >= 0.5).astype(np.int32)

    return map_rows(docs, ["text"], "score double, predicted int", make)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from labelled ones outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), 3, 1)
    out = F.coalesce(id_crc("doc_id") % 3 == 1, F.lit(False)).alias("held_out")
    return score(docs.select("doc_id", out, "text"), model).select("doc_id", "held_out", "score", "predicted")

"""Language identification with interpolated Kneser-Ney character models.

One model per language. A model scores a word as a sequence of characters between word
boundaries: ``p(c | h) = max(n(hc) - D, 0) / n(h) + gamma(h) * p(c | h')``, with raw counts at
the highest order and continuation counts below it. N-grams of every order sit in sorted arrays
of 64-bit hashes; a lookup is a binary search. All languages share the arrays' keys, and each
has its own column of log-probabilities and back-off weights.

A text's cross-entropy is the mean of its letters' negative log-probabilities. The language with
the lowest wins. A posterior, whose temperature is fitted on labelled texts kept out of the
counts, is the score; a text is rejected where it has no letter, or its cross-entropy lies far
above what the winner's own texts of that length have.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordTable, drop_durable, durable, hash_unit, held, id_crc, map_rows

UNDETERMINED = "und"
BROADCAST_LANGUAGES = 10_000
SCHEMA = "lang_pred string, score double, cross_entropy double, rejected boolean, letters long"
_LETTERS = re.compile(r"[^\W\d_]+")
_BOUNDARY = 1
_LONGEST = 4096  # a longer run of letters is scored in pieces of this length, so that memory is bounded


def _pieces(text: str) -> list[str]:
    """Runs of letters in a text; signs such as a raised two, which belong to words but are no letters, make no run alone."""
    found = [p for p in _LETTERS.findall(text) if p.isalpha() or any(map(str.isalpha, p))]
    return [p[k : k + _LONGEST] for p in found for k in range(0, len(p), _LONGEST)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    return x * np.uint64(0x9E3779B97F4A7C15)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each between boundaries, and where each position's word starts."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    total = len(flat) + 2 * len(words)
    starts = np.concatenate([[0], np.cumsum(lengths + 2)[:-1]]).astype(np.int64)
    codes = np.full(total, _BOUNDARY, np.uint64)
    inner = np.ones(total, bool)
    inner[starts] = inner[starts + lengths + 1] = False
    codes[inner] = flat
    return codes, np.repeat(starts, lengths + 2)


def _grams(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order, the hash of the n-gram that ends at each position."""
    out, h = [], np.zeros(len(codes), np.uint64)
    for n in range(1, order + 1):
        shifted = np.zeros_like(codes)
        shifted[n - 1 :] = codes[: len(codes) - n + 1]
        h = _mix(h + shifted + np.uint64(0x517CC1B727220A95 + n))
        out.append(h)
    return out


@dataclass
class KneserNey:
    """Character models of several languages; see the module's text."""

    languages: list[str]
    order: int
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    gamma: list[np.ndarray]
    floor: np.ndarray
    temperature: float = 1.0
    usual: np.ndarray | None = None
    spread: np.ndarray | None = None
    token: str = field(default_factory=lambda: uuid.uuid4().hex)

    @classmethod
    def fit(cls, texts: dict[str, list[str]], order: int = 5, discount: float = 0.75) -> KneserNey:
        """Count and estimate on ``texts``, lists of texts by language."""
        languages = sorted(texts)
        if not languages:
            return cls([], order, [], [], [], np.zeros(0))
        per, alphabet = [], set()
        for language in languages:
            words = Counter(w for t in texts[language] for w in _pieces(t.lower()))
            names = sorted(words) or ["\u0001"]
            codes, starts = _codes(names)
            weights = np.repeat(np.array([words[w] or 1 for w in names], float), [len(w) + 2 for w in names])
            alphabet.update(codes.tolist())
            per.append((codes, starts, weights))
        floor = np.full(len(languages), -np.log(len(alphabet) + 1.0))
        tables: list[list[tuple]] = [[] for _ in range(order)]
        for codes, starts, weights in per:
            grams, at = _grams(codes, order), np.arange(len(codes))
            found = []
            for n in range(1, order + 1):
                ok = np.flatnonzero((at - n + 1 >= starts) & (at > starts))
                keys, first, inverse = np.unique(grams[n - 1][ok], return_index=True, return_inverse=True)
                found.append((keys, ok[first], np.bincount(inverse, weights[ok])))
            previous = None
            for n in range(1, order + 1):
                keys, last, counts = found[n - 1]
                if n < order:  # distinct left neighbours instead of occurrences; word starts keep their counts
                    _, longer, _ = found[n]
                    slot = np.searchsorted(keys, grams[n - 1][longer])
                    left = np.bincount(slot, minlength=len(keys))
                    counts = np.where(left > 0, left, counts if n > 1 else 1)
                history = grams[n - 2][last - 1] if n > 1 else np.zeros(len(keys), np.uint64)
                contexts, inverse = np.unique(history, return_inverse=True)
                total, kinds = np.bincount(inverse, counts), np.bincount(inverse)
                weight = discount * kinds / total
                lower = np.exp(floor[0]) if previous is None else previous[np.searchsorted(found[n - 2][0], grams[n - 2][last])]
                p = np.maximum(counts - discount, 0) / total[inverse] + weight[inverse] * lower
                previous = p
                tables[n - 1].append((keys, np.log(p), contexts, np.log(weight)))
        keys, logp, gamma = [], [], []
        for n in range(order):
            # a context of order n is the n-gram before it, so its weight is kept with that n-gram
            wanted = [t[0] for t in tables[n]] + ([t[2] for t in tables[n + 1]] if n + 1 < order else [])
            union = np.unique(np.concatenate(wanted))
            p = np.full((len(union), len(languages)), np.nan, np.float32)
            g = np.zeros((len(union), len(languages)), np.float32)
            for k in range(len(languages)):
                p[np.searchsorted(union, tables[n][k][0]), k] = tables[n][k][1]
                if n + 1 < order:
                    g[np.searchsorted(union, tables[n + 1][k][2]), k] = tables[n + 1][k][3]
            keys.append(union)
            logp.append(p)
            gamma.append(g)
        root = np.array([t[3][0] for t in tables[0]])
        return cls(languages, order, keys, logp, gamma, floor + root)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Summed natural log-probability of each word, by language; the last column counts its characters."""
        codes, starts = _codes(words)
        grams, at = _grams(codes, self.order), np.arange(len(codes))
        score = np.tile(self.floor.astype(np.float32), (len(codes), 1))
        context, weights = None, None
        for n in range(1, self.order + 1):
            keys, h = self.keys[n - 1], grams[n - 1]
            slot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = np.flatnonzero((keys[slot] == h) & (at - n + 1 >= starts))
            slot = slot[hit]
            if context is not None:  # the weight of the context of n - 1 characters before a position
                ends = context[0] + 1
                inside = ends < len(codes)
                inside[inside] &= (ends - n + 1 >= starts[np.minimum(ends, len(codes) - 1)])[inside]
                score[ends[inside]] += weights[context[1][inside]]
            p = self.logp[n - 1][slot]
            np.copyto(p, score[hit], where=np.isnan(p))
            score[hit] = p
            context, weights = (hit, slot), self.gamma[n - 1]
        score[at == starts] = 0
        first = np.flatnonzero(at == starts)
        counted = np.diff(first, append=len(at)) - 1.0
        return np.column_stack([np.add.reduceat(score, first, axis=0, dtype=np.float64), counted])

    def _word_rows(self, words: list[str]) -> np.ndarray:
        """``word_scores`` of words as they stand in a text: only their letters count."""
        pieces = [_pieces(w) for w in words]
        out = np.zeros((len(words), len(self.languages) + 1))
        flat, owner = [p for ps in pieces for p in ps], np.repeat(np.arange(len(words)), [len(p) for p in pieces])
        room = np.cumsum([len(p) for p in flat]) // (64 * _LONGEST) if flat else np.zeros(0, int)
        for k in np.unique(room):  # a bounded number of characters at a time
            lo, hi = np.searchsorted(room, [k, k + 1])
            np.add.at(out, owner[lo:hi], self.word_scores(flat[lo:hi]))
        return out

    def table(self) -> WordTable:
        return WordTable(len(self.languages) + 1, self._word_rows)

    def score_texts(self, texts: list[str | None], table: WordTable | None = None) -> np.ndarray:
        """For each whole text, its cross-entropy by language and, last, the characters behind it: none where no language is known."""
        if not self.languages:
            return np.zeros((len(texts), 1))
        out = (table or self.table()).sums([(t or "").lower().split() for t in texts])
        with np.errstate(invalid="ignore", divide="ignore"):
            out[:, :-1] = -out[:, :-1] / out[:, -1:]
        return out

    def calibrate(self, texts: list[str], truth: list[str]) -> None:
        """Fit the posterior's temperature and each language's usual cross-entropy on labelled texts."""
        if not self.languages:
            return
        scored = self.score_texts(texts)
        keep = scored[:, -1] > 0
        entropy, size = scored[keep, :-1], scored[keep, -1]
        gold = np.array([self.languages.index(x) for x in truth])[keep]
        self.usual, self.spread = np.full(len(self.languages), 3.0), np.full(len(self.languages), 3.0)
        if not len(gold):
            return
        best, least = 1.0, np.inf
        for temperature in np.geomspace(0.02, 50, 60):
            z = -entropy * np.sqrt(size)[:, None] * temperature
            z = z - z.max(axis=1, keepdims=True)
            loss = (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(gold)), gold]).mean()
            if loss < least - 1e-9:
                best, least = temperature, loss
        self.temperature = float(best)
        for k in range(len(self.languages)):
            if (own := gold == k).any():
                e, n = entropy[own, k], size[own]
                self.usual[k] = np.median(e)
                self.spread[k] = max(0.3, 1.4826 * np.median(np.abs(e - self.usual[k]) * np.sqrt(n)))

    def decide(self, scored: np.ndarray, z_reject: float) -> list[tuple]:
        """(language, score, cross-entropy, rejected, characters) of each row of ``score_texts``."""
        out = []
        for row in scored:
            size, entropy = row[-1], row[:-1]
            if size == 0:
                out.append((UNDETERMINED, 0.0, None, True, 0))
                continue
            z = -entropy * np.sqrt(size) * self.temperature
            p = np.exp(z - z.max())
            k = int(entropy.argmin())
            limit = self.usual[k] + max(1.5, z_reject * self.spread[k] / np.sqrt(size))
            out.append((self.languages[k], float(p[k] / p.sum()), float(entropy[k]), bool(entropy[k] > limit), int(size)))
        return out


def fit(docs: DataFrame, learn: Column, per_language: int = 600, order: int = 5) -> KneserNey:
    """Fit and calibrate on about ``per_language`` labelled texts of each language among the rows of ``learn``.

    The sample is drawn by a hash of text, so it does not depend on partitioning; its bound is
    the parameter, and copies of a text count once, so that a large group of them can't exceed it.
    A fourth of it calibrates, the rest is counted. Languages' numbers of texts stay in a table that is
    joined to the texts; what comes to the driver is the sample. Without any labelled text the model
    knows no language and rejects every text.
    """
    usable = docs.where(learn & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    shares = durable(usable.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("share")), "language-shares")
    shares_here = F.broadcast(shares) if shares.count() <= BROADCAST_LANGUAGES else shares
    likely = usable.withColumn("u", hash_unit("text", seed=11)).join(shares_here, "lang").where("u < share").select("text", "lang")
    rows = likely.dropDuplicates(["text", "lang"]).withColumn("part", hash_unit("text", seed=12)).collect()
    rows.sort(key=lambda r: (r["part"], r["lang"], r["text"]))
    drop_durable(shares)
    languages = sorted({r["lang"] for r in rows})
    count = {k: [r["text"] for r in rows if r["lang"] == k and r["part"] >= 0.25] for k in languages}
    short = [k for k, v in count.items() if not v]
    for k in short:
        count[k] = [r["text"] for r in rows if r["lang"] == k]
    model = KneserNey.fit(count, order)
    held = [r for r in rows if r["part"] < 0.25] or rows
    model.calibrate([r["text"] for r in held], [r["lang"] for r in held])
    return model


def identify(docs: DataFrame, model: KneserNey, z_reject: float = 8.0) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``cross_entropy``, ``rejected`` and ``letters``.

    Whole texts of any length are scored, in one pass without a shuffle. Null, empty and letterless texts
    get ``und``, score 0 and are rejected, and so is every text where the model knows no language. Of
    languages with equal cross-entropy the first by name wins. Repeated rows get equal results, an
    empty table none. Columns of ``docs`` by those names are replaced; all others pass through as they are.
    """
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts):
        model, out = handle.value, []
        for k in range(0, len(texts), 200):
            out += model.decide(model.score_texts(texts[k : k + 200], held(model.token, model.table)), z_reject)
        return list(zip(*out, strict=True)) or [()] * 5

    return map_rows(docs, ["text"], SCHEMA, make)


def learnable(docs: DataFrame, modulus: int, remainder: int) -> Column:
    """Rows whose id's CRC-32 leaves another remainder; rows with a null id are never learnt from."""
    return F.coalesce(id_crc("doc_id") % modulus != remainder, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs, learnable(docs, 4, 2))
    held = F.coalesce(id_crc("doc_id") % 4 == 2, F.lit(False)).alias("held_out")
    return identify(docs.select("doc_id", held, "text"), model).drop("text")

"""Registered queries and stages on empty tables, odd columns and small instances by brute force."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feedlake.llm import ann, common, langid, mixing, packing, pii, quality, simhash
from feedlake.llm.queries import QUERIES

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", [q for q in QUERIES if q != "pipeline"])
def test_empty_tables_give_no_row(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, keep_rank string, shard string, copies string, `a.b` int, m map<string,int>, row string, fp int"


def test_stages_keep_odd_columns(spark):
    rows = [(n, f"the house number {n} and the garden with {n} trees" * 3, "en", f"s{n % 2}", 0, 0.5, "k", "sh", "c", n, {"x": n}, "r", 7) for n in range(12)]
    docs = spark.createDataFrame([*rows, (None, None, None, None, None, None, None, None, None, None, None, None, None)], ODD)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.dtypes == docs.dtypes, name
        for r in out.where("doc_id is not null").collect():
            assert (r["score"], r["keep_rank"], r["shard"], r["copies"], r["a.b"], r["m"], r["row"], r["fp"]) == (0.5, "k", "sh", "c", r["doc_id"], {"x": r["doc_id"]}, "r", 7), name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0, name


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fit(docs, F.lit(True))).collect()} == {"und"}
    labels = spark.createDataFrame([], TABLES["labels"])
    assert {(r["score"], r["predicted"]) for r in quality.score(docs, quality.fit(docs, labels, 3, 1)).collect()} == {(0.5, 1)}


def test_very_long_texts(spark):
    docs = spark.createDataFrame([(1, "ab" * 400_000, "en"), (2, "word " * 100_000, "en")], "doc_id long, text string, lang string")
    assert langid.identify(docs, langid.fit(docs, F.lit(True))).where("score >= 0").count() == 2
    model = quality.QualityModel().fit(["good words here"] * 8 + ["bad"] * 8, np.array([1] * 8 + [0] * 8))
    assert quality.score(docs, model).count() == 2
    assert simhash.near_duplicates(docs.select("doc_id", "text")).count() == 2
    assert pii.find(docs).where("n_email = 0").count() == 2


@pytest.mark.parametrize(
    ("text", "span"),
    [
        ("to user at mail dot example dot com.", "user at mail dot example dot com"),
        ("to john [аt] example.com", "john [аt] example.com"),
        ("pay four one one one - one one one one - one one one one - one one one one ok", "four one one one - one one one one - one one one one - one one one one"),
        ("we met at noon dot com is", None),
    ],
)
def test_composed_transducers(text, span):
    base, spans = pii.all_spans(text)
    assert not base and [text[a:b] for _, a, b in spans] == ([span] if span else [])


# -- mixing ---------------------------------------------------------------------------------------


def test_mix_of_single_documents(spark):
    docs = spark.createDataFrame([(n, " ".join(["w"] * 1000), s) for n, s in enumerate("abc")], "doc_id long, text string, source string")
    got = {r["source"]: r for r in mixing.mix_sizes(docs).collect()}
    assert {s: r["taken"] for s, r in got.items()} == {"a": 2000, "b": 2000, "c": 1000}  # targets 2000, 1667 and 833
    assert all(len(r["shards"]) == r["copies"] == len(r["positions"]) for r in got.values())


def test_op10_on_a_small_instance(spark, tmp_path):
    rng = np.random.default_rng(3)
    sources = ["b", "a", None, "ä", "Z"]
    rows = [(n, " ".join(["w"] * int(rng.integers(0, 60))), sources[int(rng.integers(5))]) for n in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in mixing.op10_mixing(spark, str(tmp_path)).collect()}
    size = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in sources}
    order, limit = ["Z", "a", "b", "ä", None], {s: 2.0 * size[s] for s in sources}
    weight = dict(zip(order, [5.0, 2, 1, 5, 2], strict=True))
    target, capped = {}, set()
    while True:
        free = 1.5 * sum(size.values()) - sum(limit[s] for s in capped)
        target = {s: limit[s] if s in capped else free * weight[s] / sum(w for x, w in weight.items() if x not in capped) for s in sources}
        if not (over := {s for s in sources if target[s] > limit[s] and s not in capped}):
            break
        capped |= over
    for s in sources:
        own = [got[n] for n, _, x in rows if x == s]
        assert own[0]["source_size"] == size[s] and own[0]["target"] == pytest.approx(target[s])
        assert abs(sum(r["taken"] for r in own) - target[s]) <= 30
    assert all(r["size"] == len(t.split()) and r["taken"] <= 2 * r["size"] for n, t, _ in rows for r in [got[n]])
    per = np.bincount([s for r in got.values() for s in r["shards"]], minlength=16)
    assert per.min() > 0.5 * per.mean()


def test_large_populations_are_drawn_like_small_ones(monkeypatch):
    exact = [mixing._hypergeometric(np.random.default_rng(k), 40, 60, 30) for k in range(3000)]
    monkeypatch.setattr(mixing, "_EXACT", 10)
    drawn = [mixing._hypergeometric(np.random.default_rng(k), 40, 60, 30) for k in range(3000)]
    assert np.mean(drawn) == pytest.approx(np.mean(exact), abs=0.15) and np.std(drawn) == pytest.approx(np.std(exact), rel=0.08)


def test_blocks_come_as_near_as_a_document_allows():
    rng = np.random.default_rng(1)
    for _ in range(200):
        sizes, quota = rng.integers(0, 30, rng.integers(0, 8)), int(rng.integers(-10, 90))
        off = abs(int(sizes[mixing.take_block(sizes, quota)].sum()) - quota)
        assert off <= abs(quota) and (quota < 0 or off <= max(0, quota - sizes.sum()) + max(30, 0))


# -- neighbours and fingerprints ------------------------------------------------------------------


def test_recall_over_several_shards(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16))
    table = spark.createDataFrame([(n, [float(c) for c in v]) for n, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(table, table.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), k=20, shard=1100).collect()
    score = x[::100] @ x.T
    score[np.arange(30), np.arange(0, 3000, 100)] = -np.inf
    want = {(100 * q, int(n)) for q, row in enumerate(score) for n in np.argsort(-row)[:20]}
    assert len(got) == 600 and len({(r["query_id"], r["vec_id"]) for r in got} & want) >= 0.95 * 600


def test_shards_hold_every_pair_across_ring_boundaries(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ np.array([sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for _ in base], np.uint64)]))
    sent = simhash.shards(spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")).collect()
    assert sum(r["guest"] for r in sent) > 9 * len(fps) and sum(not r["guest"] for r in sent) == 10 * len(fps)
    by = {}
    for r in sent:
        by.setdefault(r["shard"], []).append((r["fp"] % (1 << 64), r["guest"]))
    met = {tuple(sorted((a, b))) for rows in by.values() for (a, g), (b, h) in itertools.combinations(rows, 2) if not (g and h)}
    near = {(int(a), int(b)) for a, b in itertools.combinations(fps.tolist(), 2) if (a ^ b).bit_count() <= 4}
    assert len(near) >= 290 and near <= met and len(met) < 0.2 * len(fps) ** 2


def test_trees_find_all_pairs(monkeypatch):
    monkeypatch.setattr(simhash, "SCANNED", 64)
    rng = np.random.default_rng(7)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(0, 12, 150)], np.uint64) for c in centre]))
    found = {(int(a), int(b)) for x, y in simhash.tree_pairs(fps, fps, 4) for a, b in zip(x, y, strict=True)}
    assert found == set(zip(*map(np.ndarray.tolist, np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)), strict=True))


def test_packing_against_every_packing():
    def least(sizes, bins=()):
        if not sizes:
            return len(bins)
        here = [least(sizes[1:], (*bins[:k], bins[k] - sizes[0], *bins[k + 1 :])) for k in range(len(bins)) if bins[k] >= sizes[0]]
        return min([*here, least(sizes[1:], (*bins, 10 - sizes[0]))])

    rng = np.random.default_rng(8)
    for _ in range(60):
        sizes = sorted(rng.integers(1, 11, rng.integers(1, 8)).tolist(), reverse=True)
        made = packing.Plan({s: sizes.count(s) for s in sizes}, 10)
        assert least(sizes) <= made.sequences <= least(sizes) + 1


def test_held_out_folds(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"))
    for modulus in (3, 4):
        got = {r["doc_id"]: r["n"] for r in docs.select("doc_id", (common.id_crc("doc_id") % modulus).alias("n")).collect()}
        assert got == {n: zlib.crc32(str(n).encode()) % modulus for n in range(200)}

"""Operators on tables, and the pipeline, against brute force."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from feedlake.llm import ann, common, mixing, packing, simhash, similar


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8)) * rng.uniform(0.5, 2, (400, 1))
    x[100:120] = x[100]
    rows = [(n, [float(c) for c in v]) for n, v in enumerate(x)] + [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [None] + [1.0] * 7)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = table.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    got = ann.nearest(table, queries, k=5).collect()
    score = x[::20] @ x.T
    score[np.arange(20), np.arange(0, 400, 20)] = -np.inf
    want = {(20 * q, int(n)) for q, row in enumerate(score) for n in np.lexsort((np.arange(400), -row.round(9)))[:5]}
    assert len(got) == 100 and len({(r["query_id"], r["vec_id"]) for r in got} & want) >= 95
    assert all(abs(r["score"] - x[r["query_id"]] @ x[r["vec_id"]]) < 1e-9 for r in got)
    assert ann.nearest(table.limit(0), queries).count() == 0
    assert ann.nearest(table.where("vec_id = 0"), queries.where("query_id = 0")).count() == 0


def test_water_fill_and_trees():
    target = mixing.water_fill(np.array([10.0, 100, 100, 0]), np.array([5.0, 2, 1, 5]), 315)
    assert target[0] == 20 and target[3] == 0 and abs(target.sum() - 315) < 1e-9 and (target <= [20, 200, 200, 0]).all()
    amounts = [5, 0, 17, 3, 1000, 1]
    split = mixing.split_quota(amounts, 300, "k")
    assert sum(split) == 300 and all(0 <= q <= a for q, a in zip(split, amounts, strict=True)) and split == mixing.split_quota(amounts, 300, "k")
    shards = mixing.split_sources([50, 7, 0, 30], 8, "k")
    assert np.array(shards).sum(axis=0).tolist() == [50, 7, 0, 30] and {sum(s) for s in shards} <= {10, 11}


def test_mix(spark):
    rng = np.random.default_rng(6)
    rows = [(n, " ".join(["w"] * int(rng.integers(0, 40))), ["a", "b", None][n % 3], 1) for n in range(900)] + [(900, None, "b", 1), (5, "dup dup", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard long")
    got = mixing.mix_sizes(docs).collect()
    assert len(got) == len(rows)
    for source in ("a", "b", None):
        own = [r for r in got if r["source"] == source]
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 50 and all(r["taken"] <= 2 * r["size"] for r in own)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_sizes(docs).collect()), key=repr)
    mixed = mixing.mix(docs, shards=4).collect()
    assert len(mixed) == sum(r["copies"] for r in got) and {r["shard"] for r in mixed} == {0, 1, 2, 3}
    assert mixing.mix_sizes(docs.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(7)
    en, de = "the house and garden with that tree over there".split(), "das haus und der garten mit diesem baum dort".split()
    rows = []
    for n in range(80):
        words = en if n % 2 else de
        rows.append((n, " ".join(words[k] + "aeiou"[rng.integers(5)] for k in rng.integers(0, len(words), 80)), "en" if n % 2 else "de", f"s{n % 3}", 0))
    rows += [(80, rows[0][1], "de", "s0", 0), (81, None, None, None, 0), (82, "12 34", "en", "s1", 0), (83, rows[1][1] + " mail a@b.co", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "pack_sequences" or out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
    first = {r["doc_id"] for r in seen["language_id"].collect()}
    assert first >= set(range(81)) and not first & {81, 82}
    kept = {r["doc_id"] for r in seen["near_dedup"].collect()}
    assert 80 not in kept and kept >= set(range(80))
    assert all("a@b.co" not in r["text"] for r in seen["personal_data"].collect())
    assert seen["pack_sequences"].select("doc_id").distinct().count() == seen["mix_sources"].select("doc_id").distinct().count()


def test_pipeline_drops_near_copies(spark):
    rng = np.random.default_rng(8)
    rows, kept = [], set()
    for n, edits in enumerate([1, 2, 3, 4, 1, 2, 3, 4, 9, 9]):  # each edit in mid-text changes 5 of 196 shingles
        words = [f"w{k}" for k in rng.integers(0, 5000, 200)]
        copy = list(words)
        for k in range(edits):
            copy[10 + 18 * k] = f"edit{n}x{k}"
        alike = (196 - 5 * edits) / (196 + 5 * edits)
        assert edits == 9 and alike < 0.8 or 0.8 <= alike < 0.96
        rows += [(2 * n, " ".join(words), "en", "s", 0), (2 * n + 1, " ".join(copy), "en", "s", 0)]
        kept |= {2 * n} | ({2 * n + 1} if edits == 9 else set())
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == kept


def test_similar_texts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similar, "MOST_IN_UNIT", 8)  # so that groups are dealt in chunks
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in range(120)]
    texts = [None, "", "one", "One", base]
    for _ in range(60):
        texts.append([f"x{rng.integers(999)}" if rng.random() < 0.02 else w for w in base])
    texts = [" ".join(t) if isinstance(t, list) else t for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [similar.shingle_set(t) for t in texts]
    label = simhash._forest(len(texts), *np.nonzero([[similar.jaccard(a, b) >= 0.8 for b in sets] for a in sets]))
    assert {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(docs).collect()} == dict(enumerate(label.tolist()))


def test_forest_holds_every_pair_within_one_bit_of_a_tree(spark, monkeypatch):
    rng, sigs, words = np.random.default_rng(3), [], similar.TREES * similar.BITS // 64
    for n in range(120):  # groups of ten around a centre; some bits of each turned
        if n % 10 == 0:
            centre = rng.integers(0, 2, 64 * (words + 1))
        turned = centre ^ (rng.random(len(centre)) < 0.14)
        sigs.append(np.packbits(turned.astype(bool), bitorder="little").view(np.int64))
    rows = [(n, int(s[0]), s[1:].tolist(), n // 2) for n, s in enumerate(sigs)]
    nodes = spark.createDataFrame(rows, "key long, fp long, sig array<long>, component long")
    fp, trees = np.array([s[0] for s in sigs]).view(np.uint64), np.array([s[1:] for s in sigs]).view(np.uint16)
    near = (np.bitwise_count(trees[:, None] ^ trees[None]) <= 1).any(axis=2) & (np.bitwise_count(fp[:, None] ^ fp[None]) <= similar.RADIUS)
    want = {(a, b) for a, b in zip(*np.nonzero(near), strict=True) if a > b and a // 2 != b // 2}
    assert len(want) > 100
    for most in (1024, 2):  # heavy shards are dealt in chunks
        monkeypatch.setattr(similar, "MOST_IN_UNIT", most)
        got = {(r["a"], r["b"]) for r in similar.crossing(nodes, similar.heavy_shards(nodes)).collect()}
        assert got == want


def test_small_sets_are_compared_exactly(spark):
    rng, texts = np.random.default_rng(4), []
    for _ in range(1000):  # eight words have four shingles, nine have five
        words = [f"w{k}" for k in rng.integers(0, 10**6, 9)]
        texts += [" ".join(words[:8]), " ".join(words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(docs).collect()} == {n: n - n % 2 for n in range(2000)}


def test_stages_bound_arrow_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(60).selectExpr("id AS doc_id", "repeat('word ', 100000) AS text", "'en' AS lang", "'s' AS source", "0 AS n_chars").coalesce(1)
    corpus_pipeline.mix_sources(spark, docs, "")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    assert max(r["n"] for r in docs.select("text").mapInArrow(sizes, "n long").collect()) <= common.BATCH_BYTES + 10**6


def test_workers_drop_what_they_held():
    assert common.held("one", lambda: 1) == common.held("one", lambda: 2) == 1
    common.forget()
    assert common.held("one", lambda: 2) == 2 and list(common.released(iter([1, 2]))) == [1, 2]
    common.forget()


def test_packing_reads_the_large_tokeniser_only_for_texts_that_need_it():
    tokens = packing.Tokens(packing.default_tokenizer())
    if not tokens.fast:
        pytest.skip("no rank file beside the vocabulary")
    assert len(tokens.of(["plain words only", None])[0]) == 12 and "encode" not in vars(tokens)
    assert tokens.of(["<|endoftext|>"])[0] == np.array(tokens.encode("<|endoftext|>", add_special_tokens=False).ids, "<u4").tobytes()


def test_mixing_keeps_its_plan_out_of_python_workers(spark):
    docs = spark.createDataFrame([(k, "some words", s) for k, s in enumerate(["a", "b", None])], "doc_id long, text string, source string")
    docs = common.durable(docs, "docs")  # a list is read in Python itself
    for found in (mixing.mix_sizes(docs), mixing.mix(docs)):
        assert "ExistingRDD" not in found._jdf.queryExecution().toString()
    assert {r["doc_id"] for r in mixing.mix_sizes(docs).collect()} == {0, 1, 2}
    assert mixing.mix_sizes(docs.limit(0)).count() == 0

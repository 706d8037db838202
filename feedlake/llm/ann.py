"""Nearest neighbours by inner product: NN-descent graphs, built by Spark joins, and greedy graph search.

Equal vectors are one node; a node knows the least ids of its rows, as many as an answer can need.
A graph spans a shard of up to ``SHARD`` nodes (fewer where vectors are so long that their numbers exceed
``MOST_NUMBERS``), so a graph, its vectors and a search fit in a task. Only tables above that have several
shards, dealt by hash; then a query's answer is the best of all shards'. A search looks at a small part of a
shard, one that grows far slower than the shard, so shards are as large as a task's memory allows.

NN-descent starts from the neighbours that nodes have in small leaves of random trees of hyperplanes. Each
round joins the symmetric graph with itself, on the shard and the middle node, into neighbours of
neighbours, scores them, and keeps each node's best, until few edges change. Scores are computed where a
block of a shard's nodes meets all its vectors. For the graph, vectors get one more component that makes
all norms equal, so that the nearest by inner product are near in the graph too; searches use the
vectors themselves.

Greedy search expands, for each query, the best nodes not yet expanded among the best ``beam`` seen,
until none is left.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cleared, drop_durable, durable

SHARD = 65_536
MOST_NUMBERS = 1 << 22
BLOCK = 8_192
NEIGHBOURS = 20
DEGREE = 64
SAMPLE = 10
ROUNDS = 3
SETTLED = 0.02
TREES, LEAF, TREES_A_TASK = 32, 1024, 8
BEAM = 96
ENTRIES = 32
QUERY_BLOCK = 1024
MERGE = 64


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v`` (doubles) of the vectors that take part: not null, not zero, all components finite."""
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    chosen = vectors.select(F.col(key).alias("vec_id"), v.alias("v")).where("v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return chosen.where(finite & F.exists("v", lambda x: x != 0))


def nodes(rows: DataFrame, members: int, shard: int = SHARD) -> DataFrame:
    """Distinct vectors with ``shard``, ``rank`` and ``size`` within it, their ``members`` least ids, and ``extra``, which evens norms."""
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= members)
    distinct = durable(ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("members")), "nodes")
    squared = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    n, top, longest = distinct.agg(F.count("*"), F.max(squared), F.max(F.size("v"))).first()
    shards = max(1, -(-n // max(1, min(shard, MOST_NUMBERS // (longest or 1)))))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    by = Window.partitionBy("shard")
    dealt = dealt.withColumns({"rank": (F.row_number().over(by.orderBy(F.col("members")[0], "v")) - 1).cast("int"), "size": F.count("*").over(by).cast("int")})
    return durable(dealt.select("shard", "rank", "size", "v", "members", F.sqrt(F.greatest(F.lit(0.0), F.lit(top or 0.0) - squared)).alias("extra")), "shards")


_EDGE = "shard int, a int, b int, score double"


def _vectors(column) -> np.ndarray:
    """Rows of an Arrow column of equally long lists of numbers."""
    import pyarrow as pa

    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(lists):
        return np.zeros((0, 1))
    return np.asarray(lists.flatten(), dtype=float).reshape(len(lists), -1)


def _matrix(table, extra: bool = False) -> np.ndarray:
    """Vectors by rank."""
    rows = _vectors(table.column("v"))
    if extra:
        rows = np.column_stack([rows, np.asarray(table.column("extra"))])
    out = np.zeros_like(rows)
    out[np.asarray(table.column("rank"))] = rows
    return out


def _edges(shard, a: np.ndarray, b: np.ndarray, value: np.ndarray, k: int):
    """The ``k`` best partners of each node among pairs, as a table of edges."""
    import pyarrow as pa

    order = np.lexsort((b, -value, a))
    a, b, value = a[order], b[order], value[order]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
    columns = [np.full(keep.sum(), shard), a[keep], b[keep], value[keep]]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["shard", "a", "b", "score"])


def leaves(x: np.ndarray, rng: np.random.Generator, most: int = LEAF) -> list[np.ndarray]:
    """Rows of ``x`` in leaves of a tree that halves them by random hyperplanes."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        own = todo.pop()
        if len(own) <= most:
            out.append(own)
            continue
        side = x[own] @ rng.normal(size=x.shape[1]).astype(x.dtype)
        order = np.argsort(side, kind="stable")
        todo += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return out


def _start(points: DataFrame, k: int) -> DataFrame:
    """Each node's best partners within its leaves, a few trees a task."""
    wide = points.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(TREES // TREES_A_TASK - 1))))

    def run(key, table):
        x, shard = _matrix(table, extra=True).astype(np.float32), key[0].as_py()
        rng = np.random.default_rng([shard, key[1].as_py()])
        codes, values = [np.zeros(0, np.int64)], [np.zeros(0)]
        for own in (o for _ in range(TREES_A_TASK) for o in leaves(x, rng)):
            score = x[own] @ x[own].T
            np.fill_diagonal(score, -np.inf)
            near = np.argpartition(-score, min(k, len(own) - 1) - 1, axis=1)[:, : min(k, len(own) - 1)] if len(own) > 1 else np.zeros((1, 0), int)
            codes.append((own[:, None] * len(x) + own[near]).ravel())
            values.append(np.take_along_axis(score, near, axis=1).ravel())
        code, first = np.unique(np.concatenate(codes), return_index=True)
        return _edges(shard, code // len(x), code % len(x), np.concatenate(values)[first], k)

    return wide.groupBy("shard", "part").applyInArrow(run, _EDGE)


def _best(points: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` best-scored partners of each node among the pairs; a block of a shard's nodes is a task's."""
    blocks = F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / BLOCK).cast("int"))).alias("block")

    def score(key, left, right):
        x = _matrix(left, extra=True)
        a, b = (np.asarray(right.column(c)).astype(np.int64) for c in "ab")
        code = np.unique(a * len(x) + b)
        a, b = code // len(x), code % len(x)
        value = np.concatenate([np.einsum("ij,ij->i", x[a[s : s + 65536]], x[b[s : s + 65536]]) for s in range(0, len(a), 65536)] or [np.zeros(0)])
        return _edges(key[0].as_py(), a, b, value, k)

    right = pairs.select("shard", F.floor(F.col("a") / BLOCK).cast("int").alias("block"), "a", "b")
    return points.select("shard", blocks, "rank", "v", "extra").groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(score, _EDGE)


def neighbour_graph(points: DataFrame, k: int = NEIGHBOURS, sample: int = SAMPLE, rounds: int = ROUNDS) -> DataFrame:
    """Edges ``a`` to ``b`` within each shard by NN-descent. Rounds are written out, so a lost executor costs one."""
    points = points.select("shard", "rank", "size", "v", "extra")
    graph = durable(_best(points, _start(points, k).select("shard", "a", "b"), k), "graph")
    for r in range(rounds):
        both = graph.select("shard", "a", "b").union(graph.select("shard", "b", "a")).distinct()
        pick = F.row_number().over(Window.partitionBy("shard", "a").orderBy(F.xxhash64(F.lit(r), "a", "b")))
        some = both.withColumn("n", pick).where(F.col("n") <= sample).drop("n")
        near, far = some.select("shard", F.col("a").alias("mid"), F.col("b").alias("x")), some.select("shard", F.col("a").alias("mid"), F.col("b").alias("y"))
        met = near.join(far, ["shard", "mid"]).where("x <> y").select("shard", F.col("x").alias("a"), F.col("y").alias("b"))
        after = durable(_best(points, met.union(graph.select("shard", "a", "b")), k), "graph")
        edges, fresh = after.count(), after.join(graph, ["shard", "a", "b"], "left_anti").count()
        drop_durable(graph)
        graph = after
        if fresh <= SETTLED * edges:
            break
    return graph


def greedy(x: np.ndarray, links: np.ndarray, query: np.ndarray, k: int, beam: int = BEAM, at_once: int = 4) -> tuple[np.ndarray, np.ndarray, int]:
    """Ranks and scores of the ``k`` best nodes that greedy search meets, best first, and how many nodes it scored.

    ``links`` has a row of neighbours for each node, filled up with -1.
    """
    n, beam = len(x), max(beam, k)
    seen = np.zeros(n + 1, bool)
    seen[-1] = True  # where links of -1 point
    ids = np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(int))
    seen[ids] = True
    score, spent, scored = x[ids] @ query, np.zeros(len(ids), bool), len(ids)
    while True:
        if len(ids) > beam:
            top = np.argpartition(-score, beam - 1)[:beam]
            ids, score, spent = ids[top], score[top], spent[top]
        waiting = np.flatnonzero(~spent)
        if not len(waiting):
            break
        if len(waiting) > at_once:
            waiting = waiting[np.argpartition(-score[waiting], at_once - 1)[:at_once]]
        spent[waiting] = True
        reached = np.unique(links[ids[waiting]])
        reached = reached[~seen[reached]]
        seen[reached] = True
        scored += len(reached)
        ids, score, spent = np.concatenate([ids, reached]), np.concatenate([score, x[reached] @ query]), np.concatenate([spent, np.zeros(len(reached), bool)])
    order = np.lexsort((ids, -score))[:k]
    return ids[order], score[order], scored


def _links(table, n: int) -> np.ndarray:
    """Rows of neighbours by rank, filled up with -1."""
    lists = table.column("links").to_pylist()
    out = np.full((n, max([1, *(len(found) for found in lists if found)])), -1, np.int32)
    for r, found in zip(np.asarray(table.column("rank")).tolist(), lists, strict=True):
        if found:
            out[r, : len(found)] = found
    return out


def _search(points: DataFrame, graph: DataFrame, queries: DataFrame, k: int, beam: int) -> DataFrame:
    """query_id and ``hits``, its ``k`` best nodes over all shards; work is dealt by shard and block of queries."""
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    shards = points.agg(F.max("shard")).first()[0]
    # a node keeps its own neighbours and, of those it is a neighbour to, the nearest up to DEGREE
    back = graph.select("shard", F.col("b").alias("a"), F.col("a").alias("b"), "score")
    back = back.withColumn("n", F.row_number().over(Window.partitionBy("shard", "a").orderBy(F.col("score").desc(), "b"))).where(F.col("n") <= DEGREE - NEIGHBOURS)
    both = graph.select("shard", "a", "b").union(back.select("shard", "a", "b"))
    links = both.groupBy("shard", "a").agg(F.sort_array(F.collect_set("b")).alias("links")).withColumnRenamed("a", "rank")
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    base = points.join(links, ["shard", "rank"], "left").select("shard", block, "rank", "v", "members", "links")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards or 0))).alias("shard"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), "query_id", "q")

    def run(key, left, right):
        import pyarrow as pa

        hit = pa.struct([("far", pa.float64()), ("members", pa.list_(pa.int64()))])
        kinds = {"query_id": pa.int64(), "shard": pa.int32(), "hits": pa.list_(hit), "scored": pa.int64()}
        rows = []
        if left.num_rows and right.num_rows:
            x = _matrix(left)
            links, members = _links(left, len(x)), [None] * len(x)
            for r, own in zip(np.asarray(left.column("rank")).tolist(), left.column("members").to_pylist(), strict=True):
                members[r] = own
            for number, query in zip(right.column("query_id").to_pylist(), _vectors(right.column("q")), strict=True):
                ids, _, scored = greedy(x, links, query, k, beam)
                exact = (x[ids] * query).sum(axis=1)
                rows.append((number, key[0].as_py(), [{"far": -v, "members": members[t]} for t, v in zip(ids.tolist(), exact.tolist(), strict=True)], scored))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    found = base.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(run, "query_id long, shard int, hits array<struct<far:double,members:array<long>>>, scored long")
    best = F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k).alias("hits")
    while (shards or 0) > 0:  # a bounded number of shards' answers meet at a time
        shards //= MERGE
        found = found.groupBy("query_id", F.floor(F.col("shard") / MERGE).cast("int").alias("shard")).agg(best, F.sum("scored").alias("scored"))
    return found.select("query_id", "hits", "scored")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, beam: int = BEAM, shard: int = SHARD) -> DataFrame:
    """query_id, ``rank`` from 1, vec_id and ``score`` of each query's ``k`` nearest found by inner product, ties to smaller ids; ``scored`` counts the nodes looked at.

    ``vectors`` has vec_id and embedding, ``queries`` query_id and embedding, of one dimension. A row whose id is the
    query's is no answer to it. Vectors that are null, zero or not finite take no part on either side; empty
    tables give no row. Repeated ids are answers once for each different vector. Other columns are left out.
    """
    with cleared() as keep:
        points = nodes(usable(vectors).where("vec_id is not null").distinct(), k + 1, shard)
        asked = durable(usable(queries, "query_id").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "queries")
        found = _search(points, neighbour_graph(points), asked, k + 1, beam)
        hits = found.select("query_id", "scored", F.explode("hits").alias("h")).select("query_id", "scored", F.explode("h.members").alias("vec_id"), (-F.col("h.far")).alias("score"))
        listed = hits.where("vec_id <> query_id")
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        out = durable(listed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "scored"), "nearest")
        keep(out)
    return out


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")).select("query_id", "rank", "vec_id", "score")

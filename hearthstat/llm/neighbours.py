"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Equal vectors are one node, so that a vector that a third of the rows share is neither a hub nor a swamp;
of its rows the smallest ids are kept, as many as an answer can hold. Nodes are dealt to shards of bounded size. A
shard's graph is built layer by layer from the top, each layer in batches that search what is already in it;
its layers are flat arrays of neighbours (rows x slots, -1 for none). All searches of a batch advance
together: a step expands every query's best open candidate. Query blocks meet every shard, each gives its
best rows in exact double precision, and the best of all shards are kept.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthstat.llm.common import map_arrow, ship, store, table

#: Neighbours per node (twice as many in the lowest layer), candidates while building and while searching.
LINKS, BUILD, SEARCH = 16, 96, 128
SHARD_ROWS, BLOCK_ROWS = 4096, 512
#: Queries whose state is held at once, and nodes inserted at once.
WIDTH, BATCH = 256, 256


def _beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best nodes found for each query from its entry nodes (queries x entries): ids (-1 for none) and products, best first."""
    n, slots = len(queries), links.shape[1]
    rows = np.arange(n)
    ids = np.full((n, width), -1, np.int64)
    score = np.full((n, width), -np.inf, np.float32)
    closed = np.ones((n, width), bool)
    seen = np.zeros((n, len(vectors)), bool)
    k = min(entry.shape[1], width)
    ids[:, :k] = entry[:, :k]
    seen[rows[:, None], entry] = True
    score[:, :k] = np.einsum("qd,qkd->qk", queries, vectors[entry[:, :k]])
    closed[:, :k] = False
    while len(active := np.flatnonzero(~closed.all(axis=1))):
        best = np.where(closed[active], -np.inf, score[active]).argmax(axis=1)
        closed[active, best] = True
        near = links[ids[active, best]]
        fresh = near >= 0
        at = np.where(fresh, near, 0)
        fresh &= ~seen[active[:, None], at]
        a, s = np.nonzero(fresh)
        seen[active[a], near[a, s]] = True
        product = np.full(near.shape, -np.inf, np.float32)
        product[a, s] = np.einsum("ad,ad->a", queries[active[a]], vectors[near[a, s]])
        all_score = np.concatenate([score[active], product], axis=1)
        top = np.argpartition(-all_score, width - 1, axis=1)[:, :width]
        ids[active] = np.take_along_axis(np.concatenate([ids[active], near], axis=1), top, axis=1)
        score[active] = np.take_along_axis(all_score, top, axis=1)
        closed[active] = np.take_along_axis(np.concatenate([closed[active], ~fresh], axis=1), top, axis=1)
    order = np.argsort(-score, axis=1, kind="stable")
    ids, score = np.take_along_axis(ids, order, axis=1), np.take_along_axis(score, order, axis=1)
    return np.where(score > -np.inf, ids, -1), score


def _chosen(vectors: np.ndarray, candidates: np.ndarray, score: np.ndarray, slots: int) -> np.ndarray:
    """Of each row's candidates (ids, -1 for none; best first) up to `slots` that point in different directions.

    A candidate that is nearer to one already chosen than to the row's own node comes after all others.
    """
    rows, k = candidates.shape
    out = np.full((rows, slots), -1, np.int64)
    valid = candidates >= 0
    spread = vectors[np.where(valid, candidates, 0)]
    between = np.einsum("rid,rjd->rij", spread, spread)
    taken = np.zeros((rows, k), bool)
    for i in range(k):
        hidden = (taken & (between[:, i, :] > score[:, i : i + 1])).any(axis=1)
        taken[:, i] = valid[:, i] & ~hidden & (taken.sum(axis=1) < slots)
    order = np.argsort(np.where(taken, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :slots]
    found = np.take_along_axis(candidates, order, axis=1)
    out[:, : found.shape[1]] = found
    return out


def _link(vectors: np.ndarray, links: np.ndarray, nodes: np.ndarray, near: np.ndarray) -> None:
    """Set the nodes' links and add the links back, choosing anew where a node has too many."""
    links[nodes] = near
    source, target = np.repeat(nodes, near.shape[1]), near.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    heads, first, count = np.unique(target, return_index=True, return_counts=True)
    wide = np.full((len(heads), links.shape[1] + count.max(initial=0)), -1, np.int64)
    wide[:, : links.shape[1]] = links[heads]
    wide[np.repeat(np.arange(len(heads)), count), links.shape[1] + np.arange(len(target)) - np.repeat(first, count)] = source
    # A pair that chose each other would be there twice.
    wide.sort(axis=1)
    wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
    score = np.einsum("hd,hkd->hk", vectors[heads], vectors[np.where(wide >= 0, wide, 0)])
    score = np.where(wide >= 0, score, -np.inf)
    best = np.argsort(-score, axis=1, kind="stable")[:, : 2 * links.shape[1]]
    for at in range(0, len(heads), WIDTH):
        some = slice(at, at + WIDTH)
        wider, scored = np.take_along_axis(wide[some], best[some], axis=1), np.take_along_axis(score[some], best[some], axis=1)
        links[heads[some]] = _chosen(vectors, wider, scored, links.shape[1])


def build_graph(vectors: np.ndarray, seed: int = 0) -> list[np.ndarray]:
    """Neighbour arrays per layer, lowest first. Nodes are taken as they come; layer l holds the first so many of them."""
    n = len(vectors)
    draws = np.sort(-np.log(np.random.default_rng(seed).random(n)) / np.log(LINKS))[::-1]
    heights = draws.astype(np.int64)
    layers: list[np.ndarray] = []
    entry = np.zeros((n, 1), np.int64)
    for level in range(int(heights[0]), -1, -1):
        size = int((heights >= level).sum())
        links = np.full((n, LINKS * (1 if level else 2)), -1, np.int64)
        done = 0
        while done < size:
            nodes = np.arange(done, min(size, max(done * 2, LINKS), done + BATCH))
            own = vectors[nodes] @ vectors[nodes].T
            np.fill_diagonal(own, -np.inf)
            ids, score = np.broadcast_to(nodes, own.shape), own
            if done:
                # Entries from the layer above; those not yet in this layer start at its first node.
                start = np.where(entry[nodes] < done, entry[nodes], 0)
                found, near = _beam(vectors, links, vectors[nodes], start, min(BUILD, done))
                ids, score = np.concatenate([found, ids], axis=1), np.concatenate([near, score], axis=1)
            best = np.argsort(-score, axis=1, kind="stable")[:, :BUILD]
            ids, score = np.take_along_axis(ids, best, axis=1), np.take_along_axis(score, best, axis=1)
            _link(vectors, links, nodes, _chosen(vectors, np.where(score > -np.inf, ids, -1), score, links.shape[1]))
            done = int(nodes[-1]) + 1
        layers.insert(0, links[:size])
        for at in range(0, n, WIDTH):
            some = slice(at, at + WIDTH)
            entry[some] = _beam(vectors, links, vectors[some], entry[some], 1)[0] if level else entry[some]
    return layers


def search_graph(vectors: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, width: int = SEARCH) -> np.ndarray:
    """Nodes near each query, best first, -1 for none."""
    out = []
    for at in range(0, len(queries), WIDTH):
        some = queries[at : at + WIDTH]
        entry = np.zeros((len(some), 1), np.int64)
        for links in layers[:0:-1]:
            entry = _beam(vectors, links, some, entry, 1)[0]
        out.append(_beam(vectors, layers[0], some, entry, max(width, 1))[0])
    return np.concatenate(out)


def _packed(**arrays: np.ndarray) -> bytes:
    buffer = io.BytesIO()
    np.savez(buffer, **arrays)
    return buffer.getvalue()


def index_shards(nodes: DataFrame) -> DataFrame:
    """A row (dim, shard, graph) per shard from rows (dim, shard, embedding, ids)."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        # A fixed order: a task that runs again builds the same graph.
        rows = rows.assign(first=[i[0] for i in rows["ids"]]).sort_values("first")
        vectors = np.array(rows["embedding"].tolist(), np.float64)
        mixed = np.random.default_rng(1).permutation(len(rows))
        vectors, ids = vectors[mixed], [np.asarray(rows["ids"].iloc[i], np.int64) for i in mixed]
        layers = build_graph(vectors.astype(np.float32))
        graph = _packed(
            vectors=vectors,
            ids=np.concatenate(ids),
            ends=np.cumsum([len(i) for i in ids]),
            **{f"links{level}": links.astype(np.int32) for level, links in enumerate(layers)},
        )
        return pd.DataFrame({"dim": rows["dim"].iloc[:1].to_numpy(), "shard": rows["shard"].iloc[:1].to_numpy(), "graph": [graph]})

    ship(nodes.sparkSession)
    return nodes.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, graph binary")


def _answers(graph: dict, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of a shard for each query: query ids, row ids, scores."""
    vectors, ids, ends = graph["vectors"], graph["ids"], graph["ends"]
    layers = [graph[f"links{level}"] for level in range(sum(name.startswith("links") for name in graph))]
    found = search_graph(vectors.astype(np.float32), layers, queries.astype(np.float32), max(SEARCH, 2 * k))
    out_q, out_v, out_s = [], [], []
    for query_id, q, nodes in zip(query_ids, queries, found, strict=True):
        nodes = nodes[nodes >= 0]
        score = (vectors[nodes] * q).sum(axis=1)
        sizes = ends[nodes] - np.where(nodes > 0, ends[nodes - 1], 0)
        rows = np.concatenate([ids[e - s : e] for e, s in zip(ends[nodes], sizes, strict=True)]) if len(nodes) else ids[:0]
        score = np.repeat(score, sizes)
        own = rows != query_id
        rows, score = rows[own], score[own]
        best = np.lexsort((rows, -score))[:k]
        out_q.append(np.full(len(best), query_id))
        out_v.append(rows[best])
        out_s.append(score[best])
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (key, embedding, dim) whose vector has only finite components and is not zero."""
    v = F.col("embedding")
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("embedding"))
    limits = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.exists(v, lambda x: x != 0)
    return rows.where(reduce(and_, [F.col("key").isNotNull(), v.isNotNull(), *limits])).withColumn("dim", F.size("embedding"))


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """Per query its k nearest rows found, by inner product: query_id, rank (from 1), vec_id, score.

    A query's own row is no answer; ties go to the smaller id. Vectors that are missing, zero, or hold missing
    or non-finite components take no part, nor do rows without an id; vectors of another length than the query's
    are no candidates. Repeated rows of an id with the same vector count once. Fewer candidates give fewer rows.
    """
    rows = usable(vectors, key, vector).distinct()
    # Of rows with the same vector only the k + 1 smallest ids can be in an answer.
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("key"))
    nodes = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    nodes = store(nodes.groupBy("dim", "embedding").agg(F.sort_array(F.collect_list("key")).alias("ids")))
    sizes = {r.dim: -(-r.n // shard_rows) for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    schema = "query_id long, vec_id long, score double"
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = reduce(lambda c, d: F.when(F.col("dim") == d, sizes[d]).otherwise(c), sizes, F.lit(1))
    shard = F.pmod(F.xxhash64(F.get("ids", F.lit(0))), shards).cast("int")
    graphs = store(index_shards(nodes.withColumn("shard", shard)))

    asked = usable(queries, key, vector).distinct()
    asked = asked.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(max(1, -(-asked.count() // BLOCK_ROWS)))))
    blocks = asked.groupBy("dim", "block").agg(F.collect_list(F.struct("key", "embedding")).alias("queries"))
    blocks = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), shards - 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, graph = None, {}
        for batch in batches:
            for i in range(len(batch)):
                name = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if name != held:
                    with np.load(io.BytesIO(batch.column(2)[i].as_py())) as loaded:
                        held, graph = name, dict(loaded)
                block = batch.column(3)[i].as_py()
                ids, asked = np.array([q["key"] for q in block]), np.array([q["embedding"] for q in block])
                found = _answers(graph, ids, asked, k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

    pairs = graphs.join(blocks, ["dim", "shard"]).select("dim", "shard", "graph", "queries")
    answers = map_arrow(pairs, run, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0))

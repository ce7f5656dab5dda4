"""Operator 8: nearest neighbours by hierarchical navigable small-world graphs, one per shard.

Equal vectors form one class: the index holds a representative and the ``k + 1`` smallest ids, which is all a result can need
of the class, so copies neither crowd the graph nor get lost. Classes are dealt to shards of about ``SHARD_ROWS`` by a hash;
each shard's graph is built by insertion and stored as flat arrays (vectors, levels, neighbours per level). Queries go in blocks
to every shard; each shard returns its nearest classes with exact double-precision distances, and the results are merged.

Vectors that are null, empty, zero or hold null or non-finite components take no part. Only vectors of one length are compared.
Ties go to the smaller id; a query never finds its own row; with fewer candidates than ``k`` all are returned.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from panelspark.llm.common import store

SHARD_ROWS = 16_384
QUERY_BLOCK = 4096
LINKS = 12
BREADTH_BUILD = 64
BREADTH_SEARCH = 96
SEED = 42


class Graph:
    """One shard's graph; ``neighbours[level]`` is a flat array of ``LINKS`` (2 * LINKS on level 0) places a node, -1 where free."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors.astype(np.float32)
        n = len(ids)
        draw = np.random.default_rng(SEED).random(n)
        self.level = np.floor(-np.log(np.maximum(draw, 1e-12)) / math.log(LINKS)).astype(int)
        self.neighbours = [np.full((n, 2 * LINKS if at == 0 else LINKS), -1, np.int32) for at in range(int(self.level.max(initial=0)) + 1)]
        self.gaps = [np.full(a.shape, np.inf, np.float32) for a in self.neighbours]
        self.used = [np.zeros(n, np.int32) for _ in self.neighbours]
        self.entry = 0
        for node in range(1, n):
            self._insert(node)
        del self.gaps

    def _distance(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        d = self.vectors[nodes] - q
        return np.einsum("ij,ij->i", d, d)

    def _walk(self, q: np.ndarray, starts: list[tuple[float, int]], breadth: int, level: int) -> list[tuple[float, int]]:
        """The ``breadth`` nearest nodes met by a best-first walk."""
        seen = {n for _, n in starts}
        todo = list(starts)
        heapq.heapify(todo)
        best = [(-d, n) for d, n in starts]
        heapq.heapify(best)
        neighbours, used = self.neighbours[level], self.used[level]
        while todo:
            d, node = heapq.heappop(todo)
            if d > -best[0][0] and len(best) >= breadth:
                break
            near = [x for x in neighbours[node, :used[node]].tolist() if x not in seen]
            if not near:
                continue
            seen.update(near)
            worst = -best[0][0]
            for g, x in zip(self._distance(q, np.array(near)).tolist(), near):
                if len(best) < breadth:
                    heapq.heappush(best, (-g, x))
                elif g < worst:
                    heapq.heapreplace(best, (-g, x))
                else:
                    continue
                heapq.heappush(todo, (g, x))
                worst = -best[0][0]
        return sorted((-d, n) for d, n in best)

    def _spread(self, nodes: np.ndarray, gaps: np.ndarray, most: int) -> np.ndarray:
        """Places of up to ``most`` nodes, nearest first, that are nearer to the centre than to one chosen before; then the nearest rest."""
        order = np.argsort(gaps, kind="stable")
        v = self.vectors[nodes[order]]
        square = np.einsum("ij,ij->i", v, v)
        between = square[:, None] + square[None] - 2 * (v @ v.T)
        chosen, nearest = [], np.full(len(order), np.inf)
        g = gaps[order]
        for k in range(len(order)):
            if g[k] < nearest[k]:
                chosen.append(k)
                if len(chosen) == most:
                    break
                nearest = np.minimum(nearest, between[k])
        if len(chosen) < most:
            rest = np.setdiff1d(np.arange(len(order)), chosen)
            chosen += rest[:most - len(chosen)].tolist()
        return order[chosen]

    def _insert(self, node: int) -> None:
        q, top = self.vectors[node], int(self.level[self.entry])
        near = [(float(self._distance(q, np.array([self.entry]))[0]), self.entry)]
        for level in range(top, int(self.level[node]), -1):
            near = self._walk(q, near[:1], 1, level)
        for level in range(min(top, int(self.level[node])), -1, -1):
            near = self._walk(q, near, BREADTH_BUILD, level)
            nodes, gaps = np.array([n for _, n in near], np.int32), np.array([d for d, _ in near], np.float32)
            chosen = self._spread(nodes, gaps, LINKS)
            neighbours, kept, used = self.neighbours[level], self.gaps[level], self.used[level]
            k = len(chosen)
            neighbours[node, :k], kept[node, :k], used[node] = nodes[chosen], gaps[chosen], k
            width = neighbours.shape[1]
            for other, gap in zip(nodes[chosen].tolist(), gaps[chosen].tolist()):
                u = used[other]
                if u < width:
                    neighbours[other, u], kept[other, u], used[other] = node, gap, u + 1
                    continue
                all_nodes, all_gaps = np.append(neighbours[other], node), np.append(kept[other], gap)
                stay = self._spread(all_nodes, all_gaps, width)
                neighbours[other], kept[other] = all_nodes[stay], all_gaps[stay]
        if self.level[node] > top:
            self.entry = node

    def search(self, q: np.ndarray, k: int, breadth: int = BREADTH_SEARCH) -> list[int]:
        """Places of the ``k`` nearest nodes found."""
        if not len(self.ids):
            return []
        q = q.astype(np.float32)
        near = [(float(self._distance(q, np.array([self.entry]))[0]), self.entry)]
        for level in range(int(self.level[self.entry]), 0, -1):
            near = self._walk(q, near[:1], 1, level)
        return [n for _, n in self._walk(q, near, max(breadth, k), 0)[:k]]


def usable(column: str = "embedding"):
    return F.expr(f"{column} IS NOT NULL AND size({column}) > 0 AND forall({column}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) "
                  f"AND exists({column}, x -> x <> 0)")


def classes(vectors: DataFrame, k: int) -> DataFrame:
    """Distinct vectors: embedding, class_id (least vec_id), ids (the ``k + 1`` smallest)."""
    order = W.partitionBy("embedding").orderBy("vec_id")
    few = vectors.select("vec_id", "embedding").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    return few.groupBy("embedding").agg(F.min("vec_id").alias("class_id"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def build_index(members: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard with its graph as flat arrays: dim, shard, graph."""
    shards = members.groupBy(F.size("embedding").alias("dim")).agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    dealt = members.select("class_id", "embedding", F.size("embedding").alias("dim")).join(shards, "dim")
    dealt = dealt.select("dim", F.expr("pmod(xxhash64(class_id), shards)").cast("int").alias("shard"), "class_id", "embedding")

    def build(held: pa.Table) -> pa.Table:
        held = held.sort_by("class_id")
        dim = held.column("dim")[0].as_py()
        vectors = held.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        graph = Graph(held.column("class_id").to_numpy(), vectors)
        state = {"ids": graph.ids, "vectors": vectors, "level": graph.level, "neighbours": graph.neighbours, "used": graph.used, "entry": graph.entry}
        return pa.table({"dim": [dim], "shard": [held.column("shard")[0].as_py()], "graph": [pickle.dumps(state)]},
                        schema=pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("graph", pa.binary())]))

    total = shards.agg(F.sum("shards")).first()[0] or 1  # a number: small shards are not put into one task
    return store(dealt.repartition(int(total), "dim", "shard").groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, graph binary"), "graphs")


def load_graph(state: bytes) -> tuple[Graph, np.ndarray]:
    held = pickle.loads(state)
    graph = Graph.__new__(Graph)
    exact = held.pop("vectors")
    graph.__dict__.update(held)
    graph.vectors = exact.astype(np.float32)
    return graph, exact.astype(np.float64)


def search(index: DataFrame, members: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest rows of each query (vec_id, embedding), by the graphs."""
    blocks = max(1, -(-queries.count() // block))
    shards = index.select(F.col("dim").alias("of"), F.col("shard").alias("shard"))
    asked = queries.select(F.col("vec_id").alias("query_id"), "embedding", F.size("embedding").alias("dim"), F.expr(f"pmod(xxhash64(vec_id), {blocks})").alias("block"))
    asked = asked.join(shards, asked.dim == shards.of).drop("of")
    spread = index.withColumn("block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))
    schema = pa.schema([("query_id", pa.int64()), ("class_id", pa.int64()), ("score", pa.float64())])

    def find(graphs: pa.Table, some: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if graphs.num_rows and some.num_rows:
            graph, exact = load_graph(graphs.column("graph")[0].as_py())
            asked_for = some.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1).astype(np.float64)
            for name, q in zip(some.column("query_id").to_pylist(), asked_for):
                found = graph.search(q, k + 1)
                gaps = np.sqrt(((exact[found] - q) ** 2).sum(axis=1))
                out[0].extend([name] * len(found)), out[1].extend(graph.ids[found].tolist()), out[2].extend(gaps.tolist())
        return pa.table(dict(zip(schema.names, out)), schema=schema)

    met = spread.groupBy("dim", "shard", "block").cogroup(asked.groupBy("dim", "shard", "block")).applyInArrow(find, "query_id bigint, class_id bigint, score double")
    nearest = W.partitionBy("query_id").orderBy("score", "class_id")
    few = met.withColumn("place", F.row_number().over(nearest)).filter(F.col("place") <= k + 1)  # k + 1 classes hold the k nearest rows
    rows = few.join(members.select("class_id", F.explode("ids").alias("vec_id")), "class_id").filter("vec_id <> query_id")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Index all usable vectors and search them for all usable queries."""
    members = store(classes(vectors.filter(usable()), k), "vector-classes")
    return search(build_index(members, shard_rows), members, queries.filter(usable()), k)

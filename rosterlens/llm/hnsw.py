"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, shard results merged.

Equal vectors form one class, so a vector that occurs very often is one node and cannot cut the graph into islands; a
class keeps its smallest ids, as many as an answer can need. Classes are dealt to shards by a hash, of a fixed size at first, later of one that grows with the square root of the table. The
graph of a shard is one row of flat arrays (ids, vectors, levels and the neighbour lists of all levels in a fixed
width), written to the shared folder. Every block of queries meets every shard; the shards' best are merged per query.
All vectors are indexed; distances are Euclidean in double precision on the original vectors.

Edge cases. Vectors that are null, empty, all zero or hold null or non-finite components take no part, nor do rows with a
null id. Ties go to the smaller id. Rows that repeat an id and vector count once. Vectors are compared with those of the
same dimension only. Fewer candidates than asked for give all of them. An empty table gives an empty result. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.llm.wordhash import mix
from rosterlens.session import written_table

SHARD_SIZE = 4096  # up to GROW_FROM vectors; beyond, shards grow with the square root of the table
GROW_FROM = 1 << 18
QUERY_BLOCK = 2048
M = 12  # neighbours per node on the upper levels; twice as many on the lowest
EF_BUILD = 80
EF_SEARCH = 120


def _levels(ids: np.ndarray) -> np.ndarray:
    """Levels drawn from a hash of the ids, so that a rebuilt shard has the same graph."""
    draw = (mix(ids.view(np.uint64) + np.uint64(1)) >> np.uint64(11)).astype(np.float64) / 2**53
    return np.minimum((-np.log(np.maximum(draw, 1e-18)) / np.log(M)).astype(np.int64), 8)


class Graph:
    """Vectors of one shard with neighbour lists per level; unused places hold -1."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: list[np.ndarray] | None = None):
        self.vectors, self.levels = vectors, levels
        self.squares = np.einsum("ij,ij->i", vectors, vectors)
        self.entry = int(np.argmax(levels)) if len(levels) else -1
        top = int(levels.max()) if len(levels) else 0
        self.links = links or [np.full((len(vectors), 2 * M if k == 0 else M), -1, np.int32) for k in range(top + 1)]

    def distances(self, query: np.ndarray, square: float, nodes: np.ndarray) -> np.ndarray:
        """Squared distances, for steering only."""
        return self.squares[nodes] - 2 * (self.vectors[nodes] @ query) + square

    def search_level(self, query: np.ndarray, square: float, entries: list[tuple[float, int]], ef: int, level: int) -> list[tuple[float, int]]:
        """The ef nearest nodes found on one level, nearest first."""
        links = self.links[level]
        seen = {n for _, n in entries}
        ahead = list(entries)
        heapq.heapify(ahead)
        best = [(-d, n) for d, n in entries]
        heapq.heapify(best)
        while ahead:
            d, node = heapq.heappop(ahead)
            if d > -best[0][0] and len(best) >= ef:
                break
            fresh = [n for n in links[node].tolist() if n >= 0 and n not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            worst = -best[0][0]
            for x, n in zip(self.distances(query, square, np.array(fresh)).tolist(), fresh):
                if len(best) < ef:
                    heapq.heappush(best, (-x, n))
                elif x < worst:
                    heapq.heapreplace(best, (-x, n))
                else:
                    continue
                worst = -best[0][0]
                heapq.heappush(ahead, (x, n))
        return sorted((-d, n) for d, n in best)

    def descend(self, query: np.ndarray, square: float, entry: int, top: int, to: int) -> tuple[float, int]:
        """Greedy steps from the entry's level down to above level ``to``."""
        near = (float(self.distances(query, square, np.array([entry]))[0]), entry)
        for level in range(top, to, -1):
            near = self.search_level(query, square, [near], 1, level)[0]
        return near

    def select(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours in different directions: one nearer to a chosen neighbour than to the node comes last."""
        chosen: list[int] = []
        rest: list[int] = []
        for d, n in found:
            if len(chosen) == most:
                break
            if chosen and self.distances(self.vectors[n], self.squares[n], np.array(chosen)).min() < d:
                rest.append(n)
            else:
                chosen.append(n)
        return chosen + rest[: most - len(chosen)]

    def build(self) -> Graph:
        entry, top = -1, -1
        for node in range(len(self.vectors)):
            level = int(self.levels[node])
            if entry >= 0:
                query, square = self.vectors[node], self.squares[node]
                near = [self.descend(query, square, entry, top, level)]
                for k in range(min(level, top), -1, -1):
                    near = self.search_level(query, square, near, EF_BUILD, k)
                    links = self.links[k]
                    width = links.shape[1]
                    chosen = self.select(near, M)
                    links[node, : len(chosen)] = chosen
                    for other in chosen:
                        free = np.flatnonzero(links[other] < 0)
                        if len(free):
                            links[other, free[0]] = node
                            continue
                        own = np.append(links[other], node)
                        order = self.distances(self.vectors[other], self.squares[other], own)
                        kept = self.select(sorted(zip(order.tolist(), own.tolist())), width)
                        links[other] = -1
                        links[other, : len(kept)] = kept
            if level > top:
                entry, top = node, level
        return self

    def nearest(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and exact Euclidean distances of the k nearest found."""
        square = float(query @ query)
        top = len(self.links) - 1
        near = self.descend(query, square, self.entry, top, 0)
        nodes = np.array([n for _, n in self.search_level(query, square, [near], max(EF_SEARCH, k), 0)])
        away = self.vectors[nodes] - query
        return nodes, np.sqrt((away * away).sum(axis=1))


def _built(batch: pd.DataFrame) -> pd.DataFrame:
    batch = batch.sort_values("rep")
    ids = batch["rep"].to_numpy(np.int64)
    graph = Graph(np.stack(batch["vector"].to_numpy()).astype(np.float64), _levels(ids)).build()
    return pd.DataFrame({
        "dim": [graph.vectors.shape[1]], "shard": [batch["shard"].iloc[0]], "ids": [ids], "levels": [graph.levels],
        "vectors": [graph.vectors.ravel()], "links": [np.concatenate([x.ravel() for x in graph.links])],
    })


_INDEX = "dim int, shard long, ids array<long>, levels array<long>, vectors array<double>, links array<int>"


def _graph_of(row: dict) -> tuple[np.ndarray, Graph]:
    ids, levels = np.asarray(row["ids"]), np.asarray(row["levels"])
    flat, links, at = np.asarray(row["links"], np.int32), [], 0
    for level in range(int(levels.max()) + 1):
        width = 2 * M if level == 0 else M
        links.append(flat[at : at + len(ids) * width].reshape(len(ids), width))
        at += len(ids) * width
    return ids, Graph(np.asarray(row["vectors"]).reshape(len(ids), -1), levels, links)


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].values.to_numpy(zero_copy_only=False) for name in ("ids", "levels", "vectors", "links", "query_ids", "query_vectors")}
                ids, graph = _graph_of(row)
                queries = row["query_vectors"].reshape(len(row["query_ids"]), -1)
                out = []
                for number, query in zip(row["query_ids"], queries):
                    nodes, distance = graph.nearest(query, k)
                    order = np.lexsort((ids[nodes], distance))[:k]
                    out.append((np.full(len(order), number), ids[nodes[order]], distance[order]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["query_id", "rep", "score"])

    return run


def usable_vectors(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
        .where("vec_id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0").where(finite).where(F.exists("vector", lambda x: x != 0))
    )


def nearest_neighbours(embeddings: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 10, shard_size: int = SHARD_SIZE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that meets ``is_query`` (a condition on vec_id)."""
    rows = usable_vectors(embeddings, vec_id, embedding)
    # k + 1 smallest ids of each distinct vector answer every query, its own id aside. Repeated rows are combined first, so
    # that they take no place of another id; both steps cut rows before their shuffle.
    by_vector = Window.partitionBy("vector").orderBy("vec_id")
    ranked = rows.distinct().withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
    members = written_table(ranked.withColumn("rep", F.min("vec_id").over(Window.partitionBy("vector"))), "members")
    nodes = members.where("n = 1").select("rep", "vector", F.size("vector").alias("dim"))
    grown = F.greatest(F.lit(1.0), F.sqrt(F.count("*") / F.lit(GROW_FROM))) * shard_size
    shards = written_table(nodes.groupBy("dim").agg(F.ceil(F.count("*") / grown).alias("shards")), "shards")  # one row per dimension
    total = shards.agg(F.sum("shards")).first()[0] or 1
    dealt = nodes.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("rep"), "shards"))
    # Building is work, not bytes: a fixed number of partitions keeps the graphs apart.
    dealt = dealt.select("dim", "shard", "rep", "vector").repartition(4 * total, "dim", "shard")
    index = written_table(dealt.groupBy("dim", "shard").applyInPandas(_built, _INDEX), "hnsw")

    asked = rows.where(is_query).select("vec_id", "vector", F.size("vector").alias("dim")).distinct()
    blocks = asked.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(QUERY_BLOCK)).alias("blocks"))
    # Each block of about QUERY_BLOCK queries is one row; it meets each shard once.
    packed = asked.join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks")).groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "vector")).alias("q"))
    packed = packed.select("dim", "block", F.col("q.vec_id").alias("query_ids"), F.flatten("q.vector").alias("query_vectors"))
    meetings = index.join(blocks, "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    meets = total * (blocks.agg(F.max("blocks")).first()[0] or 1)
    met = meetings.join(packed, ["dim", "block"]).repartition(4 * meets, "dim", "shard", "block").drop("dim", "shard", "block", "blocks")
    found = met.mapInArrow(_searched(k + 1), "query_id long, rep long, score double")
    # At most (k + 1) rows per shard and query, then (k + 1) classes of at most (k + 1) members.
    best = Window.partitionBy("query_id").orderBy("score", "rep")
    classes = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    ids = members.select("rep", "vec_id")
    answer = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        classes.join(ids, "rep").where("vec_id <> query_id").withColumn("rank", F.row_number().over(answer)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )

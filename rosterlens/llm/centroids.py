"""Centroid clustering: Lloyd's rounds on integer vectors, with heaps of bounds that tell which vectors to look at again.

Vectors are turned into integers and packed into blocks, one row each, without a shuffle. For every vector a block knows
the gap between a lower bound of its distance to all other centroids and an upper bound of that to its own. Each cluster
of a block keeps its gaps in a heap. A round does not touch them: moving centroids add to one offset per cluster (the own
drift and the largest drift of another), and a vector stays where it is as long as its gap, raised by the offset at the time
of entry, is above the offset now. Only what has expired is popped, compared with all centroids in exact integers and
pushed into the heap of its cluster. Blocks keep the sums of their clusters up to date, so a round sends k sums of each block.
The heaps travel as flat arrays in the blocks' rows, and each round is a table in the shared folder.

Edge cases. Vectors that are null, of another length or hold null or non-finite components take no part, nor do rows with a
null id, nor vectors with a component so large that a squared distance would not fit a long (beyond 2**27 after scaling at 64
components). Repeated rows are vectors of their own. Ties go to the smaller cluster. With fewer vectors than clusters each is a
centroid. Equal start vectors give an empty cluster, which stays where it is. A sum of distances that no long can hold is null.
An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.session import written_table


@dataclass(frozen=True)
class Settings:
    clusters: int = 16
    rounds: int = 3
    dim: int = 64
    scale: int = 64
    seed: str = "1"  # prefix of the hashed ids that pick the start vectors
    block: int = 16_384  # vectors in a block

    @property
    def largest(self) -> int:
        """The largest component whose squared distances all fit a long."""
        return math.isqrt(2**62 // self.dim) // 2


def integer_vectors(df: DataFrame, vec_id: str, embedding: str, s: Settings) -> DataFrame:
    """vec_id and the components floor(scale * x) of the vectors that take part."""
    usable = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(float(s.largest // s.scale))))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("x") == s.dim)).where(usable)
    return rows.select("vec_id", F.transform("x", lambda x: F.floor(x * F.lit(s.scale)).cast("int")).alias("q"))


def start_order(vec_id: Column, seed: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), vec_id.cast("string")), 256)


def scan(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each vector by exact squared distances (ties: the smaller number) and the gap to the next one."""
    squared = (vectors * vectors).sum(axis=1)[:, None] - 2 * (vectors @ centroids.T) + (centroids * centroids).sum(axis=1)
    near = squared.argmin(axis=1)
    if len(centroids) == 1:
        return near, np.full(len(vectors), np.inf)
    at = np.arange(len(vectors)), near
    first = np.sqrt(squared[at].astype(np.float64))
    squared[at] = np.iinfo(np.int64).max
    return near, np.sqrt(squared.min(axis=1).astype(np.float64)) - first


class Block:
    """Vectors of one block, their clusters, a heap of (gap + offset at entry, vector) per cluster and the clusters' sums."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors

    @classmethod
    def started(cls, ids: np.ndarray, vectors: np.ndarray, centroids: np.ndarray) -> Block:
        block = cls(ids, vectors)
        block.cluster, gaps = scan(vectors, centroids)
        block.heaps, block.rescanned = [], len(ids)
        k = len(centroids)
        block.sums, block.counts = np.zeros((k, vectors.shape[1]), np.int64), np.bincount(block.cluster, minlength=k)
        for c in range(k):
            own = np.flatnonzero(block.cluster == c)
            block.sums[c] = vectors[own].sum(axis=0)
            heap = list(zip(gaps[own].tolist(), own.tolist()))
            heapq.heapify(heap)
            block.heaps.append(heap)
        return block

    def moved(self, centroids: np.ndarray, offsets: np.ndarray) -> Block:
        """Pop what has expired under the new offsets and scan it against the new centroids."""
        expired = []
        for heap, offset in zip(self.heaps, offsets.tolist()):
            reach = offset + 1e-9 * (1 + offset)  # rounding of the bounds may only cause a scan, never save one
            while heap and heap[0][0] <= reach:
                expired.append(heapq.heappop(heap)[1])
        self.rescanned = len(expired)
        if expired:
            rows = np.array(expired)
            near, gaps = scan(self.vectors[rows], centroids)
            old = self.cluster[rows]
            away = old != near
            for sign, c in ((-1, old[away]), (1, near[away])):
                np.add.at(self.sums, c, sign * self.vectors[rows[away]])
                np.add.at(self.counts, c, sign)
            self.cluster[rows] = near
            for row, c, key in zip(expired, near.tolist(), (gaps + offsets[near]).tolist()):
                heapq.heappush(self.heaps[c], (key, row))
        return self

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        return ((self.vectors - centroids[self.cluster]) ** 2).sum(axis=1)

    FIELDS = "ids array<long>, vectors array<int>, cluster array<int>, keys array<double>, nodes array<int>, ends array<int>, sums array<long>, counts array<long>, rescanned long"

    def row(self) -> pa.RecordBatch:
        entries = [x for heap in self.heaps for x in heap]
        parts = (
            (self.ids, pa.int64()), (self.vectors.ravel(), pa.int32()), (self.cluster, pa.int32()), ([x for x, _ in entries], pa.float64()), ([x for _, x in entries], pa.int32()),
            (np.cumsum([len(h) for h in self.heaps]), pa.int32()), (self.sums.ravel(), pa.int64()), (self.counts, pa.int64()),
        )
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind)) for x, kind in parts]
        return pa.RecordBatch.from_arrays([*lists, pa.array([self.rescanned], pa.int64())], names=[f.split()[0] for f in self.FIELDS.split(", ")])

    @classmethod
    def of(cls, batch: pa.RecordBatch, i: int) -> Block:
        flat = {name: batch.column(name)[i].values.to_numpy(zero_copy_only=False) for name in batch.schema.names if name != "rescanned"}
        n, k = len(flat["ids"]), len(flat["counts"])
        block = cls(flat["ids"], flat["vectors"].reshape(n, -1).astype(np.int64))
        block.cluster, block.sums, block.counts = flat["cluster"].astype(np.int64), flat["sums"].reshape(k, -1).copy(), flat["counts"].copy()
        entries, ends = list(zip(flat["keys"].tolist(), flat["nodes"].tolist())), flat["ends"].tolist()
        block.heaps = [entries[a:b] for a, b in zip([0, *ends], ends)]  # a heap's list is its array, so no order is lost
        return block


def _started(centroids: np.ndarray, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids.append(part.column(0).to_numpy())
                vectors.append(part.column(1).flatten().to_numpy().reshape(part.num_rows, -1).astype(np.int64))
                held += part.num_rows
                if held >= size:
                    yield Block.started(np.concatenate(ids), np.concatenate(vectors), centroids).row()
                    ids, vectors, held = [], [], 0
        if held:
            yield Block.started(np.concatenate(ids), np.concatenate(vectors), centroids).row()

    return run


def _moved(centroids: np.ndarray, offsets: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield Block.of(batch, i).moved(centroids, offsets).row()

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block.of(batch, i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.ids), pa.array(block.cluster, pa.int32()), pa.array(block.distances(centroids))], names=["vec_id", "cluster", "distance"]
                )

    return run


def _next_centroids(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) per component; only k * (dim + 1) totals reach the driver."""
    totals = blocks.select(F.posexplode(F.concat("counts", "sums")).alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
    flat, k = {r["at"]: r["n"] for r in totals}, len(centroids)
    counts = np.array([flat[c] for c in range(k)])
    sums = np.array([flat[k + i] for i in range(centroids.size)]).reshape(centroids.shape)
    return np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster_vectors(
    embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", settings: Settings = Settings(), history: list | None = None
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 per vector after the rounds of ``settings``.

    ``history`` collects the vectors scanned in each assignment, for reports.
    """
    s = settings
    rows = integer_vectors(embeddings, vec_id, embedding, s)
    start = rows.select("q", start_order(F.col("vec_id"), s.seed).alias("h")).orderBy("h", "q").limit(s.clusters).collect()
    if not start:
        empty = rows.where("false")
        return empty.select("vec_id", *(F.lit(None).cast(kind).alias(name) for name, kind in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    centroids = np.array([r["q"] for r in start], np.int64)
    blocks = written_table(rows.mapInArrow(_started(centroids, s.block), Block.FIELDS), "clusters")
    offsets = np.zeros(len(centroids))
    for _ in range(s.rounds):
        if history is not None:
            history.append(blocks.agg(F.sum("rescanned")).first()[0])
        new = _next_centroids(blocks, centroids)
        drift = np.sqrt(((new - centroids) ** 2).sum(axis=1).astype(np.float64))
        others = [np.delete(drift, c).max(initial=0.0) for c in range(len(drift))]
        offsets, centroids = offsets + drift + others, new
        blocks = written_table(blocks.mapInArrow(_moved(centroids, offsets), Block.FIELDS), "clusters")
    if history is not None:
        history.append(blocks.agg(F.sum("rescanned")).first()[0])
    assigned = blocks.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long")
    # One total per cluster.
    inertia = {r["cluster"]: r["n"] for r in assigned.groupBy("cluster").agg(F.try_sum("distance").alias("n")).collect()}
    whole = sum(inertia.values()) if all(n is not None for n in inertia.values()) else 2**63
    of_cluster = lambda values, kind: F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster") + 1)
    return assigned.select(
        "vec_id", "cluster", "distance", of_cluster([inertia.get(c) for c in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(whole if whole < 2**63 else None).cast("long").alias("inertia"), of_cluster([digest(c) for c in centroids], "string").alias("centroid_sha256"),
    )


def clusters_sql(s: Settings = Settings()) -> str:
    """The same rows over table embeddings, every vector against every centroid in every round."""
    distance = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS HUGEINT)))"
    steps = []
    for r in range(s.rounds + 1):
        steps.append(f"""
        a{r} AS MATERIALIZED (SELECT v.rn, min(struct_pack(d := {distance}, c := c.c)) AS best FROM kept v CROSS JOIN c{r} c GROUP BY v.rn)""")
        if r < s.rounds:
            steps.append(f"""
        m{r} AS MATERIALIZED (SELECT cluster AS c, list(CAST(CASE WHEN total >= 0 THEN total // n ELSE -((n - 1 - total) // n) END AS BIGINT) ORDER BY i) AS q
               FROM (SELECT best.c AS cluster, i, sum(q[i]) AS total, count(*) AS n
                     FROM a{r} JOIN kept USING (rn) CROSS JOIN range(1, {s.dim + 1}) p(i) GROUP BY best.c, i) GROUP BY cluster),
        c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.q, o.q) AS q FROM c{r} o LEFT JOIN m{r} m ON o.c = m.c)""")
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: CAST(floor({s.scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = {s.dim}
              AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) <= {s.largest // s.scale}))),
        c0 AS MATERIALIZED (
            SELECT CAST(row_number() OVER (ORDER BY sha256('{s.seed}:' || CAST(vec_id AS VARCHAR)), q) - 1 AS INT) AS c, q FROM kept
            QUALIFY c < {s.clusters}),{",".join(steps)}
        SELECT k.vec_id, a.best.c AS cluster, CAST(a.best.d AS BIGINT) AS distance,
               CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c.q, ',')) AS centroid_sha256
        FROM a{s.rounds} a JOIN kept k USING (rn) JOIN c{s.rounds} c ON a.best.c = c.c"""
